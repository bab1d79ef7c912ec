"""Toxicity as ordered severity: cumulative-link (proportional-odds) regression.

P(grade <= k | x) = sigmoid(theta_k - w.x) with theta ascending: one weight vector is shared by all
thresholds.  x is sparse and binary: which hashed words, and which beginnings of words, the text has
(words lower-cased in A-Z, cut at ASCII white space, stripped of ASCII punctuation).  Of the features
in MIN_TEXTS texts of the fit or more, those most associated with the grade are kept.  The output is
the expected grade, the sum over k of P(grade > k).

The fit takes at most ``max_fit_rows`` labelled texts, those with the smallest hash of their
identifier (the bound is the only thing that does not grow with the data); every text is scored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, text_of

BINS = 1 << 20
STARTS = (4, 5, 6)  # bytes of a word's beginning
MIN_TEXTS = 5
MAX_FEATURES = 4096  # with a weight
STRIP = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
CACHE_WORDS = 400_000


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32 [BINS]
    thresholds: np.ndarray  # ascending

    def at_least(self, score: float) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -60, 60)))


def word_bins(word: bytes) -> tuple[int, ...]:
    """The features of a word; a word of punctuation alone keeps it."""
    word = word.strip(STRIP) or word
    return (zlib.crc32(word) % BINS, *(zlib.crc32(word[:n], n) % BINS for n in STARTS if len(word) >= n))


def _features(batches):
    """Distinct features of each text."""
    for batch in batches:
        bins = [sorted({b for w in set(text.as_py().split()) for b in word_bins(w)}) for text in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bins, pa.list_(pa.int32()))], ["grade", "bins"])


def fit_arrays(
    rows: np.ndarray, bins: np.ndarray, grades: np.ndarray, steps: int = 200, penalty: float = 1e-4, min_texts: int = MIN_TEXTS, max_features: int = MAX_FEATURES
) -> Model:
    """Adam on the mean negative log-likelihood plus an L2 penalty; the same input, the same model.

    rows, bins: the entries that are 1.  grades: integers from 0.  With no row, or one
    grade only, every text gets that grade (0 with no row).
    """
    top = int(grades.max(initial=0))
    if not len(grades) or len(np.unique(grades)) < 2:
        return Model(np.zeros(BINS, np.float32), np.full(top, -30.0) if top else np.array([30.0]))
    texts = np.bincount(bins, minlength=BINS)
    excess = np.bincount(bins, (grades - grades.mean())[rows], BINS)
    z = np.where(texts >= min_texts, np.abs(excess) / np.sqrt(np.maximum(texts, 1)), 0)
    chosen = np.zeros(BINS, bool)
    chosen[np.argsort(-z, kind="stable")[:max_features]] = True
    often = (chosen & (z > 0))[bins]
    rows, bins = rows[often], bins[often]
    used, column = np.unique(bins, return_inverse=True)
    share = np.array([np.mean(grades <= k) for k in range(top)]).clip(1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    params = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v, n = np.zeros_like(params), np.zeros_like(params), len(grades)
    each = np.arange(n)
    for step in range(1, steps + 1):
        w, raw = params[: len(used)], params[len(used) :]
        theta = raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])
        score = np.bincount(rows, w[column], n)
        below = 1 / (1 + np.exp(-np.clip(theta[None, :] - score[:, None], -60, 60)))
        cdf = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], 1)
        slope = np.concatenate([np.zeros((n, 1)), below * (1 - below), np.zeros((n, 1))], 1)
        p = np.maximum(cdf[each, grades + 1] - cdf[each, grades], 1e-12)
        high, low = slope[each, grades + 1] / p, slope[each, grades] / p
        d_score = (high - low) / n
        d_theta = np.zeros(top + 1)
        np.add.at(d_theta, np.minimum(grades, top), np.where(grades < top, -high / n, 0))
        np.add.at(d_theta, np.maximum(grades - 1, 0), np.where(grades > 0, low / n, 0))
        d_theta = d_theta[:top]
        d_raw = np.concatenate([[d_theta.sum()], np.cumsum(d_theta[::-1])[::-1][1:] * np.exp(raw[1:])])
        grad = np.concatenate([np.bincount(column, d_score[rows], len(used)) + penalty * w, d_raw])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(BINS, np.float32)
    weights[used] = params[: len(used)]
    raw = params[len(used) :]
    return Model(weights, raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))]))


def fit(docs: DataFrame, labels: DataFrame, grade_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_fit_rows: int = 8000, min_texts: int = MIN_TEXTS, max_features: int = MAX_FEATURES) -> Model:
    """Fit on labelled texts, max_fit_rows at most.

    Labels that are null or negative, or whose text is missing, don't count.  A label whose identifier
    several documents have is fitted on the least of their texts, so no more rows than labels are read.
    Of the features, those in min_texts texts or more and of them max_features are kept.
    """
    known = labels.filter(F.col(grade_col) >= 0).select(F.col(id_col).alias("_id"), F.col(grade_col).cast("int").alias("grade"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "grade").limit(max_fit_rows)
    rows = docs.select(docs[id_col].alias("_id"), lower_ascii(text_of(docs, text_col)).alias("text")).join(F.broadcast(chosen), "_id")
    rows = rows.groupBy("_id", "grade").agg(F.min("text").alias("text")).select("grade", "text")
    got = rows.mapInArrow(_features, "grade int, bins array<int>").toArrow().combine_chunks()
    sizes = np.array([len(x) for x in got["bins"]], np.int64)
    bins = np.asarray(got["bins"].combine_chunks().flatten() if len(got) else [], np.int64)
    return fit_arrays(np.repeat(np.arange(len(got)), sizes), bins, np.asarray(got["grade"], np.int64), min_texts=min_texts, max_features=max_features)


class _Weighted(dict):
    """Word -> those of its features that have a weight."""

    def __init__(self, weights):
        super().__init__()
        self.weights = weights

    def __missing__(self, word):
        found = tuple(b for b in word_bins(word) if self.weights[b])
        if len(self) < CACHE_WORDS and len(word) < 64:
            self[word] = found
        return found


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append (expected_severity double, p_toxic double: P(grade > 0), grade int: the likeliest).

    keep: columns of the input to return, doc_id unless given; one of them that has an output's name
    is replaced by it.  A text without words (null, empty, white space) has no features and is
    scored by the thresholds alone.  Repeated rows are scored each; an empty table gives no rows.
    """
    outputs = ["expected_severity", "p_toxic", "grade"]
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in outputs]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fitted = shared.value
        cache, weight = _Weighted(fitted.weights), fitted.weights.item
        for batch in batches:
            scores = []
            for text in batch.column(len(keep)).cast(pa.binary()):
                bins = set().union(*map(cache.__getitem__, set(text.as_py().split())))
                scores.append(sum(map(weight, sorted(bins))))
            above = 1 / (1 + np.exp(np.clip(fitted.thresholds[None, :] - np.array(scores)[:, None], -60, 60)))
            of_grade = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(of_grade.argmax(1), pa.int32())], [*keep, *outputs]
            )

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    text = lower_ascii(text_of(docs, text_col)).alias("_text")
    return docs.select(*(docs[c] for c in keep), text).mapInArrow(run, f"{kept}expected_severity double, p_toxic double, grade int")
