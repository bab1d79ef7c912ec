"""Context-tree weighting over bytes, learned from and applied to a whole distributed corpus.

Model.  A byte is eight binary decisions; each of the 255 partial bytes has a binary source whose
context is the ``depth`` bytes before it.  Every context node keeps the Krichevsky-Trofimov estimate
of its own counts, and its weighted probability is half that estimate, half the product over the
contexts one byte longer; so a prediction mixes the estimates of all depths.  A text is scored with
the counts of the training texts as they stand, to the byte 0xFF, which UTF-8 never has and which
ends each text (and pads the context before its start).

Scale.  Texts are packed into compressed blocks.  A block names its distinct grams (context and
byte) and words; their counts are summed over all blocks in buckets of keys, the tree is computed in
groups by the two most recent context bytes (of distinct grams, whose number doesn't grow with
repetition), and each block gets back the values of its own grams and words only, in the order in which it
finds them again in its texts.  What moves is linear in the corpus (see cells in blocks.py).  Nothing that
grows with the corpus is broadcast or collected: the two upper levels of the tree are 65,535 nodes.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import buckets_for, cuts, fixed_cells, joined, mixed, number_cells, packed, read_fixed, read_numbers, read_sorted, sorted_cells, trim, unpacked
from .blocks import _cells as cells
from .common import discard, lower_ascii, release, small_batches, stage, text_of

END = 0xFF
DEPTH = 6
BLOCK_BYTES = 16 << 20
SCALE, WIDTH = float(1 << 32), 5  # a gram's value travels as a multiple of 2**-32, in so many bytes
CHUNK = 1 << 20  # bytes whose grams are held at once

_TABLE = np.concatenate([[math.lgamma(0.5)], math.lgamma(0.5) + np.cumsum(np.log(np.arange(1 << 16) + 0.5))])


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2) for whole numbers."""
    x = np.maximum(n, 1) + 0.5
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < len(_TABLE), _TABLE[np.minimum(n, len(_TABLE) - 1)], series)


def log_factorial(n: np.ndarray) -> np.ndarray:
    x = np.maximum(n, 0) + 1.0
    table = _FACTORIALS[np.minimum(n, len(_FACTORIALS) - 1)]
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < len(_FACTORIALS), table, series)


_FACTORIALS = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1 << 16)))])


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the KT block probability of n0 zeros and n1 ones."""
    return log_gamma_half(n0) + log_gamma_half(n1) - math.log(math.pi) - log_factorial(n0 + n1)


def log_half_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b) - math.log(2)


# ------------------------------------------------------------------------------------------ grams


def grams_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all decisions of the texts, and where each text's begin.

    A key is the context, most recent byte first, then the byte; a text has one more than bytes.
    """
    pad = bytes([END] * depth)
    data = np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8).astype(np.uint64)
    n = len(data) - depth
    key = data[depth:].copy()
    for d in range(1, depth + 1):
        key |= data[depth - d : depth - d + n] << np.uint64(8 * (depth + 1 - d))
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths + depth) - (lengths + depth)
    own = np.ones(n, bool)
    for d in range(1, depth):  # of the padding after a text only the first byte is its end
        own[begins + lengths + d] = False
    return key[own], np.cumsum(lengths + 1) - (lengths + 1)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with summed counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = cuts(keys)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct keys, sorted."""
    keys = np.sort(keys)
    return keys[cuts(keys)]


def by_bucket(place: np.ndarray, buckets: int) -> np.ndarray:
    """A stable order by bucket; short numbers are sorted by their digits."""
    return np.argsort(place.astype(np.uint16) if buckets <= 1 << 16 else place, kind="stable")


# ------------------------------------------------------------------------------------------- tree


def _nodes(keys: np.ndarray, counts: np.ndarray, level: int):
    """(node ids, n0, n1) of the decision on bit ``level`` of the byte; keys: context and byte."""
    node = keys >> np.uint64(8 - level)
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    total = np.add.reduceat(counts, first)
    ones = np.add.reduceat(np.where((keys >> np.uint64(7 - level)) & np.uint64(1), counts, 0), first)
    return node[first], total - ones, ones


class Tree:
    """The weighted tree from depth ``top`` down, of the grams of some contexts of that depth."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
        """keys: sorted, distinct, with positive counts, all of them for each context at ``top``."""
        self.depth, self.top = depth, top
        shrunk = {depth: (keys, counts)}
        for d in range(depth - 1, top - 1, -1):
            k, c = shrunk[d + 1]
            context = k >> np.uint64(16)  # without the oldest context byte and the byte itself
            shrunk[d] = summed(context << np.uint64(8) | (k & np.uint64(255)), c)
        self.levels = [self._level(shrunk, j) for j in range(8)]

    def _level(self, shrunk, j):
        """For each depth: node ids, probability of a one, share of the node's own estimate, log weighted."""
        out: dict = {}
        for d in range(self.depth, self.top - 1, -1):
            node, n0, n1 = _nodes(*shrunk[d], j)
            own = log_kt(n0, n1)
            if d == self.depth:
                weighted, share = own, np.ones(len(node))
            else:
                below, _, _, below_weighted, *_ = out[d + 1]
                bits = np.uint64(j)
                parent = (below >> np.uint64(8) >> bits) << bits | (below & np.uint64((1 << j) - 1))
                children = np.bincount(np.searchsorted(node, parent), below_weighted, len(node))
                weighted = log_half_sum(own, children)
                share = np.exp(own - math.log(2) - weighted)
            out[d] = (node, (n1 + 0.5) / (n0 + n1 + 1), share, weighted, n0, n1)
        return out

    def tops(self):
        """(context and partial byte, bit level, n0, n1, log weighted) of the nodes at ``top``."""
        for j, level in enumerate(self.levels):
            node, _, _, weighted, n0, n1 = level[self.top]
            yield node, j, n0, n1, weighted

    def ones(self, keys: np.ndarray, j: int) -> np.ndarray:
        """P(bit j is one) for each key, mixed over the depths from ``top`` down."""
        p = np.full(len(keys), 0.5)
        byte = keys & np.uint64(255)
        for d in range(self.depth, self.top - 1, -1):
            node, estimate, share, *_ = self.levels[j][d]
            context = keys >> np.uint64(8 * (self.depth - d + 1))
            want = context << np.uint64(j) | byte >> np.uint64(8 - j)
            at = np.minimum(np.searchsorted(node, want), max(0, len(node) - 1))
            if len(node):
                seen = node[at] == want
                p = np.where(seen, share[at] * estimate[at] + (1 - share[at]) * p, 0.5)
        return p


class Upper:
    """Depths 0 and 1, from sums over the nodes at depth 2."""

    def __init__(self, c1: np.ndarray, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        """For each (recent byte, partial byte from 1 to 255): counts, and the children's log product."""
        shape = (257, 256)  # row 256: the root
        zeros, ones, under = (np.zeros(shape) for _ in range(3))
        zeros[c1, node], ones[c1, node], under[c1, node] = n0, n1, below
        own = log_kt(zeros[:256].astype(np.int64), ones[:256].astype(np.int64))
        weighted = log_half_sum(own, under[:256])
        self.share = np.full(shape, 0.5)
        self.share[:256] = np.exp(own - math.log(2) - weighted)
        zeros[256], ones[256] = zeros[:256].sum(0), ones[:256].sum(0)
        root = log_kt(zeros[256].astype(np.int64), ones[256].astype(np.int64))
        self.share[256] = np.exp(root - math.log(2) - log_half_sum(root, weighted.sum(0)))
        self.estimate = (ones + 0.5) / (zeros + ones + 1)
        self.seen = zeros + ones > 0

    def mix(self, c1: np.ndarray, node: np.ndarray, p: np.ndarray) -> np.ndarray:
        for row in (c1, np.full(len(c1), 256)):
            share = self.share[row, node]
            p = np.where(self.seen[row, node], share * self.estimate[row, node] + (1 - share) * p, 0.5)
        return p


def log_probabilities(keys: np.ndarray, tree: Tree, upper: Upper) -> np.ndarray:
    """Log10 probability of each key's byte in its context."""
    byte = (keys & np.uint64(255)).astype(np.int64)
    recent = (keys >> np.uint64(8 * tree.depth)).astype(np.int64)
    out = np.zeros(len(keys))
    for j in range(8):
        p = upper.mix(recent, 1 << j | byte >> 8 - j, tree.ones(keys, j))
        out += np.log10(np.where(byte >> 7 - j & 1, p, 1 - p))
    return out


# ------------------------------------------------------------------------------------- DataFrames


def _pieces(texts, depth: int):
    """(places of texts, keys, begins) for about CHUNK bytes at a time; a longer text comes in parts."""
    places, held, size = [], [], 0
    for k, text in enumerate(texts):
        if len(text) > CHUNK:
            data = np.frombuffer(bytes([END] * depth) + text + bytes([END]), np.uint8)
            for i in range(0, len(text) + 1, CHUNK):
                part = data[i : i + CHUNK + depth].astype(np.uint64)
                n = len(part) - depth
                key = part[depth:].copy()
                for d in range(1, depth + 1):
                    key |= part[depth - d : depth - d + n] << np.uint64(8 * (depth + 1 - d))
                yield [k], key, np.zeros(1, np.int64)
            continue
        places.append(k)
        held.append(text)
        size += len(text)
        if size >= CHUNK:
            yield places, *grams_of(held, depth)
            places, held, size = [], [], 0
    if held:
        yield places, *grams_of(held, depth)


def _texts(table: pa.Table):
    """The texts one by one, so that a block is not held twice."""
    return (x.as_buffer().to_pybytes() for x in table["text"].combine_chunks().cast(pa.binary()))


class Lookup:
    """Places of keys in a table without repeats, by open addressing; every key asked for is in it."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = self._slots(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            missed = self.table[slot] != left
            left, slot = left[missed], (slot[missed] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        out = self.table[slot]
        left = np.flatnonzero(self.keys[out] != keys)
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            out[left] = self.table[slot]
            missed = self.keys[out[left]] != keys[left]
            left, slot = left[missed], slot[missed]
        return out


class Own:
    """A block's distinct grams and words, in the order in which they travel: by bucket, then grams by
    themselves and words by their first place.  Counts (in training texts) only if asked for."""

    def __init__(self, table: pa.Table, depth: int, buckets: int, counting: bool):
        self.held_out = table["held_out"].to_numpy()
        keys, counts = self._counted(table, depth) if counting else (self._named(table, depth), None)
        place = (mixed(keys) % np.uint64(buckets)).astype(np.int64)
        order = by_bucket(place, buckets)
        self.keys, self.bucket = keys[order], place[order]
        if counting:
            self.counts = counts[order]

        split = pc.ascii_split_whitespace(table["text"].combine_chunks())
        words, of = split.flatten(), pc.list_parent_indices(split).to_numpy()
        real = pc.greater(pc.binary_length(words), 0)
        coded = words.filter(real).cast(pa.large_binary()).dictionary_encode()
        self.text = of[real.to_numpy(zero_copy_only=False)]  # of each occurrence
        words = coded.dictionary
        place = np.fromiter(map(zlib.crc32, words.to_numpy(zero_copy_only=False)), np.int64, len(words)) % buckets
        order = by_bucket(place, buckets)
        self.words, self.word_bucket = words.take(pa.array(order)), place[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.word = back[coded.indices.to_numpy()]  # of each occurrence
        if counting:
            self.word_counts = np.bincount(self.word[~self.held_out[self.text]], minlength=len(order))

    def _counted(self, table: pa.Table, depth: int) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for places, found, begins in _pieces(_texts(table), depth):
            learnt = np.repeat(~self.held_out[places], np.diff([*begins, len(found)]))
            for part, weight in ((found[learnt], 1), (found[~learnt], 0)):
                own = np.sort(part)
                at = cuts(own)
                keys.append(own[at])
                counts.append(np.diff(np.append(at, len(own))) * weight)
            if len(keys) > 16:
                keys, counts = ([x] for x in summed(np.concatenate(keys), np.concatenate(counts)))
        return summed(np.concatenate(keys), np.concatenate(counts))

    def _named(self, table: pa.Table, depth: int) -> np.ndarray:
        keys = [np.zeros(0, np.uint64)]
        for _, found, _ in _pieces(_texts(table), depth):
            keys.append(distinct(found))
            if len(keys) > 8:
                keys = [distinct(np.concatenate(keys))]
        return distinct(np.concatenate(keys))


def _bucketed(buckets: int, depth: int):
    """A block -> cells of its grams (kind 0) and words (kind 1) with their counts in training texts; its totals (kind 2)."""

    def run(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = Own(unpacked(blob.as_py()), depth, buckets, True)
                at, at_word = cuts(own.bucket), cuts(own.word_bucket)
                lined = pc.binary_join_element_wise(own.words, pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
                data, lengths = joined(lined)
                ends = np.append(np.cumsum(lengths), 0)[np.append(at_word[1:], len(lengths)) - 1] if len(at_word) else at_word
                yield _rows(block, 0, own.bucket[at], sorted_cells(own.keys, at), number_cells(own.counts, at))
                yield _rows(block, 1, own.word_bucket[at_word], cells(data, ends), number_cells(own.word_counts, at_word))
                totals = np.array([own.word_counts.sum(), (~own.held_out).sum()])
                yield _rows(block, 2, np.zeros(1, np.int64), pa.array([b""], pa.binary()), number_cells(totals, np.zeros(1, np.int64)))
                del own, lined, data
                trim()

    return run


def _rows(block: int, kind: int, bucket: np.ndarray, a: pa.Array, b: pa.Array) -> pa.RecordBatch:
    n = len(bucket)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(bucket.astype(np.int64)), pa.array(np.full(n, kind, np.int32)), a, b], ["block", "bucket", "kind", "a", "b"])


def _sum_keys(table: pa.Table) -> pa.Table:
    keys, _ = read_sorted(table["a"])
    found, n = summed(keys, read_numbers(table["b"])[0].astype(np.int64))
    trim()
    return pa.table({"gram": found.view(np.int64), "n": n})


def _sum_words(table: pa.Table) -> pa.Table:
    """Corpus counts of each block's words in this bucket, and the number of words seen in training."""
    data, lengths = joined(table["a"])
    counts, each = read_numbers(table["b"])
    coded = pa.array(data.tobytes().split(b"\n")[:-1], pa.large_binary()).dictionary_encode()
    word = coded.indices.to_numpy()
    total = np.bincount(word, counts.astype(np.float64)).astype(np.int64)
    starts = np.cumsum(each) - each
    seen = np.append(int((total > 0).sum()), np.zeros(len(table) - 1, np.int64))
    return pa.table({"block": table["block"], "bucket": table["bucket"], "kind": table["kind"], "seen": seen, "answer": number_cells(total[word], starts)})


def _sorted_counts(table: pa.Table, depth: int):
    keys = table["gram"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, n = keys[order], table["n"].to_numpy()[order]
    learnt = n > 0
    return keys, Tree(keys[learnt], n[learnt], depth, 2) if learnt.any() else None


def _tops(depth: int):
    def run(table: pa.Table) -> pa.Table:
        _, tree = _sorted_counts(table, depth)
        out = [np.zeros(0)] * 5
        for node, j, n0, n1, weighted in tree.tops() if tree else ():
            recent = (node >> np.uint64(8 + j)).astype(np.int64)
            partial = 1 << j | (node & np.uint64((1 << j) - 1)).astype(np.int64)
            cells, place = np.unique(recent << 8 | partial, return_inverse=True)
            new = [cells >> 8, cells & 255, *(np.bincount(place, x, len(cells)) for x in (n0, n1, weighted))]
            out = [np.concatenate(x) for x in zip(out, new, strict=True)]
        return pa.table({k: pa.array(v.astype(t)) for (k, t), v in zip((("c1", np.int64), ("node", np.int64), ("n0", np.int64), ("n1", np.int64), ("below", np.float64)), out, strict=True)})

    return run


def _scored(depth: int, upper):
    def run(table: pa.Table) -> pa.Table:
        keys, tree = _sorted_counts(table, depth)
        tree = tree or _NoTree(depth)
        return pa.table({"gram": keys.view(np.int64), "logp": log_probabilities(keys, tree, upper.value)})

    return run


class _NoTree:
    """Contexts that no training text has."""

    def __init__(self, depth):
        self.depth = depth

    def ones(self, keys, j):
        return np.full(len(keys), 0.5)


def _answer(left: pa.Table, right: pa.Table) -> pa.Table:
    """Values of each block's grams in this bucket."""
    grams, logp = right["gram"].to_numpy().view(np.uint64), right["logp"].to_numpy()
    order = np.argsort(grams)
    grams, value = grams[order], np.rint(-logp[order] * SCALE).astype(np.uint64)
    keys, each = read_sorted(left["a"])
    values = value[np.searchsorted(grams, keys)] if len(keys) else value[:0]
    found = fixed_cells(values, np.cumsum(each) - each, WIDTH)
    trim()
    return pa.table({"block": left["block"], "bucket": left["bucket"], "kind": left["kind"], "answer": found})


def _score(depth: int, buckets: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for blob in blocks["blob"]:
            table = unpacked(blob.as_py())
            own = Own(table, depth, buckets, False)
            answers = answers.select(["bucket", "kind", "answer"]).sort_by([("kind", "ascending"), ("bucket", "ascending")])
            values = -(read_fixed(answers.filter(pc.equal(answers["kind"], 0))["answer"], WIDTH) / SCALE)
            totals, _ = read_numbers(answers.filter(pc.equal(answers["kind"], 1))["answer"])
            logs, seen, n = np.log10(totals + 1.0), totals > 0, len(table)
            found = [np.bincount(own.text, w, n) for w in (None, seen[own.word], logs[own.word])]
            lookup, held_out = Lookup(own.keys), own.held_out
            del own, totals, logs, seen
            scores, sizes = np.zeros(n), pc.binary_length(table["text"]).to_numpy().astype(np.int64)
            for places, grams, begins in _pieces(_texts(table), depth):
                scores[places] += np.add.reduceat(values[lookup.find(grams)], begins)
            columns = {"size": sizes, "words": found[0].astype(np.int64), "known": found[1].astype(np.int64), "logs": found[2], "score": scores}
            out.append(pa.table({"doc_id": table["doc_id"], "held_out": held_out} | columns))
            del table, values, lookup
            trim()
        return pa.concat_tables(out)

    return run


def held_out_column(id_col):
    return F.coalesce(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the texts whose crc32(identifier as text) mod 7 is not 2, and score all of them.

    Returns, one row per input row: doc_id, held_out, n_tokens (words and one end), n_known,
    train_tokens, base_score (unigram words with add-one smoothing), score (log10 probability of the
    lower-cased text and its end), n_bytes, bits_per_byte (code length per byte, the end counted).
    Null text: the empty text, whose end alone is scored.  Null identifier: crc32 of the empty text.
    With no training text every bit has probability one half.
    """
    if not 2 <= depth <= 7:
        raise ValueError("a gram of depth + 1 bytes must fit into 64 bits, and the tree has two upper levels")
    rows = docs.select(docs[id_col].alias("doc_id"), held_out_column(docs[id_col]).alias("held_out"), lower_ascii(text_of(docs, text_col)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    blocks = packed(rows, "text", BLOCK_BYTES)
    buckets = buckets_for(blocks)
    cell = "block long, bucket long, kind int, a binary, b binary"
    own = stage(blocks.select("block", "blob").mapInArrow(_bucketed(buckets, depth), cell), "grams")
    with small_batches(spark):
        counts = stage(own.filter("kind = 0").groupBy("bucket").applyInArrow(_sum_keys, "gram long, n long"), "counts")
        totals = stage(own.filter("kind = 1").groupBy("bucket").applyInArrow(_sum_words, "block long, bucket long, kind int, seen long, answer binary"), "words")
    release(spark)
    sums = own.filter("kind = 2").mapInArrow(_totals, "tokens long, ends long").agg(F.sum("tokens"), F.sum("ends")).first()
    train_words, ends = (sums[0] or 0) + (sums[1] or 0), sums[1] or 0
    vocabulary = (totals.agg(F.sum("seen")).first()[0] or 0) + (1 if ends else 0)

    by_context = counts.withColumn("part", F.shiftright("gram", 8 * (depth - 1)) % F.lit(buckets * 3 + 1))
    tops = by_context.groupBy("part").applyInArrow(_tops(depth), "c1 long, node long, n0 long, n1 long, below double")
    nodes = tops.groupBy("c1", "node").agg(F.sum("n0"), F.sum("n1"), F.sum("below")).toArrow()  # 65,280 rows at most
    upper = spark.sparkContext.broadcast(Upper(*(nodes.column(i).to_numpy() for i in range(5))))
    del tops
    release(spark)
    logp = by_context.groupBy("part").applyInArrow(_scored(depth, upper), "gram long, logp double")
    logp = logp.mapInArrow(_with_bucket(buckets), "bucket long, gram long, logp double")
    with small_batches(spark):
        values = own.filter("kind = 0").select("block", "bucket", "kind", "a").groupBy("bucket").cogroup(logp.groupBy("bucket")).applyInArrow(_answer, "block long, bucket long, kind int, answer binary")
        values = stage(values, "answers")
    discard(own, counts)
    del logp, by_context
    release(spark)
    answers = values.union(totals.select("block", "bucket", "kind", "answer"))
    scored = blocks.select("block", "blob").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(depth, buckets), f"doc_id {kind}, held_out boolean, size long, words long, known long, logs double, score double"
    )
    size = F.lit(math.log10(max(1, train_words + vocabulary + 1)))
    return scored.select(
        "doc_id",
        "held_out",
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + F.lit(1 if ends else 0)).alias("n_known"),
        F.lit(train_words).cast("long").alias("train_tokens"),
        (F.col("logs") + F.lit(math.log10(ends + 1)) - (F.col("words") + 1) * size).alias("base_score"),
        "score",
        F.col("size").alias("n_bytes"),
        (-F.col("score") * F.lit(math.log2(10)) / (F.col("size") + 1)).alias("bits_per_byte"),
    )


def _totals(batches):
    for batch in batches:
        found = read_numbers(batch.column(4))[0].astype(np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["tokens", "ends"])


def _with_bucket(buckets: int):
    def run(batches):
        for batch in batches:
            grams = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            place = (mixed(grams) % np.uint64(buckets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), *batch.columns], ["bucket", "gram", "logp"])

    return run
