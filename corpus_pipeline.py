"""A training-data pipeline over ``documents``: five stages, each one of the operators in ``subsumer.llm``.

Every stage takes all rows its predecessor kept, reads them from Parquet and returns a DataFrame;
all but the last return the columns of documents.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsumer.llm import bpe, exact_dedup, mixing, simhash, toxicity
from subsumer.llm.common import discard, read_table, scratch, sieve, sifted, stage, text_of

#: A document is rejected from this expected severity on.
SEVERITY = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the severity limit; the model is fitted on the labelled ones among docs.

    Null and empty texts have no features: they are judged by the thresholds alone (and stay while most
    labelled texts are clean).  Equal texts share a fate, repeated rows too.  No documents: none back.
    """
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=docs.columns).filter(F.col("expected_severity") < SEVERITY).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest identifier.

    Null equals the empty text.  A null identifier stays only where a group has no other; of repeated
    rows one stays.  Texts of any length are compared whole.  No documents: none back.
    """
    rest = [c for c in docs.columns if c != "doc_id"]
    return exact_dedup.content_sort(docs, keep="smallest", carry=rest).filter("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles.

    Texts without words (null, empty) are alike.  A text of under five words is one shingle.  The smallest
    identifier of a group stays (nulls last); rows that repeat share a fate.  No documents: none back.
    """
    gone = stage(simhash.near_copies(docs, size=5, similarity=0.8).filter("NOT stays").select(F.col("node").alias("_node")).distinct(), "gone")
    marked = sifted(docs.withColumn("_node", F.xxhash64(docs["doc_id"], text_of(docs))), "_node", sieve(gone, "_node"))
    others = marked.filter("_maybe").join(gone, "_node", "left_anti")  # only texts that the bitmap leaves open move
    return marked.filter("NOT _maybe").select(*docs.columns).union(others.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources tempered to 0.88 of the largest entropy; the budget uses each document at least once.

    A null source is the source ""; sources without a token are emitted once.  Texts without tokens (null,
    empty) are in the first epoch.  Repeated rows are documents of their own.  No documents: none back.
    """
    target = mixing.Target(evenness=0.88, highest=1.0, budget="cover", silent=True)
    return mixing.mix(docs, target, carry=[c for c in docs.columns if c != "doc_id"]).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token identifiers of each row, verified by decoding: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    Null and empty texts have no identifiers.  A row for each emission, so documents of small sources may
    come more than once.  No documents: none back.
    """
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


#: Folders of intermediate tables of the stage before, whose result has been written by the time the next begins.
_before: list[str] = []


def _tidy(function):
    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scratch(spark, docs, _before):
            return function(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _tidy(drop_toxic)),
    ("exact_dedup", _tidy(drop_exact_copies)),
    ("simhash_near_dedup", _tidy(drop_near_copies)),
    ("source_mixing", _tidy(mix_sources)),
    ("bpe", _tidy(encode)),
]

#: The fitted model and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES[:-1]):
        read, docs = docs, stage(function(spark, docs, sf_dir), name)
        if k:
            discard(read)
    return STAGES[-1][1](spark, docs, sf_dir)
