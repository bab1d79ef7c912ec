"""The queries of this subpackage, for the repository's entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunk_store, ctw, exact_dedup, jpeg, mixing, repeats, simhash, toxicity, unigram_count
from .common import read_table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(read_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), mixing.Target(evenness=0.95))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_count.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.read_back(jpeg.to_media(read_table(spark, sf_dir, "documents")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), size=3, k=2)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents")).drop("spans")


def op7_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = chunk_store.write_store(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return chunk_store.read_facts(spark, store)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_sort(read_table(spark, sf_dir, "documents"), keep="largest")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_severity, p_toxic, grade, toxic: whether a filter at severity 0.5 rejects it."""
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("toxic", F.col("expected_severity") >= 0.5)


QUERIES = {f.__name__: f for f in (op1_context_tree, op2_source_mixing, op3_token_counts, op4_jpeg_media, op5_simhash, op6_repeats, op7_chunk_store, op8_exact_dedup, op9_bpe, op10_toxicity)}

ORACLE_SQL = {
    "op2_source_mixing": mixing.oracle(0.95),
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
