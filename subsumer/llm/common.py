"""Helpers that every operator of this subpackage uses.

Conventions held by all operators here
--------------------------------------
* Input is any DataFrame with an identifier and a text column (names are parameters); every
  other column is ignored unless a docstring says that it is carried along.  Columns of the input
  that clash with an output name never matter, because outputs are built from selected columns.
* A null text counts as the empty text.  A null identifier is kept as null; rows are never dropped
  for it.
* An empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


SIEVE_WORDS = 1 << 19  # of 64 bits: what a sieve broadcasts has as many rows at most


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, only a local session (one machine, as in tests) gets a temporary folder; on a
    cluster that would be each machine's own, so it is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="subsumer-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that ``stage`` wrote since the list was taken; ``scratch`` takes it.
_staged: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage, lets several consumers use one computation, and survives the loss of
    any executor, as the files do not live on one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/subsumer/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing needs any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/subsumer/" in path:
                delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession, docs: DataFrame, before: list[str]):
    """For a step whose result is written before the next one begins: delete what earlier steps staged
    (``before``, which then gets what this one stages), unless ``docs`` is read from it."""
    in_use = {f.rpartition("/")[0].rpartition("/")[2] for f in docs.inputFiles()}
    kept = [p for p in before if p.rpartition("/")[2] in in_use]
    for path in before:
        if path not in kept:
            delete(spark, path)
    begin = len(_staged)
    try:
        yield
    finally:
        before[:] = kept + _staged[begin:]
        del _staged[begin:]


def _sieve_place(column: Column) -> Column:
    return F.xxhash64(F.lit(7), column).bitwiseAND(F.lit(SIEVE_WORDS * 64 - 1))


def sieve(keys: DataFrame, column: str) -> DataFrame:
    """(_word, _bits): a bitmap of hashed keys, of bounded size however many there are."""
    place = keys.select(_sieve_place(F.col(column)).alias("_p"))
    words = place.selectExpr("shiftright(_p, 6) AS _word", "shiftleft(1L, cast(_p & 63 AS int)) AS _bit")
    return words.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def sifted(df: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """Add _maybe: false for rows whose key is not in the sieve; true for all others and some more."""
    place = df.withColumn("_p", _sieve_place(F.col(column))).withColumn("_word", F.expr("shiftright(_p, 6)"))
    joined = place.join(F.broadcast(bits), "_word", "left")
    hit = F.expr("coalesce(shiftright(_bits, cast(_p & 63 AS int)) & 1L, 0L) = 1L")
    return joined.withColumn("_maybe", hit).drop("_word", "_p", "_bits")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def text_of(df: DataFrame, text_col: str = "text") -> Column:
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def ship(spark: SparkSession, path: str):
    """Broadcast one vocabulary file; its size does not depend on the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of frames that are no longer referenced, before the next round."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches, rows: int = 1000):
    """Arrow batches of at most so many rows, so that what is made of one stays small."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Bound the bytes of the Arrow batches that jobs run inside it send to Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)
