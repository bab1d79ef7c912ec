"""Relations from Parquet tables, single delimited files and folders of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Dialect

RAGGED = "_ragged"
SCALARS = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def scalar_places(df: DataFrame) -> list[int]:
    """Places of the columns that can be keys; nested and binary ones can't."""
    return [i for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, SCALARS)]


def from_parquet(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def _options(dialect: Dialect) -> dict:
    return {
        "sep": dialect.separator,
        "quote": dialect.quote,
        "escape": dialect.escape,
        "multiLine": dialect.multi_line,
        "ignoreLeadingWhiteSpace": dialect.ignore_leading_space,
        "nullValue": dialect.null_string,
        "emptyValue": "",
        "mode": "PERMISSIVE",
    }


def header_of(spark: SparkSession, path: str, dialect: Dialect) -> list[str]:
    """Names from the first line, or made up: column0, column1, and so on."""
    first = spark.read.options(**(_options(dialect) | {"multiLine": False})).csv(path).limit(1).collect()
    if not first:
        return []
    return [str(v) for v in first[0]] if dialect.header else [f"{dialect.header_prefix}{i}" for i in range(len(first[0]))]


def read_delimited(spark: SparkSession, path: str, dialect: Dialect = Dialect()) -> DataFrame:
    """All columns as text.  Rows with more or fewer fields than the header are dropped if the dialect
    says so, else padded or cut.  An empty file is a relation without columns and rows."""
    names = header_of(spark, path, dialect)
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    places = [f"c{i}" for i in range(len(names))]
    fields = [T.StructField(p, T.StringType()) for p in places]
    schema = T.StructType([*fields, T.StructField(RAGGED, T.StringType())] if dialect.skip_ragged else fields)
    rows = spark.read.options(**_options(dialect), header=dialect.header, enforceSchema=True, columnNameOfCorruptRecord=RAGGED).schema(schema).csv(path)
    if dialect.skip_ragged:
        # the always-true test names every field: the parser sees a ragged row only if it parses all of it
        rows = rows.filter(F.col(RAGGED).isNull() & (F.hash(*places) >= F.lit(-(2**31))))
    return rows.select(*places).toDF(*names)


def list_folder(spark: SparkSession, folder: str) -> dict[str, str]:
    """Table name (file name without its last extension) -> path, from whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = [s.getPath().getName() for s in found]
    return {n.rpartition(".")[0] or n: f"{folder.rstrip('/')}/{n}" for n in sorted(names) if n[:1] not in "._"}


def from_folder(spark: SparkSession, folder: str, dialect: Dialect = Dialect(), tables: list[str] | None = None) -> dict[str, DataFrame]:
    """Every file of a folder as a relation, or those named."""
    paths = list_folder(spark, folder)
    return {n: read_delimited(spark, paths[n], dialect) for n in tables or paths}
