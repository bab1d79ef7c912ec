"""Relations and their attributes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scalar_places


@dataclass(frozen=True)
class Relation:
    """A table under discovery; a column's global number is offset plus its place.

    df's columns are c0, c1, and so on: columns are known by place, so their names may repeat, differ in
    case only or hold any character.  columns: the names, for reports.
    """

    id: int
    name: str
    df: DataFrame
    columns: tuple[str, ...]
    offset: int


def relations_of(tables: dict[str, DataFrame]) -> list[Relation]:
    found, offset = [], 0
    for k, (name, df) in enumerate(tables.items()):
        places = scalar_places(df)
        columns = tuple(df.columns[i] for i in places)
        by_place = df.toDF(*(f"x{i}" for i in range(len(df.columns)))).select(*(F.col(f"x{i}").alias(f"c{k}") for k, i in enumerate(places)))
        found.append(Relation(k, name, by_place, columns, offset))
        offset += len(columns)
    return found


def attribute_catalog(spark: SparkSession, relations: list[Relation]) -> DataFrame:
    """(attr_id, rel_id, cols: array of one place, rel, attr: relation.column) of single columns."""
    rows = [(r.offset + i, r.id, [i], r.name, f"{r.name}.{c}") for r in relations for i, c in enumerate(r.columns)]
    return spark.createDataFrame(rows, "attr_id long, rel_id int, cols array<int>, rel string, attr string")


def names_of(spark: SparkSession, relations: list[Relation]) -> DataFrame:
    """(rel_id, rel, names: the columns' names)."""
    return spark.createDataFrame([(r.id, r.name, list(r.columns)) for r in relations], "rel_id int, rel string, names array<string>")


def with_names(attrs: DataFrame, names: DataFrame) -> DataFrame:
    """Add to (rel_id, cols): rel, columns (names, in order) and attr ("rel.a,rel.b")."""
    listed = attrs.join(names, "rel_id").withColumn("columns", F.transform("cols", lambda c: F.get("names", c))).drop("names")
    return listed.withColumn("attr", F.concat_ws(",", F.transform("columns", lambda c: F.concat(F.col("rel"), F.lit("."), c))))
