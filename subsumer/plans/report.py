"""Results as nested documents, and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .discover import Discovery


def nested(found: Discovery) -> DataFrame:
    """(layer, relation, dependants: array of (dependant, referenced: array of (relation, attribute, degree)))."""
    one = F.struct(F.col("ref_rel").alias("relation"), F.col("ref_columns").alias("attribute"), F.col("partial_degree").alias("degree"))
    parts = found.described().select("layer", F.col("dep_rel").alias("relation"), F.col("dep_columns").alias("dependant"), one.alias("one"))
    by_dep = parts.groupBy("layer", "relation", "dependant").agg(F.array_sort(F.collect_list("one")).alias("referenced"))
    return by_dep.groupBy("layer", "relation").agg(F.array_sort(F.collect_list(F.struct("dependant", "referenced"))).alias("dependants"))


def write(found: Discovery, folder: str) -> None:
    """<folder>/pinds: one JSON document a layer and relation, by layer; <folder>/run: the run's figures."""
    nested(found).write.mode("overwrite").partitionBy("layer").json(f"{folder}/pinds")
    config, spark = found.config, found.relations[0].df.sparkSession
    run = found.summary().withColumns(
        {
            "name": F.lit(config.name),
            "threshold": F.lit(config.threshold),
            "max_nary": F.lit(config.max_nary).cast("int"),
            "nulls": F.lit(config.nulls.value),
            "duplicates": F.lit(config.duplicates.value),
            "relations": F.lit(len(found.relations)),
            "total_attributes": F.lit(sum(len(r.columns) for r in found.relations)),
            "total_unary": F.lit(sum(x.n_valid for x in found.layers if x.arity == 1)),
            "total_nary": F.lit(sum(x.n_valid for x in found.layers if x.arity > 1)),
            "total_seconds": F.lit(sum(x.seconds for x in found.layers)),
            "parallelism": F.lit(spark.sparkContext.defaultParallelism),
            "shuffle_partitions": F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))),
        }
    )
    run.write.mode("overwrite").json(f"{folder}/run")
