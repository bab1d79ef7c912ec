"""Which candidates hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DiscoveryConfig, Duplicates, Nulls
from ..functions.expressions import cap_of, exact_degree, partial_degree, size_of


def with_caps(stats: DataFrame, config: DiscoveryConfig) -> DataFrame:
    """Add size (what degrees refer to) and cap (violations allowed)."""
    sized = stats.withColumn("size", size_of(F.col("n_rows"), F.col("n_distinct"), config))
    return sized.withColumn("cap", cap_of(F.col("size"), config.threshold))


def shared_or_free(shared: DataFrame, stats: DataFrame, config: DiscoveryConfig) -> DataFrame:
    """(dep_id, ref_id, n, keys) of the single-column pairs that can hold, in place of all ordered pairs:
    those that share a key, and those without whose dependent side may be violated by all its rows."""
    most = F.col("size") + (F.col("n_null") if config.nulls is Nulls.INEQUALITY else F.lit(0))
    free = with_caps(stats, config).filter(most <= F.col("cap")).select(F.col("attr_id").alias("dep_id"))
    pairs = free.crossJoin(stats.select(F.col("attr_id").alias("ref_id"))).filter("dep_id <> ref_id")  # which hold, but for null modes
    rest = pairs.join(shared, ["dep_id", "ref_id"], "left_anti")
    return shared.select("dep_id", "ref_id", "n", "keys").union(rest.select("dep_id", "ref_id", F.lit(0).cast("long"), F.lit(0).cast("long")))


def violations(pairs: DataFrame, stats: DataFrame, config: DiscoveryConfig) -> DataFrame:
    """(dep_id, ref_id, size, cap, viol) of each pair (with n and keys shared, null: none) that the null
    mode lets through.

    Shared keys are counted and taken from the size, so a pair without any stays.
    """
    deps = with_caps(stats, config).select(F.col("attr_id").alias("dep_id"), "size", "cap", F.col("n_null").alias("dep_nulls"))
    joined = pairs.join(deps, "dep_id")
    counted = F.coalesce(F.col("n") if config.duplicates is Duplicates.AWARE else F.col("keys"), F.lit(0))
    found = F.col("size") - counted
    if config.nulls is Nulls.INEQUALITY:
        found = found + F.col("dep_nulls")
    if config.nulls is Nulls.FOREIGN:
        whole = stats.filter("n_null = 0").select(F.col("attr_id").alias("ref_id"))
        joined = joined.join(whole, "ref_id", "left_semi")
    return joined.select("dep_id", "ref_id", "size", "cap", found.alias("viol"))


def at_most(attrs: DataFrame, before: DataFrame) -> DataFrame:
    """(attr_id, most_rows, most_keys): bounds for attributes, from the statistics of the layer before."""
    known = before.select("rel_id", F.col("cols").alias("head"), F.col("n_rows").alias("most_rows"), F.col("n_distinct").alias("head_keys"))
    ends = before.select("rel_id", F.col("cols").alias("tail"), F.col("n_distinct").cast("double").alias("tail_keys"))
    split = attrs.select("attr_id", "rel_id", F.slice("cols", 1, F.size("cols") - 1).alias("head"), F.slice("cols", -1, 1).alias("tail"))
    joined = split.join(known, ["rel_id", "head"]).join(ends, ["rel_id", "tail"], "left")  # tails are known on the second layer only
    product = F.coalesce(F.col("head_keys") * F.col("tail_keys"), F.col("most_rows").cast("double"))
    return joined.select("attr_id", "most_rows", F.least(F.col("most_rows").cast("double"), product).cast("long").alias("most_keys"))


def bounded(stats: DataFrame, candidates: DataFrame, most: DataFrame) -> DataFrame:
    """Statistics with bounds in place of counts for attributes that are referenced sides only: not all their keys
    were counted."""
    deps = candidates.select(F.col("dep_id").alias("attr_id")).distinct().withColumn("counted", F.lit(True))
    joined = stats.join(deps, "attr_id", "left").join(most, "attr_id", "left")
    given = {k: F.when(F.col("counted"), F.col(k)).otherwise(F.col(b)) for k, b in (("n_rows", "most_rows"), ("n_distinct", "most_keys"))}
    return joined.withColumns(given).drop("counted", "most_rows", "most_keys")


def still_open(counted: DataFrame, stats: DataFrame, most: DataFrame, config: DiscoveryConfig) -> DataFrame:
    """(dep_id, ref_id) of those that may hold, where counted and stats are of some parts of the keys only.

    Violations can but grow, and the size, hence the cap, is bounded: by the rows, or by the keys seen and
    a key for each row not seen.  So no pair that holds is left out.
    """
    seen = stats.select(F.col("attr_id").alias("dep_id"), "n_rows", "n_distinct").join(most.withColumnRenamed("attr_id", "dep_id"), "dep_id")
    keys = F.least("most_keys", F.col("n_distinct") + F.col("most_rows") - F.col("n_rows"))
    bound = cap_of(size_of(F.col("most_rows"), keys, config), config.threshold)
    return counted.join(seen.select("dep_id", bound.alias("bound")), "dep_id").filter("viol <= bound").select("dep_id", "ref_id")


def valid(counted: DataFrame, config: DiscoveryConfig) -> DataFrame:
    """Candidates within their cap, with both degrees."""
    kept = counted.filter("viol <= cap")
    return kept.withColumns(
        {"partial_degree": partial_degree(F.col("viol"), F.col("cap"), config.threshold), "exact_degree": exact_degree(F.col("viol"), F.col("size"))}
    )


def violating_keys(dep: DataFrame, ref: DataFrame) -> DataFrame:
    """(key, n) of the dependent side that the referenced side lacks; both: key counts of one attribute."""
    return dep.filter("key IS NOT NULL").join(ref.select("key"), "key", "left_anti").select("key", "n")


def referenced_by(valid_pairs: DataFrame) -> DataFrame:
    """(ref_id, n_dependents)."""
    return valid_pairs.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n_dependents"))
