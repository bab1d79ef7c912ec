"""Candidate generation, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unary_candidates(attrs: DataFrame) -> DataFrame:
    """Each ordered pair of distinct attributes, also of one relation.  Both sides are catalogues."""
    deps, refs = attrs.select(F.col("attr_id").alias("dep_id")), attrs.select(F.col("attr_id").alias("ref_id"))
    return deps.crossJoin(refs).filter("dep_id <> ref_id")


def unary_index(valid_pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """(dep_rel, dep_col, ref_rel, ref_col) of valid single-column pairs with values on both sides."""
    full = stats.filter("n_rows > 0").select("attr_id", "rel_id", F.col("cols")[0].alias("col"))
    deps = full.toDF("dep_id", "dep_rel", "dep_col")
    refs = full.toDF("ref_id", "ref_rel", "ref_col")
    return valid_pairs.join(deps, "dep_id").join(refs, "ref_id").select("dep_rel", "dep_col", "ref_rel", "ref_col")


def described(valid_pairs: DataFrame, stats: DataFrame, with_rows: bool = True) -> DataFrame:
    """(dep_rel, dep_cols, ref_rel, ref_cols) of valid pairs, with_rows: whose dependent side has values.

    Only pairs with values are made longer; the subset check takes all that hold.
    """
    sides = stats.select("attr_id", "rel_id", "cols", "n_rows")
    deps = (sides.filter("n_rows > 0") if with_rows else sides).drop("n_rows").toDF("dep_id", "dep_rel", "dep_cols")
    refs = sides.drop("n_rows").toDF("ref_id", "ref_rel", "ref_cols")
    return valid_pairs.join(deps, "dep_id").join(refs, "ref_id").select("dep_rel", "dep_cols", "ref_rel", "ref_cols")


def extensions(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs made longer by one unary pair of the same relations.

    Dependent columns ascend, referenced ones don't repeat, and within one relation the two sides
    have no column in common.
    """
    apart = (
        (F.col("dep_rel") != F.col("ref_rel"))
        | ~F.array_contains("dep_cols", F.col("ref_col")) & ~F.array_contains("ref_cols", F.col("dep_col")) & (F.col("dep_col") != F.col("ref_col"))
    )
    joined = pairs.join(index, ["dep_rel", "ref_rel"])
    fits = joined.filter((F.col("dep_col") > F.element_at("dep_cols", -1)) & ~F.array_contains("ref_cols", F.col("ref_col")) & apart)
    longer = {"dep_cols": F.concat("dep_cols", F.array("dep_col")), "ref_cols": F.concat("ref_cols", F.array("ref_col"))}
    return fits.withColumns(longer).select("dep_rel", "dep_cols", "ref_rel", "ref_cols").distinct()


def without(columns, place):
    """An array of columns without the one at a place."""
    return F.concat(F.slice(columns, 1, place), F.slice(columns, place + 2, F.size(columns)))


def closed(longer: DataFrame, pairs: DataFrame, arity: int) -> DataFrame:
    """Those whose pairs with any one place dropped are all in ``pairs`` (of arity - 1 columns).

    The last place needs no test: what is left then is the pair that was made longer.
    """
    if arity < 3:
        return longer
    each = longer.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(arity - 2))))
    each = each.withColumns({"d": without("dep_cols", F.col("place")), "r": without("ref_cols", F.col("place"))})
    known = pairs.select("dep_rel", "ref_rel", F.col("dep_cols").alias("d"), F.col("ref_cols").alias("r"))
    kept = each.join(known, ["dep_rel", "ref_rel", "d", "r"], "left_semi")
    counted = kept.groupBy("dep_rel", "dep_cols", "ref_rel", "ref_cols").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") == arity - 1).drop("n")


def interned(longer: DataFrame) -> DataFrame:
    """(attr_id, rel_id, cols) of the attributes on either side; numbers follow (rel_id, cols).

    Numbers are places in a sorted table, so the result has to be written before it is used twice.
    """
    sides = longer.select(F.col("dep_rel").alias("rel_id"), F.col("dep_cols").alias("cols")).union(longer.select("ref_rel", "ref_cols")).distinct()
    ordered = sides.repartitionByRange("rel_id", "cols").sortWithinPartitions("rel_id", "cols")
    return ordered.select(F.monotonically_increasing_id().alias("attr_id"), "rel_id", "cols")


def as_ids(longer: DataFrame, attrs: DataFrame) -> DataFrame:
    """(dep_id, ref_id) of described candidates."""
    deps = attrs.select(F.col("attr_id").alias("dep_id"), F.col("rel_id").alias("dep_rel"), F.col("cols").alias("dep_cols"))
    refs = attrs.select(F.col("attr_id").alias("ref_id"), F.col("rel_id").alias("ref_rel"), F.col("cols").alias("ref_cols"))
    return longer.join(deps, ["dep_rel", "dep_cols"]).join(refs, ["ref_rel", "ref_cols"]).select("dep_id", "ref_id")


def live_places(candidates: DataFrame, attrs: DataFrame, few: DataFrame, most: int) -> DataFrame:
    """(attr_id, place, rel_id, col) of attributes that are referenced sides only: the place where their dependent
    sides' columns have the fewest values, ``most`` in sum, and those columns.

    few: (rel_id, col, n: distinct values) of columns with few.  A key that has none of the values there is no
    dependent side's, so it can't be shared.
    """
    deps = attrs.select(F.col("attr_id").alias("dep_id"), "rel_id", F.posexplode("cols").alias("place", "col"))
    sides = candidates.join(deps, "dep_id").select(F.col("ref_id").alias("attr_id"), "place", "rel_id", "col").distinct()
    sums = sides.join(few, ["rel_id", "col"], "left").groupBy("attr_id", "place").agg(F.sum("n").alias("n"), F.bool_and(F.col("n").isNotNull()).alias("all"))
    least = sums.filter(F.col("all") & (F.col("n") <= most)).groupBy("attr_id").agg(F.min(F.struct("n", "place"))["place"].alias("place"))
    only = least.join(candidates.select(F.col("dep_id").alias("attr_id")), "attr_id", "left_anti")
    return only.join(sides, ["attr_id", "place"])
