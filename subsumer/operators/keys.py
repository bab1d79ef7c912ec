"""From rows to key counts, and from key counts to signatures.

A signature is the set of attributes that share a key, known by 96 bits of hash.  Counts summed by
signature and attribute are all that statistics, overlaps and violations need, and there are few of
them, so the data are read and shuffled once a layer and every later join is over attributes, not
values.  The set itself never travels with a key's members: a signature's rows are its members.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DiscoveryConfig
from ..functions.expressions import key_of, normalized
from .catalog import Relation

#: Attributes of one relation up to which they become expressions, which stay in generated code, and
#: up to which their list is broadcast; beyond, rows and list are joined by salt.
INLINE_ATTRIBUTES = 256
BROADCAST_ATTRIBUTES = 20_000
SALTS = 64

#: Keys of several columns are dealt by hash into so many parts; a pass over the data takes some of them.
PARTS = 48


def cells(relation: Relation, config: DiscoveryConfig, needed: set[int] | None = None) -> DataFrame:
    """A row's cells as array<string>; columns that no attribute needs are null and not read."""
    values = [normalized(F.col(f"c{i}"), config) if needed is None or i in needed else F.lit(None).cast("string") for i in range(len(relation.columns))]
    return relation.df.select(F.array(*values).alias("cells") if values else F.array().cast("array<string>").alias("cells"))


def unary_keys(relation: Relation, config: DiscoveryConfig) -> DataFrame:
    """(attr_id, key: the text) of each cell: the relation unpivoted.  A null cell has a null key."""
    rows = cells(relation, config).select(F.posexplode("cells").alias("place", "key"))
    return rows.select((F.lit(relation.offset) + F.col("place")).cast("long").alias("attr_id"), "key")


def _of_parts(is_null: Column, hashed: Column, parts: range) -> Column:
    """Whether a key is of the parts; null keys are of the first."""
    part = F.pmod(hashed, F.lit(PARTS))
    return F.when(is_null, F.lit(parts.start == 0)).otherwise((part >= parts.start) & (part < parts.stop))


def nary_keys(relation: Relation, attrs: DataFrame, n_attrs: int, needed: set[int], config: DiscoveryConfig, parts: range = range(PARTS)) -> DataFrame:
    """(attr_id, key array<string>) of each row and attribute; a null component makes the key null.

    parts: only keys of these are returned; each key is of one, whatever the attribute.
    """
    own = attrs.filter(F.col("rel_id") == relation.id)
    if n_attrs <= INLINE_ATTRIBUTES:
        # one short expression for a constant list of attributes: one for each would be a method too long to be compiled
        found = own.select("attr_id", "cols").collect()
        arity = len(found[0].cols)
        listed = [F.struct(F.lit(i).cast("long").alias("attr_id"), *(F.lit(c).alias(f"c{j}") for j, c in enumerate(cols))) for i, cols in found]
        rows = cells(relation, config, needed).select("cells", F.explode(F.array(*listed)).alias("a"))
        rows = rows.select("a.attr_id", *(F.get("cells", F.col(f"a.c{j}")).alias(f"k{j}") for j in range(arity)))
        whole = reduce(and_, (F.col(f"k{j}").isNotNull() for j in range(arity)))
        if len(parts) < PARTS:
            rows = rows.filter(_of_parts(~whole, F.xxhash64(*(f"k{j}" for j in range(arity))), parts))
        return rows.select("attr_id", F.when(whole, F.array(*(f"k{j}" for j in range(arity)))).alias("key"))
    own = own.select(F.struct("attr_id", "cols").alias("a"))
    rows = cells(relation, config, needed)
    if n_attrs <= BROADCAST_ATTRIBUTES:
        joined = rows.crossJoin(F.broadcast(own.agg(F.collect_list("a").alias("all")))).select("cells", F.explode("all").alias("a"))
    else:
        salted = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", (F.rand(7) * SALTS).cast("int")).join(salted, "salt").select("cells", "a")
    keys = joined.select("a.attr_id", key_of(F.col("cells"), F.col("a.cols")).alias("key"))
    return keys if len(parts) == PARTS else keys.filter(_of_parts(F.col("key").isNull(), F.xxhash64("key"), parts))


def column_values(relation: Relation, columns: list[int], config: DiscoveryConfig) -> DataFrame:
    """(rel_id, col, value) of some columns, each value once."""
    cell = [F.struct(F.lit(i).alias("col"), normalized(F.col(f"c{i}"), config).alias("value")) for i in columns]
    rows = relation.df.select(F.explode(F.array(*cell)).alias("v")).select(F.lit(relation.id).alias("rel_id"), "v.col", "v.value")
    return rows.filter("value IS NOT NULL").distinct()


def live(keys: DataFrame, places: DataFrame, values: DataFrame) -> DataFrame:
    """Keys (arrays) but for those whose component at their attribute's place is none of its values.

    places: (attr_id, place), values: (attr_id, value), both small; attributes without a place, and null keys, stay.
    """
    placed = keys.join(F.broadcast(places), "attr_id", "left").withColumn("value", F.get("key", F.col("place")))
    found = placed.join(F.broadcast(values.withColumn("met", F.lit(True))), ["attr_id", "value"], "left")
    return found.filter("met OR place IS NULL OR key IS NULL").select("attr_id", "key")


def packed(keys: DataFrame, arity: int) -> DataFrame:
    """Keys of so many components as one text each: each component but the last follows its length."""
    part = [F.get("key", F.lit(j)) for j in range(arity)]
    return keys.select("attr_id", F.concat(*(c for p in part[:-1] for c in (F.length(p).cast("string"), F.lit(":"))), *part).alias("key"))


def value_counts(keys: DataFrame) -> DataFrame:
    """(key, attr_id, n).  Rows with a null key are counted, too, under the null key."""
    return keys.groupBy("key", "attr_id").agg(F.count(F.lit(1)).alias("n"))


def value_groups(counts: DataFrame) -> DataFrame:
    """(key, members: array of (attr_id, n) in the order of attr_id): the inverted index."""
    return counts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("attr_id", "n"))).alias("members"))


def signatures(groups: DataFrame) -> DataFrame:
    """(signature: of attr_ids that share keys, is_null, attr_id, n: rows, keys: distinct keys)."""
    own = F.col("members.attr_id")
    signature = F.struct(F.xxhash64(own).alias("a"), F.hash(own).alias("b"))
    rows = groups.select(signature.alias("signature"), F.col("key").isNull().alias("is_null"), F.explode("members").alias("m"))
    return rows.groupBy("signature", "is_null", F.col("m.attr_id").alias("attr_id")).agg(F.sum("m.n").alias("n"), F.count(F.lit(1)).alias("keys"))


def attribute_stats(attrs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(attr_id, n_rows: with a key, n_distinct: keys, n_null: rows without), attributes without rows included."""
    known = ~F.col("is_null")
    sums = sigs.groupBy("attr_id").agg(
        F.sum(F.when(known, F.col("n"))).alias("n_rows"), F.sum(F.when(known, F.col("keys"))).alias("n_distinct"), F.sum(F.when(~known, F.col("n"))).alias("n_null")
    )
    return attrs.join(sums, "attr_id", "left").na.fill(0, ["n_rows", "n_distinct", "n_null"])


def overlaps(sigs: DataFrame) -> DataFrame:
    """(dep_id, ref_id, n: rows of dep whose key ref has, keys), for pairs that share a key."""
    rows = sigs.filter("NOT is_null")
    refs = rows.select("signature", F.col("attr_id").alias("ref_id"))
    pairs = rows.withColumnRenamed("attr_id", "dep_id").join(refs, "signature").filter("dep_id <> ref_id")
    return pairs.groupBy("dep_id", "ref_id").agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"))


def overlaps_of(sigs: DataFrame, candidates: DataFrame) -> DataFrame:
    """As overlaps, of candidates (dep_id, ref_id) only: a signature's other pairs are never made."""
    rows = sigs.filter("NOT is_null")
    asked = rows.withColumnRenamed("attr_id", "dep_id").join(candidates.select("dep_id", "ref_id"), "dep_id")
    met = asked.join(rows.select("signature", F.col("attr_id").alias("ref_id")), ["signature", "ref_id"], "left_semi")
    return met.groupBy("dep_id", "ref_id").agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"))


def mask(keys: DataFrame, live: DataFrame) -> DataFrame:
    """Keys that occur in ``live`` (column key); others can't be part of a dependency of more columns."""
    return keys.join(live.select("key").distinct(), "key", "left_semi")
