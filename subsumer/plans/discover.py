"""The level-wise discovery of inclusion dependencies."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DiscoveryConfig
from ..operators import candidates as C
from ..operators import keys as K
from ..operators import validity as V
from ..operators.catalog import Relation, attribute_catalog, names_of, relations_of, with_names
from .staging import discard, release, stage

#: Rows with keys of several columns that a pass over the data shuffles, about; more are taken in several passes.
KEYS_A_PASS = 120_000_000

#: Bytes of a shuffled row (measured on two-column keys: 26), and the input's bytes that a pass may shuffle, about; a
#: quarter of KEYS_A_PASS is always taken.
ROW_BYTES = 26
INPUT_A_PASS = 2

#: Distinct values, in sum, of the dependent sides' columns at one place, up to which a referenced side's other keys
#: aren't shuffled.
LIVE_VALUES = 1024


@dataclass
class Layer:
    """Tables of one arity: attributes with statistics, candidates with counts (unless all are asked for:
    on the first layer only those that can hold, later less those refuted before all keys were counted,
    and the attributes of no others), those that hold.  Statistics beyond the first layer are bounds for attributes
    that are no candidate's dependent side."""

    arity: int
    stats: DataFrame
    counted: DataFrame
    valid: DataFrame
    n_attributes: int
    n_candidates: int
    n_valid: int
    seconds: float


@dataclass
class Discovery:
    """Everything that a run found."""

    config: DiscoveryConfig
    relations: list[Relation]
    layers: list[Layer] = field(default_factory=list)

    def clean(self) -> None:
        """Delete the tables of all layers; what has not been written or collected by then is gone."""
        for layer in self.layers:
            discard(layer.stats, layer.counted)

    def described(self) -> DataFrame:
        """Valid pairs of all layers, each side as relation, columns (array) and rendered list."""
        spark = self.relations[0].df.sparkSession
        names = names_of(spark, self.relations)
        found = []
        for layer in self.layers:
            attrs = with_names(layer.stats.select("attr_id", "rel_id", "cols"), names).select("attr_id", "rel", "columns", "attr")
            rows = layer.valid.join(attrs.toDF("dep_id", "dep_rel", "dep_columns", "dep"), "dep_id").join(attrs.toDF("ref_id", "ref_rel", "ref_columns", "ref"), "ref_id")
            found.append(rows.drop("dep_id", "ref_id").withColumn("layer", F.lit(layer.arity)))
        return reduce(DataFrame.unionByName, found)

    def table(self) -> DataFrame:
        """(layer, dep, ref, size, cap, viol, partial_degree, exact_degree), columns by name."""
        return self.described().select("layer", "dep", "ref", "size", "cap", "viol", "partial_degree", "exact_degree")

    def summary(self) -> DataFrame:
        """One row a layer: (layer, attributes, candidates, valid, seconds)."""
        spark = self.relations[0].df.sparkSession
        rows = [(x.arity, x.n_attributes, x.n_candidates, x.n_valid, x.seconds) for x in self.layers]
        return spark.createDataFrame(rows, "layer int, attributes long, candidates long, valid long, seconds double")


def layer_signatures(keys: list[DataFrame]) -> DataFrame:
    return K.signatures(K.value_groups(K.value_counts(reduce(DataFrame.union, keys))))


def judged(arity: int, attrs: DataFrame, n_attributes: int, candidates: DataFrame | None, n_candidates: int, sigs: list[DataFrame], config: DiscoveryConfig, began: float, most: DataFrame | None = None) -> Layer:
    """The layer from its staged signatures; all is over attributes.  Without candidates: all ordered pairs
    are, of which only those that can hold are counted.  most: bounds for sides whose keys weren't all counted."""
    every = reduce(DataFrame.union, sigs)
    sums = K.attribute_stats(attrs, every)
    stats = stage(sums if most is None else V.bounded(sums, candidates, most), f"stats{arity}")
    shared = K.overlaps(every) if arity == 1 else K.overlaps_of(every, candidates)
    pairs = V.shared_or_free(shared, stats, config) if candidates is None else candidates.join(shared, ["dep_id", "ref_id"], "left")
    counted = stage(V.violations(pairs, stats, config), f"counted{arity}")
    discard(*sigs)
    held = V.valid(counted, config)
    return Layer(arity, stats, counted, held, n_attributes, n_candidates, held.count(), time.monotonic() - began)


def first_layer(spark: SparkSession, relations: list[Relation], config: DiscoveryConfig, every: bool = False) -> Layer:
    """every: count all ordered pairs, also those that share no key."""
    began = time.monotonic()
    attrs = attribute_catalog(spark, relations).select("attr_id", "rel_id", "cols")
    n = sum(len(r.columns) for r in relations)
    sigs = stage(layer_signatures([K.unary_keys(r, config) for r in relations]), "signatures1")
    release(spark)
    return judged(1, attrs, n, C.unary_candidates(attrs) if every else None, n * (n - 1), [sigs], config, began)


def sides_of(candidates: DataFrame, attrs: DataFrame) -> DataFrame:
    """Attributes on either side of candidates."""
    ids = candidates.select(F.col("dep_id").alias("attr_id")).union(candidates.select("ref_id")).distinct()
    return attrs.join(ids, "attr_id", "left_semi")


def shuffled(counts: DataFrame, tasks: int) -> float:
    """Rows that two shuffles take for (rows, keys) of attributes, or fewer: each task has each key once, at
    most, and then all have."""
    return counts.agg(F.sum(F.least("rows", F.col("keys") * tasks) + F.col("keys"))).first()[0] or 0


def rows_a_pass(relations: list[Relation]) -> float:
    """Rows that a pass may shuffle: KEYS_A_PASS, less where they would be more bytes than INPUT_A_PASS times the input."""
    size = sum(int(str(r.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for r in relations)
    return min(KEYS_A_PASS, max(KEYS_A_PASS / 4, INPUT_A_PASS * size / ROW_BYTES))


def few_valued(layer: Layer, attrs: DataFrame, candidates: DataFrame, relations: list[Relation], config: DiscoveryConfig) -> tuple[DataFrame, DataFrame] | None:
    """Staged columns with few values (rel_id, col, n) of dependent sides, and their values (rel_id, col, value); None
    if there are none.  layer: the first one."""
    columns = attrs.join(candidates.select(F.col("dep_id").alias("attr_id")), "attr_id", "left_semi").select("rel_id", F.explode("cols").alias("col")).distinct()
    singles = layer.stats.filter(F.col("n_distinct") <= LIVE_VALUES).select("rel_id", F.col("cols")[0].alias("col"), F.col("n_distinct").alias("n"))
    few = stage(singles.join(columns, ["rel_id", "col"]), "few")
    own = {}
    for k, c in few.select("rel_id", "col").collect():  # columns in use
        own.setdefault(k, []).append(c)
    if not own:
        discard(few)
        return None
    return few, stage(reduce(DataFrame.union, [K.column_values(r, sorted(own[r.id]), config) for r in relations if r.id in own]), "values")


def passes(
    arity: int, attrs: DataFrame, candidates: DataFrame, most: DataFrame, relations: list[Relation], config: DiscoveryConfig, every: bool, known: tuple[DataFrame, DataFrame] | None = None
) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Staged signatures of all parts of the keys, the candidates left and their attributes.

    Each pass reads the data and shuffles the keys of as many parts as make about rows_a_pass rows; then its
    shuffle files go.  known: columns with few values, and the values; keys of referenced sides that therefore are
    no dependent side's aren't shuffled.  Candidates that a pass refutes for good (none if every), and attributes of no others,
    are not in the next one.  What is left has been counted over all keys.
    """
    spark, sigs, begin = attrs.sparkSession, [], 0
    largest = attrs.join(most, "attr_id").agg(F.max_by("rel_id", "most_rows")).first()[0]
    tasks = next(r.df for r in relations if r.id == largest).rdd.getNumPartitions()
    keys, limit = shuffled(most.toDF("attr_id", "rows", "keys"), tasks) / K.PARTS, rows_a_pass(relations)
    while True:
        parts = range(begin, min(K.PARTS, begin + max(1, int(limit / max(keys, 1)))))
        # a row for each relation, and for each of its columns in use: no more than the schemas have
        sizes = {r["rel_id"]: r["count"] for r in attrs.groupBy("rel_id").count().collect()}
        columns = {tuple(r) for r in attrs.select("rel_id", F.explode("cols")).distinct().collect()}
        made = [K.nary_keys(r, attrs, sizes[r.id], {c for k, c in columns if k == r.id}, config, parts) for r in relations if r.id in sizes]
        if known:
            places = stage(C.live_places(candidates, attrs, known[0], LIVE_VALUES), f"places{arity}")
            values = stage(places.join(known[1], ["rel_id", "col"]).select("attr_id", "value").distinct(), f"live{arity}")
            made = [K.live(m, places.select("attr_id", "place").distinct(), values) for m in made]
        sigs.append(stage(layer_signatures([K.packed(m, arity) for m in made]), f"signatures{arity}"))
        del made
        if known:
            discard(places, values)
        release(spark)
        begin = parts.stop
        if begin == K.PARTS:
            return sigs, candidates, attrs
        seen = reduce(DataFrame.union, sigs)
        stats = stage(K.attribute_stats(attrs, seen), f"stats{arity}")
        if not every:
            counted = V.violations(candidates.join(K.overlaps_of(seen, candidates), ["dep_id", "ref_id"], "left"), stats, config)
            candidates = stage(V.still_open(counted, stats, most, config), f"open{arity}")
            attrs = stage(sides_of(candidates, attrs), f"attributes{arity}")
        keys = shuffled(stats.join(attrs.select("attr_id"), "attr_id", "left_semi").select(F.col("n_rows").alias("rows"), F.col("n_distinct").alias("keys")), tasks) / begin
        discard(stats)
        if not every and candidates.isEmpty():
            return sigs, candidates, attrs


def next_layer(layer: Layer, index: DataFrame, relations: list[Relation], config: DiscoveryConfig, every: bool = False) -> Layer | None:
    """The layer of one column more, or None if there is no candidate.  every: count all candidates to the
    end, also those that some of the keys refute."""
    began, arity = time.monotonic(), layer.arity + 1
    pairs = C.extensions(C.described(layer.valid, layer.stats), index)
    longer = stage(C.closed(pairs, C.described(layer.valid, layer.stats, with_rows=False), arity), f"candidates{arity}")
    attrs = stage(C.interned(longer), f"attributes{arity}")
    n_attributes, n_candidates = attrs.count(), longer.count()
    if not n_candidates:
        return None
    asked, most = stage(C.as_ids(longer, attrs), f"asked{arity}"), stage(V.at_most(attrs, layer.stats), f"most{arity}")
    known = few_valued(layer, attrs, asked, relations, config) if layer.arity == 1 and n_attributes <= K.INLINE_ATTRIBUTES else None
    sigs, left, own = passes(arity, attrs, asked, most, relations, config, every, known)
    found = judged(arity, own, n_attributes, left, n_candidates, sigs, config, began, most if known else None)
    discard(*(known or ()), longer, attrs, asked, most, *([] if left is asked else [left, own]))
    return found


def discover(tables: dict[str, DataFrame], config: DiscoveryConfig = DiscoveryConfig()) -> Discovery:
    """Find all dependencies that hold, from single columns up to max_nary columns.

    tables: name -> DataFrame, at least one.  Nested and binary columns are left out.  Columns
    without any value hold vacuously on the first level and are never extended.
    """
    relations = relations_of(tables)
    if not relations:
        raise ValueError("no tables")
    spark = relations[0].df.sparkSession
    found = Discovery(config, relations)
    layer = first_layer(spark, relations, config)
    found.layers.append(layer)
    index = C.unary_index(layer.valid, layer.stats)
    while layer.n_valid and (config.max_nary is None or layer.arity < config.max_nary):
        layer = next_layer(layer, index, relations, config)
        if layer is None:
            break
        found.layers.append(layer)
    return found
