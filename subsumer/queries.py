"""Named queries over the driver's tables, one or more for each operator, with SQL for the same rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DiscoveryConfig, Duplicates, Nulls
from .functions.expressions import normalized
from .operators import candidates as C
from .operators import keys as K
from .operators import validity as V
from .operators.catalog import attribute_catalog, names_of, relations_of, with_names
from .plans.discover import discover, first_layer, layer_signatures, next_layer
from .plans.report import nested
from .plans.staging import shared_dir, stage
from .sources import from_parquet, read_delimited

#: The default catalogue, columns in the order of the tables.
SCHEMA = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
}
COLUMNS = {t: c.split() for t, c in SCHEMA.items()}
SMALL = ["region", "nation", "supplier"]
PARTIAL = 0.93


def tables(spark: SparkSession, sf_dir: str, names=None) -> dict[str, DataFrame]:
    return from_parquet(spark, sf_dir, list(names or SCHEMA))


def with_nulls(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three relations with nulls: in a dependent column, in a referenced one, and nothing but nulls."""
    own = tables(spark, sf_dir, ["lineitem", "supplier", "nation"])
    return {
        "items": own["lineitem"].select(F.nullif("l_linenumber", F.lit(1)).alias("line"), F.col("l_suppkey").alias("supp"), F.lit(None).cast("string").alias("none")),
        "keys": own["supplier"].select(F.nullif("s_suppkey", F.lit(1)).alias("supp"), F.col("s_nationkey").alias("nation")),
        "nations": own["nation"].select(F.col("n_nationkey").alias("nation"), F.nullif("n_regionkey", F.lit(0)).alias("region")),
    }


NULL_SQL = """
    items AS (SELECT nullif(l_linenumber, 1) AS line, l_suppkey AS supp, NULL::VARCHAR AS none FROM lineitem),
    keys AS (SELECT nullif(s_suppkey, 1) AS supp, s_nationkey AS nation FROM supplier),
    nations AS (SELECT n_nationkey AS nation, nullif(n_regionkey, 0) AS region FROM nation)"""


def with_pair_nulls(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Order and line number of all items: with nulls in the second column, in the first, and in neither."""
    items = tables(spark, sf_dir, ["lineitem"])["lineitem"]
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    return {
        "no_line": items.select(order.alias("o"), F.nullif(line, F.lit(7)).alias("n")),
        "no_order": items.select(F.nullif(order, F.lit(1)).alias("o"), line.alias("n")),
        "whole": items.select(order.alias("o"), line.alias("n")),
    }


PAIR_NULL_SQL = """
    no_line AS (SELECT l_orderkey AS o, nullif(l_linenumber, 7) AS n FROM lineitem),
    no_order AS (SELECT nullif(l_orderkey, 1) AS o, l_linenumber AS n FROM lineitem),
    whole AS (SELECT l_orderkey AS o, l_linenumber AS n FROM lineitem)"""
PAIR_NULL_COLUMNS = {"no_line": ["o", "n"], "no_order": ["o", "n"], "whole": ["o", "n"]}


def triples(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three columns of all items, twice, in another order."""
    items = tables(spark, sf_dir, ["lineitem"])["lineitem"]
    order, part, line = F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("n")
    return {"here": items.select(order, part, line), "there": items.select(line, order, part)}


TRIPLE_SQL = """
    here AS (SELECT l_orderkey AS o, l_partkey AS p, l_linenumber AS n FROM lineitem),
    there AS (SELECT l_linenumber AS n, l_orderkey AS o, l_partkey AS p FROM lineitem)"""
TRIPLE_COLUMNS = {"here": ["o", "p", "n"], "there": ["n", "o", "p"]}
NULL_COLUMNS = {"items": ["line", "supp", "none"], "keys": ["supp", "nation"], "nations": ["nation", "region"]}


# --------------------------------------------------------------------------------- shared SQL parts


def cells_sql(columns: dict[str, list[str]], equality: bool = False) -> str:
    """attr, v: every cell of every attribute."""
    value = "coalesce({c}::VARCHAR, '')" if equality else "nullif({c}::VARCHAR, '')"
    return " UNION ALL ".join(f"SELECT '{t}.{c}' AS attr, {value.format(c=f'{t}.{c}')} AS v FROM {t}" for t, cs in columns.items() for c in cs)


def unary_sql(columns: dict[str, list[str]], threshold: float = 1.0, aware: bool = True, nulls: str = "subset", more: str = "") -> str:
    """CTEs up to ``counted`` (dep, ref, size, cap, viol) and ``held``."""
    size, weight = ("n_rows", "d.n") if aware else ("n_distinct", "1")
    extra = " + d.n_null" if nulls == "inequality" else ""
    where = "WHERE r.n_null = 0" if nulls == "foreign" else ""
    return f"""WITH {more + "," if more else ""}
        cells AS ({cells_sql(columns, nulls == "equality")}),
        kv AS (SELECT attr, v, count(*)::BIGINT AS n FROM cells WHERE v IS NOT NULL GROUP BY ALL),
        stats AS (SELECT attr, count(v)::BIGINT AS n_rows, count(DISTINCT v)::BIGINT AS n_distinct, (count(*) - count(v))::BIGINT AS n_null FROM cells GROUP BY attr),
        shared AS (SELECT d.attr AS dep, r.attr AS ref, sum({weight})::BIGINT AS n FROM kv d JOIN kv r ON d.v = r.v AND d.attr <> r.attr GROUP BY ALL),
        counted AS (
            SELECT d.attr AS dep, r.attr AS ref, d.{size} AS size, trunc((1.0::DOUBLE - {threshold}::DOUBLE) * d.{size})::BIGINT AS cap,
                   (d.{size} - coalesce(s.n, 0){extra})::BIGINT AS viol
            FROM stats d JOIN stats r ON d.attr <> r.attr LEFT JOIN shared s ON s.dep = d.attr AND s.ref = r.attr {where}),
        held AS (SELECT * FROM counted WHERE viol <= cap)"""


def pairs_sql(threshold: float, aware: bool = True, columns=COLUMNS, nulls: str = "subset") -> str:
    """CTEs after unary_sql: the second level, ``nary_counted`` and ``nary_held``."""
    places = ", ".join(f"('{t}.{c}', '{t}', {i})" for t, cs in columns.items() for i, c in enumerate(cs))
    cell = "coalesce({}::VARCHAR, '')" if nulls == "equality" else "{}::VARCHAR"
    rows = " UNION ALL ".join(
        f"SELECT '{t}' AS rel, k, unnest([{', '.join(str(i) for i in range(len(cs)))}]) AS col, unnest([{', '.join(cell.format(c) for c in cs)}]) AS v FROM (SELECT *, row_number() OVER () AS k FROM {t})"
        for t, cs in columns.items()
    )
    size, weight = ("n_rows", "d.n") if aware else ("n_distinct", "1")
    extra = " + p.n_null" if nulls == "inequality" else ""
    whole = "JOIN pair_stats q ON q.rel = rr AND q.c1 = r1 AND q.c2 = r2 AND q.n_null = 0" if nulls == "foreign" else ""
    return f"""
        places(attr, rel, col) AS (VALUES {places}),
        u1 AS (SELECT d.rel AS dr, d.col AS dc, r.rel AS rr, r.col AS rc
               FROM held JOIN places d ON d.attr = dep JOIN places r ON r.attr = ref JOIN stats sd ON sd.attr = dep JOIN stats sr ON sr.attr = ref
               WHERE sd.n_rows > 0 AND sr.n_rows > 0),
        nary AS (SELECT a.dr, a.dc AS d1, b.dc AS d2, a.rr, a.rc AS r1, b.rc AS r2 FROM u1 a JOIN u1 b USING (dr, rr)
                 WHERE b.dc > a.dc AND b.rc <> a.rc AND (dr <> rr OR (b.rc <> a.dc AND a.rc <> b.dc AND b.rc <> b.dc))),
        sides AS (SELECT dr AS rel, d1 AS c1, d2 AS c2 FROM nary UNION SELECT rr, r1, r2 FROM nary),
        rowcells AS ({rows}),
        pair_kv AS (SELECT sides.rel AS rel, c1, c2, x.v AS v1, y.v AS v2, count(*)::BIGINT AS n
                    FROM sides JOIN rowcells x ON x.rel = sides.rel AND x.col = c1 JOIN rowcells y ON y.rel = sides.rel AND y.col = c2 AND y.k = x.k
                    WHERE x.v IS NOT NULL AND y.v IS NOT NULL GROUP BY sides.rel, c1, c2, v1, v2),
        pair_stats AS (SELECT sides.rel AS rel, sides.c1 AS c1, sides.c2 AS c2, coalesce(sum(n), 0)::BIGINT AS n_rows, count(n)::BIGINT AS n_distinct,
                              (any_value(t.total) - coalesce(sum(n), 0))::BIGINT AS n_null
                       FROM sides JOIN (SELECT rel, count(DISTINCT k) AS total FROM rowcells GROUP BY rel) t ON t.rel = sides.rel
                       LEFT JOIN pair_kv p ON p.rel = sides.rel AND p.c1 = sides.c1 AND p.c2 = sides.c2 GROUP BY sides.rel, sides.c1, sides.c2),
        pair_shared AS (SELECT nary.*, coalesce(sum({weight}) FILTER (r.rel IS NOT NULL), 0)::BIGINT AS n
                        FROM nary LEFT JOIN pair_kv d ON d.rel = dr AND d.c1 = d1 AND d.c2 = d2
                        LEFT JOIN pair_kv r ON r.rel = rr AND r.c1 = r1 AND r.c2 = r2 AND r.v1 = d.v1 AND r.v2 = d.v2 GROUP BY ALL),
        nary_counted AS (SELECT s.*, p.{size} AS size, trunc((1.0::DOUBLE - {threshold}::DOUBLE) * p.{size})::BIGINT AS cap, p.{size} - s.n{extra} AS viol
                         FROM pair_shared s JOIN pair_stats p ON p.rel = dr AND p.c1 = d1 AND p.c2 = d2 {whole}),
        nary_held AS (SELECT * FROM nary_counted WHERE viol <= cap)"""


NARY_NAMES = """SELECT p.attr || ',' || q.attr AS dep, r.attr || ',' || s.attr AS ref{more} FROM {source} x
    JOIN places p ON p.rel = dr AND p.col = d1 JOIN places q ON q.rel = dr AND q.col = d2 JOIN places r ON r.rel = rr AND r.col = r1 JOIN places s ON s.rel = rr AND s.col = r2"""
PAIR = "dep, ref, size, cap, viol"


# ------------------------------------------------------------------------------------------ queries


def named(spark, relations, df, sides):
    """Replace attribute numbers by names."""
    attrs = attribute_catalog(spark, relations).select("attr_id", "attr")
    for number, name in sides.items():
        df = df.join(attrs.toDF(number, name), number).drop(number)
    return df


def unary(spark, sf_dir, config=DiscoveryConfig(), own=None, every=False):
    relations = relations_of(own or tables(spark, sf_dir))
    return relations, first_layer(spark, relations, config, every)


def unary_held(config, own=None):
    def query(spark, sf_dir):
        relations, layer = unary(spark, sf_dir, config, own(spark, sf_dir) if own else None)
        return named(spark, relations, layer.valid, {"dep_id": "dep", "ref_id": "ref"}).select("dep", "ref", "size", "cap", "viol")

    return query


def unary_counted(config):
    def query(spark, sf_dir):
        relations, layer = unary(spark, sf_dir, config, every=True)
        return named(spark, relations, layer.counted, {"dep_id": "dep", "ref_id": "ref"}).select("dep", "ref", "viol")

    return query


def violation_caps(spark, sf_dir):
    relations, layer = unary(spark, sf_dir, DiscoveryConfig(PARTIAL))
    return named(spark, relations, V.with_caps(layer.stats, DiscoveryConfig(PARTIAL)), {"attr_id": "attr"}).select("attr", "size", "cap")


def partial_degree(spark, sf_dir):
    relations, layer = unary(spark, sf_dir, DiscoveryConfig(PARTIAL))
    found = named(spark, relations, layer.valid, {"dep_id": "dep", "ref_id": "ref"})
    return found.select("dep", "ref", F.round("partial_degree", 9).alias("partial_degree"), F.round("exact_degree", 9).alias("exact_degree"))


def referenced_by(spark, sf_dir):
    relations, layer = unary(spark, sf_dir)
    return named(spark, relations, V.referenced_by(layer.valid), {"ref_id": "ref"}).select("ref", "n_dependents")


def scan(table):
    def query(spark, sf_dir):
        df = tables(spark, sf_dir, [table])[table]
        return df.select(*(normalized(df[c], DiscoveryConfig()).alias(c) for c in COLUMNS[table]))

    return query


def scan_sql(table):
    return f"SELECT {', '.join(f'{c}::VARCHAR AS {c}' for c in COLUMNS[table])} FROM {table}"


def synth_header(spark, sf_dir):
    df = tables(spark, sf_dir, ["region"])["region"]
    return df.select(*(df[c].cast("string").alias(f"column{i}") for i, c in enumerate(COLUMNS["region"])))


def null_normalize(spark, sf_dir):
    df = with_nulls(spark, sf_dir)["items"]
    kept, equal = DiscoveryConfig(null_string="2"), DiscoveryConfig(null_string="2", nulls=Nulls.EQUALITY)
    rows = df.select(normalized(df["line"], kept).alias("as_null"), normalized(df["line"], equal).alias("as_value"))
    return rows.groupBy("as_null", "as_value").agg(F.count(F.lit(1)).alias("n"))


def attr_catalog(spark, sf_dir):
    return attribute_catalog(spark, relations_of(tables(spark, sf_dir))).select("attr_id", "rel_id", "rel", "attr")


def unpivot_values(spark, sf_dir):
    relations = relations_of(tables(spark, sf_dir, SMALL))
    keys = reduce(DataFrame.union, [K.unary_keys(r, DiscoveryConfig()) for r in relations])
    return named(spark, relations, keys, {"attr_id": "attr"}).select("attr", F.col("key").alias("v"))


def value_counts_of(spark, sf_dir, names):
    relations = relations_of(tables(spark, sf_dir, names))
    counts = K.value_counts(reduce(DataFrame.union, [K.unary_keys(r, DiscoveryConfig()) for r in relations]))
    return named(spark, relations, counts, {"attr_id": "attr"}).select("attr", F.col("key").alias("v"), "n")


def value_counts(spark, sf_dir):
    return value_counts_of(spark, sf_dir, ["orders"])


def value_counts_all(spark, sf_dir):
    return value_counts_of(spark, sf_dir, list(SCHEMA))


def value_groups(spark, sf_dir):
    return value_groups_of(spark, sf_dir, SMALL)


def value_groups_all(spark, sf_dir):
    return value_groups_of(spark, sf_dir, list(SCHEMA))


def value_groups_of(spark, sf_dir, names):
    relations = relations_of(tables(spark, sf_dir, names))
    groups = K.value_groups(K.value_counts(reduce(DataFrame.union, [K.unary_keys(r, DiscoveryConfig()) for r in relations])))
    rows = named(spark, relations, groups.select("key", F.explode("members.attr_id").alias("attr_id")), {"attr_id": "attr"})
    return rows.groupBy("key").agg(F.concat_ws(",", F.array_sort(F.collect_list("attr"))).alias("attrs")).select(F.col("key").alias("v"), "attrs")


def attr_stats(spark, sf_dir):
    relations, layer = unary(spark, sf_dir)
    return named(spark, relations, layer.stats, {"attr_id": "attr"}).select("attr", "n_rows", "n_distinct")


def null_counts(spark, sf_dir):
    relations, layer = unary(spark, sf_dir, own=with_nulls(spark, sf_dir))
    return named(spark, relations, layer.stats, {"attr_id": "attr"}).select("attr", "n_rows", "n_distinct", "n_null")


def nonempty_attrs(spark, sf_dir):
    relations, layer = unary(spark, sf_dir, own=with_nulls(spark, sf_dir))
    return named(spark, relations, layer.stats.filter("n_rows > 0"), {"attr_id": "attr"}).select("attr", "n_rows")


def unary_index(spark, sf_dir):
    relations, layer = unary(spark, sf_dir, own=with_nulls(spark, sf_dir))
    rels = names_of(spark, relations).select("rel_id", "rel")
    found = C.unary_index(layer.valid, layer.stats)
    for side in ("dep", "ref"):
        found = found.join(rels.toDF(f"{side}_rel", f"{side}_name"), f"{side}_rel")
    return found.select(F.col("dep_name").alias("dep_rel"), "dep_col", F.col("ref_name").alias("ref_rel"), "ref_col")


def unary_candidates(spark, sf_dir):
    relations = relations_of(tables(spark, sf_dir))
    return named(spark, relations, C.unary_candidates(attribute_catalog(spark, relations)), {"dep_id": "dep", "ref_id": "ref"})


def overlap_counts(spark, sf_dir):
    relations = relations_of(tables(spark, sf_dir))
    sigs = stage(layer_signatures([K.unary_keys(r, DiscoveryConfig()) for r in relations]), "signatures")
    return named(spark, relations, K.overlaps(sigs), {"dep_id": "dep", "ref_id": "ref"}).select("dep", "ref", "n", "keys")


def violating_values(spark, sf_dir):
    relations = relations_of({k: v for k, v in tables(spark, sf_dir, ["lineitem", "supplier"]).items()})
    config, number = DiscoveryConfig(), {a: r.offset + r.columns.index(a) for r in relations for a in r.columns}
    counts = K.value_counts(reduce(DataFrame.union, [K.unary_keys(r, config) for r in relations]))
    side = lambda a: counts.filter(F.col("attr_id") == number[a])
    cases = [("l_suppkey", "s_suppkey"), ("l_partkey", "s_suppkey")]
    found = [V.violating_keys(side(d), side(r)).select(F.lit(d).alias("dep"), F.lit(r).alias("ref"), F.col("key").alias("v"), "n") for d, r in cases]
    return reduce(DataFrame.union, found)


def second_candidates(spark, sf_dir, threshold=1.0):
    relations, layer = unary(spark, sf_dir, DiscoveryConfig(threshold))
    index = C.unary_index(layer.valid, layer.stats)
    return relations, C.extensions(C.described(layer.valid, layer.stats), index)


def nary_candidates_2(spark, sf_dir):
    relations, longer = second_candidates(spark, sf_dir)
    names = names_of(spark, relations)
    for side in ("dep", "ref"):
        own = longer.select(F.col(f"{side}_rel").alias("rel_id"), F.col(f"{side}_cols").alias("cols")).distinct()
        shown = with_names(own, names).select(F.col("rel_id").alias(f"{side}_rel"), F.col("cols").alias(f"{side}_cols"), F.col("attr").alias(side))
        longer = longer.join(shown, [f"{side}_rel", f"{side}_cols"])
    return longer.select("dep", "ref")


def nary_candidates_3(spark, sf_dir):
    """Three-column candidates from the two-column dependencies that hold."""
    relations = relations_of(triples(spark, sf_dir))
    first = first_layer(spark, relations, DiscoveryConfig(PARTIAL))
    index = C.unary_index(first.valid, first.stats)
    second = next_layer(first, index, relations, DiscoveryConfig(PARTIAL))
    pairs = C.described(second.valid, second.stats)
    longer = C.closed(C.extensions(pairs, index), C.described(second.valid, second.stats, with_rows=False), 3)
    names = names_of(spark, relations)
    for side in ("dep", "ref"):
        own = longer.select(F.col(f"{side}_rel").alias("rel_id"), F.col(f"{side}_cols").alias("cols")).distinct()
        shown = with_names(own, names).select(F.col("rel_id").alias(f"{side}_rel"), F.col("cols").alias(f"{side}_cols"), F.col("attr").alias(side))
        longer = longer.join(shown, [f"{side}_rel", f"{side}_cols"])
    return longer.select("dep", "ref")


def nary_counted(config):
    """All two-column candidates of tables with nulls, with their violations."""

    def query(spark, sf_dir):
        relations = relations_of(with_pair_nulls(spark, sf_dir))
        first = first_layer(spark, relations, config)
        second = next_layer(first, C.unary_index(first.valid, first.stats), relations, config, every=True)
        attrs = with_names(second.stats.select("attr_id", "rel_id", "cols"), names_of(spark, relations)).select("attr_id", "attr")
        return second.counted.join(attrs.toDF("dep_id", "dep"), "dep_id").join(attrs.toDF("ref_id", "ref"), "ref_id").select("dep", "ref", "size", "cap", "viol")

    return query


RAGGED = ["a,b,c", '1,,"x"', '2,"",y', "3,z", "4,q,r,s", '5, lead,"l1\nl2"']


def ragged_skip(spark, sf_dir):
    """A delimited file, written here, whose rows 3 and 4 have too few and too many fields."""
    path = f"{shared_dir(spark)}/subsumer/ragged-{uuid.uuid4().hex}"
    rows = spark.createDataFrame([("\n".join(RAGGED),)], "value string").coalesce(1)
    rows.write.text(path)
    return read_delimited(spark, path)


def nary_attrs(spark, sf_dir):
    relations, longer = second_candidates(spark, sf_dir, PARTIAL)
    return with_names(C.interned(longer).select("rel_id", "cols"), names_of(spark, relations)).select("attr")


def apriori_check(spark, sf_dir):
    """Three-column pairs from all two-column candidates as if they held, and those that are closed."""
    _, pairs = second_candidates(spark, sf_dir, PARTIAL)
    pairs = stage(pairs, "pairs")
    index = pairs.select("dep_rel", F.explode(F.arrays_zip("dep_cols", "ref_cols")).alias("z"), "ref_rel").select("dep_rel", F.col("z.dep_cols").alias("dep_col"), "ref_rel", F.col("z.ref_cols").alias("ref_col")).distinct()
    longer = stage(C.extensions(pairs, index), "longer")
    known = C.closed(longer, pairs, 3).withColumn("closed", F.lit(True))
    rows = longer.join(known, ["dep_rel", "dep_cols", "ref_rel", "ref_cols"], "left")
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return rows.select("dep_rel", text("dep_cols").alias("dep"), "ref_rel", text("ref_cols").alias("ref"), F.coalesce("closed", F.lit(False)).alias("closed"))


def pair_keys(spark, sf_dir, own):
    """Keys of the first two columns of items, and of its first and third."""
    relation = relations_of({"items": own})[0]
    attrs = spark.createDataFrame([(0, 0, [0, 1]), (1, 0, [0, 2])], "attr_id long, rel_id int, cols array<int>")
    return K.value_counts(K.nary_keys(relation, attrs, 2, {0, 1, 2}, DiscoveryConfig()))


def nary_keys(spark, sf_dir):
    own = tables(spark, sf_dir, ["orders"])["orders"].select("o_custkey", "o_orderstatus", "o_orderpriority")
    return pair_keys(spark, sf_dir, own).select("attr_id", F.col("key")[0].alias("a"), F.col("key")[1].alias("b"), "n")


def nary_null_rows(spark, sf_dir):
    rows = pair_keys(spark, sf_dir, with_nulls(spark, sf_dir)["items"])
    return rows.groupBy("attr_id", F.col("key").isNull().alias("is_null")).agg(F.sum("n").alias("n"))


def nary_held(threshold, duplicates=Duplicates.AWARE):
    def query(spark, sf_dir):
        found = discover(tables(spark, sf_dir), DiscoveryConfig(threshold, max_nary=2, duplicates=duplicates)).table()
        return found.filter("layer = 2").select("dep", "ref", "size", "cap", "viol")

    return query


def masked(spark, sf_dir, names):
    """Cells of the named tables whose value an exact dependency's dependent side has, in whichever table."""
    relations, layer = unary(spark, sf_dir)
    deps = layer.valid.select(F.col("dep_id").alias("attr_id")).distinct()
    live = reduce(DataFrame.union, [K.unary_keys(r, DiscoveryConfig()) for r in relations]).join(deps, "attr_id", "left_semi").filter("key IS NOT NULL").select("key")
    own = [r for r in relations if r.name in names]
    keys = reduce(DataFrame.union, [K.unary_keys(r, DiscoveryConfig()) for r in own])
    return named(spark, relations, K.mask(keys, live), {"attr_id": "attr"}).groupBy("attr").agg(F.count(F.lit(1)).alias("n"))


def live_value_mask(spark, sf_dir):
    return masked(spark, sf_dir, ["nation", "supplier"])


def live_value_mask_all(spark, sf_dir):
    return masked(spark, sf_dir, list(SCHEMA))


def layer_summary(spark, sf_dir):
    return discover(tables(spark, sf_dir), DiscoveryConfig(PARTIAL, max_nary=2)).summary().drop("seconds")


def shown_nested(spark, sf_dir, max_nary):
    found = nested(discover(tables(spark, sf_dir), DiscoveryConfig(max_nary=max_nary)))
    rows = found.select("layer", "relation", F.explode("dependants").alias("d")).select("layer", "relation", "d.*")
    refs = F.transform("referenced", lambda r: F.concat(r["relation"], F.lit("."), F.concat_ws(",", r["attribute"])))
    return rows.select("layer", "relation", F.concat_ws(",", "dependant").alias("dependant"), F.concat_ws(";", F.array_sort(refs)).alias("referenced"))


def report_nested(spark, sf_dir):
    return shown_nested(spark, sf_dir, 1)


def report_nested_2(spark, sf_dir):
    return shown_nested(spark, sf_dir, 2)


CONFIGS = {
    "unary_exact": DiscoveryConfig(),
    "unary_partial_093": DiscoveryConfig(PARTIAL),
    "unary_partial_unaware": DiscoveryConfig(PARTIAL, duplicates=Duplicates.UNAWARE),
}
NULL_CONFIGS = {f"null_{m.value}": DiscoveryConfig(0.8, nulls=m) for m in Nulls}

QUERIES = {
    "scan_lineitem": scan("lineitem"),
    "scan_events": scan("events"),
    **{f.__name__: f for f in (synth_header, null_normalize, attr_catalog, unpivot_values, value_counts, value_groups, attr_stats, null_counts, nonempty_attrs)},
    **{f.__name__: f for f in (unary_candidates, overlap_counts, violating_values, violation_caps, partial_degree, referenced_by, unary_index)},
    "violations_aware": unary_counted(DiscoveryConfig(PARTIAL)),
    "violations_unaware": unary_counted(DiscoveryConfig(PARTIAL, duplicates=Duplicates.UNAWARE)),
    **{k: unary_held(c) for k, c in CONFIGS.items()},
    **{k: unary_held(c, with_nulls) for k, c in NULL_CONFIGS.items()},
    **{f.__name__: f for f in (nary_candidates_2, nary_attrs, apriori_check, nary_keys, nary_null_rows, live_value_mask, live_value_mask_all, layer_summary, report_nested, report_nested_2)},
    "nary_exact_2": nary_held(1.0),
    "nary_partial_2": nary_held(PARTIAL),
    "nary_unaware_2": nary_held(PARTIAL, Duplicates.UNAWARE),
    **{f.__name__: f for f in (value_counts_all, value_groups_all, nary_candidates_3, ragged_skip)},
    **{f"nary_{k}": nary_counted(c) for k, c in NULL_CONFIGS.items()},
}

_EXACT, _PART = unary_sql(COLUMNS), unary_sql(COLUMNS, PARTIAL)
_UNAWARE = unary_sql(COLUMNS, PARTIAL, aware=False)
_NULLS = unary_sql(NULL_COLUMNS, more=NULL_SQL)
_CATALOG = [(t, c) for t, cs in COLUMNS.items() for c in cs]
_TRIPLES = """
        zipped AS (SELECT dr, d1 AS dc, rr, r1 AS rc FROM nary UNION SELECT dr, d2, rr, r2 FROM nary),
        longer AS (SELECT DISTINCT n.*, z.dc AS d3, z.rc AS r3 FROM nary n JOIN zipped z USING (dr, rr)
                   WHERE z.dc > d2 AND z.rc NOT IN (r1, r2) AND (dr <> rr OR (z.rc NOT IN (d1, d2) AND r1 <> z.dc AND r2 <> z.dc AND z.rc <> z.dc)))"""

ORACLE_SQL = {
    "scan_lineitem": scan_sql("lineitem"),
    "scan_events": scan_sql("events"),
    "synth_header": "SELECT r_regionkey::VARCHAR AS column0, r_name AS column1 FROM region",
    "null_normalize": f"WITH {NULL_SQL} SELECT nullif(line::VARCHAR, '2') AS as_null, coalesce(line::VARCHAR, '2') AS as_value, count(*) AS n FROM items GROUP BY ALL",
    "attr_catalog": "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {list(COLUMNS).index(t)}, '{t}', '{t}.{c}')" for i, (t, c) in enumerate(_CATALOG)) + ") AS x(attr_id, rel_id, rel, attr)",
    "unpivot_values": cells_sql({t: COLUMNS[t] for t in SMALL}),
    "value_counts": f"SELECT attr, v, count(*) AS n FROM ({cells_sql({'orders': COLUMNS['orders']})}) GROUP BY ALL",
    "value_counts_all": f"SELECT attr, v, count(*) AS n FROM ({cells_sql(COLUMNS)}) GROUP BY ALL",
    "value_groups_all": f"SELECT v, string_agg(attr, ',' ORDER BY attr) AS attrs FROM (SELECT DISTINCT attr, v FROM ({cells_sql(COLUMNS)})) GROUP BY v",
    "value_groups": f"SELECT v, string_agg(attr, ',' ORDER BY attr) AS attrs FROM (SELECT DISTINCT attr, v FROM ({cells_sql({t: COLUMNS[t] for t in SMALL})})) GROUP BY v",
    "attr_stats": f"{_EXACT} SELECT attr, n_rows, n_distinct FROM stats",
    "null_counts": f"{_NULLS} SELECT * FROM stats",
    "nonempty_attrs": f"{_NULLS} SELECT attr, n_rows FROM stats WHERE n_rows > 0",
    "unary_candidates": f"{_EXACT} SELECT d.attr AS dep, r.attr AS ref FROM stats d JOIN stats r ON d.attr <> r.attr",
    "overlap_counts": f"{_EXACT} SELECT d.attr AS dep, r.attr AS ref, sum(d.n)::BIGINT AS n, count(*) AS keys FROM kv d JOIN kv r ON d.v = r.v AND d.attr <> r.attr GROUP BY ALL",
    "violating_values": " UNION ALL ".join(
        f"SELECT '{d}' AS dep, 's_suppkey' AS ref, {d}::VARCHAR AS v, count(*) AS n FROM lineitem WHERE {d} NOT IN (SELECT s_suppkey FROM supplier) GROUP BY ALL" for d in ("l_suppkey", "l_partkey")
    ),
    "violation_caps": f"{_PART} SELECT attr, n_rows AS size, trunc((1.0::DOUBLE - {PARTIAL}::DOUBLE) * n_rows)::BIGINT AS cap FROM stats",
    "partial_degree": f"""{_PART} SELECT dep, ref, round(CASE WHEN cap > 0 THEN 1 - viol / cap + {PARTIAL}::DOUBLE * viol / cap ELSE 1.0::DOUBLE END, 9)::DOUBLE AS partial_degree,
        round(CASE WHEN size > 0 THEN 1 - viol / size ELSE 1.0::DOUBLE END, 9)::DOUBLE AS exact_degree FROM held""",
    "referenced_by": f"{_EXACT} SELECT ref, count(*) AS n_dependents FROM held GROUP BY ref",
    "unary_index": f"""{_NULLS}, places(attr, rel, col) AS (VALUES {", ".join(f"('{t}.{c}', '{t}', {i})" for t, cs in NULL_COLUMNS.items() for i, c in enumerate(cs))})
        SELECT d.rel AS dep_rel, d.col AS dep_col, r.rel AS ref_rel, r.col AS ref_col FROM held JOIN places d ON d.attr = dep JOIN places r ON r.attr = ref
        JOIN stats sd ON sd.attr = dep JOIN stats sr ON sr.attr = ref WHERE sd.n_rows > 0 AND sr.n_rows > 0""",
    "violations_aware": f"{_PART} SELECT dep, ref, viol FROM counted",
    "violations_unaware": f"{_UNAWARE} SELECT dep, ref, viol FROM counted",
    "unary_exact": f"{_EXACT} SELECT {PAIR} FROM held",
    "unary_partial_093": f"{_PART} SELECT {PAIR} FROM held",
    "unary_partial_unaware": f"{_UNAWARE} SELECT {PAIR} FROM held",
    **{k: f"{unary_sql(NULL_COLUMNS, 0.8, nulls=c.nulls.value, more=NULL_SQL)} SELECT {PAIR} FROM held" for k, c in NULL_CONFIGS.items()},
    "nary_candidates_2": f"{_EXACT}, {pairs_sql(1.0)} {NARY_NAMES.format(more='', source='nary')}",
    "nary_attrs": f"{_PART}, {pairs_sql(PARTIAL)} SELECT p.attr || ',' || q.attr AS attr FROM sides JOIN places p ON p.rel = sides.rel AND p.col = c1 JOIN places q ON q.rel = sides.rel AND q.col = c2",
    "apriori_check": f"""{_PART}, {pairs_sql(PARTIAL)}, {_TRIPLES},
        rels(rel, id) AS (VALUES {", ".join(f"('{t}', {i})" for i, t in enumerate(COLUMNS))})
        SELECT a.id AS dep_rel, d1 || ',' || d2 || ',' || d3 AS dep, b.id AS ref_rel, r1 || ',' || r2 || ',' || r3 AS ref,
               EXISTS (SELECT 1 FROM nary n WHERE n.dr = l.dr AND n.rr = l.rr AND n.d1 = l.d1 AND n.d2 = l.d3 AND n.r1 = l.r1 AND n.r2 = l.r3)
               AND EXISTS (SELECT 1 FROM nary n WHERE n.dr = l.dr AND n.rr = l.rr AND n.d1 = l.d2 AND n.d2 = l.d3 AND n.r1 = l.r2 AND n.r2 = l.r3) AS closed
        FROM longer l JOIN rels a ON a.rel = dr JOIN rels b ON b.rel = rr""",
    "nary_keys": """SELECT 0::BIGINT AS attr_id, o_custkey::VARCHAR AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY ALL
        UNION ALL SELECT 1::BIGINT, o_custkey::VARCHAR, o_orderpriority, count(*) FROM orders GROUP BY ALL""",
    "nary_null_rows": f"WITH {NULL_SQL} SELECT 0::BIGINT AS attr_id, line IS NULL OR supp IS NULL AS is_null, count(*) AS n FROM items GROUP BY ALL UNION ALL SELECT 1::BIGINT, line IS NULL OR none IS NULL, count(*) FROM items GROUP BY ALL",
    "live_value_mask": f"{_EXACT} SELECT attr, count(*) AS n FROM cells WHERE v IN (SELECT v FROM kv WHERE attr IN (SELECT dep FROM held)) AND (attr LIKE 'nation.%' OR attr LIKE 'supplier.%') GROUP BY attr",
    "live_value_mask_all": f"{_EXACT} SELECT attr, count(*) AS n FROM cells WHERE v IN (SELECT v FROM kv WHERE attr IN (SELECT dep FROM held)) GROUP BY attr",
    "layer_summary": f"""{_PART}, {pairs_sql(PARTIAL)} SELECT 1 AS layer, (SELECT count(*) FROM stats) AS attributes, (SELECT count(*) FROM counted) AS candidates, (SELECT count(*) FROM held) AS valid
        UNION ALL SELECT 2, (SELECT count(*) FROM sides), (SELECT count(*) FROM nary), (SELECT count(*) FROM nary_held)""",
    "report_nested": f"""{_EXACT} SELECT 1 AS layer, split_part(dep, '.', 1) AS relation, split_part(dep, '.', 2) AS dependant, string_agg(ref, ';' ORDER BY ref) AS referenced FROM held GROUP BY ALL""",
    "report_nested_2": f"""{_EXACT}, {pairs_sql(1.0)}, names(rel, col, name) AS (SELECT rel, col, split_part(attr, '.', 2) FROM places),
        found AS (SELECT 1 AS layer, split_part(dep, '.', 1) AS relation, split_part(dep, '.', 2) AS dependant, ref FROM held
                  UNION ALL SELECT 2, dr, p.name || ',' || q.name, rr || '.' || r.name || ',' || s.name FROM nary_held
                  JOIN names p ON p.rel = dr AND p.col = d1 JOIN names q ON q.rel = dr AND q.col = d2 JOIN names r ON r.rel = rr AND r.col = r1 JOIN names s ON s.rel = rr AND s.col = r2)
        SELECT layer, relation, dependant, string_agg(ref, ';' ORDER BY ref) AS referenced FROM found GROUP BY ALL""",
    "nary_exact_2": f"{_EXACT}, {pairs_sql(1.0)} {NARY_NAMES.format(more=', x.size, cap, viol', source='nary_held')}",
    "nary_unaware_2": f"{_UNAWARE}, {pairs_sql(PARTIAL, aware=False)} {NARY_NAMES.format(more=', x.size, cap, viol', source='nary_held')}",
    **{
        f"nary_{k}": f"{unary_sql(PAIR_NULL_COLUMNS, 0.8, nulls=c.nulls.value, more=PAIR_NULL_SQL)}, {pairs_sql(0.8, columns=PAIR_NULL_COLUMNS, nulls=c.nulls.value)} {NARY_NAMES.format(more=', x.size, cap, viol', source='nary_counted')}"
        for k, c in NULL_CONFIGS.items()
    },
    "nary_candidates_3": f"""{unary_sql(TRIPLE_COLUMNS, PARTIAL, more=TRIPLE_SQL)}, {pairs_sql(PARTIAL, columns=TRIPLE_COLUMNS)},
        longer AS (SELECT DISTINCT n.dr, n.rr, n.d1, n.d2, n.r1, n.r2, z.dc AS d3, z.rc AS r3 FROM nary_held n JOIN u1 z USING (dr, rr)
                   WHERE n.size > 0 AND z.dc > d2 AND z.rc NOT IN (r1, r2) AND (dr <> rr OR (z.rc NOT IN (d1, d2) AND r1 <> z.dc AND r2 <> z.dc AND z.rc <> z.dc))),
        names(rel, col, name) AS (SELECT rel, col, attr FROM places)
        SELECT a.name || ',' || b.name || ',' || c.name AS dep, x.name || ',' || y.name || ',' || z.name AS ref FROM longer l
        JOIN names a ON a.rel = dr AND a.col = d1 JOIN names b ON b.rel = dr AND b.col = d2 JOIN names c ON c.rel = dr AND c.col = d3
        JOIN names x ON x.rel = rr AND x.col = r1 JOIN names y ON y.rel = rr AND y.col = r2 JOIN names z ON z.rel = rr AND z.col = r3
        WHERE EXISTS (SELECT 1 FROM nary_held n WHERE n.dr = l.dr AND n.rr = l.rr AND n.d1 = l.d1 AND n.d2 = l.d3 AND n.r1 = l.r1 AND n.r2 = l.r3)
          AND EXISTS (SELECT 1 FROM nary_held n WHERE n.dr = l.dr AND n.rr = l.rr AND n.d1 = l.d2 AND n.d2 = l.d3 AND n.r1 = l.r2 AND n.r2 = l.r3)""",
    "ragged_skip": "SELECT * FROM (VALUES ('1', NULL, 'x'), ('2', NULL, 'y'), ('5', 'lead', 'l1' || chr(10) || 'l2')) AS t(a, b, c)",
    "nary_partial_2": f"{_PART}, {pairs_sql(PARTIAL)} {NARY_NAMES.format(more=', x.size, cap, viol', source='nary_held')}",
}
