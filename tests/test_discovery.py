import random

import pytest
from pyspark.sql import functions as F

from subsumer import DiscoveryConfig, Duplicates, Nulls, discover

from . import brute


def frames(spark, tables):
    return {n: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)) for n, (cols, rows) in tables.items()}


def ours(spark, tables, *args, **kwargs):
    found = discover(frames(spark, tables), DiscoveryConfig(*args, **kwargs)).table()
    return sorted(tuple(r) for r in found.select("layer", "dep", "ref", "size", "cap", "viol").collect())


M1 = {"l": (["a"], [("1",), ("1",), ("2",), ("3",), (None,)]), "r": (["b"], [("1",), ("2",), (None,)])}
BACK = (1, "r.b", "l.a")


@pytest.mark.parametrize(
    ("threshold", "nulls", "aware", "expected"),
    [
        (0.8, Nulls.SUBSET, True, [(*BACK, 2, 0, 0)]),
        (0.8, Nulls.EQUALITY, True, [(*BACK, 3, 0, 0)]),
        (0.75, Nulls.FOREIGN, True, []),
        (0.75, Nulls.INEQUALITY, True, []),
        (0.75, Nulls.SUBSET, True, [(1, "l.a", "r.b", 4, 1, 1), (*BACK, 2, 0, 0)]),
        (0.75, Nulls.EQUALITY, True, [(1, "l.a", "r.b", 5, 1, 1), (*BACK, 3, 0, 0)]),
        (0.75, Nulls.SUBSET, False, [(*BACK, 2, 0, 0)]),
        (0.6, Nulls.SUBSET, False, [(1, "l.a", "r.b", 3, 1, 1), (*BACK, 2, 0, 0)]),
    ],
)
def test_nulls_and_duplicates(spark, threshold, nulls, aware, expected):
    assert ours(spark, M1, threshold, nulls=nulls, duplicates=Duplicates.AWARE if aware else Duplicates.UNAWARE) == expected


def test_three_layers_with_permuted_reference(spark):
    tables = {"s": (["x", "y", "z"], [("1", "a", "A"), ("2", "b", "B")]), "t": (["w", "p", "q"], [("A", "1", "a"), ("B", "2", "b"), ("C", "3", "c")])}
    found = ours(spark, tables)
    assert [(r[1], r[2]) for r in found if r[0] == 3] == [("s.x,s.y,s.z", "t.p,t.q,t.w")]
    assert [(r[1], r[2]) for r in found if r[0] == 2] == [("s.x,s.y", "t.p,t.q"), ("s.x,s.z", "t.p,t.w"), ("s.y,s.z", "t.q,t.w")]
    assert [x.n_candidates for x in discover(frames(spark, tables)).layers] == [30, 3, 1]


def test_same_table_all_null_and_text(spark):
    assert [r[:3] for r in ours(spark, {"u": (["m", "n"], [("1", "1"), ("2", "2")])})] == [(1, "u.m", "u.n"), (1, "u.n", "u.m")]
    nothing = {"v": (["e", "f"], [(None, "9")])}
    assert ours(spark, nothing) == [(1, "v.e", "v.f", 0, 0, 0)]
    assert ours(spark, nothing, nulls=Nulls.INEQUALITY) == []
    assert ours(spark, {"i": (["k"], [("1",), ("2",)]), "j": (["k"], [("01",), ("2.0",)])}) == []


def test_keys_are_injective_and_levels_are_kept(spark):
    tables = {"c": (["k1", "k2"], [("1", "23")]), "d": (["j1", "j2"], [("1", "3"), ("12", "3"), ("12", "23")])}
    assert [r[:3] for r in ours(spark, tables)] == [(1, "c.k1", "d.j1"), (1, "c.k2", "d.j2")]
    # not anti-monotone: (x, y) in (p, q) holds on full rows, but x in p does not
    tables = {"D": (["x", "y"], [("9", None), ("9", None), ("1", "a"), ("2", "a")]), "R": (["p", "q"], [("1", "a"), ("2", "a")])}
    found = ours(spark, tables)
    assert [r[:3] for r in found if r[0] == 2] == [(2, "R.p,R.q", "D.x,D.y")]


def test_pairs_without_rows_count_in_the_subset_check(spark):
    rows = [("1", "x", None), (None, "y", "z")]
    tables = {"s": (["a", "b", "c"], rows), "t": (["p", "q", "r"], rows)}
    found = ours(spark, tables)
    assert found == brute.discover(tables)
    assert {r[1:3] for r in found if r[0] == 3} == {("s.a,s.b,s.c", "t.p,t.q,t.r"), ("t.p,t.q,t.r", "s.a,s.b,s.c")}


def test_columns_are_known_by_place(spark):
    """Names with a dot, repeated, or that differ in case only."""
    rows = [("1", "a", "u"), ("2", "b", "v")]
    one = spark.createDataFrame(rows, "x string, y string, z string").toDF("a.b", "k", "k")
    two = spark.createDataFrame(rows, "x string, y string, z string").toDF("c", "C", "d`e")
    found = discover({"one": one, "two": two}, DiscoveryConfig(max_nary=2)).table()
    got = {(r.layer, r.dep, r.ref) for r in found.collect()}
    assert {(1, "one.a.b", "two.c"), (2, "one.a.b,one.k", "two.c,two.C"), (2, "one.k,one.k", "two.C,two.d`e")} <= got


def test_a_value_that_very_many_columns_share(spark):
    """Signatures of hundreds of attributes, and only candidate pairs beyond the first layer."""
    wide = {f"w{k}": spark.createDataFrame([tuple(["0"] * 40)], ", ".join(f"c{i} string" for i in range(40))) for k in range(3)}
    layer = discover(wide, DiscoveryConfig(max_nary=1)).layers[0]
    assert (layer.n_candidates, layer.n_valid) == (120 * 119, 120 * 119)


def test_pairs_that_share_nothing_are_not_written(spark):
    """A catalogue of 5,000 columns has 25 million ordered pairs, of which six share a key."""
    n = 1000
    tables = {f"t{k}": spark.createDataFrame([tuple("1" if i == 7 and k < 3 else f"{k}-{i}" for i in range(n))], ", ".join(f"c{i} string" for i in range(n))) for k in range(5)}
    layer = discover(tables, DiscoveryConfig(max_nary=1)).layers[0]
    assert (layer.n_candidates, layer.n_valid, layer.counted.count()) == (5000 * 4999, 6, 6)


@pytest.mark.parametrize("nulls", list(Nulls))
@pytest.mark.parametrize("threshold", [1.0, 0.4, 0.0])
def test_pairs_without_a_shared_key_that_hold(spark, nulls, threshold):
    """Empty columns, and caps that cover a whole column."""
    tables = {"a": (["x", "y", "z"], [("1", None, "5"), ("2", None, None)]), "b": (["p"], [("9",), (None,)]), "c": (["q"], [])}
    for mode in Duplicates:
        assert ours(spark, tables, threshold, nulls=nulls, duplicates=mode, max_nary=1) == brute.discover(tables, threshold, nulls.value, mode is Duplicates.AWARE, max_nary=1)


def test_cap_is_truncated_and_degrees(spark):
    tables = {"g": (["k"], [(str(i),) for i in range(10)]), "h": (["k"], [(str(i),) for i in range(9)])}
    assert [r[1] for r in ours(spark, tables, 0.9)] == ["h.k"]
    rows = discover(frames(spark, tables), DiscoveryConfig(0.89)).table().filter("dep = 'g.k'").collect()
    assert [(r.cap, r.viol, round(r.partial_degree, 9), r.exact_degree) for r in rows] == [(1, 1, 0.89, 0.9)]


@pytest.mark.parametrize("seed", range(8))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    tables = {}
    for name, width in (("a", rng.randint(2, 4)), ("b", rng.randint(2, 4))):
        pool = ["1", "2", "3", None] if seed % 2 else ["1", "2", "3", "4", ""]
        base = [tuple(rng.choice(pool) for _ in range(width)) for _ in range(rng.randint(0, 5))]
        tables[name] = ([f"c{i}" for i in range(width)], base * 2 + [tuple(rng.choice(pool) for _ in range(width))])
    nulls = list(Nulls)[seed % 4]
    aware, threshold = seed % 3 != 0, rng.choice([1.0, 0.7, 0.5])
    mode = Duplicates.AWARE if aware else Duplicates.UNAWARE
    assert ours(spark, tables, threshold, nulls=nulls, duplicates=mode) == brute.discover(tables, threshold, nulls.value, aware)


def test_the_three_ways_to_keys_agree(spark, monkeypatch):
    from subsumer.operators import keys

    tables = {"s": (["x", "y"], [("1", "a"), ("2", "b")]), "t": (["p", "q"], [("1", "a"), ("2", "b")])}
    want = ours(spark, tables)
    monkeypatch.setattr(keys, "INLINE_ATTRIBUTES", 0)
    assert ours(spark, tables) == want
    monkeypatch.setattr(keys, "BROADCAST_ATTRIBUTES", 0)
    assert ours(spark, tables) == want
    assert any(r[0] == 2 for r in want)


def test_empty_tables_and_limits(spark):
    tables = {"a": (["x"], []), "b": (["x"], [("1",)])}
    assert ours(spark, tables) == brute.discover(tables)
    with pytest.raises(ValueError, match="no tables"):
        discover({})
    with pytest.raises(ValueError, match="threshold"):
        DiscoveryConfig(1.5)


@pytest.mark.parametrize(("nulls", "mode"), [(Nulls.SUBSET, Duplicates.AWARE), (Nulls.INEQUALITY, Duplicates.UNAWARE)])
def test_keys_in_passes(spark, monkeypatch, nulls, mode):
    """A pass for each part or few of the keys: results are the same, and refuted candidates leave early."""
    from subsumer.operators import keys
    from subsumer.plans import discover as plan

    taken = []
    asked = keys.nary_keys
    monkeypatch.setattr(keys, "nary_keys", lambda relation, attrs, n, needed, config, parts: taken.append((relation.id, n, parts)) or asked(relation, attrs, n, needed, config, parts))
    monkeypatch.setattr(keys, "PARTS", 4)
    monkeypatch.setattr(plan, "KEYS_A_PASS", 80)
    rng = random.Random(31)
    rows = [(str(k), str(rng.randrange(9)), rng.choice(["u", "v", None])) for k in range(100)]
    shuffled = [(a, rows[(k * 7) % 100][1], c) for k, (a, _, c) in enumerate(rows)]
    tables = {"s": (["a", "b", "c"], rows[3:] + rows[5:20]), "t": (["p", "q", "r"], rows[:98]), "w": (["x", "y"], [r[:2] for r in shuffled])}
    want = brute.discover(tables, 0.9, nulls.value, mode is Duplicates.AWARE, max_nary=2)
    assert any(r[0] == 2 and r[5] > 0 for r in want)
    assert ours(spark, tables, 0.9, nulls=nulls, duplicates=mode, max_nary=2) == want
    last = {k: p for k, _, p in taken}
    assert len({p for _, _, p in taken}) > 2
    assert last[2] != last[1]  # pairs of w are refuted before the last pass


@pytest.mark.parametrize("inline", [256, 0])
def test_each_key_is_of_one_part(spark, monkeypatch, inline):
    from subsumer.operators import keys
    from subsumer.operators.catalog import relations_of

    monkeypatch.setattr(keys, "INLINE_ATTRIBUTES", inline)
    table = spark.createDataFrame([(str(k % 40), None if k % 7 == 0 else str(k % 3)) for k in range(300)], "a string, b string")
    relation = relations_of({"t": table})[0]
    attrs = spark.createDataFrame([(0, 0, [0, 1]), (1, 0, [1, 0])], "attr_id long, rel_id int, cols array<int>")
    rows = lambda parts: sorted(map(repr, keys.nary_keys(relation, attrs, 2, {0, 1}, DiscoveryConfig(), parts).collect()))
    some = [rows(range(k, k + 12)) for k in range(0, keys.PARTS, 12)]
    assert sorted(sum(some, [])) == rows(range(keys.PARTS))
    assert all(some) and not any(set(x) & set(y) for k, x in enumerate(some) for y in some[:k])


def test_the_summary_counts_what_passes_refute(spark, monkeypatch):
    """Attributes and candidates of a layer are all of them, also those that leave before the last pass."""
    from subsumer.plans import discover as plan

    rows = [(str(k), str(k * 7 % 60)) for k in range(60)]
    tables = {"s": (["a", "b"], rows), "t": (["p", "q"], [(a, rows[(k + 1) % 60][1]) for k, (a, _) in enumerate(rows)])}
    counts = lambda: [tuple(r)[:4] for r in discover(frames(spark, tables), DiscoveryConfig(0.9, max_nary=2)).summary().collect()]
    whole = counts()
    monkeypatch.setattr(plan, "KEYS_A_PASS", 150)
    assert counts() == whole
    assert whole[1][1:] == (4, 4, 0)


@pytest.mark.parametrize("mode", [Duplicates.AWARE, Duplicates.UNAWARE])
def test_a_pass_shuffles_no_more_than_asked(spark, monkeypatch, mode):
    """Keys that every task has anew are as many rows of a shuffle, however few distinct ones there are."""
    from subsumer.operators import keys
    from subsumer.plans import discover as plan

    taken = {}
    asked = keys.nary_keys

    def watched(relation, attrs, n, needed, config, parts):
        made = asked(relation, attrs, n, needed, config, parts)
        taken[parts] = taken.get(parts, 0) + made.withColumn("task", F.spark_partition_id()).distinct().count() + made.distinct().count()
        return made

    monkeypatch.setattr(keys, "nary_keys", watched)
    monkeypatch.setattr(plan, "KEYS_A_PASS", 2400)
    rows = [(f"a{k}", f"b{k * 7 % 600}") for k in range(600)] * 8
    tables = {name: spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), f"{name}1 string, {name}2 string") for name in "st"}
    assert discover(tables, DiscoveryConfig(0.9, max_nary=2, duplicates=mode)).layers[1].n_valid == 2
    assert len(taken) > 2 and max(taken.values()) < 1.5 * 2400


@pytest.mark.parametrize("nulls", list(Nulls))
def test_keys_that_no_dependent_side_can_have_are_not_shuffled(spark, monkeypatch, nulls):
    """Three values of s.b meet 600 of t.q: other keys of (t.p, t.q) are left out, null ones not, in one pass and in several."""
    from subsumer.operators import keys
    from subsumer.plans import discover as plan

    sent = []
    asked = keys.packed
    monkeypatch.setattr(keys, "packed", lambda made, arity: sent.append(made.count()) or asked(made, arity))
    s = [(str(k), f"v{k % 3}") for k in range(50)]
    t = [(str(k), f"v{k % 3}" if k < 49 else f"w{k}") for k in range(600)] + [(None, "v1"), ("v", None)]
    tables = {"s": (["a", "b"], s), "t": (["p", "q"], t)}
    for mode, rows in ((Duplicates.AWARE, plan.KEYS_A_PASS), (Duplicates.UNAWARE, 600)):
        monkeypatch.setattr(plan, "KEYS_A_PASS", rows)
        sent.clear()
        want = brute.discover(tables, 0.9, nulls.value, mode is Duplicates.AWARE, max_nary=2)
        assert ours(spark, tables, 0.9, nulls=nulls, duplicates=mode, max_nary=2) == want
        if nulls is not Nulls.FOREIGN:
            assert [r[1:] for r in want if r[0] == 2] == [("s.a,s.b", "t.p,t.q", 50, 4, 1)] and sum(sent) <= 50 + 49 + 2


def test_a_pass_is_no_more_than_the_input_allows(spark, tmp_path):
    """However many rows a pass may take, their bytes are reckoned against those of the input."""
    from subsumer.operators.catalog import relations_of
    from subsumer.plans import discover as plan

    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("cast(id as string) a", "cast(id * 7 as string) b").coalesce(1).write.parquet(path)
    one, many = ([spark.read.parquet(path)] * n for n in (1, 20))
    limit = lambda tables: plan.rows_a_pass(relations_of({f"t{k}": t for k, t in enumerate(tables)}))
    assert limit(one) == plan.KEYS_A_PASS / 4
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    old, plan.KEYS_A_PASS = plan.KEYS_A_PASS, 10**4
    try:
        assert limit(many) == pytest.approx(min(10**4, 40 * size / plan.ROW_BYTES), rel=0.1)
    finally:
        plan.KEYS_A_PASS = old
