import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from subsumer.llm import mixing


@pytest.fixture
def corpus(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "big" if rng.random() < 0.6 else rng.choice("abcde")) for i in range(600)]
    rows += [(900, None, "a"), (901, "", None), (902, "x y", None), (5, "t t", "a"), (5, "t t", "a"), (None, "n n n", "b"), (903, "", "silent")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_rows_equal_sql(spark, corpus):
    rows, df = corpus
    got = mixing.mix(df, mixing.Target(evenness=0.9)).toPandas()
    db = duckdb.connect()
    own = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    db.register("documents", own)
    want = db.sql(mixing.oracle(0.9)).df()
    key = ["source", "epoch", "position", "doc_id", "n_tokens", "block"]
    a, b = (x.astype({"doc_id": "float"})[[*key, "weight"]].sort_values(key).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a[key], b[key], check_dtype=False)
    assert np.allclose(a.weight, b.weight)


def test_weights_meet_the_target_and_budgets(spark, corpus):
    rows, df = corpus
    tokens = {}
    for _, t, s in rows:
        tokens[s or ""] = tokens.get(s or "", 0) + len((t or "").split())
    tokens = {s: n for s, n in tokens.items() if n}
    total = sum(tokens.values())
    got = mixing.mix(df, mixing.Target(evenness=0.9)).toPandas()
    weight = got.groupby("source").weight.first()
    entropy = -(weight * np.log(weight)).sum() / np.log(len(tokens))
    assert abs(entropy - 0.9) < 1e-6
    for s, n in got.groupby("source").n_tokens.sum().items():
        assert np.floor(weight[s] * total) <= n < np.floor(weight[s] * total) + 31
    limited = mixing.mix(df, mixing.Target(max_repetition=1.5)).toPandas()
    share = limited.groupby("source").weight.first()
    assert max(share[s] * total / tokens[s] for s in tokens) <= 1.5 + 1e-6


def test_cover_uses_every_text(spark, corpus):
    rows, df = corpus
    got = mixing.mix(df, mixing.Target(evenness=0.95, highest=1.0, budget="cover"), carry=["text", "source"]).toPandas()
    used = set(zip(got.doc_id.fillna(-1), got.text.fillna("")))
    assert {(i if i is not None else -1, t or "") for i, t, s in rows if s != "silent"} == used


def test_empty_and_bad_targets(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string"), mixing.Target(evenness=0.9)).collect() == []
    with pytest.raises(ValueError, match="either"):
        mixing.Target()


def test_cover_keeps_texts_without_tokens(spark):
    """Many wordless texts, some ordered last, in a source whose budget is its own tokens, and a source of nothing else."""
    rows = [(i, "w w" if i % 10 == 0 else "", "one") for i in range(200)] + [(1000 + i, None, "silent") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cover = {"evenness": 0.88, "highest": 1.0, "budget": "cover"}
    got = mixing.mix(df, mixing.Target(**cover)).collect()
    assert sorted(r.doc_id for r in got) == list(range(200))
    got = mixing.mix(df, mixing.Target(**cover, silent=True)).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in rows)
    assert {(r.weight, r.epoch, r.position) for r in got if r.source == "silent"} == {(0.0, 0, 0)}
    none = mixing.mix(df.filter("source = 'silent'"), mixing.Target(**cover, silent=True)).collect()
    assert sorted(r.doc_id for r in none) == list(range(1000, 1009))
    with pytest.raises(ValueError, match="cover"):
        mixing.Target(evenness=0.9, silent=True)
