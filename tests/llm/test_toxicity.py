import math
import random
import zlib

import numpy as np
import pytest

from subsumer.llm import toxicity


@pytest.fixture(scope="module")
def graded():
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        grade = rng.choice([0, 0, 0, 1, 2])
        words = rng.choices([f"w{k}" for k in range(300)], k=60)
        for bad in (["rude", "Nasty!"], ["vile", "Hateful,"])[:grade]:
            words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words), grade))
    return rows


def test_severity_of_unseen_texts(spark, docs, graded):
    df = docs([(i, t) for i, t, _ in graded])
    labels = spark.createDataFrame([(i, g) for i, _, g in graded if i < 1000] + [(5000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [(g, got[i]) for i, _, g in graded if i >= 1000]
    assert np.mean([g == r.grade for g, r in held]) > 0.9
    means = [np.mean([r.expected_severity for g, r in held if g == k]) for k in range(3)]
    assert means[0] < 0.3 < means[1] < means[2]


def test_scores_of_three_grades_by_hand(spark, docs, graded, odd):
    """The whole chain for each text in plain Python: words, features, both thresholds, expected grade."""
    rows = [(i, t) for i, t, _ in graded[:300]] + odd
    labels = spark.createDataFrame([(i, g) for i, _, g in graded[:250]], "doc_id long, toxic int")
    model = toxicity.fit(docs(rows), labels)
    want = []
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode()
        bins = set()
        for word in low.split():
            bare = word.strip(bytes(c for c in range(33, 127) if not chr(c).isalnum())) or word
            bins |= {zlib.crc32(bare) % toxicity.BINS} | {zlib.crc32(bare[:n], n) % toxicity.BINS for n in (4, 5, 6) if len(bare) >= n}
        score = sum(float(model.weights[b]) for b in sorted(bins))
        above = [1 / (1 + math.exp(theta - score)) for theta in model.thresholds]
        shares = [1 - above[0], above[0] - above[1], above[1]]
        want.append((repr(i), sum(above), above[0], shares.index(max(shares))))
    got = [(repr(r.doc_id), r.expected_severity, r.p_toxic, r.grade) for r in toxicity.score(docs(rows), model).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert (a[0], a[3]) == (b[0], b[3]) and a[1:3] == pytest.approx(b[1:3], abs=1e-9)


def test_the_fit_is_a_minimum_and_repeated_identifiers_count_once(spark, docs, graded):
    labels = spark.createDataFrame([(i, g) for i, _, g in graded], "doc_id long, toxic int")
    rows = [(i, t) for i, t, _ in graded]
    model = toxicity.fit(docs(rows), labels)
    again = toxicity.fit(docs(rows + rows[:200]), labels)
    assert np.allclose(model.weights, again.weights, atol=1e-5) and np.allclose(model.thresholds, again.thresholds, atol=1e-5)
    bins = [sorted({b for w in set(t.lower().encode().split()) for b in toxicity.word_bins(w)}) for _, t in rows]
    grades = np.array([g for _, _, g in graded])
    flat = np.repeat(np.arange(len(bins)), [len(b) for b in bins]), np.array([x for b in bins for x in b])
    model = toxicity.fit_arrays(*flat, grades, steps=3000, penalty=0.01)

    def loss(weights, thresholds):
        scores = np.array([weights[b].sum() for b in bins], float)
        below = 1 / (1 + np.exp(scores[:, None] - thresholds[None, :]))
        cdf = np.concatenate([np.zeros((len(bins), 1)), below, np.ones((len(bins), 1))], 1)
        each = np.arange(len(bins))
        return -np.log(cdf[each, grades + 1] - cdf[each, grades]).mean() + 0.005 * (weights.astype(float) ** 2).sum()

    best = loss(model.weights, model.thresholds)
    for scale in (0.8, 1.25):
        assert loss(model.weights * np.float32(scale), model.thresholds) > best
    for k in range(2):
        for step in (-0.3, 0.3):
            moved = model.thresholds.copy()
            moved[k] += step
            assert loss(model.weights, moved) > best


def test_odd_rows_and_columns(spark, docs, odd):
    labels = spark.createDataFrame([(1, 0), (5, 1)], "doc_id long, toxic int")
    df = docs(odd).withColumnRenamed("kept", "grade")
    model = toxicity.fit(df, labels)
    got = toxicity.score(df, model, keep=df.columns).collect()
    assert len(got) == len(odd)
    assert got[0].asDict().keys() == {*df.columns, "expected_severity", "p_toxic"}
    assert toxicity.score(docs([]), model).collect() == []


def test_nothing_to_learn(spark, docs):
    df = docs([(1, "a"), (2, "b")])
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [round(r.expected_severity, 6) for r in toxicity.score(df, none).collect()] == [0.0, 0.0]
    same = toxicity.fit(df, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"))
    assert [r.grade for r in toxicity.score(df, same).collect()] == [1, 1]
