"""The pipeline stage by stage on the smallest tables, each against a plain computation."""

import random

import corpus_pipeline as P
import pytest

from subsumer.llm.common import stage


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(2000)]
    rows, toxic = [], set()
    for i in range(400):
        text = rng.choices(words, k=rng.randint(100, 200))
        if i % 9 == 0:
            for _ in range(4):
                text[rng.randrange(100)] = rng.choice(["awful", "nasty", "vile"])
            toxic.add(i)
        rows.append((i, " ".join(text)))
    clean = [r for r in rows if r[0] not in toxic]
    exact = [(1000 + k, clean[k][1]) for k in range(20)]
    near = [(2000 + k, clean[50 + k][1] + " more") for k in range(20)]
    rows += [*exact, *near, (3000, None), (3001, "")]
    folder = str(tmp_path_factory.mktemp("tables"))
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", rng.choice(["a", "a", "a", "b"]), 0) for i, t in rows], shape).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 400)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, dict(rows), toxic


def test_stages(spark, corpus):
    folder, texts, toxic = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for name, function in P.STAGES[:-1]:
        docs = stage(function(spark, docs, folder), name)
        assert docs.columns == columns
        kept.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    clean = set(texts) - toxic
    assert set(kept[0]) == clean
    assert set(kept[1]) == clean - set(range(1000, 1020)) - {3001}
    assert set(kept[2]) == set(kept[1]) - set(range(2000, 2020))
    assert set(kept[3]) == set(kept[2])
    final = P.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted(r.doc_id for r in final) == kept[3]


def test_run(spark, corpus):
    assert P.run(spark, corpus[0]).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
