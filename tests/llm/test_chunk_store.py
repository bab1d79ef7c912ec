import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from subsumer.llm import chunk_store as C

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_crc_of_joined_strings():
    rng = random.Random(3)
    for _ in range(50):
        a, b = rng.randbytes(rng.randint(0, 40)), rng.randbytes(rng.randint(0, 3000))
        assert C.combine_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
        assert C.shifted(np.array([zlib.crc32(a)]), np.array([len(b)]))[0] ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_cuts_depend_on_content():
    ids = np.random.default_rng(0).integers(0, 50_000, 20_000).astype(np.uint32)
    ends = C.cut(ids)
    assert ends[-1] == len(ids)
    sizes = np.diff([0, *ends])
    assert sizes.max() <= C.LONGEST and sizes[:-1].min() >= C.SHORTEST
    shifted = C.cut(np.concatenate([ids[:50] + 1, ids]))
    assert len({e - 50 for e in shifted} & set(ends)) > 0.9 * len(ends)
    assert C.cut(ids[:0]) == []


def test_store_and_read_back(spark, docs, odd):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    rows = odd + [(100 + k, " ".join(rng.choices(["alpha", "beta", "Gamma\n", "delta,"], k=rng.randint(0, 900)))) for k in range(30)]
    store = C.write_store(docs(rows), PATH)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(C.read_facts(spark, store).collect(), key=lambda r: r.start)
    ids = {r.start: r for r in C.read_ids(spark, store).collect()}
    assert [r.doc_id for r in got] == [i for i, _ in ordered]
    at = 0
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t)
    for r in got:
        assert r.start == at
        options = [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts[r.doc_id]]
        mine = next(o for o in options if list(ids[r.start].ids) == o)
        assert (r.n_tokens, r.ids_crc32) == (len(mine), zlib.crc32(np.array(mine, "<u4").tobytes()))
        at += len(mine)
    names = [bytes(r.name) for r in spark.read.parquet(f"{store.path}/content").filter("kind = 0").select("name").collect()]
    assert len(names) == len(set(names))


def test_damage_is_noticed(spark, docs):
    store = C.write_store(docs([(1, "some text"), (2, "other text")]), PATH)
    other = C.write_store(docs([(1, "some text"), (3, "else")]), PATH)
    recipes = spark.read.parquet(f"{other.path}/recipes").collect()
    spark.createDataFrame(recipes, spark.read.parquet(f"{other.path}/recipes").schema).write.mode("overwrite").parquet(f"{store.path}/recipes")
    with pytest.raises(C.Broken):
        C.read_facts(spark, store).collect()


def test_empty_table(spark, docs):
    assert C.read_facts(spark, C.write_store(docs([]), PATH)).collect() == []
