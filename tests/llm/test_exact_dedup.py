import hashlib
import random
from collections import defaultdict

import pytest

from subsumer.llm.exact_dedup import content_sort


def check(rows, got, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    by_text = defaultdict(list)
    for r in got:
        by_text[r.text_sha256].append(r)
    assert len(got) == len(rows)
    assert len(by_text) == len(groups)
    for text, ids in groups.items():
        found = by_text[hashlib.sha256(text.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        best = (min(known) if keep == "smallest" else max(known)) if known else None
        assert sorted(map(repr, (r.doc_id for r in found))) == sorted(map(repr, ids))
        assert {r.keep_id for r in found} == {best}
        assert {r.group_size for r in found} == {len(ids)}
        assert [r.doc_id for r in found if r.kept] == [best]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_odd_rows(docs, odd, keep):
    check(odd, content_sort(docs(odd), keep=keep).collect(), keep)
    assert content_sort(docs([]), keep=keep).collect() == []


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_a_hot_text_over_many_partitions(spark, docs, keep):
    rng = random.Random(2)
    prefix = "p" * 40
    rows = [(i, prefix if rng.random() < 0.4 else prefix + rng.choice(["", "a", "b", str(i)])) for i in range(3000)]
    rng.shuffle(rows)
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(rows, content_sort(docs(rows), keep=keep).collect(), keep)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def test_carried_columns_and_bad_option(docs):
    rows = content_sort(docs([(1, "a"), (2, "a")]), carry=["text", "source"]).filter("kept").collect()
    assert [(r.doc_id, r.text, r.source) for r in rows] == [(1, "a", "s")]
    with pytest.raises(ValueError, match="keep"):
        content_sort(docs([]), keep="first")
