import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from subsumer.llm import simhash as S
from subsumer.llm.components import components


def plain_fingerprint(text, size=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("bands", "brute"), [(4, 256), (6, 256), (4, 4)])
def test_all_close_pairs_are_found(monkeypatch, bands, brute):
    monkeypatch.setattr(S, "BRUTE", brute)
    rng = np.random.default_rng(0)
    found = []
    for base in rng.integers(0, 1 << 63, 30, dtype=np.uint64).tolist():
        for _ in range(20):
            found.append(base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)))
    fps = np.unique(np.array(found, np.uint64)).view(np.int64)
    i, j = np.nonzero(np.triu(np.bitwise_count((fps[:, None] ^ fps[None, :]).astype(np.uint64)) <= 2, 1))
    want = {frozenset(p) for p in zip(fps[i].tolist(), fps[j].tolist(), strict=True)}
    got = set()
    keys = S.band_keys(fps, 2, bands)
    for c in range(keys.shape[1]):
        order = np.argsort(keys[:, c], kind="stable")
        a, b = S.close_pairs(fps[order], np.flatnonzero(np.diff(keys[order, c], prepend=-1)), 2)
        got |= {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == want


def test_rows_against_brute_force(docs, odd):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(50)]
    rows = [(100 + k, " ".join(rng.choices(words, k=300))) for k in range(15)]
    for k in range(60):
        copy = rng.choice(rows)[1].split()
        copy[rng.randrange(len(copy))] = "W%d" % rng.randrange(50)
        rows.append((200 + k, " ".join(copy)))
    rows += odd
    fps = [plain_fingerprint(t) for _, t in rows]
    nodes = sorted(set(fps))
    root = classes(nodes, lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            first[root[f]] = min(i, first.get(root[f], i))
    want = sorted(((i, f"{f:016x}", first.get(root[f])) for (i, _), f in zip(rows, fps, strict=True)), key=repr)
    assert sorted(map(tuple, S.near_duplicates(docs(rows)).collect()), key=repr) == want
    assert len({c for _, _, c in want}) < len(set(fps))
    assert S.near_duplicates(docs([])).collect() == []


def test_components_of_paths_stars_and_noise(spark):
    rng = random.Random(7)
    edges = [(k, k + 1) for k in range(40)] + [(1000, 1000 + k) for k in range(1, 50)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)] + [(5, 5)]
    nodes = sorted({x for e in edges for x in e})
    linked = {frozenset(e) for e in edges}
    root = classes(nodes, lambda a, b: frozenset((a, b)) in linked)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == root[n] for n in nodes)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_copies(docs, odd):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(5000)]
    rows, want = [], {}
    for g in range(20):
        text = rng.choices(words, k=400)
        for k in range(4):
            copy = list(text)
            for _ in range(4 * k):
                copy[rng.randrange(400)] = rng.choice(words)
            rows.append((g * 10 + k, " ".join(copy)))
    sets = {i: set(S.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    root = classes(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r.node: r for r in S.near_copies(docs(rows)).collect()}
    gone = {r.component for r in got.values()}
    want = {root[i] for i in root if list(root.values()).count(root[i]) > 1}
    assert gone <= want and len(gone) >= 0.9 * len(want)
    assert len(got) >= 0.9 * sum(1 for i in root if root[i] in want)
    assert sum(r.stays for r in got.values()) == len(gone)
    fates = S.near_copies(docs(odd)).collect()
    assert all(r.component is not None for r in fates)
    assert S.near_copies(docs([])).collect() == []


def brute_groups(rows, at_least=0.8):
    """Identifier -> smallest of its group, for groups of two or more."""
    sets = {i: set(S.shingle_hashes(t.lower().encode(), 5).tolist()) for i, t in rows}
    root = classes(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= at_least * len(sets[a] | sets[b]))
    sizes = Counter(root.values())
    return {i: r for i, r in root.items() if sizes[r] > 1}


def found_groups(spark, docs, rows):
    own = docs(rows)
    nodes = own.select("doc_id", F.xxhash64("doc_id", "text").alias("node"))
    return {r.doc_id: r.component for r in S.near_copies(own).join(nodes, "node").collect()}


@pytest.mark.parametrize("block", [1024, 50])
def test_long_runs_are_compared_in_full(spark, docs, monkeypatch, block):
    """Hundreds of texts that share a long passage, each alike to few of them."""
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    passage = rng.choices(words, k=90)
    tails = [rng.choices(words, k=30) for _ in range(150)]
    rows = []
    for k in range(600):
        tail = list(tails[k % 150])
        for p in rng.sample(range(30), rng.randint(0, 3)):
            tail[p] = rng.choice(words)
        rows.append((k, " ".join(passage + tail)))
    want = brute_groups(rows)
    assert len(set(want.values())) > 100
    assert found_groups(spark, docs, rows) == want


def test_no_pair_at_the_threshold_is_lost(spark, docs, odd):
    """Pairs at 0.8 or little more, from 8 against 9 words to hundreds of words."""
    rng = random.Random(13)
    words = [f"v{k}" for k in range(4000)]
    rows = []
    for k in range(0, 400, 2):
        text = rng.choices(words, k=8 if k < 200 else rng.randint(40, 400))
        shingles = len(text) - 4
        rows += [(k, " ".join(text)), (k + 1, " ".join([*text, *rng.choices(words, k=shingles // 4)]))]
    want = brute_groups(rows)
    assert len(want) == 400
    assert found_groups(spark, docs, rows) == want
    named = [(5000 + k, t or "") for k, (i, t) in enumerate(odd)]
    assert found_groups(spark, docs, named) == brute_groups(named)


def test_near_copies_come_by_fingerprint(spark, docs, monkeypatch):
    """Without the exact search of the rest, alike texts within two bits are still found."""

    def nothing(batches):
        for batch in batches:
            yield from ()

    monkeypatch.setattr(S, "_shared", nothing)
    rng = random.Random(14)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for g in range(30):
        text = rng.choices(words, k=400)
        rows += [(10 * g + k, " ".join([*text, *rng.choices(words, k=3 * k)])) for k in range(4)]
    sets = {i: set(S.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    prints = {i: plain_fingerprint(t, 5) for i, t in rows}
    root = classes(sorted(sets), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    sizes = Counter(root.values())
    want = {i: r for i, r in root.items() if sizes[r] > 1}
    assert len(set(want.values())) > 5
    assert found_groups(spark, docs, rows) == want
