import hashlib
import random
from collections import Counter

import pytest

from subsumer.llm import repeats


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = [(i, gone.index(0, i) if 0 in gone[i:] else len(t)) for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, docs, seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(repeats, "PART", 150)
        monkeypatch.setattr(repeats, "BLOCK_BYTES", 700)
        monkeypatch.setattr(repeats, "BUCKET_BYTES", 300)
    rng = random.Random(seed)
    letters = ["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyzé"][seed % 3]
    length = [8, 20, 50, 20][seed]
    some = lambda n: "".join(rng.choices(letters, k=n))
    pool = [some(rng.randint(5, 150)) for _ in range(8)]
    rows = [(i, "".join(rng.choice(pool) if rng.random() < 0.6 else some(rng.randint(0, 60)) for _ in range(rng.randint(0, 8)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "a" * 400), (60, rows[3][1]), (60, rows[3][1]), (None, pool[0])]
    want = sorted(((repr(i), *b) for (i, _), b in zip(rows, brute([(t or "").encode() for _, t in rows], length), strict=True)), key=repr)
    got = repeats.remove_repeats(docs(rows), length, with_text=True).collect()
    found = [(repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got]
    assert sorted(found, key=repr) == want


def test_usual_length_and_edges(docs, odd):
    passage = " ".join(f"word{k}" for k in range(60))
    rows = [(1, "start one " + passage + " end"), (2, "other " + passage), (3, "nothing of it")]
    got = {r.doc_id: r for r in repeats.remove_repeats(docs(rows)).collect()}
    assert [got[k].n_spans for k in (1, 2, 3)] == [1, 1, 0]
    assert got[3].n_removed == 0 and got[1].n_removed >= len(passage)
    assert len(repeats.remove_repeats(docs(odd)).collect()) == len(odd)
    assert repeats.remove_repeats(docs([])).collect() == []
