import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from subsumer.llm import ctw

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class Plain:
    """The tree by the book, node by node."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for t in texts:
            for context, node, bit in self.decisions(t):
                for d in range(depth + 1):
                    self.counts[context[:d], node][bit] += 1
                    if d < depth:
                        self.children[context[:d], node].add(context[: d + 1])
        self.cache = {}

    def decisions(self, text):
        data = bytes([255] * self.depth) + text + b"\xff"
        for i in range(self.depth, len(data)):
            context = bytes(reversed(data[i - self.depth : i]))
            node = 1
            for j in range(8):
                bit = data[i] >> 7 - j & 1
                yield context, node, bit
                node = node << 1 | bit

    def own(self, key):
        a, b = self.counts[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(self, context, node):
        key = context, node
        if key not in self.cache:
            if len(context) == self.depth:
                self.cache[key] = self.own(key)
            else:
                below = sum(self.weighted(c, node) for c in self.children[key])
                a, b = self.own(key), below
                self.cache[key] = max(a, b) + math.log1p(math.exp(-abs(a - b))) - math.log(2)
        return self.cache[key]

    def one(self, context, node, d=0):
        key = context[:d], node
        if key not in self.counts:
            return 0.5
        a, b = self.counts[key]
        estimate = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return estimate
        share = math.exp(self.own(key) - math.log(2) - self.weighted(*key))
        return share * estimate + (1 - share) * self.one(context, node, d + 1)

    def score(self, text):
        return sum(math.log10(p if bit else 1 - p) for context, node, bit in self.decisions(text) for p in [self.one(context, node)])


def held_out(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_against_the_plain_tree(spark, docs, depth, monkeypatch):
    monkeypatch.setattr(ctw, "CHUNK", 100)
    rng = random.Random(depth)
    rows = [(i, "".join(rng.choices(["the ", "Cat", "s", " ", "\n", "é", "\x00"], k=rng.randint(0, 12)))) for i in range(25)]
    rows += [(100, None), (101, ""), (7, "Cat"), (7, "Cat"), (None, "cats"), (102, "zq" * 150)]
    texts = [(t or "").encode().translate(LOWER) for _, t in rows]
    train = [t for (i, _), t in zip(rows, texts, strict=True) if not held_out(i)]
    model = Plain(train, depth)
    words = Counter(w for t in train for w in [*t.split(), None])
    n, v = sum(words.values()), len(words)
    want = []
    for (i, _), t in zip(rows, texts, strict=True):
        own = [*t.split(), None]
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own)
        want.append((repr(i), held_out(i), len(own), sum(words[w] > 0 for w in own), n, base, model.score(t)))
    got = [(repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ctw.score(docs(rows), depth).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-5, abs=1e-5)


def test_probabilities_sum_to_one_and_learning_helps(spark, docs):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=40))) for i in range(200)]
    got = ctw.score(docs(rows)).collect()
    assert max(r.bits_per_byte for r in got if r.held_out) < 0.6
    assert ctw.score(docs([])).collect() == []
    alone = [i for i in range(50) if held_out(i)][:1]
    only = ctw.score(docs([(alone[0], "ab")])).collect()[0]
    assert (only.train_tokens, only.n_known) == (0, 0)
    assert only.score == pytest.approx(-3 * 8 * math.log10(2))
