import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from subsumer.llm import unigram_count as U

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    with open(PATH, "rb") as f:
        return U.pieces_of(f.read())


def library_count(pieces, text, fallback=False):
    vocab = [("<unk>", 0.0), *pieces.items()] + [(f"<0x{b:02X}>", 0.0) for b in range(256)] * fallback
    return Tokenizer(models.Unigram(vocab, 0, fallback)), U.MARK + text.replace(" ", U.MARK)


@pytest.mark.parametrize("fallback", [False, True])
def test_counts_equal_the_library(pieces, fallback):
    tokenizer, _ = library_count(pieces, "", fallback)
    counter = U.Counter(pieces, fallback)
    assert counter.by_word
    rng = random.Random(4)
    parts = ["the ", "  ", "tion", "er", "a", "\n", "\t", "é", "中文", "😀", "1234", " in", "ing ", "ß", "zz", "\x00", U.MARK]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        assert counter.count(text) == len(tokenizer.encode(U.MARK + text.replace(" ", U.MARK)).ids), repr(text)


def test_ties_and_fractions():
    for pieces in ({"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "aab": -3.0, "ba": -2.0}, {"▁": -1.5, "a": -0.25, "aa": -0.5, "b": -3.125, "ab": -3.375}):
        tokenizer, _ = library_count(pieces, "")
        counter, rng = U.Counter(pieces), random.Random(5)
        for _ in range(500):
            text = "".join(rng.choices("ab x", k=rng.randint(1, 9)))
            assert counter.count(text) == len(tokenizer.encode(U.MARK + text.replace(" ", U.MARK)).ids), text


def test_rows(docs, odd, pieces):
    got = sorted(map(tuple, U.count_tokens(docs(odd), PATH).collect()), key=repr)
    tokenizer, _ = library_count(pieces, "", True)
    want = [(i, len(tokenizer.encode(U.MARK + t.replace(" ", U.MARK)).ids) if t else 0) for i, t in odd]
    assert got == sorted(want, key=repr)
    assert U.count_tokens(docs([]), PATH).collect() == []
