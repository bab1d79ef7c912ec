import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from subsumer.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_codec_equals_the_library(library):
    with open(PATH, "rb") as f:
        codec = bpe.Codec(f.read())
    rng = random.Random(1)
    parts = [*"ab  \n\n\t\x01\x02\x03\x1c\x85 é中'sTll0١²​😀.!|﻿\x00", "<|endoftext|>", "'re", " <|endo", "there", "tion"]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    for _ in range(500):
        ids = [rng.randrange(50_257) for _ in range(6)]  # not always UTF-8
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_rows(spark, docs, odd, library):
    got = sorted(map(tuple, bpe.digest(docs(odd), PATH).collect()), key=repr)
    want = []
    for i, t in odd:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert {r.decoded for r in bpe.encode_decode(docs(odd), PATH).collect()} == {t or "" for _, t in odd}
    assert bpe.digest(docs([]), PATH).collect() == []
