"""Byte-level BPE: encode with a priority queue of merge ranks, decode by concatenation.

A pre-token is a doubly linked list of symbols.  Every adjacent pair that has a merge rank is in a
heap as (rank, position).  The smallest is popped; if the pair at that position no longer has that
rank the entry is stale and skipped, otherwise the right symbol is unlinked and the two new pairs
are pushed.  Equal ranks go left to right, as in the public library.

Texts are cut into chunks at single spaces and line breaks between two non-space characters, where
a pre-token always ends; the identifiers of a chunk are kept in a bounded cache, so the queue runs
once per distinct chunk.  Other white space stays inside a chunk and goes through the pre-tokenizer.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of

#: How the public byte-level format splits text and writes bytes as characters.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

#: Chunks that a cache holds before it is emptied, and the longest chunk that it takes.
CACHE_ENTRIES = 600_000
CACHE_CHUNK = 64

_SPACED = re.compile(r"(?<=\S) (?=\S)")
#: First characters of cache keys: start of the text, a line break before, the key spelt out.
HEAD, LINE, WHOLE = "\x02", "\x01", "\x03"
#: Texts for the careful split: white space but single spaces and line breaks inside, or the marks.
UNEVEN = "[\\x00-\\x09\\x0b-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]|^[ \\n]|[ \\n]$|^$"


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next from U+0100."""
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(PRINTABLE) else chr(next(spare)) for b in range(256)]


class Codec:
    """Vocabulary and merges of one byte-level BPE file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        vocab: dict[str, int] = spec["model"]["vocab"]
        chars = byte_chars()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.of_byte = [vocab[c] for c in chars]
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[a] << 21 | vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [b""] * size
        for s, i in vocab.items():
            self.strings[i] = bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        self.decimal = [b"%d" % i for i in range(size)]
        self._cut = regex.compile(PRE_TOKEN)
        marks = sorted(self.special, key=len, reverse=True)
        self._marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        self.chunks = _Chunks(self)

    def encode_piece(self, piece: str) -> list[int]:
        """Identifiers of one pre-token."""
        merge = self.merge
        sym = [self.of_byte[b] for b in piece.encode()]
        n = len(sym)
        if n == 1:
            return sym
        heap = []
        for i in range(n - 1):
            m = merge.get(sym[i] << 21 | sym[i + 1])
            if m:
                heap.append(m[0] << 32 | i)
        if not heap:
            return sym
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i] if sym[i] >= 0 else n
            if j >= n:
                continue  # stale: unlinked, or nothing to its right
            m = merge.get(sym[i] << 21 | sym[j])
            if m is None or m[0] != top >> 32:
                continue  # stale: the pair has changed
            sym[i], sym[j] = m[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merge.get(sym[i] << 21 | sym[k])
                if m:
                    heapq.heappush(heap, m[0] << 32 | i)
            k = before[i]
            if k >= 0:
                m = merge.get(sym[k] << 21 | sym[i])
                if m:
                    heapq.heappush(heap, m[0] << 32 | k)
        return [s for s in sym if s >= 0]

    def encode_chunk(self, chunk: str) -> bytes:
        out: list[int] = []
        for piece in self._cut.findall(chunk):
            out += self.encode_piece(piece)
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Identifiers of a whole text as little-endian 32-bit integers.

        Strings of special tokens in the text become those tokens, as the library does by default.
        """
        if not text:
            return b""
        if self._marks and any(m in text for m in self.special):
            parts = self._marks.split(text)
            return b"".join(
                np.array([self.special[p]], "<u4").tobytes() if k % 2 else self.encode_plain(p) for k, p in enumerate(parts)
            )
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        return encode_with(self.chunks, text)

    def decode(self, ids: list[int]) -> str:
        """Text of the identifiers; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class Spaced(Exception):
    """A chunk has white space in it or is empty, so the text needs the careful split."""


class _Chunks(dict):
    """Chunk of a text -> identifiers; a leading mark tells what stood before the chunk."""

    def __init__(self, codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, key: str) -> bytes:
        found = self.codec.encode_chunk(unmarked(key))
        if len(key) <= CACHE_CHUNK:
            self[key] = found
        return found


def unmarked(key: str) -> str:
    """The text that a cache key stands for; Spaced if it may not have been cut off there."""
    head = key[:1]
    if head == WHOLE:
        return key[1:]
    body = key[1:] if head in (HEAD, LINE) else key
    if body.split() != [body]:
        raise Spaced
    return body if head == HEAD else ("\n" if head == LINE else " ") + body


def plain_keys(text: str) -> list[str]:
    """The cache keys of a text by the quick split; none if the text has the marks themselves."""
    if not text or LINE in text or HEAD in text or WHOLE in text:
        return []
    return (HEAD + text.replace("\n", " " + LINE)).split(" ")


def spaced_keys(text: str) -> list[str]:
    """The cache keys of any text by the careful split; none of the empty text."""
    if not text:
        return []
    first, *rest = _SPACED.split(text)
    return [WHOLE + first, *(WHOLE + " " + w for w in rest)]


def encode_with(cache: dict, text: str) -> bytes:
    """The values of a text's chunks, joined; cache has or makes the value of a key."""
    if not text:
        return b""
    if len(cache) > getattr(cache, "limit", CACHE_ENTRIES):
        cache.clear()
    keys = plain_keys(text)
    if keys:
        try:
            return b"".join(map(cache.__getitem__, keys))
        except Spaced:
            pass
    return b"".join(map(cache.__getitem__, spaced_keys(text)))


_codecs: dict[int, Codec] = {}


def codec_of(content: bytes) -> Codec:
    """One codec per vocabulary and Python worker; its cache outlives a task."""
    key = hash(content)
    if key not in _codecs:
        _codecs[key] = Codec(content)
    return _codecs[key]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode the identifiers again.

    Returns (doc_id, ids binary: little-endian 32-bit integers, decoded string), one row per input
    row, repeated rows included.  Null and empty text: no identifiers and the empty text.
    """
    vocab = ship(docs.sparkSession, path)

    def run(batches):
        codec = codec_of(vocab.value)
        for batch in batches:
            ids = [codec.encode(t) for t in batch.column(1).to_pylist()]
            texts = [codec.decode(np.frombuffer(i, "<u4").tolist()) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of :func:`encode_decode`'s work.

    The same codec in the same pass, with the digests taken before the rows leave Python.
    """
    vocab = ship(docs.sparkSession, path)

    def run(batches):
        codec = codec_of(vocab.value)
        decimal, strings = codec.decimal.__getitem__, codec.strings.__getitem__
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column(1):
                ids = np.frombuffer(codec.encode(text.as_py()), "<u4").tolist()
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(b",".join(map(decimal, ids))).hexdigest())
                back = b"".join(map(strings, ids)).decode("utf-8", "replace")
                of_text.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
