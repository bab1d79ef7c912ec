"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi.

An Aho-Corasick automaton lists every vocabulary piece that ends at a position; dynamic programming
carries the best score and, with it, only the number of pieces.  Tie rules are those of the public
unigram model: among equal scores the earliest start wins (the longest last piece), a character
without a piece of its own may be unknown at the least score minus ten, neighbouring unknowns are
one token, and with byte fallback each of their bytes is one.

Pieces hold the word mark only at their beginning.  Where scores are whole numbers, so that sums
are exact, a text therefore falls into words whose best paths are independent, and each distinct
word is solved once per worker (in a bounded cache).  Otherwise the whole text is solved at once.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, text_of

MARK = "▁"  # stands for a space
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 600_000
CACHE_WORD = 64

_WORD = re.compile(f"{MARK}*[^{MARK}]*")


class Counter(dict):
    """Word with its mark -> number of pieces."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool = False):
        """pieces: vocabulary with scores, the unknown token not among them."""
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min([*pieces.values(), 0.0]) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.by_word = all(float(s).is_integer() for s in pieces.values()) and not any(MARK in p.lstrip(MARK) for p in pieces) and MARK in pieces

    def solve(self, text: str) -> int:
        """Pieces of the best path over text."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end, matches in enumerate(ends):
            top, start, single = None, 0, False
            for size, score in matches:  # longest first
                found = best[end + 1 - size] + score
                single |= size == 1
                if top is None or found > top:
                    top, start = found, end + 1 - size
            e = end + 1
            if not single and (top is None or best[end] + self.unknown > top):
                best[e], unknown[e] = best[end] + self.unknown, True
                if self.byte_fallback:
                    count[e] = count[end] + len(text[end].encode())
                else:
                    count[e] = count[end] + (not unknown[end])
            else:
                best[e], count[e] = top, count[start] + 1
        return count[n]

    def __missing__(self, word: str) -> int:
        found = self.solve(word)
        if len(word) <= CACHE_WORD:
            self[word] = found
        return found

    def count(self, text: str) -> int:
        """Tokens of a text; a mark is put before it and spaces become marks.  Empty text: none."""
        if not text:
            return 0
        if not self.by_word:
            return self.solve(MARK + text.replace(" ", MARK))
        if len(self) > CACHE_WORDS:
            self.clear()
        if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            return sum(map(self.__getitem__, filter(None, _WORD.findall(MARK + text.replace(" ", MARK)))))
        return sum(map(self.__getitem__, (MARK + text.replace(" ", " " + MARK)).split(" ")))


def pieces_of(content: bytes) -> dict[str, float]:
    """Pieces and scores of a sentencepiece model file, without unknown, control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): model.get_score(i) for i in ids}


_counters: dict = {}


def count_tokens(docs: DataFrame, path: str, byte_fallback: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens long) of every text, one row per input row.  Null and empty texts have 0."""
    vocab = ship(docs.sparkSession, path)

    def run(batches):
        key = (hash(vocab.value), byte_fallback)
        if key not in _counters:
            _counters[key] = Counter(pieces_of(vocab.value), byte_fallback)
        counter = _counters[key]
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long")
