"""Removal of long repeated strings by a content-determined parse (after prefix-free parsing).

Triggers.  A rolling hash is taken of every CORE-byte string, and a string that is the leftmost
minimum among those in some LENGTH-byte window is a trigger; so each such window contains its
trigger, at the same place in every copy of the window, and the triggers cut each text into phrases.

Dictionary.  A phrase's entry is its trigger's CORE bytes and, around them, the hull: all bytes that
windows with this trigger can cover.  Entries of all texts are brought into one order (by rank
fingerprint, where equal strings are adjacent as in a suffix order) and compared with their
neighbours: a core that occurs once rules out its windows, a hull that occurs twice settles them.

Parse.  For what is left, windows near the ends of a repeat, each window (a phrase suffix and what
follows it in the parse) is ordered in the same way and compared with its neighbours.

Ranks are fingerprints of 96 bits and more rather than lexicographic, as only equality of LENGTH bytes
is asked for.  Texts move in compressed blocks; a block's entries go to buckets by fingerprint (as
cells, see blocks.py) and only verdicts come back, in the order in which the block derives the same
entries again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import buckets_for, cuts, fixed_cells, joined, mixed, packed, read_fixed, read_sorted, sorted_cells, trim, unpacked
from .common import release, small_batches, stage, text_of

BLOCK_BYTES = 4 << 20  # of text: entries hardly repeat within a block, so small ones cost little
BUCKET_BYTES = 32 << 20
WINDOW_BUCKETS = 16  # times as many buckets, as there is an entry for each open window, up to one a byte
PART = 1 << 18  # bytes of a part without margins; places in a part take 20 bits
PLACE = np.uint64((1 << 20) - 1)


class Roller:
    """Hashes of all substrings of a part, from prefix sums modulo 2**64."""

    _tables: dict = {}

    def __init__(self, data: np.ndarray, which: int):
        if which not in self._tables:
            base = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[which]
            n = 1 << 20
            up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(which))
            self._tables[which] = np.cumprod(up), np.cumprod(down), values
        up, self.down, values = self._tables[which]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])

    def at(self, begins: np.ndarray, size: int) -> np.ndarray:
        return mixed((self.sums[begins + size] - self.sums[begins]) * self.down[begins])


class Parts:
    """A block's texts, as parts of whole texts or, of a longer text, pieces with margins."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, length: int):
        """data: the texts' bytes, joined; sizes: of each text."""
        self.length = length
        self.core = length // 2 + 4 if length > 16 else max(1, length // 2)
        self.reach = length - self.core  # a window's trigger begins up to here after the window
        self.data, self.sizes = data, sizes
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes

    def spans(self):
        """(first text, text after the last, own begin, own end, begin and end with margins)."""
        k, n = 0, len(self.sizes)
        while k < n:
            if self.sizes[k] > PART:
                for a in range(int(self.begins[k]), int(self.ends[k]), PART):
                    b = min(a + PART, int(self.ends[k]))
                    yield k, k + 1, a, b, max(int(self.begins[k]), a - self.reach - 1), min(int(self.ends[k]), b + self.length + self.reach)
                k += 1
                continue
            last = int(np.searchsorted(self.ends, self.begins[k] + PART, "right"))
            yield k, last, int(self.begins[k]), int(self.ends[last - 1]), int(self.begins[k]), int(self.ends[last - 1])
            k = last

    def scan(self, span):
        """Runs of windows with one trigger: (trigger, first, last window, counted here) and the entries.

        All places are the block's.  A run that began in the piece before is not counted again.
        """
        first, last, a, b, low, high = span
        data = self.data[low:high]
        none = np.zeros(0, np.int64)
        if high - low < self.length:
            return (none, none, none, np.zeros(0, bool)), none.astype(np.uint64), none.astype(np.uint64)
        keys = Roller(data, 0).every(self.core)
        keys = (keys & ~PLACE) | np.arange(len(keys), dtype=np.uint64)
        window = self.reach + 1
        width = 1
        while width * 2 <= window:
            keys = np.minimum(keys[:-width], keys[width:])
            width *= 2
        if width < window:
            rest = window - width
            keys = np.minimum(keys[:-rest], keys[rest:])
        text = np.repeat(np.arange(first, last), np.minimum(self.ends[first:last], high) - np.maximum(self.begins[first:last], low))
        starts = np.arange(low, low + len(keys))
        own = (starts + self.length <= self.ends[text[: len(keys)]]) & (starts >= a - 1) & (starts < b)
        starts, trigger = starts[own], (keys[own] & PLACE).astype(np.int64) + low
        new = np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (starts[1:] != starts[:-1] + 1)]) if len(starts) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        tails = np.concatenate([heads[1:], [len(starts)]]) - 1 if len(heads) else heads
        t, s0, s1 = trigger[heads], starts[heads], starts[tails]
        counted = s0 >= a
        s0 = np.maximum(s0, a)
        keep = s1 >= a
        t, s0, s1, counted = t[keep], s0[keep], s1[keep], counted[keep]
        hashes = mixed(~Roller(data, 0).at(t - low, self.core))  # minima crowd at small values; buckets are ranges
        of = text[t - low]
        whole = (t - self.reach >= self.begins[of]) & (t + self.length <= self.ends[of])
        hull = np.zeros(len(t), np.uint64)
        hull[whole] = np.maximum(Roller(data, 1).at(t[whole] - self.reach - low, self.length + self.reach), np.uint64(1))
        return (t, s0, s1, counted), hashes, hull


class Entries:
    """Distinct (a, b) pairs in order, with whether they occur once or more.

    A bucket is a range of a, which is a finished hash, so buckets follow the same order.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, counted: np.ndarray, buckets: int):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        head = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        first = np.flatnonzero(head)
        self.of = np.empty(len(a), np.int32)  # entry of each given pair
        self.of[order] = np.cumsum(head, dtype=np.int32) - 1
        self.times = np.minimum(np.add.reduceat(counted[order].astype(np.int32), first), 2).astype(np.uint8) if len(first) else np.zeros(0, np.uint8)
        self.a, self.b = a[first], b[first]
        self.bucket = ((self.a >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)

    def rows(self, block: int, width: int) -> pa.RecordBatch:
        """A row for each bucket; width: bytes of b that travel."""
        at = cuts(self.bucket)
        where = [pa.array(np.full(len(at), block)), pa.array(self.bucket[at])]
        return pa.RecordBatch.from_arrays([*where, sorted_cells(self.a, at), fixed_cells(self.b, at, width), fixed_cells(self.times, at, 1)], NAMES)


#: Bytes of b that travel: a hull is compared among all entries with its core, so it keeps all; a window's
#: first 64 bits are its own already.
HULL, WINDOW = 8, 4
ENTRY = "block long, bucket long, a binary, b binary, times binary"
NAMES = ["block", "bucket", "a", "b", "times"]


def verdicts(width: int):
    def run(table: pa.Table) -> pa.Table:
        found = _verdicts(table, width)
        trim()
        return found

    return run


def _verdicts(table: pa.Table, width: int) -> pa.Table:
    """For each block's entries of one bucket: 0 if a occurs once in the corpus, 2 or 3 if (a, b)
    occurs more than once, else 1.  Where a occurs with other b, too, one entry of each repeated
    (a, b) gets the 3: it still has to show its windows to the others'.  b = 0 never counts as equal.
    """
    a, sizes = read_sorted(table["a"])
    b = read_fixed(table["b"], width)
    times = read_fixed(table["times"], 1)
    order = np.lexsort((b, a))
    out = np.zeros(len(a), np.uint8)
    if len(a):
        x, y, n = a[order], b[order], times[order].astype(np.int64)
        del a, b, times
        new = np.append(True, x[1:] != x[:-1])
        newer = new | np.append(True, y[1:] != y[:-1])
        heads, first = np.flatnonzero(new), np.flatnonzero(newer)
        several = np.add.reduceat(newer, heads, dtype=np.int64) > 1  # b in a group
        of = np.searchsorted(heads, first, "right") - 1  # group of each (a, b)
        totals = np.add.reduceat(n, first)
        equal = (totals > 1) & (y[first] != 0)
        verdict = np.where(equal, 2, np.add.reduceat(n, heads)[of] > 1).astype(np.uint8)
        found = np.repeat(verdict, np.diff(np.append(first, len(x))))
        found[first[equal & several[of]]] = 3
        out[order] = found
    flags = fixed_cells(out, np.cumsum(sizes) - sizes, 1)
    return pa.table({"block": table["block"], "bucket": table["bucket"], "flags": flags})


def _texts(blob: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A block's rows, its texts' bytes as they lie in memory, and their sizes."""
    table = unpacked(blob)
    column = table["text"].combine_chunks()
    column = (column.chunk(0) if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return table, data, np.diff(ends)


class Block:
    """What the rounds derive from a block's texts."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, length: int, buckets: int):
        self.parts, self.buckets = Parts(data, sizes, length), buckets
        self.spans = list(self.parts.spans())
        runs, cores, hulls = zip(*(self.parts.scan(s) for s in self.spans), strict=True) if self.spans else ((), (), ())
        self.counts = [len(c) for c in cores]
        join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
        self.first, self.last = (join([r[i] for r in runs], np.int64) for i in (1, 2))
        self.phrases = Entries(join(cores, np.uint64), join(hulls, np.uint64), join([r[3] for r in runs], bool), buckets)

    def settled(self, flags: np.ndarray) -> np.ndarray:
        """Whether the windows of each run are repeated (2, 3), not (0) or open (1)."""
        return flags[self.phrases.of]

    def open_windows(self, state: np.ndarray):
        """Windows that phrases leave open or that have to be shown to such, and their entries."""
        starts, a, b, begin = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
        for span, count in zip(self.spans, self.counts, strict=True):
            mine = np.arange(begin, begin + count)[state[begin : begin + count] & 1 == 1]
            begin += count
            if not len(mine):
                continue
            sizes = self.last[mine] - self.first[mine] + 1
            own = np.repeat(self.first[mine] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            low, data = span[4], self.parts.data[span[4] : span[5]]
            starts.append(own)
            a.append(Roller(data, 0).at(own - low, self.parts.length))
            b.append(np.maximum(Roller(data, 1).at(own - low, self.parts.length) >> np.uint64(32), np.uint64(1)))
        starts, a, b = (np.concatenate(x) for x in (starts, a, b))
        return starts, Entries(a, b, np.ones(len(starts), bool), self.buckets * WINDOW_BUCKETS)

    def covered(self, state: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bytes inside a repeated window: of the settled runs, and of the windows that start at ``starts``."""
        change = np.zeros(len(self.parts.data) + 1, np.int8)  # of each kind at most one begins and ends at a place
        sure = state >= 2
        change[self.first[sure]] += 1
        change[self.last[sure] + self.parts.length] -= 1
        change[starts] += 1
        change[starts + self.parts.length] -= 1
        out, carried = np.empty(len(change) - 1, bool), 0
        for begin in range(0, len(out), PART):
            depth = np.cumsum(change[begin : min(begin + PART, len(out))], dtype=np.int32) + carried
            out[begin : begin + PART], carried = depth > 0, int(depth[-1])
        return out


def _flags(answers: pa.Table, which: int) -> np.ndarray:
    """Verdicts of a block's entries, in their order."""
    own = answers.filter(pc.equal(answers["which"], which)).sort_by("bucket")
    return joined(own["flags"])[0] if len(own) else np.zeros(0, np.uint8)


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Find and remove each byte in a ``length``-byte string that also starts elsewhere in the corpus.

    Elsewhere includes another place in the same text; overlaps count; strings are judged on the
    input and never cross texts.  Returns, one row per input row: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, spans array<struct<begin long, end long>> (removed bytes, end exclusive) and, with
    with_text, kept binary (what remains; it may cut a character).  Null and short texts keep all.
    """
    if length < 8:
        raise ValueError("length must be 8 or more")
    rows = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    blocks = packed(rows, "text", BLOCK_BYTES).select("block", "n_bytes", "blob")
    buckets = buckets_for(blocks, BUCKET_BYTES)
    blocks = blocks.select("block", "blob")

    def phrases(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Block(*_texts(blob.as_py())[1:], length, buckets)
                yield found.phrases.rows(block, HULL)
                del found
                trim()

    def windows(own: pa.Table, answers: pa.Table) -> pa.Table:
        out = [pa.table({n: pa.array([], pa.int64() if k < 2 else pa.binary()) for k, n in enumerate(NAMES)})]
        for block, blob in zip(own["block"].to_pylist(), own["blob"], strict=True):
            found = Block(*_texts(blob.as_py())[1:], length, buckets)
            _, entries = found.open_windows(found.settled(_flags(answers, 0)))
            out.append(pa.Table.from_batches([entries.rows(block, WINDOW)]))
            del found, entries
        trim()
        return pa.concat_tables(out)

    def finish(own: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for blob in own["blob"]:
            table, data, sizes = _texts(blob.as_py())
            found = Block(data, sizes, length, buckets)
            state = found.settled(_flags(answers, 0))
            starts, entries = found.open_windows(state)
            gone = found.covered(state, starts[_flags(answers, 1)[entries.of] >= 2])
            results = []
            for begin, end in zip(found.parts.begins.tolist(), found.parts.ends.tolist(), strict=True):
                text, own_gone = data[begin:end].tobytes(), gone[begin:end]
                if not own_gone.any():
                    results.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), [], text if with_text else None))
                    continue
                edges = np.flatnonzero(np.diff(own_gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                kept = data[begin:end][~own_gone].tobytes()
                spans = [{"begin": x, "end": y} for x, y in edges.tolist()]
                results.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept if with_text else None))
            columns = list(zip(*results, strict=True))
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            made = {"doc_id": table["doc_id"]}
            for name, column, t in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()), strict=True):
                if with_text or name != "kept":
                    made[name] = pa.array(column, t)
            out.append(pa.table(made))
            del found, data, table, gone, starts, entries
            trim()
        return pa.concat_tables(out)

    answer = "block long, bucket long, flags binary"
    with small_batches(docs.sparkSession):
        judged = blocks.mapInArrow(phrases, ENTRY).groupBy("bucket").applyInArrow(verdicts(HULL), answer)
        first = stage(judged.withColumn("which", F.lit(0)), "verdicts")
    del judged
    release(docs.sparkSession)
    with small_batches(docs.sparkSession):
        judged = blocks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(windows, ENTRY).groupBy("bucket").applyInArrow(verdicts(WINDOW), answer)
        second = stage(judged.withColumn("which", F.lit(1)), "verdicts")
    del judged
    release(docs.sparkSession)
    shape = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: long, end: long>>"
    return blocks.groupBy("block").cogroup(first.union(second).groupBy("block")).applyInArrow(finish, shape + (", kept binary" if with_text else ""))
