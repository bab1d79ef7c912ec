"""Texts packed into compressed blocks, and values exchanged between blocks by key.

A block is a row that holds some tens of megabytes of rows as one compressed Arrow table; it moves
through a shuffle at a fraction of the texts' size and is the unit to which models computed from the
whole corpus are sent back.
"""

from __future__ import annotations

import ctypes
import ctypes.util

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage

BLOCK_BYTES = 32 << 20
BUCKET_BYTES = 16 << 20  # of text for each bucket of keys


_libc = ctypes.CDLL(ctypes.util.find_library("c"))


def trim() -> None:
    """Give memory that a block needed back to the system; workers are reused and would keep it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


# Cells.  A block's sorted entries are cut where the bucket changes; each bucket that has any gets one
# binary value, so there are never more rows than entries, however many blocks and buckets there are.
# All cells of a block are made, and all cells of a bucket are read, in a few vector operations.


def cuts(bucket: np.ndarray) -> np.ndarray:
    """Where each cell begins; bucket ascends."""
    return np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)


def _cells(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values of joined bytes, given the end of each."""
    offsets = np.append(0, ends).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def joined(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and each value's length."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    whole = (whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)).cast(pa.large_binary())
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(whole) else np.zeros(0, np.uint8)
    return data, np.diff(ends) if len(whole) else np.zeros(0, np.int64)


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of unsigned numbers, seven bits each, the last without the high bit; and each one's length."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1 << 7 * k)
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    begins = ends - sizes
    for k in range(int(sizes.max(initial=0))):
        own = sizes > k
        out[begins[own] + k] = (values[own] >> np.uint64(7 * k)).astype(np.uint8) & 127 | (sizes[own] > k + 1).astype(np.uint8) << 7
    return out, sizes


def _unvarints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and where each ends."""
    ends = np.flatnonzero(data < 128) + 1
    sizes = np.diff(ends, prepend=0)
    begins, out = ends - sizes, np.zeros(len(ends), np.uint64)
    for k in range(int(sizes.max(initial=0))):
        own = sizes > k
        out[own] |= (data[begins[own] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out, ends


def number_cells(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Cells of unsigned numbers, small ones short."""
    data, sizes = _varints(values)
    return _cells(data, np.append(np.cumsum(sizes), 0)[np.append(starts[1:], len(values)) - 1] if len(starts) else starts)


def read_numbers(column) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all cells, joined, and how many each cell has."""
    data, lengths = joined(column)
    values, ends = _unvarints(data)
    return values, np.diff(np.searchsorted(ends, np.cumsum(lengths), "right"), prepend=0)


def sorted_cells(keys: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Cells of unsigned keys that ascend in each cell, as differences."""
    steps = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    steps[starts] = keys[starts]
    return number_cells(steps, starts)


def read_sorted(column) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = read_numbers(column)
    sums = np.cumsum(steps, dtype=np.uint64)
    before = np.append(np.uint64(0), sums)[np.cumsum(counts) - counts]
    return sums - np.repeat(before, counts), counts


def fixed_cells(values: np.ndarray, starts: np.ndarray, width: int) -> pa.Array:
    """Cells of the lowest ``width`` bytes of each number."""
    wide = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return _cells(wide, np.append(starts[1:], len(values)) * width if len(starts) else starts)


def read_fixed(column, width: int) -> np.ndarray:
    data, _ = joined(column)
    wide = np.zeros((len(data) // width, 8), np.uint8)
    wide[:, :width] = data.reshape(-1, width)
    return wide.view("<u8").ravel()


def packed(rows: DataFrame, text_col: str, block_bytes: int | None = None) -> DataFrame:
    """(block long, n_bytes long, n_rows long, blob binary), written to the shared folder.

    A block takes rows of one input partition up to block_bytes of text, or one longer text.
    """
    most = block_bytes or BLOCK_BYTES

    def run(batches):
        first, number, held, size = TaskContext.get().partitionId() << 24, 0, [], 0

        def block():
            nonlocal number, held, size
            table = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table.combine_chunks())
            row = [[first + number], [size], [len(table)], [squeeze(sink.getvalue())]]
            number, held, size = number + 1, [], 0
            trim()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["block", "n_bytes", "n_rows", "blob"])

        for batch in batches:
            ends = np.cumsum([len(t) for t in (x.as_buffer() for x in batch.column(text_col).cast(pa.binary()))], dtype=np.int64)
            begin, done = 0, 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(ends, done + most - size, "right")))
                held.append(batch.slice(begin, end - begin))
                size += int(ends[end - 1]) - done
                begin, done = end, int(ends[end - 1])
                if size >= most or begin < batch.num_rows:
                    yield block()
        if held:
            yield block()

    with small_batches(rows.sparkSession):
        return stage(rows.mapInArrow(run, "block long, n_bytes long, n_rows long, blob binary"), "blocks")


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(expand(blob)).read_all()


def buckets_for(blocks: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets of keys: as many as keep a bucket's share of the corpus about the same."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return int(max(8, -(-total // bucket_bytes)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of a key can choose its bucket."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
