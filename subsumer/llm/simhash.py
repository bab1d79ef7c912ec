"""SimHash near-duplicates, joined through tables of distances to reference fingerprints (pivots).

The pivots are zero and the masks of 32 two-bit segments.  A fingerprint's table is its Hamming
distance to each of them.  By the triangle inequality two fingerprints within k bits differ by k or
less in every coordinate; and since a flipped bit changes the coordinate of one segment only (taken
relative to the distance to zero), at most k of B bands of segments can have unequal coordinates.
So fingerprints meet under a key for each choice of B - k bands whose coordinates must agree, pairs
whose largest coordinate difference is over k are discarded, and the survivors are verified bit by
bit.  This loses no pair.  Equal fingerprints are merged first, links become components, and a
component is named by its smallest identifier.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lower_ascii, release, sieve, sifted, slices, stage, text_of
from .components import components

SEED = 42
SEGMENT = 2
SEGMENTS = 64 // SEGMENT
#: Reference fingerprints: zero, then the mask of each segment.
PIVOTS = np.array([0, *(((1 << SEGMENT) - 1) << SEGMENT * s for s in range(SEGMENTS))], np.uint64)
BRUTE = 256  # runs up to here are compared pair by pair


def shingle_hashes(raw: bytes, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words (all words if there are fewer), repeats included."""
    words = raw.split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(raw: bytes, size: int) -> int:
    """Signed 64-bit SimHash: a bit is 1 if it is set in over half of the shingle hashes."""
    return fingerprint_of(shingle_hashes(raw, size))


def fingerprint_of(hashes: np.ndarray) -> int:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row.  Texts without words (null, empty) have fingerprint 0."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t.as_py(), size) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), lower_ascii(text_of(docs, text_col)).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def distances(fps: np.ndarray) -> np.ndarray:
    """The pivot distance table: [fingerprint, pivot]."""
    return np.bitwise_count(fps.astype(np.uint64)[:, None] ^ PIVOTS[None, :]).astype(np.int16)


def coordinates(table: np.ndarray) -> np.ndarray:
    """What each segment adds to the distance to zero, from the table alone: [fingerprint, segment]."""
    return (table[:, :1] + SEGMENT - table[:, 1:]) // 2


def _code(coords: np.ndarray, segments) -> np.ndarray:
    out = np.zeros(len(coords), np.int64)
    for s in segments:
        out = out * (SEGMENT + 1) + coords[:, s]
    return out


def band_keys(fps: np.ndarray, k: int, bands: int) -> np.ndarray:
    """[fingerprint, choice]: a 64-bit key for each choice of bands - k bands."""
    coords = coordinates(distances(fps))
    split = np.array_split(np.arange(SEGMENTS), bands)
    choices = list(combinations(range(bands), bands - k))
    out = np.empty((len(fps), len(choices)), np.int64)
    for c, choice in enumerate(choices):
        code = _code(coords, [s for b in choice for s in split[b]])  # below 3**32 < 2**51
        out[:, c] = code * len(choices) + c
    return out


def survivors(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), those within k bits: first by largest coordinate difference, then by bits."""
    near = np.abs(table[i] - table[j]).max(1, initial=0) <= k
    i, j = i[near], j[near]
    close = np.bitwise_count((fps[i] ^ fps[j]).astype(np.uint64)) <= k
    return i[close], j[close]


def close_pairs(fps: np.ndarray, starts: np.ndarray, k: int, segments=tuple(range(SEGMENTS))) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within k bits inside each run; starts: where runs of fps begin.

    A run over BRUTE is split again by the coordinates of ``segments`` before any comparison.
    """
    sizes = np.diff([*starts, len(fps)])
    table, left, right = distances(fps), [], []
    small = np.repeat(sizes <= BRUTE, sizes)
    remaining = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(fps)) - 1  # of the run, after a place
    at, step = np.flatnonzero(small & (remaining > 0)), 1
    while len(at):
        for part in np.array_split(at, len(at) // 100_000 + 1):
            i, j = survivors(fps, table, part, part + step, k)
            left.append(fps[i])
            right.append(fps[j])
        step += 1
        at = at[remaining[at] >= step]
    for begin, size in zip(np.asarray(starts)[sizes > BRUTE].tolist(), sizes[sizes > BRUTE].tolist(), strict=True):
        run = fps[begin : begin + size]
        parts = np.array_split(np.array(segments, int), k + 2)
        if len(segments) < k + 2:
            for x in range(0, size, BRUTE):
                i, j = (v.ravel() for v in np.meshgrid(np.arange(x, min(x + BRUTE, size)), np.arange(x, size), indexing="ij"))
                i, j = survivors(run, table[begin : begin + size], i[i < j], j[i < j], k)
                left.append(run[i])
                right.append(run[j])
            continue
        coords = coordinates(table[begin : begin + size])
        for choice in combinations(range(k + 2), 2):
            code = _code(coords, [s for b in choice for s in parts[b]])
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.diff(code[order], prepend=-1))
            rest = tuple(int(s) for b in range(k + 2) if b not in choice for s in parts[b])
            i, j = close_pairs(run[order], cuts, k, rest)
            left.append(i)
            right.append(j)
    none = np.zeros(0, fps.dtype)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few of the pairs as connect the same nodes."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    out = np.array(kept, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def links(fps: DataFrame, k: int = 2, bands: int = 4) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all that are within k bits.

    fps: a column fp, without repeats.  Where several pairs connect the same fingerprints in a
    task, a spanning forest of them is returned.  More bands give longer keys: exact either way.
    """
    if not 0 < k < bands:
        raise ValueError("bands must be more than k, and k positive")

    def keys(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            found = band_keys(own, k, bands)
            yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(np.repeat(own, found.shape[1]))], ["key", "fp"])

    def join(batches):
        held_key, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in _with_end(batches):
            key = held_key if batch is None else np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
            own = held if batch is None else np.concatenate([held, batch.column(1).to_numpy(zero_copy_only=False)])
            cut = len(key) if batch is None else int(np.searchsorted(key, key[-1])) if len(key) else 0
            held_key, held = key[cut:], own[cut:]
            if cut:
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(key[:cut]) != 0]))
                a, b = forest(*close_pairs(own[:cut], cuts, k))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = fps.select("fp").mapInArrow(keys, "key long, fp long")
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(join, "a long, b long")


def _with_end(batches):
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, size: int = 3, k: int = 2, bands: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint: 16 hex digits, component_id: smallest identifier reachable), row by row.

    Texts without words have fingerprint 0 and link like any other.  Null identifiers keep their
    row and never name a component, unless it has no other.
    """
    rows = stage(fingerprints(docs, size, id_col, text_col), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes, k, bands)).withColumnRenamed("node", "fp")
    linked = roots.union(roots.select(F.col("root").alias("fp"), "root").distinct()).join(classes, "fp")
    named = linked.join(linked.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    named = classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ------------------------------------------------------------- near copies at a Jaccard similarity

SKETCH, WIDE = 4, 32  # words of a sketch, and of the one that single pairs are compared by
SAMPLE, FREQUENT = 8000, 65_536  # texts sampled for shingles that are common, and most of them
HELD = 1 << 18  # pairs of a task held to tell repeated ones
BLOCK = 1024  # larger runs are dealt into blocks of about so many, and each pair of blocks compared


def sketch(shingles: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Longs of parities: two sets differ in as many shingles as their sketches in bits, or more."""
    counts = np.bincount((shingles >> np.uint64(48)).astype(np.int64) % (64 * words), minlength=64 * words)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


SPARE = 0.05  # of a set's shingles: by so many its prefix is longer than one shared shingle needs
STARS = 2  # rounds of stars around random members, after those around the least


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """As many of the rarest shingles as any set of that similarity must share one of (of its own prefix),
    and spare ones: two such sets a and b share 1 + min(spare(a), spare(b)) of their prefixes.

    common: sorted hashes of shingles that come last, in the order of ranks.  Any order is exact.
    """
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        shingles = shingles[np.argsort(np.where(common[at] == shingles, ranks[at], 0), kind="stable")]
    return shingles[: len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-9)) + 1 + int(SPARE * len(shingles))]


def _common_shingles(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of the most common shingles of a sample, and their places from 1; they only set an order."""
    every = max(1, rows.count() // SAMPLE)

    def run(batches):
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t.as_py(), size)).view(np.int64) for t in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], ["shingle"])

    counts = rows.filter(F.pmod("node", F.lit(every)) == 0).select("text").mapInArrow(run, "shingle long").groupBy("shingle").count()
    found = [r.shingle for r in counts.filter("count > 2").orderBy("count", "shingle", ascending=False).limit(FREQUENT).collect()]
    hashes, ranks = np.array(found[::-1], np.int64).view(np.uint64), np.arange(1, len(found) + 1)
    order = np.argsort(hashes)
    return hashes[order], ranks[order]


def _prefixes(size: int, similarity: float, common):
    def run(batches):
        hashes, ranks = common.value
        for batch in slices(batches):
            # texts without words are alike: one shingle that stands for none
            sets, fps = [], []
            for t in batch.column(1).cast(pa.binary()):
                found = shingle_hashes(t.as_py(), size)
                fps.append(fingerprint_of(found))
                sets.append(np.unique(found))
            sets = [s if len(s) else np.zeros(1, np.uint64) for s in sets]
            words = np.stack([sketch(s) for s in sets]) if sets else np.zeros((0, SKETCH), np.int64)
            keys = pa.array([prefix(s, similarity, hashes, ranks).view(np.int64) for s in sets], pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            wide = pa.array([sketch(s, WIDE) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, *(pa.array(words[:, k]) for k in range(SKETCH)), wide, pa.array(fps, pa.int64()), keys], ["node", "n", *(f"w{k}" for k in range(SKETCH)), "wide", "fp", "keys"])

    return run


def _whole_runs(batches, by: int):
    """Columns of whole runs: rows equal in the first ``by`` columns, by which they arrive sorted."""
    held = None
    for batch in _with_end(batches):
        if batch is not None:
            own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = own if held is None else [np.concatenate(p) for p in zip(held, own, strict=True)]
        if held is None or not len(held[0]):
            continue
        starts = np.append(0, np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:by]], axis=0)) + 1)
        cut = len(held[0]) if batch is None else int(starts[-1])
        if cut:
            yield [c[:cut] for c in held], starts[starts < cut]
            held = [c[cut:] for c in held]


def _shared(batches):
    """Rows, once each, of keys that two nodes or more have, with the least node of the key and their number."""
    for (key, node, n, place), _ in _whole_runs(batches, 1):
        once = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        key, node, n, place = key[once], node[once], n[once], place[once]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        many = np.repeat(sizes > 1, sizes)
        out = [key, node, n, place, np.repeat(node[starts], sizes), np.repeat(sizes, sizes)]
        yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in out], ["key", "node", "n", "place", "first", "members"])


def _cross_pairs(similarity: float):
    """All pairs of each run that are not of one group yet, less those that proven bounds exclude.

    A run is a key's nodes, or those of two blocks of them.  A pair whose shingles from a shared one
    on are too few is left to the first key that it shares.
    """

    def found(batches):
        for (_, low, high, block, node, n, place, group, *words), starts in _whole_runs(batches, 3):
            sizes = np.diff(np.append(starts, len(node)))
            remaining = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(node)) - 1
            at, step = np.flatnonzero(remaining > 0), 1
            while len(at):
                for i in np.array_split(at, len(at) // 100_000 + 1):
                    j = i + step
                    apart = (group[i] != group[j]) & ((low[i] == high[i]) | (block[i] != block[j]))
                    i, j = i[apart], j[apart]
                    both = n[i] + n[j]
                    need = np.ceil(both * similarity / (1 + similarity) - 1e-9)  # shingles to be shared
                    bits = sum((np.bitwise_count((w[i] ^ w[j]).view(np.uint64)).astype(np.int64) for w in words), np.zeros(len(i), np.int64))
                    spare = np.floor(SPARE * np.minimum(n[i], n[j]))  # as many shared ones before may have been left out
                    near = (np.minimum(n[i] - place[i], n[j] - place[j]) >= need - spare) & (bits <= both - 2 * need)
                    a, b = node[i[near]], node[j[near]]
                    if len(a):
                        yield np.minimum(a, b), np.maximum(a, b)
                step += 1
                at = at[remaining[at] >= step]

    def run(batches):
        """Texts that share many keys come up again and again: once each, as far as HELD pairs go."""
        none = np.zeros(0, np.int64)
        a, b, more, n = none, none, [], 0
        for pair in _with_end(found(batches)):
            if pair is not None:
                more.append(pair)
                n += len(pair[0])
                if n < HELD:
                    continue
            a, b = (np.concatenate([x, *(p[k] for p in more)]) for k, x in enumerate((a, b)))
            order = np.lexsort((b, a))
            a, b, more, n = a[order], b[order], [], 0
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
            a, b = a[new], b[new]
            if len(a) and (pair is None or len(a) >= HELD):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                a, b = none, none

    return run


def _shingle_sets(size: int):
    def run(batches):
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t.as_py(), size)).view(np.int64) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return run


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", k: int = 2, bands: int = 4) -> DataFrame:
    """Groups of texts linked by a Jaccard similarity of word-shingle sets of ``similarity`` or more.

    First come the SimHash fingerprints of all texts and their links within ``k`` bits, through the
    tables of distances to pivots (``links``), each verified on the whole sets.  Alike texts may be
    more bits apart, so the rest, pairs that are not of one group by then, is searched exactly.
    That search loses no pair: two such sets share some of their rarest shingles (prefix filter), also
    after each has left out those of its keys that most texts have (fewer, for both, than they share),
    and pairs are discarded only by their sizes, the places of the shared shingle and the bits in which
    their sketches differ, all of which bound the shingles they share.  There each text is compared
    first with the least node of each of its keys, then with random nodes of keys that still have several
    groups; then all pairs that are not in one group yet, where keys of many nodes are compared by
    pairs of blocks.  Every link is verified on the whole sets.

    Returns (node long, component: smallest identifier of the group, stays boolean) for texts in a
    group of two or more, where node is xxhash64(identifier, text): repeated rows share a node and a
    fate.  One node of each group stays, the one with the smallest identifier (nulls last).
    """
    own = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text")).withColumn("node", F.xxhash64("doc_id", "text"))
    rows = own.select("node", lower_ascii(F.col("text")).alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(_common_shingles(rows, size))
    names = [f"w{k}" for k in range(SKETCH)]
    longs = ", ".join(f"{w} long" for w in names)
    sets = stage(rows.mapInArrow(_prefixes(size, similarity, common), f"node long, n long, {longs}, wide array<long>, fp long, keys array<long>"), "prefixes")
    keyed = sets.select(F.posexplode("keys").alias("place", "key"), "node", "n").select("key", "node", "n", F.col("place").cast("long").alias("place"))
    shape = "key long, node long, n long, place long, first long, members long"
    every = stage(keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared, shape), "shared")
    release(docs.sparkSession)
    # each of a pair leaves out s / (1 + s) of its spare ones at most: together, no more than either has
    common_first = Window.partitionBy("node").orderBy(F.desc("members"), "key")
    left_out = F.floor((F.col("n") * SPARE - 1) * F.lit(similarity / (1 + similarity)))
    shared = stage(every.withColumn("rank", F.row_number().over(common_first)).filter(F.col("rank") > left_out).drop("rank"), "shared")
    discard(every)
    bits = sets.drop("keys", "wide", "fp").distinct()

    def ends(some: DataFrame, of, table: DataFrame) -> DataFrame:
        """Pairs with a column of both nodes, as s and t; ``of`` makes the column from the nodes' rows."""
        asked = sieve(some.select(F.explode(F.array("a", "b")).alias("node")), "node")  # so that other rows stay where they are
        own = of(sifted(table, "node", asked).filter("_maybe")).dropDuplicates(["node"])
        return some.join(own.toDF("a", "s"), "a").join(own.toDF("b", "t"), "b")

    def verified(some: DataFrame) -> DataFrame:
        """The pairs that are alike: first by the wide sketches, a proven bound, then by the whole sets."""
        pairs = ends(some, lambda r: r.select("node", F.struct("n", "wide")), sets)
        bits_apart = F.aggregate(F.zip_with("s.wide", "t.wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        near = stage(pairs.filter(bits_apart <= (F.col("s.n") + F.col("t.n")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)).select("a", "b"), "near")
        both = ends(near, lambda r: r.select("node", "text").mapInArrow(_shingle_sets(size), "node long, shingles array<long>"), rows)
        shared = F.size(F.array_intersect("s", "t"))
        found = stage(both.filter(shared >= F.lit(similarity) * (F.size("s") + F.size("t") - shared)).select("a", "b"), "links")
        discard(near)
        return found

    def grouped(roots: DataFrame) -> DataFrame:
        named = roots.union(roots.select("root", "root").distinct()).withColumnRenamed("root", "group")
        return bits.join(named, "node", "left").withColumn("group", F.coalesce("group", "node"))

    classes = stage(sets.groupBy("fp").agg(F.min("node").alias("first")), "classes")
    equal = sets.select("fp", "node").distinct().join(classes, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    close = links(classes, k, bands).distinct().join(classes.toDF("a", "s"), "a").join(classes.toDF("b", "t"), "b").select(F.least("s", "t"), F.greatest("s", "t"))
    near = stage(equal.union(close), "close")
    by_print = verified(near)
    discard(classes, near)
    release(docs.sparkSession)
    roots = components(by_print)
    stars = shared.filter("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    left = grouped(roots).select(F.col("node").alias("a"), F.col("group").alias("g"), F.col("n").alias("m"), *(F.col(w).alias(f"x{k}") for k, w in enumerate(names)))
    right = grouped(roots).select(F.col("node").alias("b"), F.col("group").alias("h"), "n", *(F.col(w).alias(f"y{k}") for k, w in enumerate(names)))
    apart = sum((F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in range(SKETCH)), F.lit(0))
    most = (F.col("m") + F.col("n")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)
    stars = stars.join(left, "a").join(right, "b").filter("g <> h").filter((apart <= most) & (F.abs(F.col("m") - F.col("n")) <= most)).select("a", "b")
    stars = stage(stars, "stars")
    first = verified(stars)
    discard(stars, roots)
    release(docs.sparkSession)
    found, roots, told = [by_print, first], components(by_print.union(first)), F.struct("node", "group", "n", *names)
    for salt in range(STARS + 1):
        open_rows = stage(shared.drop("first", "n").join(grouped(roots), "node"), "open")
        centre = F.min_by(told, F.xxhash64("node", "key", F.lit(salt))).alias("c")
        mixed = open_rows.groupBy("key").agg(F.min("group").alias("g"), F.max("group").alias("h"), centre).filter("g <> h")
        if salt == STARS:
            break
        pairs = open_rows.join(mixed, "key").filter("group <> c.group")
        apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"c.{w}"))) for w in names), F.lit(0))
        most = (F.col("n") + F.col("c.n")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)
        pairs = pairs.filter((apart <= most) & (F.abs(F.col("n") - F.col("c.n")) <= most)).select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
        pairs = stage(pairs, "stars")
        discard(open_rows, roots)
        found.append(verified(pairs))
        discard(pairs)
        release(docs.sparkSession)
        roots = components(reduce(DataFrame.union, found))
    mixed = mixed.select("key")
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("long")
    dealt = open_rows.join(mixed, "key", "left_semi").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "n", "place", "group", *names)
    runs = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    rest = stage(runs.mapInArrow(_cross_pairs(similarity), "a long, b long").distinct(), "rest")
    discard(shared, open_rows, roots)
    release(docs.sparkSession)
    last = verified(rest)
    roots = components(reduce(DataFrame.union, [*found, last]))
    discard(*found, last, rest, sets)
    members = roots.union(roots.select("root", "root").distinct())
    ids = own.select("node", "doc_id").join(members, "node").distinct()
    stay = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col("node").alias("node"))
    keeper = ids.groupBy("root").agg(F.min(stay).alias("m"))
    return ids.join(keeper, "root").select("node", F.col("m.doc_id").alias("component"), (F.col("node") == F.col("m.node")).alias("stays"))
