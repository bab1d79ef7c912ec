"""Token identifiers in a content-addressed store.

Writer: every text is encoded by the public tokenizers library and ended with identifier 0.  A
rolling hash over the identifiers cuts each stream into chunks, a chunk is named by the SHA-256 of
its bytes and stored once, and a document is a recipe of chunk names.  Layout of a store's folder:

    content/kind=0   chunks: name, body (little-endian unsigned integers, 16 bits if the vocabulary allows)
    content/kind=1   recipes as produced
    recipes          recipes in ascending order of the identifier: start, n_ids, names, Merkle leaf
    manifest         for each ordered part: rows, identifiers, Merkle root of its leaves

Reader: bodies are hashed again and compared with their names, recipes with their leaves and the
manifest; a mismatch fails the job.  The CRC of a document is combined from those of its chunks, so
bodies don't move once more.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import HEAD, LINE, UNEVEN, WHOLE, spaced_keys, unmarked
from .common import shared_dir, ship, slices, stage, text_of

SHORTEST, LONGEST = 64, 1024  # identifiers in a chunk, but for a stream's last
MASK = 0xFF  # a cut where these bits of the hash are zero
ROLL = 8  # identifiers in the rolling hash
NAME = 32
TOGETHER = 64  # chunks in one string for the library
END = 0  # identifier that ends a stream


class Broken(RuntimeError):
    """What was read from the store is not what its names and roots say."""


class LibraryChunks:
    """Texts -> identifiers by the library, each distinct chunk of a batch looked up or encoded once.

    A text is cut at single spaces (and line breaks) between non-space characters, where a pre-token
    always ends.  The identifiers of all chunks known so far lie in one pool; new chunks are encoded
    many in a call, set apart by a special token, at which the library cuts before anything else.
    """

    entries = 900_000  # chunks, and the identifiers of their pool, kept from batch to batch
    pool_size = 1 << 23

    def __init__(self, content: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; idle threads would spin
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        added = self.tokenizer.get_added_tokens_decoder()
        special = [(t.content, i) for i, t in added.items() if t.special]
        self.mark, self.mark_id = min(special) if special else (None, None)
        self.added = [t.content.strip() or t.content for t in added.values()]
        kind = json.loads(content)
        pieces = kind.get("pre_tokenizer") or {}
        self.spelt = None  # bytes of each identifier, where the vocabulary is one of bytes
        if pieces.get("type") == "ByteLevel" and not pieces.get("add_prefix_space") and not kind.get("normalizer"):
            self.spelt = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.spelt[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}  # of a chunk in begins and sizes
        self.pool, self.begins, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, keys: list[str]) -> np.ndarray:
        """Encode chunks not known yet and return their places: those that may follow each other in a text
        as they are, the others set apart by a special token, and those that have a token of that kind in
        them one by one."""
        column = pa.array(keys, pa.large_string())
        holds = [pc.match_substring(column, token) for token in self.added]
        alone = np.logical_or.reduce([h.to_numpy(zero_copy_only=False) for h in holds]) if holds else np.zeros(len(keys), bool)
        if self.mark is None:
            alone[:] = True
        lined, *apart = (pc.starts_with(column, mark).to_numpy(zero_copy_only=False).astype(bool) for mark in (LINE, HEAD, WHOLE))
        follows = ~(alone | apart[0] | apart[1]) & (self.spelt is not None)
        pools, sizes, order = [self.pool], [self.sizes], []

        own = np.flatnonzero(follows)
        if len(own):
            own_keys = [keys[k] for k in own.tolist()]
            parts = [own_keys[i : i + TOGETHER] for i in range(0, len(own_keys), TOGETHER)]
            ids = self._library([(" " + " ".join(part)).replace(" " + LINE, "\n") for part in parts])
            length = pc.binary_length(column).to_numpy()[own] + np.where(lined[own], 1 - len(LINE.encode()), 1)
            ends, bytes_to = np.cumsum(self.spelt[ids]), np.cumsum(length)
            places = np.searchsorted(ends, bytes_to)
            if len(ends) and ends[-1] == bytes_to[-1] and (ends[places] == bytes_to).all():
                pools.append(ids)
                sizes.append(np.diff(places, prepend=-1))
                order.append(own)
            else:  # identifiers that don't spell the text
                alone |= follows
        own = np.flatnonzero(~(alone | follows))
        if len(own):
            bodies = [unmarked(keys[k]) for k in own.tolist()]
            ids = self._library([self.mark.join(bodies[i : i + TOGETHER]) + self.mark for i in range(0, len(bodies), TOGETHER)])
            between = ids == self.mark_id
            pools.append(ids[~between])
            sizes.append(np.diff(np.flatnonzero(between), prepend=-1) - 1)
            order.append(own)
        own = np.flatnonzero(alone)
        if len(own):
            found = [self._library([unmarked(keys[k])]) for k in own.tolist()]
            pools += found
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            order.append(own)

        places = np.empty(len(keys), np.int64)
        places[np.concatenate(order)] = np.arange(len(self.sizes), len(self.sizes) + len(keys))
        self.place.update(zip(keys, places.tolist(), strict=True))
        self.pool, self.sizes = np.concatenate(pools), np.concatenate(sizes)
        self.begins = np.cumsum(self.sizes) - self.sizes
        return places

    def _library(self, texts: list[str]) -> np.ndarray:
        """Identifiers of all texts, joined."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.fromiter(chain.from_iterable(x.ids for x in found), np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all texts, each with the end identifier, joined; and each text's number of them."""
        if len(self.place) > self.entries or len(self.pool) > self.pool_size:
            self._forget()
        odd = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False).astype(bool)
        even = texts.take(pa.array(np.arange(len(texts)), mask=odd))
        marked = pc.binary_join_element_wise(HEAD, pc.replace_substring(even, "\n", " " + LINE), "")
        chunks = pc.split_pattern(marked, " ")
        ends = chunks.offsets.to_numpy()[1:] - chunks.offsets[0].as_py()
        coded = chunks.flatten().dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = np.append(coded.indices.to_numpy(), 0)
        odd = np.flatnonzero(odd)
        careful = [spaced_keys(texts[k].as_py()) for k in odd.tolist()]
        if careful:
            keys = dict(zip(known, range(len(known)), strict=True))
            for own in careful:
                for key in own:
                    keys.setdefault(key, len(keys))
            known = list(keys)
        of = np.fromiter(map(self.place.get, known, repeat(-1)), np.int64, len(known))
        new = np.flatnonzero(of < 0)
        if len(new):
            of[new] = self._learn([known[k] for k in new.tolist()])
        begins, sizes = np.append(self.begins[of], 0), np.append(self.sizes[of], 0)
        if careful:  # whose keys come from Python
            counts, by_hand = np.diff(ends, prepend=0), np.zeros(len(texts), bool)
            counts[odd], by_hand[odd] = [len(own) for own in careful], True
            rows, whole = np.repeat(by_hand, counts), np.empty(counts.sum() + 1, np.int64)
            whole[:-1][~rows] = places[:-1]
            whole[:-1][rows] = np.fromiter((keys[key] for own in careful for key in own), np.int64)
            places, ends = whole, np.cumsum(counts)
        each = sizes[places[:-1]]
        total = np.append(0, np.cumsum(each))
        at = np.repeat((begins[places[:-1]] - total[:-1]).astype(np.int32), each)
        at += np.arange(total[-1], dtype=np.int32)  # the pool and a batch have fewer than 2**31 identifiers
        ends = total[ends]
        return np.insert(self.pool[at], ends, END), np.diff(ends, prepend=0) + 1


_libraries: dict[int, LibraryChunks] = {}


def library(content: bytes) -> LibraryChunks:
    key = hash(content)
    if key not in _libraries:
        _libraries[key] = LibraryChunks(content)
    return _libraries[key]


def rolling(ids: np.ndarray) -> np.ndarray:
    """Hash of the ROLL identifiers that end at each place (fewer at the beginning)."""
    x = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    out = np.zeros(len(ids), np.uint32)
    for k in range(min(ROLL, len(ids))):
        out[k:] += x[: len(x) - k] * np.uint32(pow(0x01000193, k, 1 << 32))
    out ^= out >> np.uint32(16)
    return out * np.uint32(0x85EBCA6B) >> np.uint32(7)


def cut_all(ids: np.ndarray, sizes: np.ndarray):
    """(identifiers, ends of their chunks) of each of several joined streams.

    No cut comes before SHORTEST identifiers, so a hash never reaches into the stream before.
    """
    marks = np.flatnonzero((rolling(ids) & np.uint32(MASK)) == 0) + 1
    ends = np.cumsum(sizes)
    first, last = np.searchsorted(marks, ends - sizes, "right").tolist(), np.searchsorted(marks, ends, "right").tolist()
    for begin, end, a, b in zip((ends - sizes).tolist(), ends.tolist(), first, last, strict=True):
        yield ids[begin:end], _ends((marks[a:b] - begin).tolist(), end - begin)


def _ends(marks: list[int], n: int) -> list[int]:
    out, begin, k = [], 0, 0
    while n - begin > SHORTEST:
        while k < len(marks) and marks[k] < begin + SHORTEST:
            k += 1
        begin = min(marks[k] if k < len(marks) else n, begin + LONGEST, n)
        out.append(begin)
    return out if begin == n else [*out, n]


def cut(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one stream.  They depend on the identifiers of the stream alone."""
    return next(cut_all(ids, np.array([len(ids)])))[1]


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node moves up as it is."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    while len(leaves) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = pairs + leaves[len(pairs) * 2 :]
    return leaves[0]


def leaf(identifier, n_ids: int, names: bytes) -> bytes:
    return hashlib.sha256(b"\0%s|%d|" % (str(identifier).encode(), n_ids) + names).digest()


@dataclass(frozen=True)
class Store:
    path: str
    width: int  # bytes of an identifier in a body


def write_store(docs: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Store:
    """Encode all texts and write a store (to a new folder in the shared one unless path is given).

    Null and empty texts are the end identifier alone.  Repeated rows have recipes of their own and
    share chunks.  Null identifiers come first in the order.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/subsumer/store-{uuid.uuid4().hex}"
    vocab = ship(spark, tokenizer_path)
    with open(tokenizer_path, "rb") as f:
        width = LibraryChunks(f.read()).width
    kind = docs.schema[id_col].dataType.simpleString()
    as_stored = f"<u{width}"

    def encode(batches):
        chunks = library(vocab.value)
        sent: set[bytes] = set()
        for batch in slices(batches, 2000):
            recipes, names, bodies = [], [], []
            for ids, ends in cut_all(*chunks.encode(batch.column(1))):
                body, recipe, begin = ids.astype(as_stored).tobytes(), [], 0
                for end in ends:
                    part = body[begin * width : end * width]
                    name = hashlib.sha256(part).digest()
                    recipe.append(name)
                    begin = end
                    if name not in sent:
                        sent.add(name)
                        names.append(name)
                        bodies.append(part)
                recipes.append((len(ids), b"".join(recipe)))
            if len(sent) > 1_000_000:
                sent.clear()  # a name sent twice is merged later
            n, m = len(names), len(recipes)
            ids_of = batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0] * n + [1] * m, pa.int32()),
                    pa.array(names + [None] * m, pa.binary()),
                    pa.array(bodies + [r for _, r in recipes], pa.binary()),
                    pa.concat_arrays([pa.nulls(n, ids_of.type), ids_of]),
                    pa.array([None] * n + [k for k, _ in recipes], pa.int64()),
                ],
                ["kind", "name", "body", "doc_id", "n_ids"],
            )

    shape = f"kind int, name binary, body binary, doc_id {kind}, n_ids long"
    rows = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(encode, shape)
    dealt = rows.repartition("kind", "name", "doc_id").sortWithinPartitions("kind", "name")
    dealt.mapInArrow(_once, shape).write.partitionBy("kind").parquet(f"{path}/content")

    recipes = spark.read.schema(shape).parquet(f"{path}/content").filter("kind = 1").select("doc_id", "n_ids", F.col("body").alias("names"))
    ordered = recipes.repartitionByRange("doc_id", F.xxhash64("names")).sortWithinPartitions("doc_id", F.xxhash64("names"), "names")
    placed = stage(ordered.mapInArrow(_placed, f"part int, place long, doc_id {kind}, first long, n_ids long, names binary, leaf binary, root binary"), "recipes")
    parts = placed.filter("root IS NOT NULL").select("part", F.col("place").alias("rows"), F.col("n_ids").alias("ids"), "root")
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    parts = parts.withColumn("start", F.coalesce(before, F.lit(0)))
    parts.write.parquet(f"{path}/manifest")
    starts = spark.read.schema(parts.schema).parquet(f"{path}/manifest").select("part", "start")
    final = placed.filter("root IS NULL").join(F.broadcast(starts), "part").select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_ids", "names", "leaf", "part", "place")
    final.write.parquet(f"{path}/recipes")
    return Store(path, width)


def _once(batches):
    """Drop chunks whose name is the previous one's; recipes pass."""
    last = None
    for batch in batches:
        name = batch.column(1)
        if len(name):
            same = np.append(last is not None and name[0].is_valid and name[0].as_py() == last, pc.fill_null(pc.equal(name.slice(1), name.slice(0, len(name) - 1)), False).to_numpy(zero_copy_only=False))
            last = name[len(name) - 1].as_py()
            yield batch.filter(pa.array(~same.astype(bool)))


def _placed(batches):
    """Number the recipes of an ordered part; at its end a row with its totals and Merkle root."""
    part, place, ids, leaves, identifiers = TaskContext.get().partitionId(), 0, 0, [], None
    names = ["part", "place", "doc_id", "first", "n_ids", "names", "leaf", "root"]
    for batch in batches:
        n = batch.num_rows
        sizes = batch.column(1).to_numpy(zero_copy_only=False)
        own = [leaf(i, k, r) for i, k, r in zip(batch.column(0).to_pylist(), sizes.tolist(), batch.column(2).to_pylist(), strict=True)]
        leaves += own
        first = ids + np.cumsum(sizes) - sizes
        identifiers = batch.column(0).type
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.int32()), pa.array(np.arange(place, place + n)), batch.column(0), pa.array(first), batch.column(1), batch.column(2), pa.array(own, pa.binary()), pa.nulls(n, pa.binary())], names
        )
        place, ids = place + n, ids + int(sizes.sum())
    if place:
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([place]), pa.nulls(1, identifiers), pa.array([0]), pa.array([ids]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([merkle(leaves)], pa.binary())], names
        )


# ----------------------------------------------------------------------------------------- reader


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, bits reflected."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        bit >>= 1
    return out


_shifts: dict[int, int] = {0: 1 << 31}


def _shift(n_bytes: int) -> int:
    """x to the power of 8 n_bytes, modulo the polynomial."""
    if n_bytes not in _shifts:
        half = _shift(n_bytes // 2)
        found = _times(half, half)
        _shifts[n_bytes] = _times(found, 1 << 23) if n_bytes % 2 else found
    return _shifts[n_bytes]


def combine_crc(first: int, second: int, n_bytes: int) -> int:
    """CRC-32 of two strings joined; n_bytes: length of the second."""
    return _times(_shift(n_bytes), first) ^ second


_operators: list[np.ndarray] = []


def shifted(crcs: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each CRC times x to the power of 8 n_bytes, modulo the polynomial: bit by bit of n_bytes, by tables."""
    out = crcs.astype(np.uint32)
    for bit in range(int(n_bytes.max(initial=0)).bit_length()):
        if bit == len(_operators):
            images = np.array([_times(_shift(1 << bit), 1 << i) for i in range(32)], np.uint32).reshape(4, 8)
            of_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool)
            _operators.append(np.stack([np.bitwise_xor.reduce(np.where(of_bits, row, 0), axis=1) for row in images]).astype(np.uint32))
        own = np.flatnonzero(n_bytes >> bit & 1)
        v, table = out[own], _operators[bit]
        out[own] = table[0][v & 255] ^ table[1][v >> 8 & 255] ^ table[2][v >> 16 & 255] ^ table[3][v >> 24]
    return out


def chunk_facts(store: Store, chunks: DataFrame) -> DataFrame:
    """(name, n, crc: of the identifiers as 32-bit integers) of chunks read, each checked against its name."""
    kind = f"<u{store.width}"

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            sizes, crcs = [], []
            for name, body in zip(names, batch.column(1), strict=True):
                raw = body.as_py()
                if hashlib.sha256(raw).digest() != name:
                    raise Broken(f"chunk {name.hex()} has other bytes")
                sizes.append(len(raw) // np.dtype(kind).itemsize)
                crcs.append(zlib.crc32(np.frombuffer(raw, kind).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["name", "n", "crc"])

    return chunks.select("name", "body").mapInArrow(run, "name binary, n long, crc long")


def _opened(spark: SparkSession, store: Store):
    content = spark.read.schema("kind int, name binary, body binary").parquet(f"{store.path}/content").filter("kind = 0")
    return content, spark.read.parquet(f"{store.path}/recipes")


def _checked(batches):
    for batch in batches:
        for identifier, n_ids, names, want in zip(*(batch.column(i).to_pylist() for i in (2, 4, 5, 6)), strict=True):
            if leaf(identifier, n_ids, names) != want:
                raise Broken(f"recipe of {identifier} has another leaf")
        found = batch.column(7)
        parts = found.flatten()
        at, n, crc = (parts.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        each = pc.list_value_length(found).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(each)), each)
        order = np.lexsort((at, row))
        n, crc = n[order], crc[order]
        first = np.cumsum(each) - each
        so_far = np.cumsum(n)
        totals = np.add.reduceat(n, first)  # a recipe has a chunk at least, its end identifier's
        after = np.repeat(so_far[first] - n[first] + totals, each) - so_far
        crcs = np.bitwise_xor.reduceat(shifted(crc, 4 * after), first)
        named = pc.binary_length(batch.column(5)).to_numpy(zero_copy_only=False)
        if (totals != batch.column(4).to_numpy(zero_copy_only=False)).any() or (each * NAME != named).any():
            raise Broken("a recipe lacks chunks")
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(totals), pa.array(crcs.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _uses(recipes: DataFrame) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0), (F.length("names") / NAME).cast("int") - 1))
    rows = recipes.select("part", "place", "names", at.alias("at"))
    return rows.select("part", "place", "at", F.substring("names", F.col("at") * NAME + 1, F.lit(NAME)).alias("name"))


def verify_manifest(spark: SparkSession, store: Store) -> None:
    """Compare the recipes as read, part by part, with the manifest's Merkle roots."""
    recipes = spark.read.parquet(f"{store.path}/recipes")
    manifest = spark.read.parquet(f"{store.path}/manifest")

    def root(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        return pa.table({"part": table["part"][:1], "rows_read": [len(table)], "root_read": pa.array([merkle(table["leaf"].to_pylist())], pa.binary())})

    read = recipes.select("part", "place", "leaf").groupBy("part").applyInArrow(root, "part int, rows_read long, root_read binary")
    wrong = manifest.join(read, "part", "full").filter("NOT (root <=> root_read AND rows <=> rows_read)")
    if wrong.take(1):
        raise Broken("recipes and manifest differ")


def read_facts(spark: SparkSession, store: Store) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files and checked."""
    verify_manifest(spark, store)
    content, recipes = _opened(spark, store)
    used = _uses(recipes).join(chunk_facts(store, content), "name").groupBy("part", "place").agg(F.collect_list(F.struct("at", "n", "crc")).alias("found"))
    kind = recipes.schema["doc_id"].dataType.simpleString()
    rows = recipes.join(used, ["part", "place"]).select("part", "place", "doc_id", "start", "n_ids", "names", "leaf", "found")
    return rows.mapInArrow(_checked, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, store: Store) -> DataFrame:
    """(doc_id, start, ids array<int>) of every document, reassembled."""
    content, recipes = _opened(spark, store)
    used = _uses(recipes).join(content.select("name", "body"), "name")
    whole = used.groupBy("part", "place").agg(F.array_sort(F.collect_list(F.struct("at", "body"))).alias("parts"))
    width = f"<u{store.width}"
    kind = recipes.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["body"] for p in parts), width).astype(np.int32) for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return recipes.join(whole, ["part", "place"]).select("doc_id", "start", "parts").mapInArrow(run, f"doc_id {kind}, start long, ids array<int>")
