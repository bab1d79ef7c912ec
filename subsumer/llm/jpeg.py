"""Baseline JPEG columns: a codec whose decoder stops at the DC coefficients.

Decoder: markers are parsed, the entropy-coded segments are freed of stuffing and cut at restart
markers, and all segments of a batch are Huffman-decoded in lock step with numpy, one table look-up
per symbol.  AC symbols are decoded and skipped; the DC coefficients give a luminance thumbnail of
one sample per 8x8 block, whose size and 64-bit average hash are the stored features.

Writer: a payload becomes the DC plane of a grey image, one byte per 8x8 block (with a DC quantiser
of 8 the block's luminance is the byte itself), a restart marker every 64 blocks.  Coefficients are
the format's unit, so this is lossless.  A payload over the largest image continues in another one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

ROW = 64  # blocks in a restart interval; payloads are padded to a multiple of it
MAX_BLOCKS = 8191  # blocks along one side: 65,535 samples at most
GROUP = 1 << 19  # payload bytes coded together, unless one image alone is larger

#: Fixed values of the format: counts of code lengths 1 to 16 and values of the usual DC table.
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_VALUES = tuple(range(12))
#: Only "end of block", as the writer makes no AC coefficients.
AC_LENGTHS = (1, *[0] * 15)
AC_VALUES = (0,)


class Malformed(ValueError):
    """The bytes are not a baseline JPEG that this decoder reads."""


def codes(lengths, values) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length) of a canonical Huffman table."""
    out, code, k = {}, 0, 0
    for bits, count in enumerate(lengths, 1):
        for _ in range(count):
            out[values[k]] = (code, bits)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(lengths, values) -> np.ndarray:
    """For each 16-bit window: 256 times the symbol that it begins with, plus its code's length (0: none)."""
    table = np.zeros(1 << 16, np.uint16)
    for value, (code, bits) in codes(lengths, values).items():
        table[code << 16 - bits : code + 1 << 16 - bits] = value << 8 | bits
    return table


# ---------------------------------------------------------------------------------------- writer


def _pairs() -> tuple[np.ndarray, np.ndarray]:
    """For a DC difference plus 255: the bits of difference and end of block, and their number."""
    table, (eob, eob_bits) = codes(DC_LENGTHS, DC_VALUES), codes(AC_LENGTHS, AC_VALUES)[0]
    value, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        code, bits = table[n]
        extra = d if d > 0 else d + (1 << n) - 1
        value[d + 255], size[d + 255] = ((code << n | extra) << eob_bits) | eob, bits + n + eob_bits
    return value, size


_VALUE, _SIZE = _pairs()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(wide: int, high: int, payload: int) -> bytes:
    tables = b"".join(_segment(0xC4, bytes([kind]) + bytes(lens) + bytes(vals)) for kind, lens, vals in ((0x00, DC_LENGTHS, DC_VALUES), (0x10, AC_LENGTHS, AC_VALUES)))
    return (
        b"\xff\xd8"
        + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
        + _segment(0xFE, b"payload %d" % payload)
        + _segment(0xDB, b"\0" + bytes([8] * 64))
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, high * 8, wide * 8, 1, 1, 0x11, 0))
        + tables
        + _segment(0xDD, struct.pack(">H", ROW))
        + _segment(0xDA, b"\1\1\0\0\x3f\0")
    )


def shape_of(n: int) -> tuple[int, int]:
    """Blocks across and down for a payload of n bytes, at most MAX_BLOCKS each."""
    wide = ROW * -(-n // (ROW * MAX_BLOCKS))
    return wide, -(-n // wide)


def _scan(rows: np.ndarray, numbers: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of intervals of ROW bytes each, markers included, and where each ends."""
    q = rows.astype(np.int64)
    q[:, 1:] -= rows[:, :-1]
    q[:, 0] -= 128
    q += 255
    value, size = _VALUE[q], _SIZE[q]
    upto = np.cumsum(size, 1)
    total = upto[:, -1]
    n_bytes = (total + 7) >> 3
    start = np.cumsum(n_bytes) - n_bytes
    at = (upto - size + (start * 8)[:, None]).ravel()
    value = value.ravel() << (24 - (at & 7) - size.ravel())
    at >>= 3
    length = int(n_bytes.sum())
    packed = sum(np.bincount(at + k, ((value >> (16 - 8 * k)) & 255).astype(np.float64), length + 2)[:length] for k in range(3)).astype(np.uint8)
    packed[start + n_bytes - 1] |= ((1 << (n_bytes * 8 - total)) - 1).astype(np.uint8)
    full = packed == 255
    place = np.arange(length) + np.cumsum(full) - full + 2 * np.repeat(np.arange(len(rows)), n_bytes)
    out = np.zeros(length + int(full.sum()) + 2 * len(rows), np.uint8)
    out[place] = packed
    ends = place[start + n_bytes - 1] + 1 + full[start + n_bytes - 1]
    out[ends] = 255
    out[ends + 1] = np.where(last, 0xD9, 0xD0 + numbers % 8)
    return out, ends + 2


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload, whose lengths are positive multiples of ROW."""
    media: list[bytes] = [b""] * len(payloads)
    group, held = [], 0

    def flush():
        rows = np.frombuffer(b"".join(b for _, _, b in group), np.uint8).reshape(-1, ROW)
        counts = np.array([len(b) // ROW for _, _, b in group])
        first = np.repeat(np.cumsum(counts) - counts, counts)
        numbers = np.arange(len(rows)) - first
        last = np.zeros(len(rows), bool)
        last[np.cumsum(counts) - 1] = True
        out, ends = _scan(rows, numbers, last)
        begin = 0
        for (k, head, _), end in zip(group, ends[last], strict=True):
            media[k] += head + out[begin:end].tobytes()
            begin = end
        group.clear()

    most = MAX_BLOCKS * ROW * (MAX_BLOCKS // ROW)
    for k, payload in enumerate(payloads):
        for i in range(0, len(payload), most):
            part = payload[i : i + most]
            wide, high = shape_of(len(part))
            group.append((k, _header(wide, high, len(part)), part.ljust(wide * high, b"\0")))
            held += len(part)
            if held >= GROUP:
                flush()
                held = 0
    if group:
        flush()
    return media


# --------------------------------------------------------------------------------------- decoder


@dataclass
class Image:
    width: int = 0
    height: int = 0
    parts: list = field(default_factory=list)  # (id, across, down, quantiser number) of a component
    comment: bytes = b""
    scans: list = field(default_factory=list)
    end: int = 0
    dc: dict = field(default_factory=dict)  # component id -> DC plane, in blocks


def parse(media: bytes, begin: int = 0) -> Image:
    """Markers of one image; each scan with the tables in force, its data still coded."""
    if media[begin : begin + 2] != b"\xff\xd8":
        raise Malformed("no start of image")
    image, at, quant, huff, every = Image(), begin + 2, {}, {}, 0
    while True:
        if at + 2 > len(media) or media[at] != 0xFF:
            raise Malformed("a marker is missing")
        marker = media[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            image.end = at + 2
            return image
        if at + 4 > len(media):
            raise Malformed("a segment is cut off")
        size = struct.unpack_from(">H", media, at + 2)[0]
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        try:
            if marker == 0xFE:
                image.comment = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = struct.unpack(">H", body[1:3])[0] if wide else body[1]
                    body = body[65 + 64 * wide :]
            elif marker == 0xC0:
                _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
                image.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise Malformed("not a baseline image")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huff[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xDD:
                every = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                chosen = [(body[1 + 2 * i], huff[body[2 + 2 * i] >> 4], huff[0x10 | body[2 + 2 * i] & 15]) for i in range(body[0])]
                stop = _end_of_scan(media, at)
                image.scans.append((chosen, every, dict(quant), at, stop))
                at = stop
        except (IndexError, KeyError, struct.error) as e:
            raise Malformed(f"bad segment {marker:#x}") from e


def _end_of_scan(media: bytes, at: int) -> int:
    while (at := media.find(b"\xff", at)) >= 0 and at + 1 < len(media):
        if media[at + 1] != 0 and not 0xD0 <= media[at + 1] <= 0xD7:
            return at
        at += 2
    raise Malformed("no end of image")


def _intervals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The data without stuffing and restart markers, and where each interval begins in it."""
    full = np.flatnonzero(data[:-1] == 255)
    after = data[full + 1]
    gone = np.zeros(len(data), bool)
    gone[full[after == 0] + 1] = True
    marks = full[(after >= 0xD0) & (after <= 0xD7)]
    gone[marks] = gone[marks + 1] = True
    kept = np.cumsum(~gone)
    return data[~gone], np.concatenate([[0], kept[marks]])


def _lockstep(data: np.ndarray, starts: np.ndarray, units: np.ndarray, blocks: list[tuple[int, tuple, tuple]]) -> np.ndarray:
    """DC values of intervals that share tables: [interval, unit, block in the unit].

    blocks: for each block of a unit its component's place and its DC and AC table.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
    n = len(data) + 2
    window = padded[0:n] << 40
    for k in range(1, 6):
        window |= padded[k : n + k] << (40 - 8 * k)
    limit = (n - 1) * 8
    order = np.argsort(-units, kind="stable")  # the longest first, so that those at work are a prefix
    at, units = starts[order] * 8, units[order]
    tables = [(lookup(*dc), lookup(*ac)) for _, dc, ac in blocks]
    previous = np.zeros((max(c for c, _, _ in blocks) + 1, len(at)), np.int64)
    out = np.zeros((len(at), int(units.max(initial=0)), len(blocks)), np.int16)
    for m in range(out.shape[1]):
        busy = int(np.searchsorted(-units, -m))
        pos = at[:busy]
        for b, (c, _, _) in enumerate(blocks):
            dc, ac = tables[b]
            w, used = window[pos >> 3], pos & 7
            code = dc[(w >> (32 - used)) & 0xFFFF].astype(np.int64)
            if not code.all():
                raise Malformed("no such code")
            s = code >> 8
            code = (code & 255) + s
            used += code
            extra = (w >> (48 - used)) & ((1 << s) - 1)
            previous[c, :busy] += np.where((extra << 1) >> s == 0, extra - (1 << s) + 1, extra)
            out[:busy, m, b] = previous[c, :busy]
            pos += code
            todo, k = None, 1
            while True:
                p = pos if todo is None else pos[todo]
                if p.size and int(p.max()) > limit:
                    raise Malformed("the data end too early")
                code = ac[(window[p >> 3] >> (32 - (p & 7))) & 0xFFFF]
                if not code.all():
                    raise Malformed("no such code")
                s = code >> 8
                used = (code & 255) + (s & 15)
                if todo is None:
                    pos += used
                else:
                    pos[todo] = p + used
                if not s.any():
                    break
                k = k + (s >> 4).astype(np.int64) + 1
                more = (s != 0) & (k <= 63)
                if not more.any():
                    break
                todo = np.flatnonzero(more) if todo is None else todo[more]
                k = k[more]
        at[:busy] = pos
    back = np.empty_like(out)
    back[order] = out
    return back


def decode_many(media: list[bytes]) -> list[list[Image] | Malformed]:
    """The images in each value, their DC planes decoded."""
    found: list = []
    groups: dict = {}
    for value in media:
        images, at = [], 0
        try:
            while at < len(value) or not images:
                images.append(parse(value, at))
                at = images[-1].end
        except Malformed as e:
            found.append(e)
            continue
        for image in images:
            for scan in image.scans:
                single = len(scan[0]) == 1
                sides = {p[0]: (1, 1) if single else (p[1], p[2]) for p in image.parts}
                blocks = tuple((i, dc, ac) for i, (c, dc, ac) in enumerate(scan[0]) for _ in range(sides[c][0] * sides[c][1]))
                groups.setdefault(blocks, []).append((len(found), image, scan, value, sides))
        found.append(images)
    for blocks, members in groups.items():
        part, held = [], 0
        for member in members:
            part.append(member)
            held += member[2][4] - member[2][3]
            if held >= GROUP:
                _decode_group(list(blocks), part, found)
                part, held = [], 0
        if part:
            _decode_group(list(blocks), part, found)
    return found


def _decode_group(blocks, members, found) -> None:
    datas, starts, units, plans, base = [], [], [], [], 0
    for k, image, (chosen, every, _, begin, end), value, _ in members:
        data, at = _intervals(np.frombuffer(value, np.uint8, end - begin, begin))
        most_h, most_v = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
        part = {p[0]: p for p in image.parts}
        if len(chosen) == 1:
            _, h, v, _ = part[chosen[0][0]]
            across, down = (-(-(-(-size * side // most)) // 8) for size, side, most in ((image.width, h, most_h), (image.height, v, most_v)))
        else:
            across, down = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
        n = across * down
        every = every or n
        count = -(-n // every)
        if len(at) < count:
            found[k] = Malformed("intervals are missing")
            continue
        plans.append((k, image, chosen, across, down, len(starts), count))
        starts += (at[:count] + base).tolist()
        units += [min(every, n - i * every) for i in range(count)]
        datas.append(data)
        base += len(data)
    if not plans:
        return
    try:
        values = _lockstep(np.concatenate(datas), np.array(starts), np.array(units), blocks)
    except Malformed as e:
        if len(members) == 1:
            found[members[0][0]] = e
        else:
            for member in members:
                _decode_group(blocks, [member], found)
        return
    for k, image, chosen, across, down, first, count in plans:
        if isinstance(found[k], Malformed):
            continue
        own = values[first : first + count].reshape(-1, len(blocks))
        if count > 1:
            full = np.arange(values.shape[1])[None, :] < np.array(units[first : first + count])[:, None]
            own = own[full.ravel()]
        own, b = own[: across * down], 0
        for c, _, _ in chosen:
            _, h, v, _ = next(p for p in image.parts if p[0] == c)
            h, v = (1, 1) if len(chosen) == 1 else (h, v)
            image.dc[c] = own[:, b : b + h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            b += h * v


def thumbnail(image: Image) -> np.ndarray:
    """Luminance of each 8x8 block, from the DC coefficient alone."""
    c, _, _, q = image.parts[0]
    plane = image.dc[c].astype(np.float64) * image.scans[0][2][q] / 8 + 128
    return np.clip(np.rint(plane), 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: is a cell of the 8x8 grid over the thumbnail brighter than the mean cell?"""
    cells = thumb.astype(np.float64)
    for axis in (0, 1):
        n = cells.shape[axis]
        edge = np.arange(8) * n // 8
        if n < 8:
            cells = cells.take(edge, axis)
        else:
            cells = np.add.reduceat(cells, edge, axis) / np.diff([*edge, n]).reshape((-1, 1) if axis == 0 else (1, -1))
    return np.packbits(cells > cells.mean()).tobytes().hex()


def payload_of(images: list[Image]) -> bytes:
    """The stored payload, from the DC planes and the length in the comment."""
    parts = []
    for image in images:
        plane = image.dc[image.parts[0][0]]
        parts.append((plane + 128).astype(np.uint8).tobytes()[: int(image.comment.split()[-1])])
    return b"".join(parts)


def feature_of(images: list[Image]) -> str:
    """"<width>x<height>:<thumbnail hash>" of each image, joined by "+"; a long payload has several."""
    return "+".join(f"{x.width}x{x.height}:{average_hash(thumbnail(x))}" for x in images)


# ------------------------------------------------------------------------------------- DataFrames


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as a JPEG.

    Returns (doc_id, n_bytes long: unpadded, media binary), one row per input row.  Null and empty
    texts give 64 zero bytes.
    """

    def run(batches):
        for batch in batches:
            raw = [b.as_py() for b in batch.column(1).cast(pa.binary())]
            media = encode_many([b.ljust(max(ROW, -(-len(b) // ROW) * ROW), b"\0") for b in raw])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


MEDIA_FIELDS = "width int, height int, thumb_width int, thumb_height int, thumb_hash string, error string"


def media_features(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Dimensions and DC-thumbnail hash of a column of JPEG bytes (the first image of each value).

    Returns (*keep, width, height, thumb_width, thumb_height, thumb_hash, error).  Bytes that are
    null, empty, cut off or not baseline give nulls and a reason in error; other rows stay.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for images in decode_many([v.as_py() or b"" for v in batch.column(len(keep))]):
                try:
                    if isinstance(images, Malformed):
                        raise images
                    thumb = thumbnail(images[0])
                    rows.append((images[0].width, images[0].height, thumb.shape[1], thumb.shape[0], average_hash(thumb), None))
                except (Malformed, KeyError, IndexError) as e:
                    rows.append((None, None, None, None, None, str(e) or type(e).__name__))
            kinds = [pa.int32()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))],
                [*keep, "width", "height", "thumb_width", "thumb_height", "thumb_hash", "error"],
            )

    kept = ", ".join(f"{k} {media.schema[k].dataType.simpleString()}" for k in keep)
    return media.select(*keep, media_col).mapInArrow(run, f"{kept}, {MEDIA_FIELDS}")


def read_back(media: DataFrame) -> DataFrame:
    """Decode what :func:`to_media` stored: payload digests, digest of the stored form, feature.

    Returns (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32: of the last 64 payload
    bytes, media_bytes, media_sha256, feature: see :func:`feature_of`), one row per input row; equal
    texts, repeated rows among them, have equal values.
    """

    def run(batches):
        for batch in batches:
            values = [v.as_py() for v in batch.column(2)]
            rows = []
            for value, images in zip(values, decode_many(values), strict=True):
                if isinstance(images, Malformed):
                    raise images  # the store is broken: fail, don't guess
                payload = payload_of(images)
                rows.append(
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(value), hashlib.sha256(value).hexdigest(), feature_of(images))
                )
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
