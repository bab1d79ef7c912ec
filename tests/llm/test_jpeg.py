import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from subsumer.llm import jpeg


def test_payloads_come_back():
    rng = np.random.default_rng(0)
    payloads = [bytes(64), rng.bytes(64 * 9001), b"\xff" * 640, *(rng.bytes(64 * k) for k in range(1, 30))]
    media = jpeg.encode_many(payloads)
    images = jpeg.decode_many(media)
    assert [jpeg.payload_of(x) for x in images] == payloads
    assert (images[0][0].width, images[0][0].height) == (512, 8)
    thumb = jpeg.thumbnail(images[1][0])
    assert thumb.ravel()[: len(payloads[1])].tobytes() == payloads[1]


def test_a_payload_over_several_images(monkeypatch):
    monkeypatch.setattr(jpeg, "MAX_BLOCKS", 64)
    payload = np.random.default_rng(1).bytes(64 * 64 * 3 + 128)
    media = jpeg.encode_many([payload])
    assert len(jpeg.decode_many(media)[0]) == 4
    assert jpeg.payload_of(jpeg.decode_many(media)[0]) == payload


def colour_image(rng, wide, high, restart):
    """A hand-written 4:2:0 image with AC coefficients; the DC values that a decoder has to find."""
    lengths, values = (0, 0, 0, 12, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
    ac_values = (0x00, 0xF0, 0x01, 0x12, 0x33, 0x71)
    ac_lengths = (0, 0, 6, *[0] * 13)
    dc, ac = jpeg.codes(lengths, values), jpeg.codes(ac_lengths, ac_values)
    across, down = -(-wide // 16), -(-high // 16)
    planes = [np.zeros((down * k, across * k), int) for k in (2, 1, 1)]
    bits, out, count, last, mark = "", b"", 0, [0, 0, 0], 0

    def flush(text):
        text += "1" * (-len(text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\0")

    for y in range(down):
        for x in range(across):
            if restart and count and count % restart == 0:
                out += flush(bits) + bytes([0xFF, 0xD0 + mark % 8])
                bits, last, mark = "", [0, 0, 0], mark + 1
            for c, side in ((0, 2), (1, 1), (2, 1)):
                for v in range(side):
                    for h in range(side):
                        value = rng.randint(-900, 900)
                        planes[c][y * side + v, x * side + h] = value
                        d = value - last[c]
                        last[c] = value
                        n = abs(d).bit_length()
                        bits += format(dc[n][0], f"0{dc[n][1]}b") + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "")
                        at = 1
                        while at <= 63 and rng.random() < 0.7:
                            s = rng.choice(ac_values[1:])
                            if at + (s >> 4) > 63:
                                break
                            bits += format(ac[s][0], f"0{ac[s][1]}b") + "".join(rng.choice("01") for _ in range(s & 15))
                            at += (s >> 4) + 1
                        if at <= 63:
                            bits += format(ac[0][0], f"0{ac[0][1]}b")
            count += 1
    seg = jpeg._segment
    head = b"\xff\xd8" + seg(0xE1, b"Exif") + seg(0xDB, b"\0" + bytes([4] * 64) + b"\1" + bytes([9] * 64))
    head += seg(0xC0, struct.pack(">BHHB", 8, high, wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    head += seg(0xC4, bytes([0]) + bytes(lengths) + bytes(values) + bytes([0x10]) + bytes(ac_lengths) + bytes(ac_values))
    head += (seg(0xDD, struct.pack(">H", restart)) if restart else b"") + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    return head + out + flush(bits) + b"\xff\xd9", planes


@pytest.mark.parametrize(("wide", "high", "restart"), [(16, 16, 0), (50, 33, 0), (70, 20, 2), (31, 64, 3)])
def test_colour_images(wide, high, restart):
    media, planes = colour_image(random.Random(wide), wide, high, restart)
    image = jpeg.decode_many([media, media])[1][0]
    assert (image.width, image.height) == (wide, high)
    assert all((image.dc[c + 1] == planes[c]).all() for c in range(3))
    assert (jpeg.thumbnail(image) == np.clip(np.rint(planes[0] * 4 / 8 + 128), 0, 255)).all()


def test_a_payload_of_several_images():
    parts = [bytes(range(64)), bytes(reversed(range(128)))]
    media = jpeg.encode_many(parts)
    alone = [jpeg.decode_many([m])[0] for m in media]
    images = jpeg.decode_many([b"".join(media)])[0]
    assert jpeg.payload_of(images) == b"".join(parts)
    assert jpeg.feature_of(images) == "+".join(map(jpeg.feature_of, alone))


def test_rows(spark, docs, odd):
    got = {r.doc_id: r for r in jpeg.read_back(jpeg.to_media(docs([x for x in odd if x[0] != 1]))).collect()}
    for i, t in odd:
        if i == 1:
            continue
        raw = (t or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert (got[5].feature, got[5].media_sha256) == (got[6].feature, got[6].media_sha256)
    assert jpeg.read_back(jpeg.to_media(docs([]))).collect() == []


def test_broken_media_are_reported(spark):
    whole = jpeg.encode_many([bytes(range(64))])[0]
    cut = whole[: len(whole) // 2]
    progressive = whole.replace(b"\xff\xc0", b"\xff\xc2")
    df = spark.createDataFrame([(1, bytearray(whole)), (2, None), (3, bytearray(b"no")), (4, bytearray(cut)), (5, bytearray(progressive))], "doc_id long, media binary")
    got = {r.doc_id: r for r in jpeg.media_features(df).collect()}
    assert (got[1].width, got[1].height, got[1].thumb_width, got[1].error) == (512, 8, 64, None)
    assert all(got[k].error and got[k].thumb_hash is None for k in (2, 3, 4, 5))
