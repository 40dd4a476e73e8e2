import hashlib
import struct
import zlib

import numpy as np
import pytest

from quillmesh.llm import png


def _plain_unfilter(raw, width):
    """The filters by their definitions, a sample at a time."""
    out, above = [], [0] * width
    for k in range(0, len(raw), width + 1):
        kind, row, left, corner = raw[k], [], 0, 0
        for i in range(width):
            x, b = raw[k + 1 + i], above[i]
            p = left + b - corner
            paeth = min((abs(p - left), 0, left), (abs(p - b), 1, b), (abs(p - corner), 2, corner))[2]
            left = (x + (0, left, b, (left + b) // 2, paeth)[kind]) & 255
            corner = b
            row.append(left)
        out += row
        above = row
    return bytes(out)


@pytest.mark.parametrize("rows", [1, 2, 33, 400])
def test_unfilter_mixed(rows):
    rng = np.random.default_rng(rows)
    raw = rng.integers(0, 256, (rows, 65), dtype=np.uint8)
    raw[:, 0] = np.repeat(rng.integers(0, 5, rows), rng.integers(1, 4, rows))[:rows]
    assert png.unfilter(raw).tobytes() == _plain_unfilter(raw.tobytes(), 64)


@pytest.mark.parametrize("data", [b"", b"x", b"a" * 64, bytes(range(256)) * 9, "é漢😀\n".encode() * 1000, bytes(100)])
def test_round_trip_and_checksums(data):
    payload = png.padded(data)
    assert len(payload) >= 64 and len(payload) % 64 == 0 and payload.startswith(data)
    image = png.encode(payload)
    assert png.decode(image).tobytes() == payload
    assert len(png.cosine_hash(png.decode(image))) == 16
    for at in (20, len(image) // 2, len(image) - 6):
        with pytest.raises((ValueError, struct.error, zlib.error)):
            png.decode(image[:at] + bytes([image[at] ^ 1]) + image[at + 1 :])


def test_hash_is_the_plain_cosine_transform():
    samples = np.random.default_rng(1).integers(0, 256, (77, 64), dtype=np.uint8)
    wide = np.kron(samples.astype(float), np.ones((32, 32)))  # 77*32 x 64*32: equal areas are whole blocks
    small = wide.reshape(32, 77, 32, 64).mean(axis=(1, 3))
    low = np.array([[sum(small[y, x] * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]).ravel()
    assert png.cosine_hash(samples) == np.packbits(low > np.median(low[1:])).tobytes().hex()


def test_columns(spark):
    docs = spark.createDataFrame([(1, "ab", 1), (2, None, 2), (2, "", 3), (None, "ab", 4), (3, "y" * 200000, 5)], "doc_id long, text string, feature2 int")
    got = png.with_features(png.with_media(docs)).collect()
    assert len(got) == 5
    for r in got:
        data = (r.text or "").encode()
        payload = png.padded(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
    same = [r for r in got if r.text == "ab"]
    assert same[0][3:] == same[1][3:]
    assert png.with_features(png.with_media(docs.limit(0))).count() == 0
