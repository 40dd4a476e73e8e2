"""Lossless PNG columns for binary payloads, and low-frequency cosine-transform hashes.

A payload is stored as an 8-bit greyscale image of 64 samples a row. The encoder
picks, for each image, the row filter (none, sub or up) whose residuals have the
least sum of magnitudes and writes one zlib stream in one IDAT chunk. The decoder
takes any 8-bit greyscale image without interlacing: it walks the chunks, tests every
checksum, inflates all IDAT chunks, and undoes all five filters in numpy.

The hash of an image is that of a 32 x 32 area average: its cosine transform's 8 x 8
low frequencies against their median (the constant one aside), as 16 hex digits.

Defined cases: a null payload is the empty one; the payload is padded with zero bytes to
a positive multiple of 64, so an empty one is a single row; equal payloads give equal
images; equal rows each get their own; an empty table gives an empty result; rows are
handled one by one, so a very long text costs its own size; a damaged image raises.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
LEVEL = 6
SIDE, LOW = 32, 8
# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the row width."""
    return data + bytes(WIDTH - len(data) if len(data) < WIDTH else -len(data) % WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """The PNG of a payload whose length is a positive multiple of the width."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    options = (rows, sub, up)
    costs = [int(np.abs(x.view(np.int8).astype(np.int16)).sum()) for x in options]
    kind = costs.index(min(costs))
    filtered = np.empty((len(rows), WIDTH + 1), dtype=np.uint8)
    filtered[:, 0] = kind
    filtered[:, 1:] = options[kind]
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def chunks(image: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Each chunk's kind and body, its checksum tested."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(image):
        if at + 12 > len(image):
            raise ValueError("a chunk is cut off")
        size, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + size]
        if len(body) != size or image[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            return
    raise ValueError("no IEND chunk")


def _paeth_row(row: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, left, corner = bytearray(len(row)), 0, 0
    for k, (x, b) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
        p = left + b - corner
        pa_, pb, pc = abs(p - left), abs(p - b), abs(p - corner)
        best = left if pa_ <= pb and pa_ <= pc else b if pb <= pc else corner
        left, corner = (x + best) & 255, b
        out[k] = left
    return np.frombuffer(bytes(out), dtype=np.uint8)


def _average_row(row: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, left = bytearray(len(row)), 0
    for k, (x, b) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
        left = (x + (left + b) // 2) & 255
        out[k] = left
    return np.frombuffer(bytes(out), dtype=np.uint8)


def unfilter(filtered: np.ndarray) -> np.ndarray:
    """rows x (1 + width) bytes, each with its filter in front -> the samples; runs of equal filters go at once."""
    kinds, out = filtered[:, 0], filtered[:, 1:].copy()
    if len(kinds) and int(kinds.max()) > PAETH:
        raise ValueError("unknown row filter")
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        if low == high:
            continue
        kind, part = int(kinds[low]), out[low:high]
        above = out[low - 1] if low else np.zeros(out.shape[1], dtype=np.uint8)
        if kind == SUB:
            np.add.accumulate(part, axis=1, dtype=np.uint8, out=part)
        elif kind == UP:
            part[0] += above
            np.add.accumulate(part, axis=0, dtype=np.uint8, out=part)
        elif kind in (AVERAGE, PAETH):
            undo = _average_row if kind == AVERAGE else _paeth_row
            for k in range(len(part)):
                part[k] = above = undo(part[k], above)
    return out


def decode(image: bytes) -> np.ndarray:
    """The samples, rows x width."""
    head, data = None, []
    for kind, body in chunks(image):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit greyscale without interlacing is read")
    width, height = head[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8)
    if len(raw) != height * (width + 1):
        raise ValueError("the image data has another size")
    return unfilter(raw.reshape(height, width + 1))


def _basis() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * SIDE))


def _areas(size: int) -> np.ndarray:
    """SIDE x size weights: the average over equal stretches of an axis."""
    edges = np.arange(SIDE + 1) * size / SIDE
    at = np.arange(size)
    return np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None) / (size / SIDE)


_BASIS, _COLUMNS = _basis(), _areas(WIDTH)


def _shrunk(samples: np.ndarray) -> np.ndarray:
    """SIDE x SIDE area averages; the rows are summed by running totals, so a tall image costs its size."""
    columns = _COLUMNS if samples.shape[1] == WIDTH else _areas(samples.shape[1])
    wide = samples @ columns.T
    total = np.vstack([np.zeros(SIDE), np.cumsum(wide, axis=0)])
    edges = np.arange(SIDE + 1) * len(wide) / SIDE
    whole = np.minimum(edges.astype(int), len(wide))
    part = edges - whole
    at_edge = total[whole] + part[:, None] * wide[np.minimum(whole, len(wide) - 1)]
    return np.diff(at_edge, axis=0) / (len(wide) / SIDE)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits: which low frequencies are above their median."""
    low = np.round(_BASIS @ _shrunk(samples) @ _BASIS.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


STORED = "media binary, n_bytes long"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds the PNG of each text's UTF-8 bytes as a binary column, and n_bytes, their number."""

    @F.pandas_udf("binary")
    def stored(texts):
        import pandas as pd

        return pd.Series([encode(padded(x)) for x in texts], dtype=object)

    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.withColumn(media, stored(data)).withColumn("n_bytes", F.octet_length(data).cast("long"))


def with_features(docs: DataFrame, media: str = "media") -> DataFrame:
    """Reads a PNG column back and adds its digests and hash as the columns of FEATURES."""

    @F.pandas_udf(FEATURES)
    def features(images):
        import pandas as pd

        rows = []
        for image in images:
            samples = decode(image)
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), cosine_hash(samples)))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in FEATURES.split(", ")])

    return docs.select("*", features(F.col(media)).alias("_png_features")).select(*docs.columns, "_png_features.*")


def op7_png(spark, sf_dir: str) -> DataFrame:
    """Every document as a PNG in a table of the shared folder, read back from there."""
    from quillmesh.llm.common import table, written

    media = with_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    stored = written(media.select("doc_id", "n_bytes", "media"), "media")
    return with_features(stored).drop("media")
