"""Media columns: payload bytes as PNG images, read back with checks, and perceptual hashes.

A payload is an RGB image of 64 pixels (192 bytes) a row.  Rows are filtered, deflated and
written as checksummed chunks; reading tests every checksum and undoes the filters with numpy.
The feature is the sign pattern of the low-frequency cosine-transform coefficients of the image
in grey, shrunk to 32 x 32.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WIDTH = 64
PIXEL = 3
ROW = WIDTH * PIXEL
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of deflated data in one chunk.
CHUNK = 1 << 16

_SIDE, _LOW = 32, 8
_k = np.arange(_SIDE)
_COSINES = np.cos(np.pi / _SIDE * (_k[None, :] + 0.5) * _k[:_LOW, None])


def pad(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of a row."""
    return data + b" " * (max(1, -(-len(data) // ROW)) * ROW - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


def _filtered(image: np.ndarray) -> np.ndarray:
    """Rows behind their filter numbers, each by the one of none, left and up with least sum."""
    left, up = image.copy(), image.copy()
    left[:, PIXEL:] -= image[:, :-PIXEL]
    up[1:] -= image[:-1]
    tries = np.stack([image, left, up])
    best = np.abs(tries.view(np.int8).astype(np.int16)).sum(2).argmin(0)
    out = np.empty((len(image), ROW + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = tries[best, np.arange(len(image))]
    return out


def to_png(payload: bytes, level: int = 6) -> bytes:
    """The PNG of a payload of whole rows."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    header = WIDTH.to_bytes(4, "big") + len(image).to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    plain = np.zeros((len(image), ROW + 1), np.uint8)
    plain[:, 1:] = image
    # text often deflates better without filters, so the shorter of both is kept
    data = min((zlib.compress(rows.tobytes(), level) for rows in (plain, _filtered(image))), key=len)
    parts = [_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", header), *parts, _chunk(b"IEND", b"")])


def _average(row: np.ndarray, above: np.ndarray) -> None:
    for i in range(0, len(row), PIXEL):
        before = row[i - PIXEL : i].astype(np.int16) if i else 0
        row[i : i + PIXEL] += ((before + above[i : i + PIXEL]) // 2).astype(np.uint8)


def _paeth(row: np.ndarray, above: np.ndarray) -> None:
    zero = np.zeros(PIXEL, np.int16)
    for i in range(0, len(row), PIXEL):
        a, c = (row[i - PIXEL : i].astype(np.int16), above[i - PIXEL : i]) if i else (zero, zero)
        b = above[i : i + PIXEL]
        p = a + b - c
        pa_, pb, pc_ = abs(p - a), abs(p - b), abs(p - c)
        near = np.where((pa_ <= pb) & (pa_ <= pc_), a, np.where(pb <= pc_, b, c))
        row[i : i + PIXEL] += near.astype(np.uint8)


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Image bytes of rows that begin with their filter number."""
    kinds, image = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    lefts = kinds == 1
    if lefts.any():  # needs nothing from other rows
        image[lefts] = np.cumsum(image[lefts].reshape(-1, image.shape[1] // PIXEL, PIXEL), 1, dtype=np.uint8).reshape(
            -1, image.shape[1]
        )
    at = 0
    for end in [*(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]:
        kind = kinds[at]
        if kind == 2:
            if at:
                image[at] += image[at - 1]
            np.cumsum(image[at:end], 0, dtype=np.uint8, out=image[at:end])
        elif kind > 2:
            for i in range(at, end):
                above = image[i - 1].astype(np.int16) if i else np.zeros(image.shape[1], np.int16)
                (_average if kind == 3 else _paeth)(image[i], above)
        at = end
    return image


def from_png(raw: bytes) -> bytes:
    """The payload of a PNG with 8-bit RGB samples; ValueError if a check fails."""
    if raw[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, data, ended = 8, b"", [], False
    while at + 12 <= len(raw) and not ended:
        size, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != int.from_bytes(raw[at + 8 + size : at + 12 + size], "big"):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            header = body
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended or len(header) != 13 or header[8:] != bytes([8, 2, 0, 0, 0]):
        raise ValueError("not a whole 8-bit RGB image")
    width, height = int.from_bytes(header[:4], "big"), int.from_bytes(header[4:8], "big")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(rows) != height * (width * PIXEL + 1):
        raise ValueError("wrong size")
    return unfilter(rows.reshape(height, width * PIXEL + 1)).tobytes()


def cosine_hash(payload: bytes) -> str:
    """16 hex digits: which low-frequency coefficients are above their median."""
    grey = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, PIXEL).sum(2, dtype=np.float64)
    grey = grey[:, 0::2] + grey[:, 1::2]
    starts = np.arange(_SIDE) * len(grey) // _SIDE
    if len(grey) < _SIDE:
        small = grey[starts]
    else:
        small = np.add.reduceat(grey, starts, 0) / np.diff(np.append(starts, len(grey)))[:, None]
    # rounded, so that what is zero but for the order of sums is zero
    low = np.round((_COSINES @ small @ _COSINES.T).reshape(-1), 6)
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def encode_media(docs: DataFrame, level: int = 6) -> DataFrame:
    """doc_id, n_bytes and media, the PNG of each text's padded bytes.

    A null or empty text is 192 spaces.  Repeated rows and rows without a doc_id are rows like any other; further columns
    are left out.  No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column(1), pa.large_binary())
            data = [t.as_py() or b"" for t in texts]
            media = [to_png(pad(d), level) for d in data]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, data), pa.int64()), pa.array(media, pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cols.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(stored: DataFrame, with_payload: bool = False) -> DataFrame:
    """What is read back from stored media: digests, sizes, the feature and, if asked for, the payload.  No rows give no rows."""
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long,"
        " media_bytes long, media_sha256 string, feature string" + (", payload binary" if with_payload else "")
    )
    names = [n for part in schema.split(",") for n in [part.split()[0]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in (m.as_py() for m in batch.column(2)):
                payload = from_png(raw)
                rows.append(
                    (
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-16:]),
                        len(raw),
                        hashlib.sha256(raw).hexdigest(),
                        cosine_hash(payload),
                        payload,
                    )
                )
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)][: len(names) - 2]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def store_media(docs: DataFrame, level: int = 6) -> DataFrame:
    """encode_media as a table of binary columns in the shared folder.  Repeated rows stay rows."""
    return materialize(encode_media(docs, level), "media")
