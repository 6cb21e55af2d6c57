"""Media columns: texts stored as PNG samples, read back and hashed (operator 4).

A payload of 8-bit samples becomes a grey PNG, 64 samples wide: signature, IHDR, IDAT chunks of at
most 64 KiB and IEND, each chunk with its CRC-32. Reading tests every checksum, inflates, undoes all
five row filters with numpy and returns the samples. The feature is a 64-bit low-frequency hash: the
picture is averaged to 32 by 32, its cosine transform's lowest 8 by 8 terms are compared with their
median. Pictures and hashes are binary columns.

Edge cases: a null text is an empty one, stored as 64 zero samples; equal texts give equal values;
repeated rows stay; an empty table gives an empty table; extra columns are ignored by ``media_rows``.
Damaged pictures raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import text_or_empty

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 16
SIDE, LOW = 32, 8


def payload_of(text: str) -> bytes:
    """UTF-8 bytes, padded with zeros to a positive multiple of 64."""
    raw = text.encode("utf-8", "replace")
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _filtered(rows: np.ndarray) -> np.ndarray:
    """Rows with the filter (none, sub or up) of the least sum of absolute differences."""
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    kinds = (rows, sub, up)
    costs = [int(np.abs(k.view(np.int8).astype(np.int16)).sum()) for k in kinds]
    best = int(np.argmin(costs))
    out = np.empty((rows.shape[0], WIDTH + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = kinds[best]
    return out


def encode_png(payload: bytes) -> bytes:
    """A grey 8-bit PNG of the payload; its length is a positive multiple of the width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, rows.shape[0], 8, 0, 0, 0, 0)
    packed = zlib.compress(_filtered(rows).tobytes(), 4)
    parts = [_chunk(b"IDAT", packed[at:at + IDAT_BYTES]) for at in range(0, len(packed), IDAT_BYTES)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", header), *parts, _chunk(b"IEND", b"")])


def _chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG signature")
    at = 8
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8:at + 8 + size]
        if len(data) != size or at + 12 + size > len(media):
            raise ValueError("a chunk is cut short")
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"checksum of chunk {kind!r} is wrong")
        yield kind, data
        at += 12 + size


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters; runs of rows with one filter go together where they can."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(kinds)]):
        kind = kinds[start]
        if kind == 1:
            for lane in range(step):
                rows[start:end, lane::step] = np.cumsum(rows[start:end, lane::step], axis=1, dtype=np.uint8)
        elif kind == 2:
            first = max(start - 1, 0)
            rows[first:end] = np.cumsum(rows[first:end], axis=0, dtype=np.uint8)
        elif kind > 2:
            for y in range(start, end):
                above = rows[y - 1].astype(int) if y else np.zeros(rows.shape[1], int)
                for x in range(rows.shape[1]):
                    left = int(rows[y, x - step]) if x >= step else 0
                    if kind == 3:
                        guess = (left + above[x]) // 2
                    else:
                        corner = above[x - step] if x >= step else 0
                        near = left + above[x] - corner
                        guess = min((abs(near - left), 0, left), (abs(near - above[x]), 1, above[x]), (abs(near - corner), 2, corner))[2]
                    rows[y, x] = (int(rows[y, x]) + int(guess)) & 255
    return rows


def decode_png(media: bytes) -> np.ndarray:
    """Samples (rows by width) of a grey 8-bit PNG without interlacing."""
    header, packed, ended = None, [], False
    for kind, data in _chunks(media):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        elif kind == b"IEND":
            ended = True
    if header is None or not ended or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole grey 8-bit PNG")
    width, height = header[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if raw.size != height * (width + 1):
        raise ValueError("the picture's size is wrong")
    return _unfiltered(raw.reshape(height, width + 1), 1)


_ANGLE = np.pi * (2 * np.arange(SIDE) + 1) / (2 * SIDE)
_COSINES = np.cos(np.arange(LOW)[:, None] * _ANGLE[None, :])


def cosine_hash(samples: np.ndarray) -> bytes:
    """Eight bytes: which of the 64 lowest cosine terms are over their median."""
    height = samples.shape[0]
    starts = np.arange(SIDE) * height // SIDE
    ends = np.maximum((np.arange(SIDE) + 1) * height // SIDE, starts + 1)
    total = np.concatenate([np.zeros((1, samples.shape[1])), np.cumsum(samples, axis=0, dtype=np.float64)])
    small = (total[ends] - total[starts]) / (ends - starts)[:, None]
    small = small.reshape(SIDE, SIDE, -1).mean(axis=2)
    terms = np.round(_COSINES @ small @ _COSINES.T, 6)
    return np.packbits((terms > np.median(terms)).ravel()).tobytes()


def encode_media(texts: DataFrame, column: str = "text", out: str = "media") -> DataFrame:
    """Add the binary column ``out`` with each text's PNG."""

    @F.pandas_udf("binary")
    def png(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([encode_png(payload_of(t)) for t in batch], dtype=object)

    return texts.withColumn(out, png(text_or_empty(column)))


READ_BACK = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary"


def read_media(media: DataFrame, column: str = "media", out: str = "read") -> DataFrame:
    """Add the struct ``out``: digests of the samples read back, and their cosine hash."""

    @F.pandas_udf(READ_BACK)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for stored in batch:
                samples = decode_png(stored)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]),
                             len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(samples)))
            yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash"])

    return media.withColumn(out, read(F.col(column)))


def media_rows(docs: DataFrame) -> DataFrame:
    """One row per document: what was stored, what came back and its feature."""
    stored = encode_media(docs.select("doc_id", "text"))
    read = read_media(stored.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), "media"))
    return read.select("doc_id", "n_bytes", "read.payload_bytes", "read.payload_sha256", "read.tail_crc32", "read.media_bytes",
                       "read.media_sha256", F.lower(F.hex("read.hash")).alias("feature"))
