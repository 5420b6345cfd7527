"""Media columns: bytes as 8-bit grayscale PNG, read back with every checksum tested, and a cosine-transform hash.

A payload is the text's UTF-8 bytes (null: none) filled with zero bytes to a positive multiple of 64, one row of samples per
64 bytes. Rows are filtered (None throughout, or the least of None/Sub/Up by row), whichever deflates smaller. Reading tests
the signature, each chunk's CRC, zlib's Adler and the size, and undoes all five PNG filters with numpy.
Equal texts have equal values, repeated rows are rows of their own; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .common import raw, structs, text_or_empty

WIDTH = 64
CHUNK = 1 << 15
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)

_GRID, _LOW = 32, 8
_BASIS = np.cos(np.pi / _GRID * np.outer(np.arange(_LOW), np.arange(_GRID) + 0.5)).astype(np.float32)


class BadMedia(ValueError):
    """Stored bytes that are no whole PNG of this kind."""


def payload_of(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _filtered(image: np.ndarray) -> np.ndarray:
    """Rows with a leading filter byte, each by the filter whose residuals have the least sum of absolute values."""
    sub, up = image.copy(), image.copy()
    sub[:, 1:] -= image[:, :-1]
    up[1:] -= image[:-1]
    options = np.stack([image, sub, up])
    cost = np.minimum(options, 0 - options).sum(2, dtype=np.int32)
    kind = cost.argmin(0)
    return np.concatenate([kind[:, None].astype(np.uint8), options[kind, np.arange(len(image))]], 1)


def encode(payload: bytes, level: int = 6) -> bytes:
    """A payload of a positive multiple of 64 bytes as PNG."""
    if not payload or len(payload) % WIDTH:
        raise BadMedia("the payload must be a positive multiple of 64 bytes")
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    plain = np.zeros((len(image), WIDTH + 1), np.uint8)
    plain[:, 1:] = image
    body = min((zlib.compress(x.tobytes(), level) for x in (plain, _filtered(image))), key=len)
    head = struct.pack(">IIBBBBB", WIDTH, len(image), 8, 0, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", body[i : i + CHUNK]) for i in range(0, len(body), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", head) + data + _chunk(b"IEND", b"")


def _wave(paeth: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Rows of Average or Paeth residuals: a sample depends on the ones to the left and above, so all samples of a falling
    diagonal are undone at once."""
    height, width = rows.shape
    out = np.zeros((height + 1, width + 1), np.int16)
    out[0, 1:] = above
    for d in range(height + width - 1):
        r = np.arange(max(0, d - width + 1), min(height, d + 1))
        i = d - r
        left, up, corner = out[r + 1, i], out[r, i + 1], out[r, i]
        to_left, to_up, to_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        out[r + 1, i + 1] = (rows[r, i] + np.where(paeth[r], nearest, (left + up) >> 1)) & 255
    return out[1:, 1:].astype(np.uint8)


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Samples from residual rows of one byte a sample. All Sub rows go in one numpy call, and so does each run of Up rows; runs
    of Average and Paeth rows go by diagonals."""
    if len(kinds) and kinds.max() > PAETH:
        raise BadMedia("unknown row filter")
    out = rows.copy()
    if (sub := kinds == SUB).any():
        out[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint8)
    todo = np.flatnonzero(kinds >= UP)
    waves = kinds[todo] > UP
    run_ends = np.flatnonzero((np.diff(todo) != 1) | (waves[1:] != waves[:-1])) + 1
    for run in np.split(todo, run_ends) if len(todo) else []:
        lo, hi = run[0], run[-1] + 1
        above = out[lo - 1] if lo else np.zeros(rows.shape[1], np.uint8)
        if kinds[lo] == UP:
            block = rows[lo:hi].copy()
            block[0] += above
            out[lo:hi] = np.cumsum(block, axis=0, dtype=np.uint8)
        else:
            out[lo:hi] = _wave(kinds[lo:hi] == PAETH, rows[lo:hi], above)
    return out


def decode(media: bytes) -> np.ndarray:
    """The samples of a stored PNG, height x 64; BadMedia if a checksum, length or format is wrong."""
    if media[:8] != SIGNATURE:
        raise BadMedia("not a PNG")
    at, head, inflate, data, ended = 8, None, zlib.decompressobj(), [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise BadMedia("cut short")
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if at + 12 + n > len(media) or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise BadMedia(f"checksum of {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            try:
                data.append(inflate.decompress(body))
            except zlib.error as e:
                raise BadMedia(str(e)) from e
        ended = kind == b"IEND"
    if not ended or not head or head[2:] != (8, 0, 0, 0, 0) or not inflate.eof:
        raise BadMedia("no whole 8-bit grayscale image")
    flat = np.frombuffer(b"".join(data), np.uint8)
    if len(flat) != head[1] * (head[0] + 1):
        raise BadMedia("wrong number of samples")
    rows = flat.reshape(head[1], head[0] + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def _shrink(image: np.ndarray) -> np.ndarray:
    """To 32 x 32 by means of areas; fewer rows than 32 are repeated."""
    half = image.reshape(len(image), _GRID, -1).mean(2, dtype=np.float32)
    edges = np.arange(_GRID) * len(half) // _GRID
    if len(half) < _GRID:
        return half[edges]
    counts = np.diff(np.r_[edges, len(half)])
    return np.add.reduceat(half, edges, axis=0) / counts[:, None]


def feature(image: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest cosine coefficients exceed their median (the mean's is left out of it)."""
    low = (_BASIS @ _shrink(image) @ _BASIS.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


@F.arrow_udf(T.BinaryType())
def to_media(texts: pa.Array) -> pa.Array:
    return pa.array([encode(payload_of(x)) for x in raw(texts)], pa.binary())


_FIELDS = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())]


@F.arrow_udf(T.StructType().add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long").add("feature", "string"))
def from_media(stored: pa.Array) -> pa.Array:
    rows = []
    for x in stored:
        if (media := x.as_py()) is None:
            rows.append((None, None, None, None))
            continue
        payload = (image := decode(media)).tobytes()
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature(image)))
    return structs(rows, _FIELDS)


def with_media(docs: DataFrame, name: str = "media") -> DataFrame:
    """``docs`` and a binary column of that name (one of the same name is replaced) with each whole text stored as PNG."""
    ship(docs.sparkSession)
    return docs.withColumn(name, to_media(text_or_empty(F.col("text"))))


def media_features(stored: DataFrame, name: str = "media") -> DataFrame:
    """Per row: doc_id, what reading the stored bytes back gives, and size and digest of the stored form; nulls stay null."""
    m = F.col(name)
    read = stored.select("doc_id", F.octet_length("text").cast("long").alias("n"), m.alias("m"), from_media(m).alias("r"))
    return read.select(
        "doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_bytes"), "r.payload_bytes", "r.payload_sha256", "r.tail_crc32",
        F.octet_length("m").cast("long").alias("media_bytes"), F.sha2("m", 256).alias("media_sha256"), "r.feature",
    )
