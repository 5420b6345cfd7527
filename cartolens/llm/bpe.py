"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Null and empty texts have no tokens. Long texts are cut where no match of the pre-splitting pattern can reach across,
so the ids equal those of the whole text while the library never sees more than about ``PIECE`` characters and the rest of one
match at once (a run of letters without any mark or space is one match, however long). Each row gets its own result, repeated
rows equal ones; an empty table gives no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import structs, text_or_empty

#: Characters after which a long text is cut at the next safe boundary.
PIECE = 1 << 16
#: Where a match ends and the next one begins, whatever stands around, for patterns whose alternatives are contractions, runs of
#: letters, of digits or of other marks, each with a space before it at most, and white space: before a white space, and between
#: letters, digits and marks, but not after an apostrophe, which may begin a contraction.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}\p{S}])(?=[ \t\n])|(?<=\p{L})(?=[\p{N}\p{P}\p{S}])|(?<=\p{N})(?=[\p{L}\p{P}\p{S}])|(?<=[\p{P}\p{S}])(?<!')(?=[\p{L}\p{N}])")

_codecs: dict = {}


def codec(ranks_path: str, pattern: str):
    """The encoding, loaded once in each Python worker; a lost worker loads it anew."""
    if (ranks_path, pattern) not in _codecs:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _codecs[ranks_path, pattern] = encoding, [str(i) for i in range(max(ranks.values()) + 1)]
    return _codecs[ranks_path, pattern]


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text in order, cut only at safe boundaries; without one, a piece stays longer."""
    out, at = [], 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def encode_text(text: str, encoding) -> list[int]:
    if len(text) <= PIECE:
        return encoding.encode_ordinary(text)
    return [i for piece in pieces(text) for i in encoding.encode_ordinary(piece)]


def encoder(ranks_path: str, pattern: str):
    """A column function: text to array of ids."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        encoding, _ = codec(ranks_path, pattern)
        return pa.array([encode_text(t or "", encoding) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return encode


def decoder(ranks_path: str, pattern: str):
    """A column function: array of ids to the raw bytes, whole UTF-8 or not; null ids give no bytes."""

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        encoding, _ = codec(ranks_path, pattern)
        return pa.array([encoding.decode_bytes(x or []) for x in ids.to_pylist()], pa.binary())

    return decode


def digests(ranks_path: str, pattern: str):
    """A column function: text to n_tokens, ids_sha256, decoded_sha256, with no list of ids leaving the worker."""
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digest(texts: pa.Array) -> pa.Array:
        encoding, decimal = codec(ranks_path, pattern)
        rows = []
        for text in texts:
            ids = encode_text(text.as_py() or "", encoding)
            joined = " ".join([decimal[i] for i in ids])
            rows.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(encoding.decode_bytes(ids)).hexdigest()))
        return structs(rows, fields)

    return digest


def token_digests(docs: DataFrame, ranks_path: str, pattern: str, text: Column | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. One narrow pass, no shuffle; extra columns are ignored."""
    ship(docs.sparkSession)
    d = digests(ranks_path, pattern)(text_or_empty(F.col("text") if text is None else text))
    return docs.select("doc_id", d.alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
