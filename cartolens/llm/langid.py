"""Language identification by error-correcting output codes.

Each language has a codeword; a logistic classifier over hashed byte 1- to 3-grams of the letters predicts each bit;
decoding adds each bit's logistic loss, weighted by how well that bit was learned, and takes the nearest codeword.
``ambiguous`` marks texts whose second nearest codeword is almost as near. Texts that are null or without any letter are
``und`` with score 0; with no learned language all are. The fit takes about ``per_language`` texts of a language, fewer where
they would be more than ``SAMPLE`` in all, of the ``MAX_LANGUAGES`` most frequent languages (documented bounds); which ones depends
on ids and texts only, and repeated rows count once. All texts are predicted whole, equal ones alike; extra columns are ignored and
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .common import raw, structs
from .text_hash import LETTERS

DIMS = 1 << 12
PER_LANGUAGE = 250
MAX_LANGUAGES, SAMPLE = 1000, 10_000
#: Softmax share below which a prediction is flagged.
SURE = 0.6

_LETTER = regex.compile(r"\p{L}")


def grams(data: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte 1-, 2- and 3-grams of the letters, of unit length."""
    buf = LETTERS[np.frombuffer(b" " + data + b" ", np.uint8)]
    blank = buf == 0x20
    buf = buf[~(blank & np.r_[False, blank[:-1]])].astype(np.uint32)
    h = buf * np.uint32(0x9E3779B1)
    out = np.bincount(h >> np.uint32(20), minlength=DIMS)
    for n in (2, 3):
        if len(buf) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + buf[n - 1 :] * np.uint32(0xC2B2AE3D)
        g = h ^ (h >> np.uint32(13))
        out += np.bincount((g * np.uint32(0x27D4EB2F)) >> np.uint32(20), minlength=DIMS)
    root = np.sqrt(out).astype(np.float32)
    return root / max(1e-9, float(np.linalg.norm(root)))


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +1/-1: every split of the languages in two if they are few, else random columns with rows far apart."""
    if n <= 5:
        splits = [[1 if i == 0 or s >> (i - 1) & 1 else -1 for i in range(n)] for s in range(max(1, 2 ** (n - 1) - 1))]
        return np.array(splits).T
    length = max(15, 10 * int(np.ceil(np.log2(n))))
    rng = np.random.default_rng(seed)
    trials = [rng.choice([-1, 1], (n, length)) for _ in range(50)]

    def worst(code: np.ndarray) -> int:
        agree = code @ code.T
        return int((np.abs(agree - np.diag(np.diag(agree)))).max() + 10 * (np.abs(code.sum(0)) == n).sum())

    return min(trials, key=worst)


@dataclass
class Model:
    """Languages, their codewords, and each bit's weights, bias and importance; fixed size for a set of languages."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    importance: np.ndarray

    def predict(self, data: bytes) -> tuple[str, float, bool]:
        if not self.languages or not _LETTER.search(data.decode("utf-8", "replace")):
            return "und", 0.0, True
        margin = grams(data) @ self.weights + self.bias
        loss = np.logaddexp(0, -self.code * margin) @ self.importance
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        best = int(loss.argmin())
        return self.languages[best], float(share[best]), bool(share[best] < SURE)


def train(languages: list[str], inputs: np.ndarray, target: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-5) -> Model:
    """All bits at once, full-batch AdaGrad; languages weigh alike. ``target``: index of each row's language."""
    code = codewords(len(languages))
    goal = code[target].astype(np.float32)
    weight = 1 / np.bincount(target, minlength=len(languages))[target] / len(languages)
    w, b = np.zeros((DIMS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    sw, sb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(rounds):
        slope = -goal / (1 + np.exp(np.clip(goal * (inputs @ w + b), -30, 30))) * weight[:, None]
        gw, gb = inputs.T @ slope + decay * w, slope.sum(0)
        sw, sb = sw + gw**2, sb + gb**2
        w, b = (w - rate * gw / np.sqrt(sw)).astype(np.float32), (b - rate * gb / np.sqrt(sb)).astype(np.float32)
    wrong = ((goal * (inputs @ w + b) <= 0) * weight[:, None]).sum(0)
    importance = np.clip(0.5 * np.log((1 - wrong + 1e-3) / (wrong + 1e-3)), 0.05, None)
    return Model(languages, code, w, b, (importance / importance.mean()).astype(np.float32))


def fit(docs: DataFrame, allowed: Column | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from text and lang of the allowed rows: for each language those whose id hashes lowest, about per_language."""
    ship(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known if allowed is None else known.filter(allowed)
    most = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    if not sizes:
        return Model([], np.zeros((0, 0)), np.zeros((DIMS, 0)), np.zeros(0), np.zeros(0))
    wanted = min(per_language, max(1, SAMPLE // len(sizes)))
    share = F.create_map(*[F.lit(x) for k in sorted(sizes) for x in (k, wanted / sizes[k])])
    h = F.xxhash64("doc_id", "text")
    drawn = known.select("lang", "text", h.alias("h")).filter((F.col("h") % 1_000_000 + 1_000_000) / 2_000_000 < share[F.col("lang")])
    rows = drawn.dropDuplicates(["lang", "h"]).select("lang", "h", _grams("text").alias("g")).select("lang", "h", "g.*").collect()
    rows.sort(key=lambda r: (r["lang"], r["h"]))
    languages = sorted({r["lang"] for r in rows})
    if not rows:
        return Model([], np.zeros((0, 0)), np.zeros((DIMS, 0)), np.zeros(0), np.zeros(0))
    inputs = np.zeros((len(rows), DIMS), np.float32)
    for i, r in enumerate(rows):
        inputs[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], "<f2")
    return train(languages, inputs, np.array([languages.index(r["lang"]) for r in rows]))


@F.arrow_udf(T.StructType().add("at", T.BinaryType()).add("value", T.BinaryType()))
def _grams(texts: pa.Array) -> pa.Array:
    """Numbers and values of the grams that a text has."""
    found = [grams(x) for x in raw(texts)]
    return structs([((at := np.flatnonzero(g)).astype("<u2").tobytes(), g[at].astype("<f2").tobytes()) for g in found], [("at", pa.binary()), ("value", pa.binary())])


_FIELDS = [("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())]


def predictor(docs: DataFrame, model: Model):
    """A column function: whole text to lang_pred, score, ambiguous; the model is broadcast."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType().add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean"))
    def predict(texts: pa.Array) -> pa.Array:
        return structs([shared.value.predict(x) for x in raw(texts)], _FIELDS)

    return predict


def predictions(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, ambiguous; other columns are ignored."""
    out = docs.select("doc_id", held_out.alias("held_out"), predictor(docs, model)(F.col("text").cast("string")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous")
