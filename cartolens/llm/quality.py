"""Quality classifier: a factorisation machine over hashed words, structure statistics and size metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), linear in a text's distinct words.
The model is fitted on at most 2 * ``per_class`` labelled texts (a documented bound), weighted back to the class sizes of
all labelled rows; every text is then scored whole, in one narrow pass. Null texts count as empty and get a score too.
Of a repeated id the text of least hash is learned from. Without labelled rows every score is 0.5; with one class, that
class's smoothed share; an empty table gives no rows. Repeated rows get equal scores, extra columns are kept or ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from . import labelled
from .common import raw, structs, text_or_empty
from .text_hash import LOWER, word_hashes

DIMS = 1 << 13
RANK = 6
BINS = 8
PER_CLASS = 1500
THRESHOLD = 0.3
#: Names of the statistics, in the order of stats().
STATS = ("log_bytes", "log_words", "log_lines", "line_length", "word_length", "upper", "digit", "space", "symbol", "terminal", "high_byte",
    "distinct_words", "top_word", "repeated_lines", "longest_line", "shouted_words", "odd_endings", "bars", "exclaims", "vowels")

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 5
_CLASS[[33, 46, 63]] = 6
_CLASS[128:] = 7
_ODD = np.zeros(256, bool)
_ODD[[b for b in b"#$%&*@^~|<>=_+\\"]] = True


def stats(data: bytes, words: np.ndarray) -> np.ndarray:
    """Structure statistics and size metadata of a text; all finite, also for an empty one."""
    n, m = len(data), len(words)
    if not n:
        return np.zeros(len(STATS), np.float32)
    buf = np.frombuffer(data, np.uint8)
    share = np.bincount(_CLASS[buf], minlength=8) / n
    count = np.bincount(buf, minlength=256)
    lines = data.split(b"\n")
    full = [x for x in lines if x.strip()]
    _, repeats = np.unique(words, return_counts=True) if m else (None, np.zeros(1, int))
    space = _CLASS[buf] == 4
    last = np.flatnonzero(~space & np.r_[space[1:], True])
    first = np.flatnonzero(~space & np.r_[True, space[:-1]])
    shouted = np.mean((_CLASS[buf[first]] == 1) & (_CLASS[buf[np.minimum(first + 1, n - 1)]] == 1)) if m else 0.0
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    vowels = sum(int(count[v] + count[v - 32]) for v in b"aeiou")
    return np.array(
        [np.log1p(n), np.log1p(m), np.log1p(len(lines)), np.log1p(n / max(1, len(full))), n / max(1, m), share[1], share[3], share[4], share[5], share[6], share[7],
         len(repeats) / max(1, m), repeats.max() / max(1, m), 1 - len(set(full)) / max(1, len(full)), max(map(len, lines)) / n, shouted,
         np.mean(_ODD[buf[last]]) if m else 0.0, count[124] / n, count[33] / n, vowels / letters],
        np.float32,
    )


def features(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words (index, value of unit length) and statistics."""
    words = word_hashes(data, LOWER)
    index, count = np.unique((words % np.uint64(DIMS)).astype(np.int32), return_counts=True)
    value = np.log1p(count).astype(np.float32)
    return index, value / max(1e-9, float(np.sqrt((value**2).sum()))), stats(data, words)


@dataclass
class Model:
    """w0, linear weights, factors (one row a feature) and the cut points of each statistic's bins; fixed size."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    cuts: np.ndarray

    def inputs(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        index, value, stat = features(data)
        return self.join(index, value, stat)

    def join(self, index, value, stat) -> tuple[np.ndarray, np.ndarray]:
        bins = (stat[:, None] > self.cuts).sum(1) + np.arange(len(stat)) * (self.cuts.shape[1] + 1) + DIMS
        return np.r_[index, bins].astype(np.int32), np.r_[value, np.full(len(stat), 0.5, np.float32)]

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        part = self.factors[index] * value[:, None]
        total = part.sum(0)
        return float(self.bias + self.linear[index] @ value + 0.5 * (total @ total - (part * part).sum()))

    def score(self, data: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*self.inputs(data)), -30, 30))))


def _constant(p: float) -> Model:
    size = DIMS + len(STATS)
    return Model(float(np.log(p / (1 - p))), np.zeros(size, np.float32), np.zeros((size, RANK), np.float32), np.zeros((len(STATS), 0), np.float32))


def train(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], sizes: dict[int, int], epochs: int = 12, rate: float = 0.08,
    decay: float = 2e-3, seed: int = 7) -> Model:
    """Logistic loss by AdaGrad over small batches; ``rows``: label, index, value, statistics."""
    if not rows:
        return _constant(0.5)
    if len({r[0] for r in rows}) < 2:
        n = len(rows)
        return _constant((n + 1) / (n + 2) if rows[0][0] else 1 / (n + 2))
    labels = np.array([r[0] for r in rows])
    cuts = np.quantile(np.stack([r[3] for r in rows]), np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.astype(np.float32)
    rng = np.random.default_rng(seed)
    size = DIMS + len(STATS) * BINS
    model = Model(0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32), cuts)
    inputs = [model.join(*r[1:]) for r in rows]
    total = sum(sizes.values())
    weight = np.array([sizes[y] / total / max(1, (labels == y).sum()) for y in (0, 1)])[labels] * len(rows)
    seen_w, seen_v, seen_b = np.full(size, 1e-4, np.float32), np.full((size, RANK), 1e-4, np.float32), 1e-4
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 32)):
            index = np.concatenate([inputs[i][0] for i in batch])
            value = np.concatenate([inputs[i][1] for i in batch])
            row = np.repeat(np.arange(len(batch)), [len(inputs[i][0]) for i in batch])
            part = model.factors[index] * value[:, None]
            sums = np.stack([np.bincount(row, part[:, f], len(batch)) for f in range(RANK)], 1)
            margin = model.bias + np.bincount(row, model.linear[index] * value, len(batch)) + 0.5 * ((sums**2).sum(1) - np.bincount(row, (part**2).sum(1), len(batch)))
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[batch]) * weight[batch] / len(batch)
            used, place = np.unique(index, return_inverse=True)
            g = slope[row] * value
            gw = np.bincount(place, g, len(used)) + decay * model.linear[used] / len(batch)
            gv = np.stack([np.bincount(place, g * (sums[row, f] - part[:, f]), len(used)) for f in range(RANK)], 1) + decay * model.factors[used] / len(batch)
            seen_b += slope.sum() ** 2
            model.bias -= rate * slope.sum() / np.sqrt(seen_b)
            seen_w[used] += gw**2
            model.linear[used] -= rate * gw / np.sqrt(seen_w[used])
            seen_v[used] += gv**2
            model.factors[used] -= rate * 0.5 * gv / np.sqrt(seen_v[used])
    return model


_ROW = [("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float32())), ("stat", pa.list_(pa.float32()))]


@F.arrow_udf(T.StructType().add("index", T.ArrayType(T.IntegerType())).add("value", T.ArrayType(T.FloatType())).add("stat", T.ArrayType(T.FloatType())))
def _features(texts: pa.Array) -> pa.Array:
    return structs([features(x) for x in raw(texts)], _ROW)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, target: str = "quality", per_class: int = PER_CLASS) -> Model:
    """A model from the labelled rows of ``allowed`` ids (all if None); reads the texts of at most 2 * per_class ids."""
    ship(docs.sparkSession)
    picked, sizes = labelled.sample(labels, target, F.lit(True) if allowed is None else allowed, per_class)
    if picked is None:
        return _constant(0.5)
    rows = labelled.texts(docs, picked).select("doc_id", "y", _features("text").alias("f")).select("doc_id", "y", "f.*").collect()
    rows = sorted(((r["doc_id"], r["y"], np.array(r["index"], np.int32), np.array(r["value"], np.float32),
        np.array(r["stat"], np.float32)) for r in rows), key=lambda r: r[0])
    return train([r[1:] for r in rows], sizes)


def scorer(docs: DataFrame, model: Model):
    """A column function: whole text to score; the fixed-size model is broadcast."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(x) for x in raw(texts)], pa.float64())

    return score


def scores(docs: DataFrame, model: Model, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Repeated rows get equal scores; other columns are ignored."""
    out = docs.select("doc_id", held_out.alias("held_out"), scorer(docs, model)(text_or_empty(F.col("text"))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all their columns, whose score reaches the threshold."""
    return docs.filter(scorer(docs, model)(text_or_empty(docs["text"])) >= threshold)
