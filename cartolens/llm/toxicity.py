"""Toxicity by the nearest labelled examples: exact TF-IDF cosine through a block-max inverted index.

Fit: at most 2 * ``per_class`` labelled texts (a documented bound) become examples. All their words are indexed; vectors are
(1 + log tf) * idf * relevance of unit length. Relevance, ((1 + G) / (16 + G))^2 of the likelihood ratio G between the classes,
is never 0: it lets words that tell the classes apart outweigh a text's topic without dropping any. Examples are sorted by
their heaviest word and cut into blocks; the index holds, for each word and block with postings, the largest weight and where
the postings are. Search: the ``COMMON`` commonest words stand in nearly every block, so their part of all cosines is one matrix
product for a few texts at a time. It gives a floor under the k-th best cosine; with the block maxima of the text's other
words it gives each block a ceiling, and only the postings of blocks that reach the floor are read. The nearest k are exact;
ties go to the lower example number. Votes weigh 1 / (distance + 0.05)^2 and by class, so that classes count as among all
labelled rows; a logistic curve fitted to the examples' own leave-one-out votes makes them scores, rounded to 6 places.
Evidence: ids of the nearest examples.

Every text is scored whole in one narrow pass. Texts without a word of the vocabulary (null, empty) get the share of toxic
rows among such examples. Repeated rows get equal scores; ties of id, very long texts and extra columns need no care.
Without labelled rows every score is 0.5; with one class, that class's smoothed share; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from . import labelled
from .common import raw, structs, text_or_empty
from .text_hash import ALNUM, word_hashes

PER_CLASS = 1500
#: Likelihood ratio at which a word's relevance is about a quarter; it doesn't depend on the number of examples.
HALF = 15.0
NEAREST = 40
#: Lengths in bytes of the beginnings of words that count as words of their own.
STEMS = (4, 5, 6)
BLOCK = 64
#: Words whose weights of all examples are laid out in full, and texts scored at a time; results depend on neither.
COMMON, TOGETHER = 2048, 32
THRESHOLD = 0.3
EVIDENCE = 3


def counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words and of their first letters, so that a stem is known with any ending; and how many of each."""
    return np.unique(word_hashes(data, ALNUM, STEMS), return_counts=True)


def vocabulary(words: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of all words of the examples, in how many each is, and its likelihood ratio between the classes."""
    vocab, df = np.unique(np.concatenate(words), return_counts=True) if words else (np.empty(0, np.uint64), np.empty(0, int))
    hits = [w for w, y in zip(words, labels, strict=True) if y]
    found, n = np.unique(np.concatenate(hits), return_counts=True) if hits else (vocab[:0], df[:0])
    pos = np.zeros(len(vocab))
    pos[np.searchsorted(vocab, found)] = n
    total, toxic = len(labels), int(labels.sum())
    cells = [(pos, df * toxic), (df - pos, df * (total - toxic)), (toxic - pos, (total - df) * toxic), (total - toxic - df + pos, (total - df) * (total - toxic))]
    ratio = sum(np.where(seen > 0, 2 * seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expect / total, 1e-9)), 0) for seen, expect in cells)
    return vocab, df, np.maximum(ratio, 0)


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges begin..end, one after the other."""
    size = end - begin
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


@dataclass
class Index:
    """Of the examples only: postings as (word, example, weight) in that order, labels and ids of the examples, and the calibration."""

    vocab: np.ndarray
    idf: np.ndarray
    word: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    class_weight: tuple[float, float]
    curve: tuple[float, float]
    without: float

    def open(self) -> Index:
        """What is derived from the postings: a cell for each word and block that has any (its block, largest weight, and where
        its postings start), where each word's cells start, and the commonest words' weights of all examples: [row, example]."""
        if not hasattr(self, "cells"):
            n, words = len(self.labels), len(self.vocab)
            self.edges = np.arange(0, max(1, n), BLOCK)
            block = self.example // BLOCK
            first = np.flatnonzero(np.r_[True, (self.word[1:] != self.word[:-1]) | (block[1:] != block[:-1])]) if len(self.word) else np.empty(0, int)
            self.cell_block, self.cell_start = block[first], np.r_[first, len(self.word)].astype(np.int32)
            self.cell_most = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0, np.float32)
            self.cells = np.searchsorted(self.word[first], np.arange(words + 1)).astype(np.int32)
            df = np.bincount(self.word, minlength=words)
            common = np.sort(np.argsort(-df, kind="stable")[:COMMON])
            self.row = np.full(words, -1, np.int32)
            self.row[common] = np.arange(len(common))
            self.dense = np.zeros((len(common), n), np.float32)
            row = self.row[self.word]
            self.dense[row[row >= 0], self.example[row >= 0]] = self.weight[row >= 0]
        return self

    def vector(self, words: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.vocab):
            return np.empty(0, int), np.empty(0, np.float32)
        at = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        ok = self.vocab[at] == words
        value = (1 + np.log(tf[ok])) * self.idf[at[ok]]
        return at[ok], (value / max(1e-9, np.sqrt((value**2).sum()))).astype(np.float32)

    def common(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The common words' part of the cosines: [text, example]. The product always has ``TOGETHER`` rows, so that a text's
        result doesn't depend on its neighbours."""
        left = np.zeros((TOGETHER, len(self.dense)), np.float32)
        for i, (at, value) in enumerate(vectors):
            row = self.row[at]
            left[i, row[row >= 0]] = value[row >= 0]
        return left @ self.dense

    def nearest(self, at: np.ndarray, value: np.ndarray, k: int, part: np.ndarray | None = None, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples that share a word; ``part`` as from common(), ``skip`` leaves one out."""
        sims = self.common([(at, value)])[0] if part is None else part
        if skip >= 0:
            sims[skip] = -1
        rare = self.row[at] < 0
        if rare.any():
            floor = np.partition(sims, -k)[-k] if len(sims) > k else 0.0
            begin, end = self.cells[at[rare]], self.cells[at[rare] + 1]
            cell, own = _ranges(begin, end), np.repeat(value[rare], end - begin)
            ceiling = np.maximum.reduceat(sims, self.edges) + np.bincount(self.cell_block[cell], self.cell_most[cell] * own, len(self.edges))
            alive = (ceiling * 1.000001 >= floor)[self.cell_block[cell]]
            cell, own = cell[alive], own[alive]
            begin, end = self.cell_start[cell], self.cell_start[cell + 1]
            place = _ranges(begin, end)
            sims = sims + np.bincount(self.example[place], self.weight[place] * np.repeat(own, end - begin), len(sims))
            if skip >= 0:
                sims[skip] = -1
        least = np.partition(sims, -k)[-k] if len(sims) > k else 0.0
        found = np.flatnonzero((sims >= least) & (sims > 0))
        best = np.lexsort((found, -sims[found]))[:k]
        return found[best], sims[found[best]]

    def vote(self, found: np.ndarray, sims: np.ndarray) -> float:
        near = 1 / (1.05 - np.minimum(sims, 1)) ** 2 * np.array(self.class_weight)[self.labels[found]]
        # one vote at distance 1 for the classes as they are keeps thin evidence from being sure
        return float((near[self.labels[found] == 1].sum() + self.without) / (near.sum() + 1))

    def scores(self, texts: list[bytes]) -> Iterator[tuple[float, list[int]]]:
        """Score and evidence of each text."""
        for lo in range(0, len(texts), TOGETHER):
            vectors = [self.vector(*counts(x)) for x in texts[lo : lo + TOGETHER]]
            parts = self.common(vectors) if len(self.vocab) else [None] * len(vectors)
            for (at, value), part in zip(vectors, parts, strict=False):
                found, sims = self.nearest(at, value, NEAREST, part) if len(at) else (at, value)
                if not len(found):
                    yield self.without, []
                    continue
                v = np.clip(self.vote(found, sims), 1e-6, 1 - 1e-6)
                p = 1 / (1 + np.exp(-np.clip(self.curve[0] * np.log(v / (1 - v)) + self.curve[1], -30, 30)))
                yield round(float(p), 6), self.ids[found[:EVIDENCE]].tolist()


def _constant(p: float) -> Index:
    none = np.empty(0, int)
    return Index(np.empty(0, np.uint64), none, none, none, none, none, none, (1.0, 1.0), (1.0, 0.0), p)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope (0.2 to 5) and offset of a weighted logistic curve, with smoothed targets."""
    goal = np.where(y == 1, 1 - 1 / (2 + (y == 1).sum()), 1 / (2 + (y == 0).sum()))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = w * (p - goal), w * p * (1 - p) + 1e-9
        hessian = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-4]])
        step = np.linalg.solve(hessian, [(g * x).sum() + 1e-2 * (a - 1), g.sum() + 1e-4 * b])
        a, b = float(np.clip(a - np.clip(step[0], -1, 1), 0.2, 5)), float(b - np.clip(step[1], -1, 1))
    return a, b


def _alike(vectors: list[tuple[np.ndarray, np.ndarray]], words: int) -> list[int]:
    """Numbers of the vectors in an order that puts like ones into the same block: halved again and again at the median of
    the direction in which their commonest words vary most."""
    df = np.bincount(np.concatenate([at for at, _ in vectors]), minlength=words)
    common = np.argsort(-df, kind="stable")[:COMMON]
    column = np.full(words, -1)
    column[common] = np.arange(len(common))
    table = np.zeros((len(vectors), len(common)), np.float32)
    for i, (at, value) in enumerate(vectors):
        ok = column[at] >= 0
        table[i, column[at[ok]]] = value[ok]

    def halves(rows: np.ndarray) -> list[int]:
        if len(rows) <= BLOCK:
            return rows.tolist()
        part = table[rows] - table[rows].mean(0)
        axis = part[int((part**2).sum(1).argmax())]
        for _ in range(8):
            axis = (part @ axis) @ part
            axis /= max(1e-12, float(np.linalg.norm(axis)))
        blocks = -(-len(rows) // BLOCK)
        rows = rows[np.argsort(part @ axis, kind="stable")]
        return halves(rows[: blocks // 2 * BLOCK]) + halves(rows[blocks // 2 * BLOCK :])

    return halves(np.arange(len(vectors)))


def build(rows: list[tuple[int, int, np.ndarray, np.ndarray]], sizes: dict[int, int]) -> Index:
    """From (id, label, word hashes, counts) of the examples and the class sizes among all labelled rows."""
    if not rows:
        return _constant(0.5)
    labels = np.array([r[1] for r in rows])
    if len(set(labels.tolist())) < 2:
        n = len(rows)
        return _constant((n + 1) / (n + 2) if labels[0] else 1 / (n + 2))
    vocab, df, ratio = vocabulary([r[2] for r in rows], labels)
    relevance = ((1 + ratio) / (1 + HALF + ratio)) ** 2
    total = sum(sizes.values())
    class_weight = tuple(sizes[y] / total / (labels == y).mean() for y in (0, 1))
    index = Index(vocab, np.log(1 + len(rows) / np.maximum(df, 1)) * relevance, *[np.empty(0, int)] * 3, labels, np.array([r[0] for r in rows]),
        class_weight, (1.0, 0.0), sizes[1] / total)
    vectors = [index.vector(*r[2:]) for r in rows]
    order = _alike(vectors, len(vocab))
    vectors = [vectors[i] for i in order]
    index.labels, index.ids = labels[order], index.ids[order]
    weigh = np.array(class_weight)[index.labels]
    empty = np.array([not len(at) for at, _ in vectors])
    index.without = float((weigh[empty & (index.labels == 1)].sum() + sizes[1] / total) / (weigh[empty].sum() + 1))
    word = np.concatenate([at for at, _ in vectors]).astype(np.int32)
    by_word = np.argsort(word, kind="stable")
    index.word = word[by_word]
    index.example = np.repeat(np.arange(len(rows)), [len(at) for at, _ in vectors]).astype(np.int32)[by_word]
    index.weight = np.concatenate([value for _, value in vectors]).astype(np.float32)[by_word]
    index.open()
    votes = []
    for lo in range(0, len(vectors), TOGETHER):
        group = vectors[lo : lo + TOGETHER]
        votes += [index.vote(*index.nearest(at, value, NEAREST, part, lo + i)) for i,
            ((at, value), part) in enumerate(zip(group, index.common(group), strict=False)) if len(at)]
    if votes:
        v = np.clip(np.array(votes), 1e-6, 1 - 1e-6)
        index.curve = _logistic(np.log(v / (1 - v)), index.labels[~empty], weigh[~empty])
    for name in ("edges", "cell_block", "cell_start", "cell_most", "cells", "row", "dense"):
        delattr(index, name)
    return index


@F.arrow_udf(T.StructType().add("words", T.BinaryType()).add("counts", T.BinaryType()))
def _counts(texts: pa.Array) -> pa.Array:
    rows = [counts(x) for x in raw(texts)]
    return structs([(w.astype("<u8").tobytes(), n.astype("<i4").tobytes()) for w, n in rows], [("words", pa.binary()), ("counts", pa.binary())])


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, target: str = "toxic", per_class: int = PER_CLASS) -> Index:
    """An index of the labelled rows of ``allowed`` ids (all if None); reads the texts of at most 2 * per_class ids."""
    ship(docs.sparkSession)
    picked, sizes = labelled.sample(labels, target, F.lit(True) if allowed is None else allowed, per_class)
    if picked is None:
        return _constant(0.5)
    rows = labelled.texts(docs, picked).select("doc_id", "y", _counts("text").alias("c")).select("doc_id", "y", "c.*").collect()
    return build(sorted(((r["doc_id"], r["y"], np.frombuffer(r["words"], "<u8"), np.frombuffer(r["counts"], "<i4")) for r in rows), key=lambda r: r[0]), sizes)


_FIELDS = [("score", pa.float64()), ("evidence", pa.list_(pa.int64()))]


def scores(docs: DataFrame, index: Index, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, evidence (ids of the nearest examples); other columns are ignored."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(index)

    @F.arrow_udf(T.StructType().add("score", "double").add("evidence", T.ArrayType(T.LongType())))
    def score(texts: pa.Array) -> pa.Array:
        return structs(list(shared.value.open().scores(raw(texts))), _FIELDS)

    out = docs.select("doc_id", held_out.alias("held_out"), score(text_or_empty(F.col("text"))).alias("s"))
    return out.select("doc_id", "held_out", "s.score", (F.col("s.score") >= threshold).cast("int").alias("predicted"), "s.evidence")
