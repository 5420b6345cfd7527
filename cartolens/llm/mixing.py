"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in the order of a hash of their id, are laid end to end and cut into blocks of ``block`` units (characters).
A source with weight w of a total W (the target weights themselves, as exact integers, never rounded) has its k-th block of a
phase released at floor(k W / w) and due at ceil((k + 1) W / w). Earliest-deadline-first over the released blocks meets every
deadline, since the weights fill the slots exactly, so after any slot each source is less than one block away from its share,
however long the phase is. When a source has run out, a new phase starts with the weights of the rest. Every row is kept, in
one place.

The schedule is made on an executor as a stream over the sources' sizes, any number of them: its state is a few numbers a source,
its rows hold the slots of one source in a range of ``total`` slots, and it is joined to the rows by source and block, not
broadcast. It is one pass in one task, a few microseconds for each block of text and for each source of each phase; a larger
``block`` makes it shorter. Running places are counted within (source, hash bucket) groups, more of them the more rows there are.

A row lies whole in the slot in which it begins. The less-than-one-block bound is on slots: of the texts themselves the share of a
source may besides be off by the length of its text that crosses the end of a block, so by more than a block where a text is
longer than one; the blocks that such a text covers whole leave their slots empty.

Null texts have size one unit, as empty ones; a null source is a source of its own; rows are ordered by a hash of id and text, so
null and repeated ids spread; equal rows are interchangeable. An empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction
from itertools import count, islice
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..runtime import ship
from .common import packed, unpacked

BLOCK = 1 << 16
#: Hash buckets of a source, at least; rows of all sources for each bucket beyond that.
BUCKETS, PER_BUCKET = 256, 500_000
#: Slots of a range of the schedule: how it is cut into rows, nothing else.
TOTAL = 1000
#: Rows of the schedule in an Arrow batch.
BATCH = 256


def turns(weights: list[int]) -> Iterator[int]:
    """For each slot, without end, the number of the source that gets it, by EDF over released blocks (ties: lowest number)."""
    total = sum(weights)
    waiting = [(0, i, 0) for i, w in enumerate(weights) if w]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    for slot in count():
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[i]), i, k))
        _, i, k = heapq.heappop(ready)
        yield i
        heapq.heappush(waiting, ((k + 1) * total // weights[i], i, k + 1))


def period(weights: list[int]) -> list[int]:
    """The turns after which each source has had its integer weight."""
    return list(islice(turns(weights), sum(weights)))


def exact(weights: Mapping[object, float]) -> dict[object, int]:
    """Weights as integers in exactly the same proportions."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("target weights must be positive")
    shares = {k: Fraction(w) for k, w in weights.items()}
    scale = lcm(*(w.denominator for w in shares.values()))
    return {k: int(w * scale) for k, w in shares.items()}


@dataclass
class Phase:
    """A source's part of a range of ``length`` slots at most: block first + j goes to slot start + slots[j], for j under ``count``."""

    source: object
    first: int
    count: int
    start: int
    length: int
    slots: list[int]


def phases(blocks: Mapping[object, int], weights: Mapping[object, float], total: int = TOTAL) -> Iterator[Phase]:
    """The schedule of given numbers of blocks, in ranges of at most ``total`` slots. A phase ends at the first turn that its
    source cannot take; the next phase's weights leave that source out."""
    left, done, start = dict(blocks), dict.fromkeys(blocks, 0), 0
    while active := sorted((s for s in left if left[s]), key=lambda s: (s is None, str(s))):
        shares = exact({s: weights[s] for s in active})
        order, ended = turns([shares[s] for s in active]), False
        while not ended:
            places: dict[object, list[int]] = {}
            length = 0
            while length < total:
                s = active[next(order)]
                if ended := not left[s]:
                    break
                places.setdefault(s, []).append(length)
                left[s] -= 1
                length += 1
            for s, slots in places.items():
                yield Phase(s, done[s], len(slots), start, length, slots)
                done[s] += len(slots)
            start += length


def tempered(sizes: Mapping[object, int], power: float = 0.5) -> dict[object, float]:
    """Target weights that flatten the sources' sizes, as is usual for training mixes."""
    return {s: n**power for s, n in sizes.items()}


_SCHEDULE = T.StructType().add("_key", "string").add("_first", "long").add("_start", "long").add("_slots", T.ArrayType(T.LongType()))
_ARROW = pa.schema([("_key", pa.string()), ("_first", pa.int64()), ("_start", pa.int64()), ("_slots", pa.list_(pa.int64()))])


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _placed(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, _th, _key, _size, _begin (units of the source before the row)."""
    size = F.greatest(F.lit(1), F.coalesce(F.length("text"), F.lit(0))).cast("long")
    slim = docs.select("doc_id", F.xxhash64("text").alias("_th"), _key(F.col("source")).alias("_key"), size.alias("_size"))
    bits = max(1, (buckets - 1).bit_length())
    slim = slim.withColumn("_h", F.xxhash64("doc_id", "_th")).withColumn("_bucket", F.shiftright("_h", 64 - bits).cast("int"))
    inner = Window.partitionBy("_key", "_bucket").orderBy("_h", "doc_id", "_th").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = slim.withColumn("_inner", F.sum("_size").over(inner) - F.col("_size"))
    sums = slim.groupBy("_key", "_bucket").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_key", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    return rows.join(sums, ["_key", "_bucket"]).select("doc_id", "_th", "_key", "_size", (F.col("_inner") + F.col("_offset")).alias("_begin"))


def schedule(docs: DataFrame, weights: Mapping[object, float] | None = None, block: int = BLOCK, total: int = TOTAL) -> DataFrame:
    """The Pfair schedule as a table: a row for each source and range of slots. ``weights`` by source (None is a null source);
    sources that it leaves out are an error, and none at all means tempered sizes."""
    size = F.greatest(F.lit(1), F.coalesce(F.length("text"), F.lit(0))).cast("long")
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(size).alias("n"))
    if weights is not None:
        exact(weights)
        left_out = F.coalesce(~F.col("source").isin([str(s) for s in weights if s is not None]), F.lit(None not in weights))
        if (lost := sizes.filter(left_out).first()) is not None:
            raise KeyError(lost["source"])
        weights = {None if s is None else str(s): w for s, w in weights.items()}
    ship(docs.sparkSession)

    def rows(batches):
        found = {s: n for b in batches for s, n in zip(*(b.column(c).to_pylist() for c in ("source", "n")), strict=True)}
        plan = phases({s: -(-n // block) for s, n in found.items()}, tempered(found) if weights is None else weights, total)
        while part := list(islice(plan, BATCH)):
            keys = ["n" if p.source is None else f"s{p.source}" for p in part]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x,
                f in zip((keys, [p.first for p in part], [p.start for p in part], [p.slots for p in part]), _ARROW, strict=True)], schema=_ARROW)

    return sizes.coalesce(1).mapInArrow(rows, _SCHEDULE)


def mixed(docs: DataFrame, weights: Mapping[object, float] | None = None, block: int = BLOCK, total: int = TOTAL, buckets: int | None = None) -> DataFrame:
    """Per row: doc_id, source, text_hash, block (of its source, by where the row begins), slot (of the mix), place (units of
    the block before the row). Sorting by slot, place, doc_id, text_hash gives the mix."""
    turn = F.posexplode("_slots").alias("_at", "_turn")
    plan = schedule(docs, weights, block, total).select("_key", "_first", "_start", turn)
    # a merge join: what Spark supposes of the schedule's size is that of one row, and it must not be broadcast for that
    plan = plan.select("_key", (F.col("_first") + F.col("_at")).alias("_b"), (F.col("_start") + F.col("_turn")).alias("_slot")).hint("merge")
    rows = _placed(docs, max(BUCKETS, docs.count() // PER_BUCKET) if buckets is None else buckets).withColumn("_block",
        F.floor(F.col("_begin") / block).cast("long")).withColumnRenamed("_key", "_k")
    rows = rows.join(plan, (F.col("_k") == F.col("_key")) & (F.col("_block") == F.col("_b")))
    source = F.when(F.col("_k") == "n", F.lit(None)).otherwise(F.substring("_k", 2, 1 << 30))
    return rows.select("doc_id", source.alias("source"), F.col("_th").alias("text_hash"), F.col("_block").alias("block"),
        F.col("_slot").alias("slot"), (F.col("_begin") % block).cast("long").alias("place"), F.col("_size").alias("size"))


def in_order(docs: DataFrame, weights: Mapping[object, float] | None = None, block: int = BLOCK, total: int = TOTAL) -> DataFrame:
    """``docs``, all rows and columns, in the order of the mix: written files read one after the other give it.

    The ranges are cut by slot; equal rows are interchangeable and share the place of the first."""
    places = mixed(docs, weights, block, total).groupBy("doc_id", "source", "text_hash").agg(F.min(F.struct("slot", "place")).alias("at"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").cast("string").eqNullSafe(F.col("source")) & (F.xxhash64("row.text") == F.col("text_hash"))
    out = packed(docs).join(places, same)
    order = ["at", "doc_id", "text_hash"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*unpacked(out, docs.columns))
