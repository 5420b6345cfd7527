"""N-gram Jaccard join: texts whose sets of five-word shingles have a Jaccard similarity of at least 3/4, by T-occurrence search.

A text's words are runs without ASCII white space, A-Z lower-cased; its set are its distinct 5-word shingles, or its whole
sequence as one if it has fewer words; null, empty and blank texts have no set and no links. Two sets x and y link if
100 |x & y| >= 75 |x | y|, hence only if |x & y| >= T(x) = ceil(3/4 |x|). Shingles, and sets as a whole (classes), are known
by 64-bit hashes: equal texts of any number are one class from the start.

1. Inverted lists, over all texts: a class posts the lowest |x| - T(x) + l(x) of its shingle hashes, l(x) = |x| / 5. Linked
   classes share at least min(l(x), l(y)) of these. Postings travel as packed arrays by hash bucket. A list of more than
   ``LONG`` classes is long; what one task sees very often is long at once and never meets in one bucket.
2. As in DivideSkip, short lists are merged and long ones only counted: a class whose shared lists are too few is out; a pair
   is a candidate if its short lists in common reach min(l(x), l(y)) less the long lists it could share. Classes with so many
   long lists that this says nothing are tied together by their long lists, each to the list's least class: no list is
   ever paired out.
3. The candidate graph's components are the groups. In a group a full T-occurrence search finds the links: every set's
   shortest inverted lists are heap-merged, the L longest are binary-probed for the classes that come often enough. Pairs
   already connected are skipped, since only connection is asked for. Groups of more than ``cap`` classes are cut into
   blocks: first each block by itself, then the classes of different components, block against block.

The result is exact but for hash collisions. Classes are told apart by 128 bits: 64 name them, and where two sets have the same
name but differ in the other 64, all names are made anew from another seed. Shingles are known by 64 bits, of which a list keeps
32 besides its bucket: a class whose m posted shingles meet in fewer lists has odds of about m^2 / (2^33 * buckets), 1e-8 for a
text of 1,000 words and 16 buckets, and it loses a link only if it had not one shared list to spare. What is connected is asked
for, not the number of links: pairs that are connected already are not compared.

Cost that grows faster than the rows: blocks of a large group are compared two by two, less those of one component, so a group
of many classes that share a long passage but are not near takes the square of its blocks. A group of near copies does not.

Null, empty and blank texts have no set and are their own component; very long texts are read whole. Rows of equal doc_id and
text get equal results and count once in the search; null ids never name a component unless all of it have none. An empty table
gives no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import packed, raw, removed, shared_dir, unpacked, written
from .components import components
from .text_hash import shingle_hashes, word_hashes

SHINGLE = 5
#: Classes beyond which an inverted list is long.
LONG = 32
#: Classes with one shingle in one task's batch beyond which it is long at once.
HOT = 512
#: Rows of the table for each part that a long list is cut into, and the least number of parts: a list of a third of all
#: classes meets in no one task.
PER_PART, PARTS = 200_000, 16
#: Postings that a bucket holds about, and that a task gathers before it sends them.
PER_BUCKET, BATCH = 1_000_000, 750_000
#: Classes of a group that are searched in one task.
CAP = 8192


def threshold(n: np.ndarray) -> np.ndarray:
    return -(-3 * n // 4)


def surplus(n: np.ndarray) -> np.ndarray:
    """Posted shingles beyond those that a linked set might all lack."""
    return np.maximum(1, n // 5)


def set_of(text: bytes) -> np.ndarray:
    return shingle_hashes(word_hashes(text), SHINGLE)


def class_of(shingles: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """The 64 bits that name a class, and another 64 that two classes of one name would differ in."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _sets(seed: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set_of(x) for x in raw(batch.column("text"))]
            names = [class_of(s, seed) if len(s) else (None, None) for s in found]
            columns = [pa.array(x, pa.int64()) for x in ([len(s) for s in found], [c for c, _ in names], [c for _, c in names])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *columns], ["doc_id", "th", "n_shingles", "cls", "rest"])

    return read


def _packed(shingles: np.ndarray, classes: np.ndarray, buckets: int, rng: np.random.Generator) -> pa.RecordBatch:
    """Postings of a batch as one row a bucket; very frequent shingles leave a mark there and go to a bucket of their own."""
    order = np.argsort(shingles, kind="stable")
    shingles, classes = shingles[order], classes[order]
    starts = np.flatnonzero(np.r_[True, shingles[1:] != shingles[:-1]])
    often = np.repeat(counts := np.diff(np.r_[starts, len(shingles)]), counts) > HOT
    rows = {"bucket": [], "h": [], "cls": [], "mark": []}

    def add(bucket: int, h: np.ndarray, c: np.ndarray, mark: np.ndarray) -> None:
        for k, v in zip(rows, (bucket, (h // np.uint64(buckets)).astype("<u4").tobytes(), c.astype("<i8").tobytes(),
            (mark // np.uint64(buckets)).astype("<u4").tobytes()), strict=True):
            rows[k].append(v)

    marks = np.unique(shingles[often])
    plain, owner = shingles[~often], classes[~often]
    own, mark_own = plain % np.uint64(buckets), marks % np.uint64(buckets)
    order = np.argsort(own, kind="stable")
    plain, owner, own = plain[order], owner[order], own[order]
    for b in np.unique(np.r_[own, mark_own]):
        lo, hi = np.searchsorted(own, [b, b + np.uint64(1)])
        add(int(b), plain[lo:hi], owner[lo:hi], marks[mark_own == b])
    for b in np.unique(shingles[often] % np.uint64(buckets)):
        # negative: spread at random; the rest of its number tells the bucket
        here = often & (shingles % np.uint64(buckets) == b)
        add(-1 - int(b) - buckets * int(rng.integers(1 << 20)), shingles[here], classes[here], marks[:0])
    return pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int64()), *[pa.array(rows[k], pa.binary()) for k in ("h", "cls", "mark")]], list(rows))


def _postings(buckets: int, seed: int = 0):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size, rng = 0, np.random.default_rng(1)

        def send() -> pa.RecordBatch:
            return _packed(np.concatenate(list(held.values())), np.repeat(np.array(list(held), np.int64), [len(v) for v in held.values()]), buckets, rng)

        for batch in batches:
            for text in batch.column("text"):
                s = set_of(text.as_buffer().to_pybytes() if text.is_valid else b"")
                if not len(s) or (c := class_of(s, seed)[0]) in held:
                    continue
                n = np.int64(len(s))
                held[c] = s[: n - threshold(n) + surplus(n)]
                size += len(held[c])
                if size >= BATCH:
                    yield send()
                    held, size = {}, 0
        if held:
            yield send()

    return post


def _lists(buckets: int):
    def meet(key: tuple, table: pa.Table) -> pa.Table:
        """Of one bucket: postings in lists of two classes or more, as (whether long, list, class)."""
        bucket = key[0].as_py()
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        h, c, mark = join("h", "<u4").astype(np.int64), join("cls", "<i8"), join("mark", "<u4").astype(np.int64)
        number = bucket if bucket >= 0 else (-1 - bucket) % buckets
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])][: len(h)]
        h, c = h[fresh], c[fresh]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        size = np.repeat(count := np.diff(np.r_[starts, len(h)]), count)
        long = (size > LONG) | np.isin(h, mark) | (bucket < 0)
        keep = (size > 1) | long
        return pa.table({"long": pa.array(long[keep]), "list": pa.array((h * buckets + number)[keep], pa.int64()), "cls": pa.array(c[keep], pa.int64())})

    return meet


class Group:
    """T-occurrence search among the sets of one group; only classes of different components are compared."""

    MU = 0.0085

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], label: np.ndarray):
        order = np.lexsort((ids, [len(s) for s in sets]))
        self.ids, self.sets = ids[order], [sets[i] for i in order]
        self.size = np.array([len(s) for s in self.sets])
        # components by number; equal given labels are one from the start
        self.label = np.unique(label[order], return_inverse=True)[1]
        tokens, inverse = np.unique(np.concatenate(self.sets), return_inverse=True)
        owner = np.repeat(np.arange(len(self.sets)), self.size)
        by_token = np.argsort(inverse, kind="stable")
        self.posted = owner[by_token]  # each list ascends, so the smaller sets come first
        self.start = np.searchsorted(inverse[by_token], np.arange(len(tokens) + 1))
        self.tokens = np.split(inverse, np.cumsum(self.size)[:-1])

    def search(self, x: int) -> None:
        n, mine = int(self.size[x]), self.tokens[x]
        least = int(threshold(np.int64(n)))
        lengths = self.start[mine + 1] - self.start[mine]
        many = min(least - 1, int(least / (self.MU * np.log2(max(2, lengths.max())) + 1)))
        mine = mine[np.argsort(lengths, kind="stable")]
        short, long = mine[: n - many], mine[n - many :]
        lists = [self.posted[self.start[t] : self.start[t + 1]] for t in short]
        # a set at most as large as this one, but not too small, and not yet connected with it
        lowest = np.searchsorted(self.size, least)
        lists = [p[(p >= lowest) & (p < x)] for p in lists if len(p) > 1]
        lists = [p[self.label[p] != self.label[x]] for p in lists]
        found, count = self.merge([p for p in lists if len(p)])
        need = -(-3 * (n + self.size[found]) // 7)
        found, count = found[count >= need - many], count[count >= need - many]
        order = np.argsort(-count, kind="stable")
        found, count = found[order], count[order]
        long = np.sort(long)
        while len(found):
            y, have = found[0], int(count[0])
            probe = self.tokens[y]
            at = np.minimum(np.searchsorted(probe, long), len(probe) - 1)
            both = have + int((probe[at] == long).sum())
            if 100 * both >= 75 * (n + int(self.size[y]) - both):
                self.label[self.label == self.label[y]] = self.label[x]
            keep = self.label[found] != self.label[x]
            keep[0] = False
            found, count = found[keep], count[keep]

    @staticmethod
    def merge(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Members of the sorted lists and in how many each is: by a heap, or where entries are many by one sort of the runs."""
        total = sum(map(len, lists))
        if total > 2048:
            return np.unique(np.concatenate(lists), return_counts=True)
        found, count = [], []
        for y in heapq.merge(*[p.tolist() for p in lists]):
            if found and found[-1] == y:
                count[-1] += 1
            else:
                found.append(y)
                count.append(1)
        return np.array(found, int), np.array(count, int)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Each class with the least class id of its component."""
        for x in range(1, len(self.sets)):
            self.search(x)
        least = np.full(self.label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, self.label, self.ids)
        return self.ids, least[self.label]


def _search(table: pa.Table) -> pa.Table:
    ids, first = np.unique(table.column("cls").to_numpy(), return_index=True)
    if len(ids) < 2:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    sets, label = table.column("shingles").to_pylist(), table.column("label").to_numpy()[first]
    own, least = Group(ids, [np.frombuffer(sets[i], "<u8") for i in first], label).run()
    return pa.table({"a": pa.array(own, pa.int64()), "b": pa.array(least, pa.int64())})


def _linked(sets: DataFrame, tasks: DataFrame) -> DataFrame:
    """Edges (a, b) found in each task; ``tasks`` (cls, label, task), ``sets`` (cls, shingles)."""
    return sets.join(tasks, "cls").groupBy("task").applyInArrow(_search, "a long, b long")


def _blocks(members: DataFrame, sets: DataFrame, cap: int, root: str) -> DataFrame:
    """Edges within groups too large for a task; ``members``: (cls, grp, size)."""
    blocks = F.ceil(F.col("size") / cap).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    first = placed.select("cls", F.col("cls").alias("label"), F.xxhash64("grp", "block").alias("task"))
    # a class is in one task only, so what a task finds are stars around the least class of each component
    named = lambda edges, old: edges.select(F.col("a").alias(old), F.col("b").alias("named"))
    inner = written(_linked(sets, first), root, "inner")
    placed = placed.join(named(inner, "cls"), "cls", "left").withColumn("label", F.coalesce("named", "cls")).drop("named")
    # one class of each component of a block, again in blocks: joins the bulk of a group of near copies
    heads = placed.filter(F.col("cls") == F.col("label"))
    heads = heads.select("cls", "label", F.xxhash64("grp", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")), F.lit("h")).alias("task"))
    across = written(_linked(sets, heads), root, "heads")
    placed = placed.join(named(across, "label"), "label", "left").withColumn("label", F.coalesce("named", "label")).drop("named")
    # blocks anew, those of a large component by themselves: two blocks of one component need no comparison
    sizes = placed.groupBy("grp", "label").agg(F.count("*").alias("own")).withColumn("whole", F.col("own") * 4 > cap)
    rest = sizes.filter("NOT whole").groupBy("grp").agg(F.sum("own").alias("others"))
    placed = placed.join(sizes, ["grp", "label"]).join(rest, "grp", "left")
    number = lambda seed, n: F.pmod(F.xxhash64("cls", F.lit(seed)), F.ceil(F.col(n) / cap)).cast("string")
    placed = placed.withColumn("part", F.when(F.col("whole"), F.concat_ws("/", "label", number(2, "own"))).otherwise(F.concat_ws("/", F.lit("rest"),
        number(3, "others"))))
    placed = written(placed.select("cls", "grp", "label", "part", "whole"), root, "parts")
    parts = placed.groupBy("grp", "part").agg(F.min("label").alias("label"), F.max("whole").alias("whole"))
    one, two = parts.alias("p"), parts.alias("q")
    pairs = one.join(two, (F.col("p.grp") == F.col("q.grp")) & (F.col("p.part") <= F.col("q.part")) & ~(F.col("p.whole") & F.col("q.whole") & (F.col("p.label") == F.col("q.label"))))
    pairs = pairs.select(F.col("p.grp").alias("grp"), F.explode(F.array_distinct(F.array("p.part", "q.part"))).alias("part"),
        F.xxhash64("p.grp", "p.part", "q.part").alias("task"))
    last = placed.join(pairs, ["grp", "part"]).select("cls", "label", "task").distinct()
    return inner.union(across).union(_linked(sets, last))


def join(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id that links reach, its own included)."""
    spark = ship(docs.sparkSession)
    root = shared_dir(spark)
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    for seed in count():
        rows = written(texts.mapInArrow(_sets(seed), f"doc_id {kind}, th long, n_shingles long, cls long, rest long"), root, f"rows-{seed}")
        named = rows.filter("cls IS NOT NULL").groupBy("cls")
        if not named.agg(F.min("rest").alias("a"), F.max("rest").alias("b")).filter("a <> b").limit(1).count():
            break
    classes = named.agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"))
    total, n_rows = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    buckets = max(16, int(total // 2 // PER_BUCKET) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    posted = texts.select("text").mapInArrow(_postings(buckets, seed), "bucket long, h binary, cls binary, mark binary")
    lists = written(posted.groupBy("bucket").applyInArrow(_lists(buckets), "long boolean, list long, cls long"), root, "lists")
    shared = lists.groupBy("cls").agg(F.count_if(~F.col("long")).alias("short"), F.count_if("long").alias("long"))
    spare = lambda n: F.greatest(F.lit(1), F.floor(n / 5))
    alive = shared.join(classes.select("cls", "n"), "cls").withColumn("low", spare(F.ceil(F.col("n") * 3 / 4)))
    alive = written(alive.filter("short + long >= low").select("cls", "n", F.col("long").alias("n_long"), (F.col("long") >= F.col("low")).alias("loose")), root, "alive")

    members = F.array_sort(F.collect_list(F.struct("cls", "n", "n_long"))).alias("m")
    merged = lists.filter("NOT long").join(alive, "cls").groupBy("list").agg(members).filter(F.size("m") > 1)
    pair = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pairs = merged.select(F.explode(pair).alias("p")).groupBy("p").agg(F.count("*").alias("c"))
    need = F.greatest(F.lit(1), F.least(spare(F.col("p.x.n")), spare(F.col("p.y.n"))) - F.least("p.x.n_long", "p.y.n_long"))
    close = (F.col("p.x.n") * 4 >= F.col("p.y.n") * 3) & (F.col("p.y.n") * 4 >= F.col("p.x.n") * 3)
    pairs = pairs.filter((F.col("c") >= need) & close).select(F.col("p.x.cls").alias("a"), F.col("p.y.cls").alias("b"))
    # a long list is cut into salted parts, its classes tied to their part's least one, and those to the list's
    loose = lists.filter("long").join(alive.filter("loose").select("cls"), "cls")
    loose = loose.select("list", "cls", F.pmod(F.xxhash64("cls"), F.lit(max(PARTS, n_rows // PER_PART))).alias("part"))
    least = loose.groupBy("list", "part").agg(F.min("cls").alias("b"))
    inner = loose.join(least, ["list", "part"]).select(F.col("cls").alias("a"), "b")
    outer = least.join(least.groupBy("list").agg(F.min("b").alias("c")), "list").select(F.col("b").alias("a"), F.col("c").alias("b"))
    stars = inner.union(outer).filter("a <> b").distinct()
    groups = components(pairs.union(stars), root, "groups").select(F.col("node").alias("cls"), F.col("component").alias("grp"))
    groups = written(groups.join(groups.groupBy("grp").agg(F.count("*").alias("size")), "grp"), root, "grouped")

    wanted = groups.join(classes, "cls").select("cls", F.col("rep.doc_id").alias("_id"), F.col("rep.th").alias("_th"))
    wanted = written(wanted, root, "wanted")
    # the texts of the groups: by a small list of ids where a count shows that it is small, else by a shuffle
    if wanted.count() <= 500_000:
        wanted = F.broadcast(wanted)
    found = texts.join(wanted, texts["doc_id"].eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("cls", "text")
    sets = written(found.mapInArrow(_shingles, "cls long, shingles binary"), root, "sets")
    plain = groups.filter(F.col("size") <= cap).select("cls", F.col("cls").alias("label"), F.col("grp").alias("task"))
    links = written(_linked(sets, plain), root, "links")
    large = groups.filter(F.col("size") > cap)
    if large.limit(1).count():
        more = written(_blocks(large, sets, cap, root), root, "more")
        joined = components(links.union(more), root, "all").select(F.col("node").alias("cls"), F.col("component").alias("head"))
    else:
        joined = links.select(F.col("a").alias("cls"), F.col("b").alias("head"))

    heads = classes.select("cls", "least").join(joined, "cls", "left").withColumn("head", F.coalesce("head", "cls"))
    named = heads.join(heads.groupBy("head").agg(F.min("least").alias("component_id")), "head").select(F.col("cls").alias("_cls"), "component_id")
    named = written(named, root, "named")
    removed(spark, root, f"rows-{seed}", "named")
    # texts without a set have no class to be joined by
    out = rows.filter("cls IS NOT NULL").join(named, F.col("cls") == F.col("_cls")).select("doc_id", "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(rows.filter("cls IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each class, once a task, however often its row is repeated."""
    seen: set[int] = set()
    for batch in batches:
        own = batch.column("cls").to_pylist()
        new = [i for i, c in enumerate(own) if not (c in seen or seen.add(c))]
        texts = raw(batch.column("text").take(pa.array(new, pa.int64())))
        yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in new], pa.int64()),
            pa.array([set_of(x).astype("<u8").tobytes() for x in texts], pa.binary())], ["cls", "shingles"])


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, whose doc_id names their component: one document of each group stays.

    Rows without id, and those that repeat a kept id, stay: no one else names them.
    """
    gone = join(docs).filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    rows = packed(docs).join(gone, F.col("row.doc_id") == F.col("doc_id"), "left_anti")
    return rows.select(*unpacked(rows, docs.columns))
