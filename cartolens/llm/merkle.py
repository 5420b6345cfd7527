"""Document fingerprints: a Merkle tree over paragraphs and sections; DataFrame functions only.

A text is cut without loss: a section ends after a blank line, a paragraph after a line break, and a leaf, of ``LEAST`` to
``MOST`` characters, at the first mark or word end of a few letters after its least length. What ends a leaf is the text itself
and not a count, so leaves fall into step again after an insertion. A leaf's digest is its SHA-256, a paragraph's is that of its
leaves' digests, a section's that of its paragraphs', and the root's that of its sections': equal roots mean equal texts. A
fingerprint is the root and the tree in short: six hexadecimal digits a leaf.

Two trees are compared from above. Sections with equal digests are alike and not entered; of the others, paragraphs with equal
digests are alike and not entered; of the rest the leaves are compared. The likeness is twice the leaves of what is alike by all
leaves, where a branch that a text repeats counts once (Dice; two empty texts are alike). The branches entered locate the edits.

A null text counts as empty; an empty text has one section of one paragraph without leaves. The next document of each row, by
descending doc_id (numbers or strings; ties by text hash, null ids last, after the last row the first), is found without a global
sort: rows are dealt into ranges of about ``PER_RANGE`` rows. Ranges are cut at percentiles of the ids, so outliers move no other
row, and evenly between two percentiles; null ids are dealt by text hash. Rows of equal id share a range. Repeated rows follow one
another. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import text_or_empty

#: Characters of a leaf.
LEAST, MOST = 12, 48
#: Percentiles at which ids are cut, and rows of a range.
CELLS, PER_RANGE = 256, 1500
_LEAF = rf"(?s).{{{LEAST},{MOST - 1}}}?(?:[.!?;:,]+\s+|[aenrst]\s+)|.{{1,{MOST}}}"


def _digest(level: str, children: Column) -> Column:
    return F.sha2(F.concat(F.lit(level), F.array_join(children, "")), 256)


def _key(digest: Column, leaves: Column) -> Column:
    """What branches are compared by: 64 bits of the digest, and the number of leaves below."""
    return F.concat(F.substring(digest, 1, 16), F.lit(":"), leaves.cast("string"))


def tree(text: Column) -> Column:
    """array<struct<digest, key, paragraphs array<struct<key, leaves array<string>>>>>: the sections of a text."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(_LEAF), F.lit(0)), lambda x: F.sha2(x, 256))
    paragraph = lambda d: F.struct(_digest("p", d).alias("digest"), F.size(d).alias("n"), F.transform(d, lambda x: F.substring(x, 1, 6)).alias("leaves"))
    section = lambda p: F.struct(
        _digest("s", F.transform(p, lambda x: x["digest"])).alias("digest"), F.aggregate(p, F.lit(0), lambda a, x: a + x["n"]).alias("n"),
        F.transform(p, lambda x: F.struct(_key(x["digest"], x["n"]).alias("key"), x["leaves"].alias("leaves"))).alias("paragraphs"),
    )
    cut = F.transform(F.split(text, "(?<=\n\n)", -1), lambda s: F.transform(F.split(s, "(?<=\n)", -1), leaves))
    made = F.transform(F.transform(cut, lambda s: F.transform(s, paragraph)), section)
    return F.transform(made, lambda s: F.struct(s["digest"].alias("digest"), _key(s["digest"], s["n"]).alias("key"), s["paragraphs"].alias("paragraphs")))


def root(nodes: Column) -> Column:
    return _digest("r", F.transform(nodes, lambda s: s["digest"]))


def fingerprint(nodes: Column) -> Column:
    """The root, "|", then the leaves: sections parted by ";", paragraphs by ","."""
    body = F.transform(nodes, lambda s: F.array_join(F.transform(s["paragraphs"], lambda p: F.array_join(p["leaves"], "")), ","))
    return F.concat(root(nodes), F.lit("|"), F.array_join(body, ";"))


def _keys(nodes: Column) -> Column:
    return F.transform(nodes, lambda x: x["key"])


def _others(nodes: Column, alike: Column) -> Column:
    return F.filter(nodes, lambda x: ~F.array_contains(alike, x["key"]))


def _below(keys: Column) -> Column:
    return F.aggregate(keys, F.lit(0), lambda n, k: n + F.substring_index(k, ":", -1).cast("int"))


def compared(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``df`` with the trees of columns ``a`` and ``b`` compared: ``name``, their likeness; ``name``_edits, array<struct<section,
    paragraph>>, the numbers of the paragraphs of ``a`` that ``b`` does not have, in order."""
    at = lambda c: f"_{name}_{c}"
    inside = lambda x: F.flatten(F.transform(_others(F.col(x), F.col(at("s"))), lambda s: s["paragraphs"]))
    rest = lambda x: F.array_distinct(F.flatten(F.transform(_others(F.col(x), F.col(at("p"))), lambda p: p["leaves"])))
    out = df.withColumn(at("s"), F.array_intersect(_keys(F.col(a)), _keys(F.col(b))))
    out = out.withColumns({at("pa"): inside(a), at("pb"): inside(b)})
    out = out.withColumn(at("p"), F.array_intersect(_keys(F.col(at("pa"))), _keys(F.col(at("pb")))))
    out = out.withColumns({at("la"): rest(at("pa")), at("lb"): rest(at("pb")), at("n"): _below(F.col(at("s"))) + _below(F.col(at("p")))})
    total = 2 * F.col(at("n")) + F.size(at("la")) + F.size(at("lb"))
    common = F.col(at("n")) + F.size(F.array_intersect(at("la"), at("lb")))
    number = lambda s, i: F.when(~F.array_contains(at("s"), s["key"]),
        F.transform(s["paragraphs"], lambda p, j: F.when(~F.array_contains(at("p"), p["key"]),
        F.struct(i.alias("section"), j.alias("paragraph")))))
    edits = F.filter(F.flatten(F.filter(F.transform(F.col(a), number), lambda s: s.isNotNull())), lambda p: p.isNotNull())
    return out.withColumns({name: F.when(total == 0, F.lit(1.0)).otherwise(2.0 * common / total),
        f"{name}_edits": edits}).drop(*[at(c) for c in ("s", "pa", "pb", "p", "la", "lb", "n")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the tree's sections and the fingerprint."""
    t = docs.select("doc_id", tree(text_or_empty(F.col("text"))).alias("sections"))
    return t.select("doc_id", "sections", fingerprint(F.col("sections")).alias("fingerprint"))


def _number(docs: DataFrame) -> Column:
    """A number that does not fall when doc_id rises: itself, or of strings the first seven bytes in which ids differ."""
    if isinstance(docs.schema["doc_id"].dataType, T.NumericType):
        return F.col("doc_id")
    low, high = docs.agg(F.min(F.col("doc_id").cast("string")), F.max(F.col("doc_id").cast("string"))).first()
    same = len(os.path.commonprefix([(low or "").encode(), (high or "").encode()]))
    digits = F.substring(F.hex(F.col("doc_id").cast("string").cast("binary")), 2 * same + 1, 14)
    return F.when(F.col("doc_id").isNotNull(), F.conv(F.rpad(digits, 14, "0"), 16, 10).cast("long"))


def _count_of(value: Column, cuts: list, lo: int = 0) -> Column:
    """How many of the ascending cuts the value reaches, by bisection, plus ``lo``."""
    if not cuts:
        return F.lit(lo)
    mid = len(cuts) // 2
    return F.when(value < F.lit(cuts[mid]), _count_of(value, cuts[:mid], lo)).otherwise(_count_of(value, cuts[mid + 1 :], lo + mid + 1))


def _ranged(docs: DataFrame, per_range: int, cells: int) -> tuple[DataFrame, int]:
    """doc_id, text, r (number of the row's range, in the order of rows), and how many ranges a cell has. Cells are numbered from
    the largest ids; the last one holds null ids."""
    number = _number(docs)
    slim = docs.select(number.alias("k"))
    n, lo, hi = slim.agg(F.count("*"), F.min("k"), F.max("k")).first()
    cells = min(cells, n // per_range + 1)
    found = slim.agg(F.percentile_approx("k", [i / cells for i in range(1, cells)], 20 * cells)).first()[0] if cells > 1 and lo is not None else []
    cuts = sorted(set(found or []))
    sub = n // (per_range * cells) + 1
    edges = [float(x) for x in ([lo, *cuts, hi] if lo is not None else [0, 0])]
    rows = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"), number.alias("k")).withColumn("i", _count_of(F.col("k"), cuts))
    begin, end = (F.get(F.array(*[F.lit(x) for x in part]), F.col("i")) for part in (edges[:-1], edges[1:]))
    share = F.when(end > begin, (F.col("k").cast("double") - begin) / (end - begin)).otherwise(0.0)
    inner = F.greatest(F.lit(0), F.least(F.lit(sub - 1), F.floor(share * sub)))
    by_hash = F.least(F.lit(sub - 1), F.floor((F.xxhash64("text") / F.lit(2.0**64) + 0.5) * sub))
    r = F.when(F.col("k").isNull(), len(edges[1:]) * sub + by_hash).otherwise((len(edges) - 2 - F.col("i")) * sub + sub - 1 - inner)
    return rows.select("doc_id", "text", r.cast("long").alias("r")), sub


def with_next(docs: DataFrame, per_range: int = PER_RANGE, cells: int = CELLS) -> DataFrame:
    """doc_id, text (null: empty), next: the text of the following row. One shuffle of the texts; what reaches the driver are a
    few numbers a cell."""
    rows, sub = _ranged(docs, per_range, cells)
    within = Window.partitionBy("r").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    inner = rows.withColumn("next", F.lead("text").over(within))
    # the first text of each range; then the first of the next range that has rows, in the same cell or a later one
    first = F.max_by("text", F.struct("doc_id", F.bitwise_not(F.xxhash64("text"))))
    heads = rows.groupBy("r").agg(first.alias("head")).withColumn("cell", F.floor(F.col("r") / sub))
    starts = [x["r"] for x in rows.groupBy(F.floor(F.col("r") / sub).alias("cell")).agg(F.min("r").alias("r")).orderBy("cell").collect()] or [0]
    after = F  # the least start beyond the cell, else the first of all
    for r in starts:
        after = after.when(F.col("cell") < r // sub, F.lit(r))
    after = after.otherwise(F.lit(starts[0]))
    heads = heads.withColumns({"follow": F.lead("head").over(Window.partitionBy("cell").orderBy("r")), "after": after})
    opening = heads.filter(F.col("r").isin(starts)).select(F.col("r").alias("s"), F.col("head").alias("opens"))
    heads = heads.join(opening, F.col("follow").isNull() & (F.col("after") == F.col("s")), "left").select(F.col("r").alias("q"),
        F.coalesce("follow", "opens").alias("head"))
    both = inner.join(heads, (F.col("r") == F.col("q")) & F.col("next").isNull(), "left")
    return both.select("doc_id", "text", F.coalesce("next", "head").alias("next"))


def edit_report(docs: DataFrame, per_range: int = PER_RANGE, cells: int = CELLS) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_edits (paragraphs that
    the edited text does not have) and first_edit (section and paragraph of the first)."""
    t = with_next(docs, per_range, cells).withColumn("n", F.length("text").cast("long"))
    cut = F.floor(F.col("n") / 3).cast("int")
    t = t.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n - floor(n / 3) as int))"), F.substring("next", F.lit(1), cut)))
    t = t.select("doc_id", F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("text")).alias("a"),
        tree(F.col("edited")).alias("b"), tree(F.col("next")).alias("c"))
    t = compared(compared(t, "a", "b", "near_edited"), "a", "c", "near_next")
    first = F.get("near_edited_edits", F.lit(0))
    return t.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("b")).alias("edited_fingerprint"),
        "near_edited", "near_next", F.size("near_edited_edits").alias("n_edits"), F.concat_ws("/", first["section"], first["paragraph"]).alias("first_edit"),
    )
