"""Line deduplication by overlapping three-line windows; DataFrame functions only.

Every three consecutive lines of a text make a window. Of windows with the same three lines anywhere in the table, the first
(least doc_id, then the text's hash, then place) stays; the lines covered by any later one are removed. Texts of fewer than
three lines have no window and stay whole, as do null (they stay null) and empty texts. Windows of blank lines only don't
count. Rows of equal doc_id and text are one document and get the same result; null ids sort first.

Windows are known by two independent 64-bit hashes. Counting is combined before its shuffle; the join that finds later
windows spreads each repeated window over ``SALTS`` tasks, so one very common passage is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

LINES = 3
SALTS = 16


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), at (number of the first line), h1, h2: a row for each window."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), _lines(F.col("text")).alias("lines")).filter(F.size("lines") >= LINES)
    text_at = lambda i, k: F.get("lines", i + k)
    window = lambda i: F.struct(
        i.alias("at"),
        F.xxhash64(*[text_at(i, k) for k in range(LINES)]).alias("h1"),
        F.xxhash64(F.lit(LINES), *[text_at(i, k) for k in range(LINES)]).alias("h2"),
        F.trim(F.concat(*[text_at(i, k) for k in range(LINES)])).eqNullSafe("").alias("blank"),
    )
    each = lines.select("doc_id", "th", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - LINES), window)).alias("w"))
    return each.filter(~F.col("w.blank")).select("doc_id", "th", "w.at", "w.h1", "w.h2")


def later_windows(docs: DataFrame) -> DataFrame:
    """doc_id, th, at of every window that is not the first of its content."""
    windows = _windows(docs)
    first = F.min(F.struct("doc_id", "th", "at")).alias("first")
    repeated = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), first).filter("n > 1")
    repeated = repeated.select("h1", "h2", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = windows.withColumn("salt", F.pmod(F.xxhash64("th", "at"), F.lit(SALTS)).cast("int"))
    both = salted.join(repeated, ["h1", "h2", "salt"])
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")) & (F.col("at") == F.col("first.at"))
    return both.filter(~same).select("doc_id", "th", "at")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cleaned and, if there is one, ``n_chars`` of changed rows counted anew; and n_lines, n_removed,
    in place of columns of these names.

    No row is dropped: a text of which nothing is left is empty.
    """
    gone = later_windows(docs).groupBy("doc_id", "th").agg(F.collect_set("at").alias("at"))
    both = packed(docs).join(gone, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("th")), "left")
    lines, covered = _lines(F.col("row.text")), F.flatten(F.transform("at", lambda p: F.array(*[p + k for k in range(LINES)])))
    both = both.withColumn("kept", F.when(F.col("at").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)))
    # the lines are bound once: a text is not cut anew for each line that stays
    rest = F.get(F.transform(F.array(lines), lambda all_: F.array_join(F.transform("kept", lambda i: F.get(all_, i)), "\n")), 0)
    both = both.withColumn("new", F.when(F.col("kept").isNull(), F.col("row.text")).otherwise(rest))
    both = both.withColumn("n_lines", F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)))
    both = both.withColumn("n_removed", F.when(F.col("kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")))
    own = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return both.select(*unpacked(both, [c for c in docs.columns if c not in ("n_lines", "n_removed")], **own), "n_lines", "n_removed")


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, and the digest of the cleaned text (null text: null)."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


#: DuckDB SQL of report() over the view documents.
SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, lines, i, lines[i + 1] || chr(10) || lines[i + 2] || chr(10) || lines[i + 3] AS body
      FROM (SELECT *, unnest(range(len(lines) - 2)) AS i FROM d WHERE len(lines) >= 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS FIRST, text, i) AS rn FROM w WHERE trim(replace(body, chr(10), '')) <> ''),
c AS (SELECT doc_id, text, list_distinct(flatten(list([i, i + 1, i + 2]))) AS covered FROM r WHERE rn > 1 GROUP BY doc_id, text),
k AS (SELECT o.doc_id, o.text, c.covered, string_split(o.text, chr(10)) AS lines
      FROM documents o LEFT JOIN c ON o.doc_id IS NOT DISTINCT FROM c.doc_id AND o.text = c.text)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(covered), 0) AS INTEGER) AS n_removed,
       CASE WHEN covered IS NULL THEN sha256(text)
            ELSE sha256(coalesce(array_to_string(list_transform(list_filter(range(len(lines)), lambda i: NOT list_contains(covered, i)), lambda i: lines[i + 1]), chr(10)), '')) END AS text_sha256
FROM k
"""
