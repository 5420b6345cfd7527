"""Crawl tables and documents: stored pages, sitemaps, portal search pages, preflight verdicts, single files."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import decode_xml, from_millis
from ..runtime import ship

MAX_SITEMAPS = 500


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{folder}/{name}.parquet")


@F.pandas_udf(T.StringType())
def unpack(body: pd.Series) -> pd.Series:
    """Text of a body that may be gzipped or deflated; a broken one stays as it is."""

    def one(b):
        if b is None:
            return None
        try:
            if b[:2] == b"\x1f\x8b":
                return gzip.decompress(b).decode("utf-8", "replace")
            if b[:1] == b"\x78":
                return zlib.decompress(b).decode("utf-8", "replace")
        except (OSError, EOFError, zlib.error):
            pass
        return b.decode("utf-8", "replace")

    return body.map(one)


def stored_pages(spark: SparkSession, path: str, max_bytes: int = 5_000_000) -> DataFrame:
    """Stored pages with ``html``; a body over the limit is cut there, between two characters, and marked truncated."""
    pages = spark.read.parquet(path)
    if "html" not in pages.columns:
        pages = pages.withColumn("html", unpack("html_gz")).drop("html_gz")
    over = F.coalesce(F.octet_length("html") > max_bytes, F.lit(False))
    return pages.withColumns({"truncated": over, "html": F.when(over, first_bytes(F.col("html"), max_bytes)).otherwise(F.col("html"))})


def first_bytes(text: Column, most: int) -> Column:
    """The whole characters within the first bytes."""
    body = text.cast("binary")
    part = F.make_valid_utf8(F.substring(body, 1, most).cast("string"))
    inside = F.hex(F.substring(body, most + 1, 1)).rlike("^[89AB]")  # the next byte continues a character
    return F.when(inside, F.regexp_replace(part, "\ufffd$", "")).otherwise(part)


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of a folder of files, one page each; the file's path stands for the URL."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("url"), unpack("content").alias("html"))


def store_pages(pages: DataFrame, path: str, mode: str = "all", findings: DataFrame | None = None) -> None:
    """Writes pages as Parquet: all, hits (those with a finding), or none."""
    if mode == "none":
        return
    if mode == "hits":
        pages = pages.join(findings.select("url").distinct(), "url", "left_semi")
    pages.write.mode("overwrite").option("compression", "zstd").parquet(path)


def sitemap_entries(docs: DataFrame) -> DataFrame:
    """(sitemap, is_index, place, loc) from sitemap documents (url, body text): XML, or lines if no <loc> is found."""
    index = F.col("body").rlike(r"(?i)<sitemapindex[\s>]")
    entry = lambda tag: F.regexp_extract_all("body", F.lit(rf"(?is)<{tag}>.*?<loc>\s*([^<\s]+)\s*</loc>.*?</{tag}>"), F.lit(1))
    locs = F.transform(F.when(index, entry("sitemap")).otherwise(entry("url")), decode_xml)
    lines = F.filter(F.transform(F.split("body", r"\r?\n"), F.trim), lambda x: x.rlike("^https?://"))
    found = F.when(~index & (F.size(locs) == 0), lines).otherwise(locs)
    # what is said of a document is made before its entries become rows: after that it would be made, and the body carried, for each
    parsed = docs.select(F.col("url").alias("sitemap"), index.alias("is_index"), found.alias("locs"))
    return parsed.select("sitemap", "is_index", F.posexplode("locs").alias("place", "loc"))


def sitemap_starts(configured: list[str], declared: list[str], homepage: str | None = None) -> list[str]:
    """Where to begin: sitemaps from the configuration, then those that robots.txt declares; else the usual place."""
    return list(dict.fromkeys([*configured, *declared])) or ([homepage.rstrip("/") + "/sitemap.xml"] if homepage else [])


def expand_sitemaps(docs: DataFrame, start: list[str], most: int = MAX_SITEMAPS) -> DataFrame:
    """(loc, sitemap) of all pages that the start sitemaps list, through any nested index; ``docs`` (url, body: text, or packed
    bytes) are all documents.

    The loop runs over index documents, of which at most ``most`` are followed: by level, then in the order of their URLs.
    """
    if docs.schema["body"].dataType == T.BinaryType():
        docs = docs.withColumn("body", unpack("body"))
    entries = sitemap_entries(docs).cache()
    seen, todo = set(), list(dict.fromkeys(start))
    while todo and len(seen) < most:
        todo = todo[: most - len(seen)]
        seen.update(todo)
        below = entries.filter(F.col("is_index") & F.col("sitemap").isin(todo)).select("loc").distinct()
        todo = [r["loc"] for r in below.filter(~F.col("loc").isin(sorted(seen))).orderBy("loc").limit(most).collect()]
    pages = entries.filter(~F.col("is_index") & F.col("sitemap").isin(sorted(seen)))
    return pages.groupBy("loc").agg(F.min("sitemap").alias("sitemap"))


_ITEM = "struct<id:string,title:string,type:string,owner:string,created:bigint,modified:bigint,url:string,orgId:string,access:string>"


def org_items(spark: SparkSession, path: str, org_id: str) -> DataFrame:
    """Items of an organisation from the JSON pages of a portal search; of repeated items the last page's."""
    pages = spark.read.schema(f"total long, start long, nextStart long, results array<{_ITEM}>").json(path, multiLine=True)
    items = pages.select("start", F.explode("results").alias("i")).select("start", "i.*")
    items = items.groupBy("id").agg(*[F.max_by(c, "start").alias(c) for c in ("title", "type", "owner", "created", "modified", "url", "orgId", "access")])
    return items.select(F.col("id").alias("item_id"), "title", "type", "owner", from_millis(F.col("created")).alias("created"),
        from_millis(F.col("modified")).alias("modified"), "url", F.coalesce("orgId", F.lit(org_id)).alias("org_id"), F.lit(1).alias("in_org"),
        "access")


def search_query(org_id: str, types: list[str]) -> str:
    """The portal search that lists an organisation's items of these types (all if none)."""
    return f"orgid:{org_id}" + (" AND (" + " OR ".join(f'type:"{t}"' for t in types) + ")" if types else "")


def consent_mode(spark: SparkSession, configured: str, path: str | None) -> bool:
    """Whether to scan with consent: as configured, or for auto as the preflight verdict says."""
    if configured != "auto":
        return configured == "on"
    if not path:
        return False
    row = spark.read.json(path, multiLine=True).select("consent_gating_detected").first()
    return bool(row and row[0])
