"""Before a crawl: a spread sample of pages, and which map hosts appear only with consent."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.urls import section
from ..operators.store import URL


def candidates(queue: DataFrame | None, listed: DataFrame | None, spark: SparkSession) -> DataFrame:
    """(url, seq) of the queue and of sitemaps, each URL once, those of the queue first."""
    known = queue.select("url", F.col("seq").cast("long").alias("seq")) if queue is not None else spark.createDataFrame([], "url string, seq long")
    if listed is None:
        return known
    more = listed.select(F.col("loc").alias("url"), F.xxhash64("loc").bitwiseAND((1 << 61) - 1).bitwiseOR(1 << 61).alias("seq"))
    return known.unionByName(more).groupBy("url").agg(F.min("seq").alias("seq"))


def stratified(urls: DataFrame, n: int, homepage: str | None = None) -> DataFrame:
    """n URLs (url, seq) by turns from each first path segment, the homepage first: url, section, turn."""
    if homepage:
        urls = urls.filter(F.col("url") != homepage).select("url",
            F.col("seq").cast("long")).unionByName(urls.sparkSession.createDataFrame([(homepage, -1)], "url string, seq long"))
    parted = urls.withColumn("section", section(F.col("url")))
    turn = F.row_number().over(Window.partitionBy("section").orderBy("seq", "url"))
    first = parted.groupBy("section").agg(F.min(F.struct("seq", "url")).alias("_first"))
    # turns beyond n cannot be in the sample
    return parted.withColumn("turn", turn).filter(F.col("turn") <= n).join(first, "section").orderBy("turn", "_first").limit(n).select("url", "section", "turn")


def consent_difference(loads: DataFrame, page: Sequence[str] = URL) -> DataFrame:
    """Loads (url, with_consent, map_hosts, cmp_signals) of each page twice: only_with_consent, the map hosts that need it.
    ``page``: the columns that tell pages apart."""
    side = lambda yes: F.coalesce(F.flatten(F.collect_list(F.when(F.col("with_consent") == yes, F.col("map_hosts")))), F.array().cast("array<string>"))
    pages = loads.groupBy(*page).agg(side(True).alias("b"), side(False).alias("a"), F.array_distinct(F.flatten(F.collect_list("cmp_signals"))).alias("cmp_signals"))
    return pages.select(*page, F.array_sort(F.array_except("b", "a")).alias("only_with_consent"), F.array_sort("cmp_signals").alias("cmp_signals"))


def consent_signals(html: Column, cmp: dict) -> Column:
    """What in a page's source says that it asks for consent, in order: names of libraries' globals, addresses of their files, and
    ``gtag`` where it sets a default of consent."""
    names = [F.when(html.rlike(rf"(?<![\w$]){re.escape(g)}(?![\w$])"), g) for g in cmp.get("globals") or []]
    files = [F.when(F.contains(F.lower(html), F.lit(p.lower())), p) for p in cmp.get("asset_patterns") or []]
    gtag = [F.when(html.rlike(cmp["gtag_consent_regex"]), "gtag")] if cmp.get("gtag_consent_regex") else []
    return F.array_compact(F.array(*names, *files, *gtag))


def accept_buttons(labels: Column, cmp: dict) -> Column:
    """Of an array of buttons' labels those that give consent."""
    return F.filter(labels, lambda x: F.trim(x).rlike(f"(?i){cmp['accept_button_regex']}"))


def gated_hosts(difference: DataFrame) -> DataFrame:
    return difference.select(F.explode("only_with_consent").alias("host")).groupBy("host").agg(F.count("*").alias("pages"))


def verdict(loads: DataFrame, page: Sequence[str] = URL) -> DataFrame:
    """One row: sample_size, consent_gating_detected, cmp_present, cmp_signals, map_hosts_only_with_consent."""
    d = consent_difference(loads, page)
    signals = F.array_sort(F.array_distinct(F.flatten(F.collect_list("cmp_signals"))))
    gated = gated_hosts(d).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("host", "pages")))).alias("map_hosts_only_with_consent"))
    out = d.agg(F.count("*").alias("sample_size"), signals.alias("cmp_signals")).crossJoin(gated)
    return out.withColumns({"consent_gating_detected": F.size("map_hosts_only_with_consent") > 0, "cmp_present": F.size("cmp_signals") > 0})


def document(verdict: DataFrame) -> str:
    """The verdict as the JSON document that a scan reads its consent mode from."""
    row = verdict.first().asDict(recursive=True)
    return json.dumps({k: row[k] for k in sorted(row)}, indent=2)
