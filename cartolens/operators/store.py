"""What a crawl's findings amount to: superseded placeholders, exemplars of site chrome, applications, occurrence counts.

Everything is derived from the findings of the whole crawl at once. ``seq`` is the order of discovery of a page; ``seq``,
``tier``, ``place`` order findings. A page scanned again replaces its findings of that tier before this.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.identity import inpage_key, is_per_page

ORDER = ("seq", "tier", "place")
#: What tells pages apart where each URL has one row; a table with several rows of one URL has (url, seq).
URL, ROW = ("url",), ("url", "seq")


def replace_rescans(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings after pages have been scanned again: those of (url, tier) in ``new`` take the place of the old ones."""
    return old.join(new.select("url", "tier").distinct(), ["url", "tier"], "left_anti").unionByName(new)


def latest_wins(df: DataFrame, keys: list[str], order: list[Column], keep_old: list[str] | None = None) -> DataFrame:
    """One row a key: the last by ``order``; columns in ``keep_old`` take their last value that is not null."""
    at = F.struct(*order)
    rest = [c for c in df.columns if c not in keys]
    own = [F.max_by(c, F.when(F.col(c).isNotNull(), at) if c in (keep_old or []) else at).alias(c) for c in rest]
    return df.groupBy(*keys).agg(*own)


def supersede(findings: DataFrame, page: Sequence[str] = URL) -> DataFrame:
    """Without the tier-1 placeholders of pages for which rendering found better.

    A rendered container supersedes all placeholders of its page; a strong identity of a vendor those of that vendor. ``page``:
    the columns that tell pages apart.
    """
    t2 = findings.filter("tier = 2")
    container = F.coalesce(F.col("container_selector"), F.lit("*"))
    whole = t2.filter((container != "*") & F.col("signal_type").isin("selector", "global", "network")).select(*page).distinct()
    vendors = t2.filter((F.col("placement") == "main_content") & ~is_per_page(F.col("identity_key")) & (F.col("type") != "map_link_only"))
    named = vendors.select(inpage_key(F.col("vendor"), F.col("url")).alias("identity_key"), *page).distinct()
    holder = (F.col("tier") == 1) & F.col("identity_key").like("inpage:%:*")
    held = findings.filter(holder).join(whole, [*page], "left_anti").join(named, [*page, "identity_key"], "left_anti")
    return findings.filter(~holder).unionByName(held)


def chrome_presence(findings: DataFrame) -> DataFrame:
    """(url, identity_key) of every page on whose chrome an application is."""
    return findings.filter("placement = 'site_chrome'").select("url", "identity_key").distinct()


def exemplars(findings: DataFrame) -> DataFrame:
    """Findings as stored: all of main content, and of site chrome those on the first page with that application and value.

    The first page comes from an aggregate that is combined before its shuffle, so an application that is on every page's
    navigation is no hot key of a window."""
    chrome = findings.filter("placement = 'site_chrome'")
    first = chrome.groupBy("identity_key", "signal_value").agg(F.min(F.struct("seq", "tier")).alias("_first"))
    kept = chrome.join(first, ["identity_key", "signal_value"]).filter(F.struct("seq", "tier") == F.col("_first")).drop("_first")
    return findings.filter("placement <> 'site_chrome'").unionByName(kept.select(findings.columns))


def type_rank(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in fixed.TYPE_RANK.items() for x in (k, v)])[kind], F.lit(0))


def applications(findings: DataFrame) -> DataFrame:
    """A row for each identity: what its first finding says, its highest type (ties: the first), first known title and target."""
    at = F.struct(*ORDER)
    early = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    back = F.struct(type_rank(F.col("type")).alias("rank"), *[(-F.col(c)).alias(c) for c in ORDER])
    return findings.groupBy("identity_key").agg(
        F.min_by("vendor", at).alias("vendor"), F.max_by("type", back).alias("type"), early("title"), F.min_by("url", at).alias("first_seen_url"), F.min("seq").alias("first_seen_seq"),
        F.min_by("arcgis_item_id", at).alias("arcgis_item_id"), early("target_url"), F.first(is_per_page(F.col("identity_key")).cast("int")).alias("per_page"),
    )


def occurrence_counts(findings: DataFrame, presence: DataFrame) -> DataFrame:
    """(identity_key, occurrence_count): distinct pages in content or chrome."""
    pages = findings.filter("placement = 'main_content'").select("identity_key", "url").union(presence.select("identity_key", "url"))
    return pages.distinct().groupBy("identity_key").agg(F.count("*").alias("occurrence_count"))


def inventory(findings: DataFrame, page: Sequence[str] = URL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored findings, applications with occurrence_count, chrome presence). Applications on no page any more are left out."""
    left = supersede(findings, page)
    presence = chrome_presence(left)
    apps = without_orphans(applications(left).join(occurrence_counts(left, presence), "identity_key", "left"))
    return exemplars(left), apps, presence


def first_sightings(findings: DataFrame) -> DataFrame:
    """The first finding of each application: the stream of new applications. Of findings equal in order and identity one."""
    row = F.struct(*[F.col(c) for c in findings.columns])
    return findings.groupBy("identity_key").agg(F.min_by(row, F.struct(*ORDER)).alias("f")).select("f.*")


def without_orphans(apps: DataFrame) -> DataFrame:
    """Applications that some page still has (occurrence_count), or that a screenshot has been taken of."""
    pictured = F.col("screenshot_path").isNotNull() if "screenshot_path" in apps.columns else F.lit(False)
    return apps.filter((F.coalesce("occurrence_count", F.lit(0)) > 0) | pictured)


def replace_requests(old: DataFrame, new: DataFrame, rescanned: DataFrame) -> DataFrame:
    """The request log after pages (url) have been rendered again: all their old requests go, also those of pages that now have
    none."""
    return old.join(rescanned.select("url").distinct(), "url", "left_anti").unionByName(new)


def duplicate_groups(findings: DataFrame, page: Sequence[str] = URL) -> DataFrame:
    """Groups of equal findings of a page: empty unless an invariant is broken."""
    return findings.groupBy(*page, "tier", "identity_key", "signal_type", "placement", "signal_value").count().filter("count > 1")


def strong_keys(findings: DataFrame, page: Sequence[str] = URL) -> DataFrame:
    """(url, vendor, keys): the strong identities in a page's main content."""
    named = F.col("identity_key").rlike("^(" + "|".join(fixed.STRONG_KEYS) + ")") & (F.col("placement") == "main_content")
    return findings.filter(named).groupBy(*page, "vendor").agg(F.array_sort(F.collect_set("identity_key")).alias("keys"))
