"""Applications against an organisation's items: whose each one is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cross_reference(apps: DataFrame, items: DataFrame, lookups: DataFrame, org_id: str) -> DataFrame:
    """``apps`` with in_county_org: 1, 0, or null for not known or not applicable; a title known there wins.

    ``items`` are the organisation's own; ``lookups`` (item_id, org_id, title, readable) answer for other ids.
    """
    own = items.filter((F.col("in_org") == 1) & (F.col("org_id") == org_id)).select(F.col("item_id").alias("_own"),
        F.col("title").alias("_own_title")).dropDuplicates(["_own"])
    other = lookups.filter("readable").select(F.col("item_id").alias("_other"), F.col("org_id").alias("_org"),
        F.col("title").alias("_other_title")).dropDuplicates(["_other"])
    out = apps.join(own, apps["arcgis_item_id"] == own["_own"], "left").join(other, apps["arcgis_item_id"] == other["_other"], "left")
    service = F.regexp_extract("identity_key", "^arcgis:service:([^/]*)/", 1)
    mine = F.when(F.col("_own").isNotNull(), 1).when(F.col("_other").isNotNull(),
        F.coalesce(F.col("_org") == org_id, F.lit(False)).cast("int")).when(service != "", (service == org_id).cast("int"))
    return out.withColumns({"in_county_org": mine, "title": F.coalesce("_own_title", "_other_title", "title")}).drop("_own", "_own_title", "_other",
        "_org", "_other_title")


def known_items(items: DataFrame, lookups: DataFrame, org_id: str) -> DataFrame:
    """All items by id: an organisation's own rows, and answers for others; unreadable ones have access unknown."""
    extra = lookups.select("item_id", "title", "org_id", F.when(F.col("readable"),
        (F.col("org_id") == org_id).cast("int")).otherwise(0).alias("in_org"),
        F.when(F.col("readable"), F.lit(None)).otherwise("unknown").alias("access"))
    old, new = items.alias("o"), extra.alias("n")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    rest = [F.col(f"o.{c}").alias(c) for c in ("type", "owner", "created", "modified", "url")]
    return old.join(new, F.col("o.item_id") == F.col("n.item_id"), "full").select(F.coalesce("o.item_id", "n.item_id").alias("item_id"),
        pick("title"), *rest, pick("org_id"), pick("in_org"), pick("access"))
