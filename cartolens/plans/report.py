"""The report's tables: applications, occurrences, coverage, ArcGIS buckets, API keys, totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import is_blocked
from ..functions.urls import request_host

APPLICATION_COLUMNS = "identity_key vendor app_kind hosting type title occurrence_count main_content_pages embed_pages linked_only site_chrome_pages placement_summary in_county_org_label arcgis_item_id per_page flagged screenshot_path example_url target_url signal_types api_keys".split()
OCCURRENCE_COLUMNS = "page_url page_title identity_key vendor application_type placement how signal_types finding_types confidence container_selector target_url max_tier".split()


def joined(column: str, where: Column | None = None) -> Column:
    """Distinct values in order, joined by commas; null if there are none."""
    value = F.col(column) if where is None else F.when(where, F.col(column))
    return F.nullif(F.array_join(F.array_sort(F.collect_set(value)), ","), F.lit(""))


def in_report(vendors: list[str]) -> Column:
    return F.lit(True) if not vendors else F.coalesce(F.lower("vendor").isin(*[v.lower() for v in vendors]), F.lit(False))


def app_kind(rule: Column, signal: Column, vendor: Column, key: Column) -> Column:
    """What an application is called by its strongest sign: the embed rule's label, else by signal, else by vendor."""
    by_script = (rule == "host:js.arcgis.com") | (vendor == "esri") & signal.isin("selector", "global", "network", "static_html")
    in_page = F.replace(F.lit(fixed.KIND_PAGE), F.lit("{vendor}"), vendor)
    labels = [F.nullif(F.regexp_extract(rule, "(?s)^embed:(.*)$", 1), F.lit("")), F.when(by_script, fixed.KIND_SCRIPT),
        F.when(signal == "image", fixed.KIND_IMAGE), F.when(key.startswith("inpage:"), in_page)]
    return F.coalesce(*labels, vendor, F.lit("unknown"))


def hosting() -> Column:
    named = {"item": F.col("arcgis_item_id").isNotNull(), "service": F.col("identity_key").startswith("arcgis:service:"),
        "esri-enterprise": F.col("vendor") == "esri-enterprise", "esri": F.col("vendor") == "esri"}
    return F.coalesce(*[F.when(condition, fixed.HOSTING[name]) for name, condition in named.items()], F.col("vendor"))


def applications_report(apps: DataFrame, findings: DataFrame, presence: DataFrame, vendors: list[str] | None = None) -> DataFrame:
    """A row for each application: one conditional aggregate of the stored findings instead of a query a column.

    ``apps`` as from store.inventory(), with in_county_org (1, 0, null) if it has been cross-referenced.
    """
    main = F.col("placement") == "main_content"
    order = F.when(F.col("signal_type") == "iframe", 0).when(F.col("signal_type") == "frame", 1).when(F.col("signal_type") == "image",
        2).when(F.col("signal_type") == "link", 3).when(F.col("signal_type") == "network", 4).otherwise(5)
    own = findings.groupBy("identity_key").agg(
        F.count_distinct(F.when(main, F.col("url"))).alias("main_content_pages"),
            F.count_distinct(F.when(main & (F.col("type") != "map_link_only"), F.col("url"))).alias("embed_pages"),
        F.min(F.when(main, F.col("url"))).alias("example_main_url"), joined("signal_type").alias("signal_types"), joined("api_key").alias("api_keys"),
            joined("arcgis_org").alias("arcgis_orgs"),
        F.max((F.col("confidence") == "high").cast("int")).alias("any_high"),
            F.min_by(F.struct("rule", "signal_type"), F.struct(order.alias("o"), "seq", "tier", "place")).alias("kind"),
    )
    chrome = presence.groupBy("identity_key").agg(F.count("*").alias("site_chrome_pages"))
    for name in ("in_county_org", "screenshot_path"):
        if name not in apps.columns:
            apps = apps.withColumn(name, F.lit(None).cast("int" if name == "in_county_org" else "string"))
    out = apps.join(own, "identity_key", "left").join(chrome, "identity_key", "left").fillna(0, ["main_content_pages", "embed_pages", "site_chrome_pages"])
    none, some = F.col("main_content_pages") == 0, F.col("site_chrome_pages") > 0
    out = out.withColumns({
        "app_kind": app_kind(F.col("kind.rule"), F.col("kind.signal_type"), F.col("vendor"), F.col("identity_key")), "hosting": hosting(),
        "linked_only": (~none & (F.col("embed_pages") == 0)).cast("int"),
        "placement_summary": F.when(none & some, fixed.SUMMARY["chrome"]).when(some, fixed.SUMMARY["both"]).otherwise(fixed.SUMMARY["content"]),
        "example_url": F.coalesce("example_main_url", "first_seen_url"), "flagged": F.col("type").isin(*fixed.FLAGGED_TYPES).cast("int"),
        "in_county_org_label": F.when(F.col("in_county_org") == 1, "yes").when(F.col("in_county_org") == 0,
            "no").when(F.col("arcgis_item_id").isNotNull(), "unknown").otherwise("n/a"),
    })
    return out.filter(in_report(vendors or [])).drop("kind", "example_main_url")


def how(signals: Column) -> Column:
    """From an array of signal types."""
    has = lambda s: F.array_contains(signals, s)
    return F.when(F.forall(signals, lambda s: s == "link"), fixed.HOW["link"]).when(has("iframe") | has("frame"),
        fixed.HOW["embed"]).when(has("image"), fixed.HOW["image"]).otherwise(fixed.HOW["page"])


def occurrences(findings: DataFrame, apps: DataFrame, titles: DataFrame | None = None, vendors: list[str] | None = None, chrome: bool = False) -> DataFrame:
    """A row for each page and application in its content (with ``chrome`` also in its navigation).

    ``titles`` (url, title, and seq if a URL may have several rows, of which the last counts).
    """
    rank = F.coalesce(F.create_map(*[F.lit(x) for k, v in fixed.CONFIDENCE.items() for x in (k, v)])[F.col("confidence")], F.lit(1))
    own = findings if chrome else findings.filter("placement = 'main_content'")
    own = own.groupBy("url", "identity_key").agg(
        F.min("placement").alias("placement"), F.array_sort(F.collect_set("signal_type")).alias("signals"), joined("type").alias("finding_types"),
            F.max(rank).alias("rank"),
        F.min("container_selector").alias("container_selector"), F.min("target_url").alias("target_url"), F.max("tier").alias("max_tier"),
    )
    out = own.join(apps.select("identity_key", "vendor", F.col("type").alias("application_type")), "identity_key").filter(in_report(vendors or []))
    if titles is not None:
        last = F.struct("seq", "title") if "seq" in titles.columns else F.col("title")
        out = out.join(titles.groupBy("url").agg(F.max_by("title", last).alias("page_title")), "url", "left")
    else:
        out = out.withColumn("page_title", F.lit(None).cast("string"))
    confidence = F.when(F.col("rank") == 3, "high").when(F.col("rank") == 2, "medium").otherwise("low")
    return out.withColumns({"how": how(F.col("signals")), "signal_types": F.array_join("signals", ","),
        "confidence": confidence}).withColumnRenamed("url", "page_url").select(*OCCURRENCE_COLUMNS)


def coverage(queue: DataFrame, findings: DataFrame) -> DataFrame:
    """(metric, value): what of the queue has been seen, in one pass over each table."""
    is_ = lambda c, v: F.col(c) == v
    q = queue.agg(
        F.count("*").alias("discovered"), F.count_if(is_("tier1_done", 1) & (F.col("status") != "skipped")).alias("crawled_tier1"),
            F.count_if(is_("tier2_done", 1)).alias("rendered_tier2"),
        F.count_if(F.col("status").isin("pending", "in_progress")).alias("pending"), F.count_if(is_("status", "failed")).alias("failed"),
            F.count_if(is_("status", "skipped")).alias("skipped"),
    )
    main = F.col("placement") == "main_content"
    f = findings.agg(F.count_distinct(F.when(main & is_("tier", 1), F.col("url"))).alias("tier1_hit_pages"),
        F.count_distinct(F.when(main & is_("tier", 2) & (F.col("type") != "map_link_only"), F.col("url"))).alias("tier2_hit_pages"))
    return reduce(DataFrame.unionByName, [x.unpivot([], x.columns, "metric", "value") for x in (q, f)])


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("c"))


def tier2_by_reason(queue: DataFrame) -> DataFrame:
    asked = queue.filter(F.col("tier2_reason").isNotNull() & (F.col("tier2_reason") != "none"))
    return asked.groupBy(F.col("tier2_reason").alias("reason")).agg(F.sum("tier2_done").alias("rendered"), F.count("*").alias("scheduled"))


def sample_rate(queue: DataFrame, findings: DataFrame) -> DataFrame:
    """rendered, hits, new_identity_pages, hit_rate of the pages rendered as a random sample: what static rules miss."""
    pages = queue.filter("tier2_reason = 'sample' AND tier2_done = 1").select("url")
    t2 = findings.filter("tier = 2 AND placement = 'main_content' AND type <> 'map_link_only'").groupBy("url").agg(F.collect_set("identity_key").alias("t2"))
    t1 = findings.filter("tier = 1").groupBy("url").agg(F.collect_set("identity_key").alias("t1"))
    seen = pages.join(t2, "url", "left").join(t1, "url", "left").withColumn("t1", F.coalesce("t1", F.array().cast("array<string>")))
    placeholder = F.exists("t1", lambda k: k.startswith("inpage:"))
    new = F.exists("t2", lambda k: ~F.array_contains("t1", k) & ~(k.startswith("inpage:") & placeholder))
    out = seen.agg(F.count("*").alias("rendered"), F.count_if(F.col("t2").isNotNull()).alias("hits"),
        F.count_if(F.coalesce(new, F.lit(False))).alias("new_identity_pages"))
    return out.withColumn("hit_rate", F.when(F.col("rendered") > 0, F.col("hits") / F.col("rendered")))


def pattern_hits(queue: DataFrame, findings: DataFrame) -> DataFrame:
    pages = queue.filter("tier2_reason = 'pattern' AND tier2_done = 1").select("url")
    hits = findings.filter("tier = 2 AND placement = 'main_content' AND type <> 'map_link_only'").select("url")
    return pages.agg(F.count("*").alias("rendered")).crossJoin(pages.join(hits, "url", "left_semi").agg(F.count_distinct("url").alias("hits")))


def failed_urls(queue: DataFrame, most: int = 200) -> DataFrame:
    return queue.filter("status = 'failed'").select("url", "error", "attempts").orderBy("url").limit(most)


def buckets(report: DataFrame, domain: str) -> DataFrame:
    """(bucket, identity_key); an application may be in several. ``domain``: a regular expression of the own domain."""
    item, key = F.col("arcgis_item_id").isNotNull(), F.col("identity_key")
    service, org, linked = key.startswith("arcgis:service:"), F.col("in_county_org"), F.col("linked_only") == 1
    member = {
        "embedded": item & (org == 1) & ~linked, "linked_only_org": item & (org == 1) & linked, "external": (item | service) & (org == 0),
            "services": service, "unknown": item & org.isNull(),
        "enterprise": ~item & (F.col("vendor") == "esri-enterprise"), "esri_inpage": ~item & (F.col("vendor") == "esri") & ~service,
            "non_arcgis_external": ~item & ~key.startswith("inpage:") & ~key.rlike(f"(?i){domain}"),
    }
    names = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in member.items()]), lambda n: n.isNotNull())
    return report.select(F.explode(names).alias("bucket"), "identity_key")


def orphaned(items: DataFrame, apps: DataFrame, org_id: str) -> DataFrame:
    """The organisation's items that no application shows, the last modified first."""
    own = items.filter((F.col("in_org") == 1) & (F.col("org_id") == org_id))
    used = apps.filter("arcgis_item_id IS NOT NULL").select(F.col("arcgis_item_id").alias("item_id")).distinct()
    return own.join(used, "item_id", "left_anti").orderBy(F.desc("modified"), "item_id")


def api_keys(findings: DataFrame, responses: DataFrame | None = None, vendors: list[str] | None = None) -> DataFrame:
    """Credentials in page sources with pages, an example and identities; ``responses`` (vendor, api_key, status, body) say how restricted."""
    keys = findings.filter("api_key IS NOT NULL").groupBy("api_key", "vendor").agg(F.count_distinct("url").alias("pages"),
        F.min("target_url").alias("example"), joined("identity_key").alias("identities"))
    keys = keys.filter(in_report(vendors or []))
    if responses is None:
        return keys.withColumn("restriction", F.lit("not probed"))
    return keys.join(responses, ["vendor", "api_key"], "left").withColumn("restriction",
        restriction(F.col("vendor"), F.col("body"), F.col("status"))).drop("body", "status")


def restriction(vendor: Column, body: Column, status: Column) -> Column:
    """What a vendor's answer (JSON) says about a key: the first label whose condition holds."""
    say, answer = fixed.KEY_LIMITS, lambda p: F.get_json_object(body, p)
    doubt = lambda value: F.concat(F.lit(say["unknown"]), F.coalesce(value, status.cast("string"), F.lit("")))
    message, code = F.coalesce(answer("$.error_message"), F.lit("")), answer("$.code")
    refused = message.rlike("(?i)IP address restrictions|not authorized|API key not valid|expired")
    listed = F.coalesce(answer("$.token.allowedUrls[0]").isNotNull(), F.lit(False))
    google = [
        (message.rlike("(?i)referer restrictions"), F.lit(say["referrer"])), (refused, F.concat(F.lit(say["other"]), F.substring(message, 1, 80))),
        (F.coalesce(answer("$.status"), status.cast("string")).isin("OK", "ZERO_RESULTS"), F.lit(say["open"])), (F.lit(True), doubt(answer("$.status"))),
    ]
    mapbox = [((code == "TokenValid") & listed, F.lit(say["url"])), (code == "TokenValid", F.lit(say["token"])), (F.lit(True), doubt(code))]
    first = lambda of, cases: F.coalesce(*[F.when((vendor == of) & condition, label) for condition, label in cases])
    return F.when(body.isNull(), say["none"]).otherwise(F.coalesce(first("google", google), first("mapbox", mapbox), F.lit(say["vendor"])))


def by_kind(apps: DataFrame) -> DataFrame:
    return counts_by(apps, "app_kind").orderBy(F.desc("c"), "app_kind")


def by_vendor(apps: DataFrame) -> DataFrame:
    return counts_by(apps, "vendor").orderBy(F.desc("c"), "vendor")


def by_type(apps: DataFrame) -> DataFrame:
    return counts_by(apps, "type").orderBy(F.desc("c"), "type")


def request_totals(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count("*").alias("requests_recorded"), F.count_distinct(request_host(F.col("request_url"))).alias("request_hosts"))


def totals(report: DataFrame, occ: DataFrame, findings: DataFrame, vendors: list[str] | None = None) -> DataFrame:
    """(metric, value) of the whole report."""
    a = report.agg(F.count("*").alias("applications"), F.count_if(F.col("flagged") == 0).alias("applications_unflagged"),
        F.count_if(F.col("placement_summary") == "site-wide navigation").alias("site_wide"))
    maps = occ.filter("how <> 'link'").agg(F.count_distinct("page_url").alias("pages_with_maps")) if vendors else findings.filter("placement = 'main_content' AND type <> 'map_link_only'").agg(F.count_distinct("url").alias("pages_with_maps"))
    parts = [a, occ.agg(F.count("*").alias("occurrences")), findings.agg(F.count("*").alias("findings")), maps]
    return reduce(DataFrame.unionByName, [x.unpivot([], x.columns, "metric", "value") for x in parts])


def status(queue: DataFrame, statuses: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """What a look at a running crawl shows."""
    size = F.octet_length("html") if "html" in pages.columns else F.octet_length("html_gz")
    done = F.count_if((F.col("tier1_done") == 1) & (F.col("status") != "skipped"))
    storage = pages.agg(F.count("*").alias("stored"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).crossJoin(queue.agg(F.count("*").alias("total")))
    return {
        "queue": counts_by(queue, "status").orderBy("status"), "sources": counts_by(queue, "source").orderBy("source"), "reasons": tier2_by_reason(queue),
        "http": statuses.groupBy(F.coalesce(F.col("http_status").cast("string"), F.lit("error")).alias("status"),
            is_blocked(F.col("http_status"), fixed.BLOCK_STATUSES).alias("refused")).agg(F.count("*").alias("n")),
        "failing": queue.filter("error IS NOT NULL").orderBy(F.desc("last_attempt_at"), "url").limit(5),
        "progress": queue.agg(done.alias("done"),
            F.count_if((F.col("tier1_done") == 1) & (F.col("status") != "skipped") & ((F.col("tier1_hit") == 1) | (F.col("tier2_hit") == 1))).alias("hits")),
        "storage": storage.withColumn("projected_bytes", F.when(F.col("stored") > 0, (F.col("bytes") / F.col("stored") * F.col("total")).cast("long"))),
    }
