"""Ground truth of a small site: detection, fusion, store semantics, reports, crawl operators, whole runs, streams."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cartolens.config import load
from cartolens.functions.urls import Scope
from cartolens.operators import crawl, detect, fuse, store
from cartolens.plans import preflight, report, xref
from cartolens.plans.run import Crawl
from cartolens.rules import default_rules
from cartolens.runtime import ship
from cartolens.sources import tables
from cartolens.streaming import streams

ITEM = "0123456789abcdef0123456789abcdef"
STORY = "f" * 32
HOME = "https://www.example.gov"
SHELL = '<html><head><title> {title} </title></head><body><header class="site-header"><nav><a href="https://storymaps.arcgis.com/stories/' + STORY + '">Story</a></nav></header><main id="main-content"><article>{body}</article></main><footer><a href="/about">About</a></footer></body></html>'
PAGES = {
    "/": "<p>Nothing</p><a href='/dash'>d</a>",
    "/dash": f'<iframe width="100%" height=400px src="//city.maps.arcgis.com/apps/dashboards/{ITEM.upper()}" title="Dash"></iframe><iframe data-src="https://city.maps.arcgis.com/apps/dashboards/{ITEM}"></iframe>',
    "/static": '<img src="https://maps.googleapis.com/maps/api/staticmap?center=37.5,-122.3&amp;zoom=10&amp;key=AIzaFAKEKEY123" alt="Map" width=600>',
    "/link": '<a href="https://www.google.com/maps/dir/a/b"><span>Get  directions</span></a> <a href="https://www.openstreetmap.org/copyright">© OSM</a>',
    "/floor": '<section><h2>Floor plan</h2><iframe src="https://public.tableau.com/views/Floor/Plan"></iframe></section>',
    "/script": '<script>var m = L.map("m"); var s = "mapbox://styles/org/s1";</script><script src="https://unpkg.com/leaflet@1.9/leaflet.js"></script>',
    "/lazy": '<div data-url="https://www.google.com/maps/d/embed?mid=1XyZ_abc123"></div><p>https://gis.example.gov/apps/viewer.</p>',
    "/nav": '<nav><a href="https://gis.example.gov/apps/viewer/">Viewer</a></nav>',
    "/find-parcel": "<p>text</p>",
}
TRUTH = {
    ("/dash", f"arcgis:item:{ITEM}", "gis_application"), ("/static", "iframe:maps.googleapis.com/maps/api/staticmap/?center=37.5,-122.3",
        "static_map_image"), ("/link", "link:google.com/maps", "map_link_only"),
    ("/floor", "iframe:public.tableau.com/views/Floor/Plan/", "non_geographic"), ("/script", f"inpage:leaflet:{HOME}/script:*", "interactive_webmap"),
        ("/script", "mapbox:style:org/s1", "interactive_webmap"),
    ("/lazy", "gmymaps:mid:1XyZ_abc123", "interactive_webmap"), ("/lazy", "iframe:gis.example.gov/apps/viewer/", "gis_application"),
        ("/nav", "iframe:gis.example.gov/apps/viewer/", "map_link_only"),
    ("/link", "iframe:www.openstreetmap.org/copyright/", "interactive_webmap"),  # suppressed as a link, seen again in the source
}
CONFIG = {"scope": {"crawl_allowlist": ["www.example.gov"], "domain": "example.gov", "portal": "city.maps.arcgis.com"},
    "seeds": {"homepage": HOME + "/"}, "detection": {"links_trigger_render": False}, "inventory": {"skip_extensions": ["pdf"]}}


@pytest.fixture(scope="module")
def rules():
    return default_rules("example.gov", "city.maps.arcgis.com")


@pytest.fixture(scope="module")
def pages(spark):
    ship(spark)
    rows = [(HOME + p, 200, "text/html", None, SHELL.format(title=f"Page {p}", body=b), i, "sitemap") for i, (p, b) in enumerate(PAGES.items())]
    rows += [(HOME + "/gone", 404, "text/html", None, "", 90, "crawl"), (HOME + "/f", 200, "application/pdf", None, "", 91, "crawl"),
        (HOME + "/old", 200, "text/html", HOME + "/dash/", "x", 92, "crawl"),
        (HOME + "/away", 200, "text/html", "https://other.example/", "x", 93, "crawl"), (HOME + "/no", 403, "text/html", None, "", 94, "crawl"),
        (HOME + "/err", None, None, None, None, 95, "crawl"), (HOME + "/empty", 200, "text/html", None, None, 96, "crawl")]
    return spark.createDataFrame(rows, "url string, http_status int, content_type string, final_url string, html string, seq long, source string").cache()


@pytest.fixture(scope="module")
def found(pages, rules):
    return detect.findings_of(detect.detect_pages(pages, rules, keep=["seq"]), 1, ["seq"]).cache()


def test_ground_truth(found):
    rows = found.collect()
    assert {(r["url"].removeprefix(HOME), r["identity_key"], r["type"]) for r in rows if r["placement"] == "main_content"} == TRUTH
    chrome = [r for r in rows if r["placement"] == "site_chrome"]
    assert {r["identity_key"] for r in chrome} == {f"arcgis:item:{STORY}"} and len(chrome) == len(PAGES)
    by = {(r["url"].removeprefix(HOME), r["identity_key"]): r for r in sorted(rows, key=lambda r: -r["place"])}  # the first finding of each
    dash, static, link = by["/dash", f"arcgis:item:{ITEM}"], by["/static",
        "iframe:maps.googleapis.com/maps/api/staticmap/?center=37.5,-122.3"], by["/link", "link:google.com/maps"]
    assert dash["width_px"] == 100 and dash["height_px"] == 400 and dash["title"] == "Dash" and dash["arcgis_org"] == "city" and static["api_key"] == "AIzaFAKEKEY123" and static["title"] == "Map"
    assert link["title"] == "Get directions" and link["flagged"] == 1
    assert store.duplicate_groups(found).count() == 0
    assert {r["placement"] for r in rows if r["url"].endswith("/nav") and "viewer" in r["identity_key"]} == {"main_content"}


def test_titles_links_and_hits(pages, rules):
    seen = {r["url"].removeprefix(HOME): r for r in detect.detect_pages(pages, rules).select("url", "title", "links",
        detect.is_hit(F.col("findings"), False).alias("hit"), detect.is_hit(F.col("findings")).alias("any")).collect()}
    assert seen["/dash"]["title"] == "Page /dash" and "/about" in seen["/"]["links"] and seen["/empty"]["title"] == ""
    assert seen["/dash"]["hit"] and not seen["/nav"]["hit"] and seen["/nav"]["any"] and not seen["/"]["any"]


def observation(page, **kw):
    base = {"url": page, "title": None, "globals": [], "selectors": [], "iframes": [], "links": [], "images": [], "frames": []}
    return {**base, **kw}


def selector(container, vendor="leaflet", **kw):
    return {"id": f"selector:.{vendor}", "selector": f".{vendor}", "vendor": vendor, "type": "interactive_webmap", "confidence": "high",
        "container": container, "bbox": {"x": 0, "y": 0, "w": 10, "h": 20}, "placement": "main_content", "non_geo": False, "visible": True, **kw}


def test_fusion(rules):
    box = {"x": 0, "y": 0, "w": 1, "h": 2}
    seen = observation(
        "p", globals=[{"id": "global:mapboxgl", "name": "mapboxgl", "vendor": "mapbox", "type": "interactive_webmap", "confidence": "high"}],
            selectors=[selector("#m", "unknown", confidence="low"), selector("#m", "unknown", visible=False, selector=".x")],
        iframes=[{"src": "https://public.tableau.com/a/b", "rule_id": None, "container": "i", "bbox": box, "placement": "main_content", "title": "T",
            "non_geo": True}], frames=[{"url": "https://public.tableau.com/a/b", "cross_origin": True, "parent": "main"},
            {"url": "https://www.google.com/maps/embed?pb=1", "cross_origin": True, "parent": "https://x.y/"}],
    )
    asked = [{"request_url": f"https://api.mapbox.com/v4/{i}", "matched_rule": "host:api.mapbox.com", "kind": "vendor_host", "is_main": True} for i in range(3)]
    out = fuse.fuse("p", seen, asked, rules, {"mapbox": {"mapbox:style:org/s1"}})
    kinds = {(f["signal_type"], f["identity_key"]): f for f in out}
    assert kinds["iframe", "iframe:public.tableau.com/a/b/"]["type"] == "non_geographic" and ("frame", "iframe:public.tableau.com/a/b/") not in kinds
    assert kinds["frame", "iframe:www.google.com/maps/embed/?pb=1"]["confidence"] == "low"
    assert {f["confidence"] for f in out if f["signal_type"] == "selector"} == {"low"} and {f["vendor"] for f in out if f["signal_type"] in ("selector",
        "global", "network")} == {"mapbox"}
    assert kinds["network", "mapbox:style:org/s1"]["signal_value"].endswith("/v4/0 (+2 more)") and kinds["network", "mapbox:style:org/s1"]["container_selector"] == "#m"
    two = fuse.fuse("p", observation("p", selectors=[selector("#a"), selector("#b")]), [], rules, {"leaflet": {"k"}})
    assert {f["identity_key"] for f in two} == {"inpage:leaflet:p:#a", "inpage:leaflet:p:#b"}
    none = fuse.fuse("p", observation("p", globals=[{"id": "global:L", "name": "L", "vendor": "leaflet", "type": "interactive_webmap", "confidence": "high"}]), [], rules)
    assert [(f["identity_key"], f["confidence"]) for f in none] == [("inpage:leaflet:p:*", "medium")]


def test_store_semantics(spark, found):
    stored, apps, presence = store.inventory(found)
    counts = {r["identity_key"]: r["occurrence_count"] for r in apps.collect()}
    assert counts[f"arcgis:item:{STORY}"] == len(PAGES) and counts["iframe:gis.example.gov/apps/viewer/"] == 2 and len(counts) == 10
    assert stored.filter("placement = 'site_chrome'").count() == 1 and presence.count() == len(PAGES)
    kinds = {r["identity_key"]: r["type"] for r in apps.collect()}
    assert kinds["iframe:gis.example.gov/apps/viewer/"] == "gis_application"
    page = HOME + "/script"
    row = found.filter("identity_key like 'inpage:%'").limit(1)
    rendered = row.withColumns({"tier": F.lit(2), "identity_key": F.lit(f"inpage:leaflet:{page}:#m"), "container_selector": F.lit("#m"),
        "signal_type": F.lit("selector"), "signal_value": F.lit(".x")})
    left = store.supersede(found.unionByName(rendered.select(found.columns)))
    assert {r["identity_key"] for r in left.filter("identity_key like 'inpage:%'").collect()} == {f"inpage:leaflet:{page}:#m"}
    again = store.replace_rescans(found, found.filter(F.col("url") == page))
    assert again.count() == found.count() and again.exceptAll(found.select(again.columns)).count() == 0
    assert store.first_sightings(found).count() == 10
    assert {r["vendor"]: r["keys"] for r in store.strong_keys(found.filter(F.col("url") == page)).collect()} == {"mapbox": ["mapbox:style:org/s1"]}
    old = spark.createDataFrame([("k", 1, "a", None), ("k", 2, None, "b")], "k string, t int, x string, y string")
    assert tuple(store.latest_wins(old, ["k"], [F.col("t")], ["x"]).select("x", "y").first()) == ("a", "b")


def test_reports(spark, found, pages):
    stored, apps, presence = store.inventory(found)
    items = spark.createDataFrame([(ITEM, "Dash item", None, 1, "ORG"), ("e" * 32, "Orphan", None, 1, "ORG")],
        "item_id string, title string, modified timestamp, in_org int, org_id string")
    lookups = spark.createDataFrame([(STORY, "OTHER", "Story item", True)], "item_id string, org_id string, title string, readable boolean")
    apps = xref.cross_reference(apps, items, lookups, "ORG")
    table = {r["identity_key"]: r for r in report.applications_report(apps, stored, presence).collect()}
    story, dash = table[f"arcgis:item:{STORY}"], table[f"arcgis:item:{ITEM}"]
    assert (story["placement_summary"], story["in_county_org_label"], story["title"], story["site_chrome_pages"]) == ("site-wide navigation", "no",
        "Story item", len(PAGES))
    assert (dash["app_kind"], dash["hosting"], dash["in_county_org_label"], dash["linked_only"]) == ("ArcGIS Dashboards", "ArcGIS Online", "yes",
        0) and table["link:google.com/maps"]["linked_only"] == 1
    occ = {(r["page_url"].removeprefix(HOME), r["identity_key"]): r["how"] for r in report.occurrences(stored, apps).collect()}
    assert occ["/dash", f"arcgis:item:{ITEM}"] == "iframe_embed" and occ["/static",
        "iframe:maps.googleapis.com/maps/api/staticmap/?center=37.5,-122.3"] == "static_image" and occ["/nav",
        "iframe:gis.example.gov/apps/viewer/"] == "link" and ("/", f"arcgis:item:{STORY}") not in occ
    full = report.applications_report(apps, stored, presence)
    buckets = {(r["bucket"], r["identity_key"]) for r in report.buckets(full, r"example\.gov").collect()}
    assert ("embedded", f"arcgis:item:{ITEM}") in buckets and ("external", f"arcgis:item:{STORY}") in buckets and ("enterprise",
        "iframe:gis.example.gov/apps/viewer/") in buckets and ("non_arcgis_external", "iframe:gis.example.gov/apps/viewer/") not in buckets
    assert [r["title"] for r in report.orphaned(items, apps, "ORG").collect()] == ["Orphan"]
    assert report.applications_report(apps, stored, presence, ["Google"]).select("vendor").distinct().collect()[0][0] == "google"
    answers = spark.createDataFrame([("google", "AIzaFAKEKEY123", 200, '{"status":"OK"}')], "vendor string, api_key string, status int, body string")
    assert [r["restriction"] for r in report.api_keys(stored, answers).collect()] == ["UNRESTRICTED (works without a referrer)"]


def test_route_and_requests(spark, pages):
    scope = Scope.make(["www.example.gov"])
    p = pages.withColumn("final", scope.normalized(F.coalesce("final_url", "url")))
    p = p.withColumns({"host": F.lit("www.example.gov"), "final_host": F.regexp_extract("final", "//([^/]+)", 1)})
    out = {r["url"].removeprefix(HOME): r["outcome"] for r in crawl.route(p, p.select("url")).collect()}
    assert {k: v for k, v in out.items() if v != "ok"} == {"/gone": "http_404", "/f": "non_html", "/old": "redirect_duplicate",
        "/away": "redirected_off_host", "/no": "retry", "/err": "retry"}
    log = [("p", i, f"https://t/{i % 3}?k={i}", "image", "tile") for i in range(60)] + [("p", 100 + i, f"https://u/{i}?q#f", "xhr",
        None) for i in range(5)] + [("p", 200, "https://u/0?z", "xhr", None)]
    kept = crawl.request_log(spark.createDataFrame(log, "url string, seq long, request_url string, resource_type string, matched_rule string"), 50, 50).collect()
    assert len([r for r in kept if r["matched_rule"]]) == 50 and sorted(r["request_url"] for r in kept if not r["matched_rule"]) == []
    kept = crawl.request_log(spark.createDataFrame(log, "url string, seq long, request_url string, resource_type string, matched_rule string"), 400, 50).collect()
    assert sorted(r["request_url"] for r in kept if not r["matched_rule"]) == [f"https://u/{i}" for i in range(5)]


def test_discovery_does_not_end_early_in_silence(spark):
    seeds, edges = spark.createDataFrame([("a",)], "url string"), spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    with pytest.raises(ValueError):
        crawl.discover(seeds, edges, max_rounds=1)


def test_crawl_operators(spark):
    seeds = spark.createDataFrame([("a",)], "url string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("x", "y")], "src string, dst string")
    assert {tuple(r) for r in crawl.discover(seeds, edges).collect()} == {("a", 0), ("b", 1), ("d", 1), ("c", 2)}
    assert {r["url"] for r in crawl.discover(seeds, edges, 3).collect()} == {"a", "b", "d"}
    fetches = spark.createDataFrame([("h", i, 200 if i < 3 else None if i % 2 else 403) for i in range(14)] + [("g", i, 500) for i in range(12)],
        "host string, seq long, http_status int")
    tripped = crawl.breaker(fetches, by="host").filter("tripped").select("host", "seq").collect()
    assert {(r["host"], r["seq"]) for r in tripped} == {("h", i) for i in (10, 11, 12, 13)}
    q = spark.createDataFrame([("a", 1, "pending", 1, 0), ("b", 2, "pending", 0, 0), ("c", 3, "in_progress", 0, 0), ("d", 4, "pending", 0, 1)],
        "url string, seq long, status string, attempts int, tier1_done int").withColumns({"retry_after": F.lit(None).cast("timestamp"),
        "last_attempt_at": F.timestamp_seconds(F.lit(0))})
    now = F.timestamp_seconds(F.lit(10_000))
    assert [r["url"] for r in crawl.claim(q, 2, now, 1).collect()] == ["b", "a"]
    assert crawl.reset_stale(q, now).filter("status = 'pending'").count() == 4
    failed = {r["url"]: (r["status"], r["retry_after"]) for r in crawl.after_failure(q.withColumn("attempts", F.col("seq").cast("int") - 1)).collect()}
    assert failed["a"][0] == "pending" and failed["a"][1].timestamp() == 15 and failed["b"][1].timestamp() == 30 and failed["c"] == ("failed", None)
    slots = crawl.rate_slots(spark.createDataFrame([("h", 0, 0), ("h", 1, 100), ("h", 2, 5000)], "host string, seq long, t_ms long"), 500).orderBy("seq").collect()
    assert [r["slot_ms"] for r in slots] == [0, 500, 5000]


def test_preflight(spark):
    urls = spark.createDataFrame([(f"https://h/{s}/{i}", 10 * k + i) for k, s in enumerate("abc") for i in range(3)] + [("https://h/", 99)], "url string, seq long")
    sample = [r["url"] for r in preflight.stratified(urls, 5, "https://h/").collect()]
    assert sample == ["https://h/", "https://h/a/0", "https://h/b/0", "https://h/c/0", "https://h/a/1"]
    loads = spark.createDataFrame([("p", True, ["x", "y"], ["OneTrust"]), ("p", False, ["x"], None), ("q", True, [], []), ("q", False, [], [])],
        "url string, with_consent boolean, map_hosts array<string>, cmp_signals array<string>")
    v = preflight.verdict(loads).first()
    assert v["consent_gating_detected"] and v["cmp_present"] and v["map_hosts_only_with_consent"] == {"y": 1} and v["sample_size"] == 2


def test_sources(spark, tmp_path):
    docs = spark.createDataFrame([("i", "<sitemapindex><sitemap><loc> m1 </loc></sitemap><sitemap><loc>m2</loc></sitemap></sitemapindex>"),
        ("m1", "<urlset><url><x/><loc>https://a/?x=1&amp;y=2</loc></url></urlset>"), ("m2", "https://b/\r\n no\nhttps://c/"),
        ("m3", "https://never/")], "url string, body string")
    assert {r["loc"] for r in tables.expand_sitemaps(docs, ["i"]).collect()} == {"https://a/?x=1&y=2", "https://b/", "https://c/"}
    for n, start in (("a", 1), ("b", 101)):
        (tmp_path / f"{n}.json").write_text(json.dumps({"total": 3, "start": start, "nextStart": -1,
            "results": [{"id": f"i{start}", "title": "T", "created": 0, "modified": 1000}, {"id": "same", "title": n}]}))
    items = {r["item_id"]: r for r in tables.org_items(spark, str(tmp_path), "ORG").collect()}
    assert len(items) == 3 and items["same"]["title"] == "b" and items["i1"]["created"] is None and items["i1"]["modified"] is not None and items["i1"]["org_id"] == "ORG"
    assert tables.search_query("O", ["A", "B"]) == 'orgid:O AND (type:"A" OR type:"B")'
    cfg = load("scan:\n  tier2_sample_rate: 0.5\n  consent:\nscope: {crawl_allowlist: [a]}", report__dir="x")
    assert cfg["scan"]["tier2_sample_rate"] == 0.5 and cfg["scan"]["consent"] == "auto" and cfg["report"]["dir"] == "x" and cfg["http"]["max_retries"] == 3


def test_run(spark, pages, tmp_path):
    folder, out = str(tmp_path / "crawl"), str(tmp_path / "out")
    pages.write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([observation(HOME + "/script", selectors=[selector("#m")])], fuse.OBSERVATION).write.parquet(f"{folder}/observations.parquet")
    spark.createDataFrame([(HOME + "/script", 0, "https://unpkg.com/leaflet/x.js", "script", "host:unpkg.com/leaflet*", "vendor_host", True)],
        "url string, seq long, request_url string, resource_type string, matched_rule string, kind string, is_main boolean").write.parquet(f"{folder}/requests.parquet")
    c = Crawl.open(spark, folder, CONFIG, robots_txt="User-agent: *\nDisallow: /about")
    done = c.run(out)
    apps = {r["identity_key"] for r in done["applications"].collect()}
    assert f"inpage:leaflet:{HOME}/script:#m" in apps and f"inpage:leaflet:{HOME}/script:*" not in apps
    queue = {r["url"].removeprefix(HOME): r for r in c.queue().collect()}
    assert queue["/find-parcel"]["tier2_reason"] == "pattern" and queue["/dash"]["tier2_reason"] == "hit" and queue["/gone"]["skip_reason"] == "http_404" and queue["/script"]["status"] == "done"
    front = {r["url"].removeprefix(HOME): r["skip_reason"] for r in c.read("frontier").collect()}
    assert front == {"/about": "robots_disallow"}
    head, *lines = Path(out, "applications.csv").read_text().splitlines()
    assert head.startswith("identity_key,vendor,app_kind") and len(lines) == len(apps) and json.loads(Path(out,
        "summary.json").read_text())["totals"]["applications"] == len(apps)
    assert "<h2>By vendor</h2><table>" in Path(out, "report.html").read_text() and len(Path(out, "findings.jsonl").read_text().splitlines()) == done["findings"].count()
    before = sorted(map(repr, c.read("applications").collect()))
    c.run(out)
    assert sorted(map(repr, c.read("applications").collect())) == before
    assert {r["identity_key"] for r in c.screenshots().collect()} <= apps and c.status()["queue"].count() == 3 and c.preflight(3)[0].count() == 3


def test_streams(spark, pages, rules, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    pages.select("url", "html", "seq").repartition(2).write.parquet(src)
    streams.ingest(streams.page_stream(spark, src), rules, out, ck).awaitTermination(120)
    batch = detect.findings_of(detect.detect_pages(pages, rules), 1)
    assert streams.current(spark, out).count() == batch.count()
    # pages scanned again: one has lost its findings, one is as before
    again = pages.select("url", F.when(F.col("url") == HOME + "/dash", "").otherwise(F.col("html")).alias("html"),
        (F.col("seq") + 1000).alias("seq")).filter(F.col("url").isin(HOME + "/dash", HOME + "/nav"))
    again.write.mode("append").parquet(src)
    streams.ingest(streams.page_stream(spark, src), rules, out, ck).awaitTermination(120)
    now, lost = streams.current(spark, out), batch.filter(F.col("url") == HOME + "/dash").count()
    assert now.count() == batch.count() - lost and now.filter(F.col("url") == HOME + "/dash").count() == 0 and lost
    events = str(tmp_path / "events")
    spark.createDataFrame([("h", i, 403) for i in range(9)] + [("g", i, 200) for i in range(9)],
        "host string, seq long, http_status int").coalesce(1).write.parquet(events)
    q = streams.breaker_stream(spark.readStream.schema("host string, seq long, http_status int").parquet(events)).writeStream.format("memory").queryName("b").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("b").filter("tripped").select("host", "seq").collect()} == {("h", 7), ("h", 8)}
    times = str(tmp_path / "times")
    found = detect.findings_of(detect.detect_pages(pages, rules), 1).select("identity_key", "url")
    for turn in ("n", "m"):  # applications that are seen again, however late, are not announced again
        found.coalesce(1).write.mode("append").parquet(times)
        new = streams.new_applications(spark.readStream.schema("identity_key string, url string").parquet(times)).writeStream.format("parquet").option("path",
            str(tmp_path / "new")).option("checkpointLocation", str(tmp_path / "new-ck")).trigger(availableNow=True).start()
        new.awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "new")).count() == batch.select("identity_key").distinct().count(), turn


def test_two_rows_of_one_url_are_two_pages(spark, pages, rules):
    once = detect.findings_of(detect.detect_pages(pages, rules, keep=["seq"]), 1, ["seq"])
    twice = detect.findings_of(detect.detect_pages(pages.unionByName(pages.withColumn("seq", F.col("seq") + 500)), rules, keep=["seq"]), 1, ["seq"])
    assert twice.count() == 2 * once.count() and twice.select("url", "seq", "place").distinct().count() == twice.count()


def test_runs_stop_and_go_on(spark, pages, tmp_path):
    folder = str(tmp_path / "crawl")
    pages.unionByName(pages.filter("seq < 3").withColumn("seq", F.col("seq") - 50)).write.parquet(f"{folder}/pages.parquet")
    script, dash = HOME + "/script", HOME + "/dash"
    spark.createDataFrame([observation(script, selectors=[selector("#m")]), observation(dash, selectors=[selector("#a"), selector("#b")])],
        fuse.OBSERVATION).write.parquet(f"{folder}/observations.parquet")
    spark.createDataFrame([(u, 0, "https://unpkg.com/leaflet/x.js", "script", "host:unpkg.com/leaflet*", "vendor_host", True) for u in (script,
        dash)], "url string, seq long, request_url string, resource_type string, matched_rule string, kind string, is_main boolean").write.parquet(f"{folder}/requests.parquet")
    spark.createDataFrame([(HOME + "/sitemap.xml", f"<urlset><url><loc>{HOME}/new</loc></url><url><loc>{HOME}/dash</loc></url></urlset>")],
        "url string, body string").write.parquet(f"{folder}/sitemaps.parquet")
    c = Crawl.open(spark, folder, CONFIG)
    with pytest.raises(crawl.Stopped, match="deadline"):
        c.run(str(tmp_path / "out"), budget=crawl.Budget(0.0))
    told = crawl.Budget()
    told.stop()
    with pytest.raises(crawl.Stopped, match="told"):
        c.run(str(tmp_path / "out"), budget=told)
    with pytest.raises(crawl.Stopped, match="disk"):
        c.run(str(tmp_path / "out"), budget=crawl.Budget(min_free_mb=1 << 40, folder=folder))
    c.inventory()
    assert c.read("queue").count() == pages.count()  # a URL is one row, however often it was recorded
    assert {r["url"].removeprefix(HOME): r["source"] for r in c.read("frontier").collect()} == {"/about": "crawl", "/new": "sitemap"}
    assert c.due(1).count() == 1
    first = c.scan(limit=1).select("url").collect()
    c.scan(limit=50)
    assert {r["url"] for r in c.read("rendered").collect()} == {script, dash} and len(first) <= 1
    assert c.scan(urls=[dash]).count() == 2 and c.read("tier2").filter(F.col("url") == dash).select("identity_key").distinct().count() == 2
    assert c.read("request_log").count() == 2 and store.duplicate_groups(c.findings()).count() == 0
    assert c.preflight(20)[0].filter(F.col("url") == HOME + "/new").count() == 1
    assert {r["flag"]: r["up"] for r in c.status()["flags"].collect()} == {"blocked": False, "disk": False}
    assert c.inventory(False).count() == pages.count() and c.read("frontier").select("url").collect()[0][0] == HOME + "/new"


def test_command_line(spark, pages, tmp_path, capsys):
    from cartolens.__main__ import main

    folder, out = str(tmp_path / "crawl"), str(tmp_path / "out")
    pages.write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([("p", True, ["x", "y"], ["OneTrust"]), ("p", False, ["x"], None)],
        "url string, with_consent boolean, map_hosts array<string>, cmp_signals array<string>").write.parquet(f"{folder}/loads.parquet")
    (tmp_path / "c.yaml").write_text(json.dumps(CONFIG))
    run = lambda *a: main([*a, "-c", str(tmp_path / "c.yaml"), "--out", out])
    assert run("inventory", folder, "--no-crawl") == 0 and run("preflight", folder) == 0
    verdict = json.loads(Path(out, "preflight.json").read_text())
    assert verdict["consent_gating_detected"] and verdict["map_hosts_only_with_consent"] == {"y": 1}
    assert run("scan", folder, "--verdict", str(Path(out, "preflight.json")), "--reset-in-progress", "--limit", "3") == 0
    assert run("status", folder) == 0 and run("report", folder, "--no-probe-keys") == 0
    assert run("run-crawl", folder, "--max-runtime", "0") == 1 and "deadline" in capsys.readouterr().err
    last = Crawl.open(spark, folder, CONFIG).runs().collect()
    assert [r["command"] for r in last] == ["run-crawl", "report", "status"] and "deadline" in last[0]["result"] and last[1]["result"] == "done"


def test_detect_static_is_a_table_function(spark, rules):
    from cartolens.rules import default_source

    spark.udtf.register("detect_static", detect.DetectStatic)
    source = json.dumps(default_source("example.gov", "city.maps.arcgis.com"))
    page = PAGES["/dash"]
    got = spark.sql("SELECT identity_key, width_px FROM detect_static(:html, :url, :rules)", args={"html": page, "url": HOME + "/dash", "rules": source}).collect()
    want = detect.detect(page, HOME + "/dash", rules)["findings"]
    assert [tuple(r) for r in got] == [(f["identity_key"], f["width_px"]) for f in want] and want


def test_pages_are_cut_by_bytes_between_characters(spark, tmp_path):
    texts = ["abc", "ééééé", "aéé漢😀", "x" * 10, "\ufffd" * 3, "", None]
    spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "url string, html string").write.parquet(str(tmp_path / "p"))
    for most in range(1, 12):
        got = {r["url"]: r for r in tables.stored_pages(spark, str(tmp_path / "p"), most).collect()}
        for i, t in enumerate(texts):
            assert got[str(i)]["html"] == (t if t is None else t.encode()[:most].decode("utf-8",
                "ignore")) and got[str(i)]["truncated"] == (len((t or "").encode()) > most)


def test_pages_are_stored_and_read_again(spark, pages, found, tmp_path):
    p = str(tmp_path / "store")
    tables.store_pages(pages, p, "hits", found)
    assert {r["url"] for r in tables.stored_pages(spark, p).collect()} == {r["url"] for r in found.select("url").distinct().collect()}
    tables.store_pages(pages, str(tmp_path / "none"), "none")
    assert not (tmp_path / "none").exists()
    (tmp_path / "f").mkdir()
    import gzip

    (tmp_path / "f" / "a").write_bytes(gzip.compress("né".encode()))
    (tmp_path / "f" / "b").write_bytes(b"plain")
    assert {r["html"] for r in tables.page_files(spark, str(tmp_path / "f")).collect()} == {"né", "plain"}
    docs = spark.createDataFrame([("i", gzip.compress(b"<urlset><url><loc>https://a/</loc></url></urlset>"))], "url string, body binary")
    assert [r["loc"] for r in tables.expand_sitemaps(docs, tables.sitemap_starts([], ["i", "i"])).collect()] == ["https://a/"]
    assert tables.sitemap_starts([], [], "https://h/") == ["https://h/sitemap.xml"]


def test_requests_and_applications_after_a_rescan(spark):
    log = spark.createDataFrame([("p", 1), ("q", 2), ("r", 3)], "url string, seq long")
    new = spark.createDataFrame([("p", 9)], "url string, seq long")
    assert {tuple(r) for r in store.replace_requests(log, new, spark.createDataFrame([("p",), ("q",)], "url string")).collect()} == {("p", 9), ("r", 3)}
    apps = spark.createDataFrame([("a", 1, None), ("b", 0, None), ("c", 0, "c.jpg"), ("d", None, None)],
        "identity_key string, occurrence_count int, screenshot_path string")
    assert {r["identity_key"] for r in store.without_orphans(apps).collect()} == {"a", "c"}
