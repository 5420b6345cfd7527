"""Goldens of URLs, identities, robots, rules and the tree, and columns against their Python twins."""

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartolens.functions import identity, text
from cartolens.functions.urls import Scope
from cartolens.functions.whatwg import form_encode, parse
from cartolens.operators import dom
from cartolens.rules import all_matches, compile_rules, default_rules, default_source, first_match_join, rule_table
from cartolens.runtime import ship
from cartolens.sources import robots

RULES = default_rules("example.gov", "city.maps.arcgis.com")
SCOPE = Scope.make(["www.example.com", "localhost:8765"], {"example.com": "www.example.com"}, [".PDF", "jpg"], ["utm_*", "fbclid"])


@pytest.mark.parametrize(
    ("url", "base", "want"),
    [
        ("HTTP://Example.COM:80/a//b/?utm_source=x&b=2 3#f", None, "http://www.example.com/a/b?b=2+3"),
        ("/x/../y/./z/", "https://u:p@www.example.com/q", "https://www.example.com/y/z"),
        ("//www.example.com./?", "https://a.b/", "https://www.example.com/"),
        ("?q=1", "https://www.example.com/p?z=2#k", "https://www.example.com/p?q=1"),
        ("", "https://www.example.com/p?z=2#k", "https://www.example.com/p?z=2"),
        ("https:\\\\www.example.com\\a b", None, "https://www.example.com/a%20b"),
        ("https://bücher.example/ü", None, "https://xn--bcher-kva.example/%C3%BC"),
        ("https://www.example.com:8443/a.PDF", None, "https://www.example.com:8443/a.PDF"),
        ("ht\ntps://www.example.com/\ta", None, "https://www.example.com/a"),
        ("http://0x7f.1/", None, "http://127.0.0.1/"),
        ("mailto:a@b.c", None, None), ("javascript:1", "https://a.b/", None), ("relative", None, None), ("http://", None, None),
            ("http://a b/", None, None), ("http://a:99999/", None, None), (None, None, None),
    ],
)
def test_normalize(url, base, want):
    u = SCOPE.normalize(url, base)
    assert (u.href if u else None) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abAZ/.?=&#%20:é\\@ +;", max_size=40))
def test_normalize_is_idempotent(tail):
    u = SCOPE.normalize("https://www.example.com/" + tail)
    if u is not None:
        again = SCOPE.normalize(u.href)
        assert again is not None and again.href == u.href


def test_normalize_column_equals_twin(spark):
    ship(spark)
    urls = [f"{s}://{h}{p}{q}{f}" for s in ("http", "HTTPS") for h in ("Example.com", "www.example.com:443", "x.y:80", "a_b.c", "1.2.3.4",
        "x.y.") for p in ("", "/", "//a//", "/a/../b", "/a.b/c-d_e", "/é") for q in ("", "?", "?utm_a=1&b=2", "?b&&c=", "?b=%20+c") for f in ("",
        "#x")] + [None, "", "x"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", SCOPE.normalized(F.col("u")).alias("n")).collect()
    assert {r["u"]: r["n"] for r in got} == {u: (v.href if (v := SCOPE.normalize(u)) else None) for u in urls}


def test_classify(spark):
    cases = {"https://example.com/a": "ok", "http://localhost:8765/": "ok", "http://localhost/": "out_of_scope_host",
        "https://www.example.com/a.Pdf?x": "asset", "ftp://www.example.com/": "unparseable", "nothing": "unparseable"}
    for url, want in cases.items():
        assert SCOPE.classify(url)[2] == want
    df = spark.createDataFrame([(u,) for u in cases], "u string").withColumn("n", SCOPE.normalized(F.col("u")))
    assert {r["u"]: r["r"] for r in df.select("u", SCOPE.classified(F.col("n")).alias("r")).collect()} == cases


ITEM = "0123456789ABCDEF0123456789abcdef"
IDENTITIES = [
    ("https://maps.googleapis.com/maps/api/staticmap?center=37.5,-122.3&zoom=10&size=600x300&key=AIzaFAKEKEY123",
        "iframe:maps.googleapis.com/maps/api/staticmap/?center=37.5,-122.3", "AIzaFAKEKEY123"),
    ("https://services.arcgis.com/ORG123abc/arcgis/rest/services/Parcels/FeatureServer/0", "arcgis:service:ORG123abc/Parcels", None),
    ("https://google.com/maps/d/embed?mid=1XyZ_abc123&hl=en", "gmymaps:mid:1XyZ_abc123", None),
    ("https://public.tableau.com/views/Dash/Map?:embed=y", "iframe:public.tableau.com/views/Dash/Map/", None),
    ("https://gis.example.gov/Html5Viewer/?viewer=raster", "iframe:gis.example.gov/Html5Viewer/", None),
    ("https://gis.example.gov/apps/publicviewer", "iframe:gis.example.gov/apps/publicviewer/", None),
        ("https://gis.example.gov/apps/publicviewer/", "iframe:gis.example.gov/apps/publicviewer/", None),
    (f"https://x.maps.arcgis.com/apps/webappviewer/index.html?id={ITEM}", f"arcgis:item:{ITEM.lower()}", None),
        (f"https://storymaps.arcgis.com/stories/{ITEM}", f"arcgis:item:{ITEM.lower()}", None),
    ("mapbox://styles/org/style1", "mapbox:style:org/style1", None),
        ("https://api.mapbox.com/styles/v1/org/s2/static/1,2?access_token=pk.1", "mapbox:style:org/s2", "pk.1"),
    ("https://x.org/a//b.html?Q=1&z=2&id=" + "v" * 70, "iframe:x.org/a/b.html?Q=1&id=h" + identity.short_hash("v" * 70), None),
        ("relative", None, None), ("", None, None),
]


@pytest.mark.parametrize(("url", "key", "api_key"), IDENTITIES)
def test_identity(url, key, api_key):
    i = identity.resolve(url, RULES)
    assert (i.key if i else None, i.api_key if i else None) == (key, api_key)


def test_identity_column_and_fixed_key(spark):
    ship(spark)
    df = spark.createDataFrame([(u, None) for u, _, _ in IDENTITIES] + [("https://www.google.com/maps?q=a", "link:google.com/maps")], "u string, k string")
    got = df.select(identity.identity_struct(RULES)("u", "k").alias("i")).select("i.key").collect()
    assert [r["key"] for r in got] == [k for _, k, _ in IDENTITIES] + ["link:google.com/maps"]


def test_sample_is_stable(spark):
    df = spark.createDataFrame([("x",)], "u string")
    assert round(df.select(identity.sample_share(F.col("u"))).first()[0] * 4294967296) == 3971870852


def test_robots(spark):
    r = robots.parse("Sitemap: https://s/x.xml\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nUser-agent: b # c\nDisallow: /private/\nDisallow: /a*z$\nAllow: /private/ok\nDisallow:\nCrawl-delay: 5\n\nUser-agent: *\nDisallow: /never",
        "cartolens")
    cases = {"/private/x": False, "/private/ok/1": True, "/abz": False, "/abz?": True, "/Private/": True, "/never": True, "/": True}
    assert {p: r.is_allowed(p) for p in cases} == cases and r.sitemaps == ["https://s/x.xml"] and r.crawl_delay == 5
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {x["path"]: x["a"] for x in df.select("path", r.allowed(F.col("path")).alias("a")).collect()} == cases
    table = spark.createDataFrame([(ok, p, robots.path_regex(p)) for ok, p in r.rules], "allow boolean, pattern string, regex string")
    assert {x["path"]: x["allowed"] for x in robots.allowed_join(df, table).collect()} == cases
    assert r.interval_ms(2) == 5000 and r.interval_ms(2, False) == 500
    assert robots.parse("User-agent: carto\nDisallow: /x", "cartolens").is_allowed("/x") is False and robots.parse("", "c").is_allowed("/")


def test_rule_order():
    label = lambda u: (r.label if (r := RULES.embed(u)) else None)
    assert label("https://a.arcgis.com/apps/MapJournal/index.html") == "ArcGIS Configurable App" and label("https://a.arcgis.com/apps/MapJournal?x") == "ArcGIS App"
    req = lambda u: (r.id, r.kind) if (r := RULES.request(u)) else None
    assert req("https://storymaps.arcgis.com/x") == ("host:*.arcgis.com",
        "vendor_host") and req("https://x.y/arcgis/rest/services/A/MapServer/1")[0] == "path:/mapserver/"
    assert req("https://x.y/wms?request=GetMap")[0].startswith("path:[?&]request=GetMap") and req("https://x.y/3/4/5.png") == ("tile", "tile")
    assert req("https://unpkg.com/leaflet@1/x.js")[0] == "host:unpkg.com/leaflet*" and req("https://unpkg.com/react") is None
    assert len(RULES.embeds) == 40 and len(RULES.hosts) == 39 and len(RULES.static_html) == 14 and len(RULES.chrome) == 22
    assert {r.vendor for r in compile_rules(default_source("example.gov"), ["Google"]).request_rules()} == {"google"}
    assert not [r for r in default_rules().hosts if "{" in r.regex]


def test_rule_columns_equal_twins(spark):
    urls = ["https://www.google.com/maps?q=1", "https://a.tile.openstreetmap.org/1/2/3.png", "https://x.y/geoserver/z", "https://none.example/",
        "https://maps.googleapis.com/maps/api/staticmap?x", "HTTPS://UNPKG.com/leaflet/x", "https://x.y/1/2/3.pbf?k"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    rows = df.select("u", RULES.request_index(F.col("u")).alias("r"), RULES.embed_index(F.col("u")).alias("e")).collect()
    for r in rows:
        assert (RULES.request_rules()[r["r"]].id if r["r"] is not None else None) == (x.id if (x := RULES.request(r["u"])) else None)
        assert (RULES.embeds[r["e"]] if r["e"] is not None else None) == RULES.embed(r["u"])
    joined = first_match_join(df, "u", rule_table(spark, RULES.embeds)).collect()
    assert {r["u"]: r["ord"] for r in joined} == {r["u"]: r["e"] for r in rows}
    html = spark.createDataFrame([("new ol.Map() L.map (x) mapbox://styles/a/b\"",)], "h string")
    assert [m["match"] for m in html.select(all_matches(F.col("h"), RULES.static_html).alias("m")).first()["m"]] == ["L.map (", "new ol.Map", "mapbox://styles/a/b"]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<main><p><a id=x>", "main_content"), ("<header><a id=x>", "site_chrome"), ("<main><nav><a id=x>", "main_content"),
            ("<article><footer><a id=x>", "site_chrome"), ("<nav class='mega-menu'><main><a id=x>", "main_content"),
        ("<main><nav class=mega-menu><a id=x>", "main_content"), ("<div class=layout-container><header><a id=x>", "site_chrome"),
            ("<div><a id=x>", "main_content"), ("<footer><div class=region-content><a id=x>", "main_content"),
        ("<nav><ul><li>a<li><a id=x></ul></nav>", "site_chrome"), ("<nav><p>open</nav><a id=x>", "main_content"), ("<script>'<header>'</script><a id=x>", "main_content"),
    ],
)
def test_placement(html, want):
    node = next(n for n in dom.parse(html).elements() if n.get("id") == "x")
    assert dom.placement(node, RULES.chrome, RULES.main) == want


def test_selectors_and_paths():
    root = dom.parse('<div id=a class="b c"><ul><li>1<li class=d data-x="map-1">2</ul></div><div class=b><p><b>y</b></div>')
    find = lambda s: [n.name for n in root.elements() if dom.matches(n, s)]
    assert find("div.b.c") == ["div"] and find("#a li") == ["li", "li"] and find("ul > li.d, b") == ["li",
        "b"] and find("div > li") == [] and find('[data-x*="map"]') == ["li"] and find("li:not(.d)") == ["li"] and find("[class=b]") == ["div"]
    li = [n for n in root.elements() if n.name == "li"][1]
    assert dom.css_path(li) == "div#a > ul > li.d:nth-of-type(2)"


def test_text_columns(spark):
    df = spark.createDataFrame([("<TITLE x>  A &amp;amp; B\n c</title><title>no", " +12px", 0, '"https://a.b/c?x=1&amp;y=2". http://d.e/f,',
        "a.png 1x, /b.png 2x,")], "h string, d string, ms long, r string, s string")
    r = df.select(text.title(F.col("h")).alias("t"), text.dimension(F.col("d")).alias("d"), text.from_millis(F.col("ms")).alias("m"),
        text.raw_urls(F.col("r")).alias("u"), text.srcset(F.col("s")).alias("s"), text.backoff_ms(F.lit(3), 15000).alias("b"),
        text.duration(F.lit(3_725_000)).alias("x"), text.shorten(F.lit("a" * 70)).alias("l")).first()
    assert r["t"] == "A &amp; B c" and r["d"] == 12 and r["m"] is None and r["u"] == ["https://a.b/c?x=1&y=2", "http://d.e/f"] and r["s"] == ["a.png",
        "/b.png"] and r["b"] == 60000 and r["x"] == "1h2m" and len(r["l"]) == 60
    html = spark.createDataFrame(pd.DataFrame({"c": ["Text/HTML; x", "application/xhtml+xml", "text/plain", None]}))
    assert [x[0] for x in html.select(text.is_html(F.col("c"))).collect()] == [True, True, False, False]


def test_whatwg_parts():
    u = parse("https://User:pw@[::1]:8080/a%2e/%2E%2e/b;c?x='y'#z")
    assert (u.user, u.netloc, u.path, u.query, u.fragment) == ("User:pw@", "[::1]:8080", "/b;c", "x=%27y%27", "z")
    assert form_encode([("a b", "ü~*"), ("c", "")]) == "a+b=%C3%BC%7E*&c="


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abA0.-~/?&=:%_é", max_size=14), st.sampled_from(["", "/", "//", "https://a.bc", "https://a.bc/", "http://xn--a.bc/",
    "https://a.b1/", "https://A.bc/"]))
def test_plain_urls_need_no_parsing(tail, head):
    from cartolens.operators.detect import Page

    for base in ("https://www.example.gov:8443/x/y?z", "http://h.example/", "mailto:x"):
        found = parse(head + tail, parse(base))
        assert Page("", base, RULES).absolute(head + tail) == (found.href if found else None)
