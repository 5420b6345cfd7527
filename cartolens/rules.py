"""Rule sets as data, compiled to prioritised matchers: Python twins for use inside UDFs, and columns.

A column matcher is one CASE of literal regular expressions, tried in order, so the first match wins without a join; the
rule table joined by regular expression gives the same result more slowly, and takes rule sets that are tables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed


@dataclass(frozen=True)
class Rule:
    id: str
    vendor: str
    type: str
    confidence: str
    regex: str
    label: str | None = None
    identity_key: str | None = None
    whole: bool = True  # of a host rule: the pattern is a host, else a host and the beginning of a path
    kind: str = ""

    @property
    def re(self) -> re.Pattern:
        return _compiled(self.regex)


#: Answers that a rule set remembers.
REMEMBERED = 20_000

_cache: dict[str, re.Pattern] = {}


def _compiled(regex: str) -> re.Pattern:
    if regex not in _cache:
        _cache[regex] = re.compile(regex, re.I | re.A)
    return _cache[regex]


def glob_regex(glob: str, anchor_end: bool = True) -> str:
    """A regular expression for a glob whose only wildcard is *."""
    return "^" + ".*".join(re.escape(part) for part in glob.split("*")) + ("$" if anchor_end else "")


def _rows(text: str, sep: str | None) -> list[list[str]]:
    lines = [x for x in text.splitlines() if x.strip()]
    return [[p.strip() for p in x.split(sep)] if sep else x.rsplit(" ", 3) for x in lines]


def default_source(domain: str = "", portal: str = "") -> dict[str, Any]:
    """The fixed rules in the shape of a rules document; without a domain or portal its rules are left out."""
    keys = ("vendor", "type", "confidence", "label", "identity_key")
    put = lambda s, d: s.replace("{domain}", d).replace("{portal}", portal)
    mine = lambda s: (domain or "{domain}" not in s) and (portal or "{portal}" not in s)
    plain = lambda text, name, sep=None, d=domain: [{name: put(r[0], d), **dict(zip(keys, r[1:], strict=False))} for r in _rows(text, sep) if mine(r[0])]
    return {
        "network": {"hosts": plain(fixed.HOSTS, "pattern"), "paths": plain(fixed.PATHS, "regex"),
            "static_map_apis": plain(fixed.STATIC_MAPS, "regex"), "tile_pattern": plain(fixed.TILE, "regex")[0]},
        "embeds": plain(fixed.EMBEDS, "regex", " | ", re.escape(domain)),
        "globals": plain(fixed.GLOBALS, "name"),
        "selectors": plain(fixed.SELECTORS, "selector", " | "),
        "static_html": plain(fixed.STATIC_HTML, "regex", " | "),
        "map_adjacent": {"patterns": fixed.MAP_ADJACENT},
        "placement": {"chrome_selectors": fixed.CHROME.split("\n")[1:-1], "main_content_selectors": fixed.MAIN.split("\n")[1:-1],
            "ignore_link_selectors": fixed.IGNORED_LINKS.split("\n")[1:-1], "ignore_link_text_regex": fixed.IGNORED_LINK_TEXT},
        "non_geographic": {"hint_regex": fixed.NON_GEOGRAPHIC},
        "identity": {"identifying_params": fixed.IDENTIFYING, "credential_params": fixed.CREDENTIALS},
        "cmp": {
            "globals": fixed.CMP_GLOBALS, "asset_patterns": fixed.CMP_ASSETS, "gtag_consent_regex": fixed.CMP_GTAG, "accept_button_regex": fixed.CMP_ACCEPT,
            "consent_cookies": [dict(zip(("name", "value"), x.split(" ", 1), strict=True)) for x in fixed.CMP_COOKIES.split("\n")[1:-1]],
        },
    }


@dataclass
class RuleSet:
    hosts: list[Rule]
    paths: list[Rule]
    static_maps: list[Rule]
    tile: Rule | None
    embeds: list[Rule]
    globals: list[dict]
    selectors: list[dict]
    static_html: list[Rule]
    map_adjacent: str
    chrome: list[str]
    main: list[str]
    ignored_links: list[str]
    ignored_text: str | None
    non_geographic: str
    identifying: frozenset[str]
    credentials: tuple[str, ...]
    cmp: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.known: dict[tuple[str, str], Rule | None] = {}

    # Python twins; the same URLs stand on many pages, so what was looked up is kept, up to ``REMEMBERED`` answers
    def lookup(self, matcher: str, url: str) -> Rule | None:
        """The rule that ``embed``, ``request`` or ``static_map`` gives."""
        if (matcher, url) not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[matcher, url] = getattr(self, matcher)(url)
        return self.known[matcher, url]

    def request(self, url: str) -> Rule | None:
        """Static map service, host, path, tile: the first that matches a request's URL; its kind says which."""
        from .functions.whatwg import parse

        if rule := self.static_map(url):
            return rule
        u = parse(url)
        host, path = (u.host, u.host + u.path) if u and u.host is not None else ("", "")
        if u and u.host is not None:
            for r in self.hosts:
                if r.re.search(host if r.whole else path):
                    return r
        return next((r for r in [*self.paths, *([self.tile] if self.tile else [])] if r.re.search(url)), None)

    def embed(self, url: str) -> Rule | None:
        return next((r for r in self.embeds if r.re.search(url)), None)

    def static_map(self, url: str) -> Rule | None:
        return next((r for r in self.static_maps if r.re.search(url)), None)

    def source_hints(self, html: str) -> list[tuple[Rule, str]]:
        """Every hint that the page source holds, with its first match."""
        return [(r, m[0][:200]) for r in self.static_html if (m := r.re.search(html))]

    # columns
    def embed_index(self, url: Column) -> Column:
        return first_match(url, [r.regex for r in self.embeds])

    def static_map_index(self, url: Column) -> Column:
        return first_match(url, [r.regex for r in self.static_maps])

    def request_rules(self) -> list[Rule]:
        return [*self.static_maps, *self.hosts, *self.paths, *([self.tile] if self.tile else [])]

    def request_index(self, url: Column) -> Column:
        """Number in request_rules() of the first that matches; host rules see host or host and path, others the URL."""
        host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
        path = F.concat(host, F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
        on = {r.id: (host if r.whole else path) if r.kind == "vendor_host" else url for r in self.request_rules()}
        return F.coalesce(*[F.when(on[r.id].rlike(f"(?i){r.regex}"), F.lit(i)) for i, r in enumerate(self.request_rules())])

    def is_map_adjacent(self, path: Column, title: Column) -> Column:
        return F.coalesce(path.rlike(f"(?i){self.map_adjacent}"), F.lit(False)) | F.coalesce(title.rlike(f"(?i){self.map_adjacent}"), F.lit(False))


def compile_rules(source: dict[str, Any], vendors: list[str] | None = None) -> RuleSet:
    """From a rules document; rules of vendors that are not asked for (empty: all) are left out here, before any matching."""
    asked = {str(v).lower() for v in vendors or []}
    keep = lambda rows: [r for r in rows or [] if not asked or str(r.get("vendor") or "").lower() in asked]
    net, place, ident = source.get("network") or {}, source.get("placement") or {}, source.get("identity") or {}
    make = lambda rows, prefix, kind: [Rule(f"{prefix}:{r.get('label') or r['regex']}" if prefix == "embed" else f"{prefix}:{r['regex']}",
        r["vendor"], r["type"], r["confidence"], r["regex"], r.get("label"), r.get("identity_key"), True, kind) for r in keep(rows)]
    hosts = [Rule(f"host:{r['pattern']}", r["vendor"], r["type"], r["confidence"], glob_regex(r["pattern"], "/" not in r["pattern"]), None, None,
        "/" not in r["pattern"], "vendor_host") for r in keep(net.get("hosts"))]
    tile = keep([net["tile_pattern"]]) if net.get("tile_pattern") else []
    return RuleSet(
        hosts, make(net.get("paths"), "path", "service_path"), make(net.get("static_map_apis"), "static", "static_map_api"),
        Rule("tile", tile[0]["vendor"], tile[0]["type"], tile[0]["confidence"], tile[0]["regex"], kind="tile") if tile else None,
        make(source.get("embeds"), "embed", "embed"),
        [{**r, "id": f"global:{r['name']}"} for r in keep(source.get("globals"))], [{**r, "id": f"selector:{r['selector']}"} for r in keep(source.get("selectors"))],
        make(source.get("static_html"), "html", "html"), "(" + "|".join((source.get("map_adjacent") or {}).get("patterns") or ["map"]) + ")",
        place.get("chrome_selectors") or [], place.get("main_content_selectors") or [], place.get("ignore_link_selectors") or [], place.get("ignore_link_text_regex"),
        (source.get("non_geographic") or {}).get("hint_regex") or "floor ?plan|seating",
        frozenset(ident.get("identifying_params") or ["id", "appid", "webmap", "mid"]), tuple(ident.get("credential_params") or ["key", "access_token", "apikey"]),
        source.get("cmp") or {},
    )


def default_rules(domain: str = "", portal: str = "", vendors: list[str] | None = None) -> RuleSet:
    return compile_rules(default_source(domain, portal), vendors)


def first_match(value: Column, regexes: list[str]) -> Column:
    """Number of the first regular expression that the value matches, ignoring case; null if none does."""
    if not regexes:
        return F.lit(None).cast("int")
    return F.coalesce(*[F.when(value.rlike(f"(?i){r}"), F.lit(i)) for i, r in enumerate(regexes)])


def pick(index: Column, values: list[str | None]) -> Column:
    """The value of a rule's number, from a literal array."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index)


def all_matches(value: Column, rules: list[Rule]) -> Column:
    """array<struct<ord, match>> of every rule that matches, with its first match of at most 200 characters."""
    each = [F.struct(F.lit(i).alias("ord"), F.substring(F.regexp_extract(value, f"(?i){r.regex}", 0), 1, 200).alias("match")) for i, r in enumerate(rules)]
    return F.filter(F.array(*each), lambda m: m["match"] != "") if each else F.array()


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(i, r.id, r.vendor, r.type, r.confidence, f"(?i){r.regex}", r.label, r.identity_key) for i, r in enumerate(rules)],
        "ord int, id string, vendor string, type string, confidence string, regex string, label string, identity_key string")


#: Rules of a table that are sent to every task; more are joined without.
MOST_RULES = 10_000


def small(rules: DataFrame) -> DataFrame:
    """``rules`` with a hint to broadcast them, if a count shows that they are few."""
    return F.broadcast(rules) if rules.limit(MOST_RULES + 1).count() <= MOST_RULES else rules


def first_match_join(df: DataFrame, value: str, rules: DataFrame) -> DataFrame:
    """``df`` with the number of the first rule of a rule table that matches, as ``ord``: for rule sets that are tables."""
    keyed = df.select(value).distinct()
    met = keyed.join(small(rules), F.expr(f"{value} rlike regex")).groupBy(value).agg(F.min("ord").alias("ord"))
    return df.join(met, value, "left")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
