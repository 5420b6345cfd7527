"""URL normalisation and crawl scope."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rules import glob_regex
from .whatwg import Url, form_encode, parse


@dataclass(frozen=True)
class Scope:
    """Hosts to crawl, aliases of hosts, extensions of assets, and globs of query parameters to drop."""

    allow: frozenset[str]
    aliases: tuple[tuple[str, str], ...] = ()
    assets: frozenset[str] = frozenset()
    drop: tuple[str, ...] = ()

    @classmethod
    def of(cls, cfg: Mapping) -> Scope:
        scope, inv = cfg.get("scope") or {}, cfg.get("inventory") or {}
        return cls.make(scope.get("crawl_allowlist") or [], scope.get("normalize_to_www") or {}, inv.get("skip_extensions") or [], inv.get("strip_query_params") or [])

    @classmethod
    def make(cls, allow: Iterable[str] = (), aliases: Mapping[str, str] | None = None, assets: Iterable[str] = (), drop: Iterable[str] = ()) -> Scope:
        return cls(frozenset(h.lower() for h in allow), tuple((k.lower(), v.lower()) for k, v in (aliases or {}).items()),
            frozenset(e.lower().lstrip(".") for e in assets), tuple(glob_regex(g) for g in drop))

    # Python twins
    def canonical_host(self, host: str) -> str:
        return dict(self.aliases).get(host.lower(), host.lower())

    def normalize(self, text: str | None, base: str | None = None) -> Url | None:
        u = parse(text, base)
        if u is None or u.host is None:
            return None
        query = u.query
        if self.drop and query:
            query = form_encode([(k, v) for k, v in u.params() if not any(re.search(d, k, re.I) for d in self.drop)]) or None
        path = re.sub("/{2,}", "/", u.path)
        host = self.canonical_host(u.host).removesuffix(".")
        return u.with_(host=host, path=path[:-1] if len(path) > 1 and path.endswith("/") else path, query=query, fragment=None, user="")

    def is_asset(self, u: Url) -> bool:
        m = re.search(r"\.([a-z0-9]{1,5})$", u.path.lower())
        return bool(m and m[1] in self.assets)

    def classify(self, text: str | None, base: str | None = None) -> tuple[str | None, bool, str]:
        """(normalised URL, whether to crawl it, reason)."""
        u = self.normalize(text, base)
        if u is None:
            return None, False, "unparseable"
        if self.canonical_host(u.netloc) not in self.allow:
            return u.href, False, "out_of_scope_host"
        if self.is_asset(u):
            return u.href, False, "asset"
        return u.href, True, "ok"

    # columns
    def normalized(self, url: Column, base: Column | None = None) -> Column:
        """The normalised URL or null. Plain absolute URLs go through expressions; only others reach Python."""
        plain = is_plain(url) if base is None else F.lit(False)
        slow = _normalize_udf(self)(F.when(~plain, url), F.lit(None).cast("string") if base is None else base)
        return F.when(plain, self._plain(url)).otherwise(slow)

    def _plain(self, url: Column) -> Column:
        scheme = F.lower(F.regexp_extract(url, "^([A-Za-z]+):", 1))
        host = F.lower(F.regexp_extract(url, "://([^/?#:]+)", 1))
        port = F.regexp_extract(url, "://[^/?#:]+:([0-9]+)", 1)
        port = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")),
            "").otherwise(F.concat(F.lit(":"), F.regexp_replace(port, "^0+(?=[0-9])", "")))
        path = F.regexp_replace(F.regexp_extract(url, "://[^/?#]+([^?#]*)", 1), "/{2,}", "/")
        path = F.when(path == "", "/").when((F.length(path) > 1) & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
        query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
        if self.drop:
            name = lambda p: F.regexp_extract(p, "^([^=]*)", 1)
            dropped = lambda p: name(p).rlike("(?i)" + "|".join(f"(?:{d})" for d in self.drop))
            kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~dropped(p))
            query = F.array_join(F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))), "&")
        for alias, target in self.aliases:
            host = F.when(host == alias, target).otherwise(host)
        return F.concat(scheme, F.lit("://"), F.regexp_replace(host, r"\.$", ""), port, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))

    def classified(self, normalized: Column) -> Column:
        """The reason, of a normalised URL (null: unparseable)."""
        netloc = F.regexp_extract(normalized, "://([^/?#]+)", 1)
        return (
            F.when(normalized.isNull(), "unparseable").when(~netloc.isin(*self.allow) if self.allow else F.lit(True), "out_of_scope_host")
            .when(extension(normalized).isin(*self.assets) if self.assets else F.lit(False), "asset").otherwise("ok")
        )


def is_plain(url: Column) -> Column:
    """Whether a URL is absolute, ASCII, without user, escapes, dot segments or odd hosts, so that expressions suffice."""
    simple = url.rlike(r"^[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z][A-Za-z0-9-]*\.?(:[0-9]{1,4})?(/[A-Za-z0-9._/-]*)?(\?[A-Za-z0-9._=&-]*)?(#[\x21-\x7e]*)?$")
    return F.coalesce(simple & ~url.rlike(r"://[^/?#]+[^?#]*/\.{1,2}(/|[?#]|$)"), F.lit(False))


def _normalize_udf(scope: Scope):
    @F.pandas_udf(T.StringType())
    def run(urls: pd.Series, bases: pd.Series) -> pd.Series:
        out = [(scope.normalize(u, b or None) if isinstance(u, str) else None) for u, b in zip(urls, bases, strict=True)]
        return pd.Series([u.href if u else None for u in out], dtype=object)

    return run


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, "://[^/?#]+([^?#]*)", 1)


def extension(url: Column) -> Column:
    return F.regexp_extract(F.lower(path_of(url)), r"\.([a-z0-9]{1,5})$", 1)


def host(url: Column) -> Column:
    """Lower-case host without port; empty if the URL has none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def section(url: Column) -> Column:
    """The first path segment, or (root)."""
    return F.coalesce(F.nullif(F.regexp_extract(path_of(url), "^/([^/]*)", 1), F.lit("")), F.lit("(root)"))


def request_host(url: Column) -> Column:
    """What stands between // and the next slash, port included."""
    return F.regexp_extract(url, "//([^/]*)/", 1)
