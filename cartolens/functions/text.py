"""Small scalar functions of reports and pages, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_html(content_type: Column) -> Column:
    return F.coalesce(content_type.rlike(r"(?i)text/html|application/xhtml"), F.lit(False))


def decode_xml(text: Column) -> Column:
    """The five named entities, the ampersand first, so an escaped entity is decoded twice."""
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def dimension(value: Column) -> Column:
    """The leading integer, else null."""
    return F.nullif(F.regexp_extract(value, r"^[\s\x{a0}]*([+-]?\d+)", 1), F.lit("")).cast("int")


def clean(text: Column, longest: int = 300) -> Column:
    """White space (no-break space too) collapsed and trimmed, then cut."""
    return F.substring(F.trim(F.regexp_replace(text, r"[\s\x{a0}]+", " ")), 1, longest)


def title(html: Column) -> Column:
    """The first title of a page; entities other than XML's stay."""
    return clean(decode_xml(F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1)))


def srcset(value: Column) -> Column:
    """The URLs of a srcset."""
    return F.filter(F.transform(F.split(value, ","), lambda s: F.get(F.split(F.trim(s), r"\s+"), 0)), lambda s: s != "")


def raw_urls(html: Column) -> Column:
    """Every absolute URL in the page source, without trailing punctuation."""
    found = F.regexp_extract_all(html, F.lit(r"https?://[^\s\"'<>()\\]+"), F.lit(0))
    return F.transform(found, lambda u: F.replace(F.regexp_replace(u, "[.,;:]+$", ""), F.lit("&amp;"), F.lit("&")))


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(F.nullif(ms, F.lit(0).cast("long")))


def backoff_ms(attempts: Column, base: int, factor: int = 1) -> Column:
    return (F.lit(base * factor) * F.pow(F.lit(2.0), attempts - 1)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.round(part * 100.0 / whole, 1))


def shorten(text: Column, n: int = 60) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def duration(ms: Column) -> Column:
    s = F.round(ms / 1000).cast("long")
    hours, minutes = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string")
    return F.when(s >= 3600, F.concat(hours, F.lit("h"), minutes, F.lit("m"))).when(s >= 60,
        F.concat(minutes, F.lit("m"), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def is_blocked(status: Column, statuses: tuple[int, ...]) -> Column:
    """Whether a status means refusal; a missing one, a network error, counts."""
    return status.isNull() | status.isin(*statuses)
