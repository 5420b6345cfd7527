"""Sinks: CSV, JSON lines, a summary, an HTML page. Tables are written by Spark; only small aggregates reach the driver."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from .report import APPLICATION_COLUMNS, OCCURRENCE_COLUMNS


def csv_lines(df: DataFrame, columns: list[str]) -> Column:
    """A row's CSV line: quoted only where needed, quotes doubled, nulls empty."""
    text = lambda c: F.col(c).cast("string")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(text(c), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *[F.when(text(c).rlike('[",\n\r]'), quoted(c)).otherwise(F.coalesce(text(c), F.lit(""))) for c in columns])


def merged(lines: DataFrame, path: str, header: str | None = None) -> None:
    """One text file from rows (value) in order. Tasks write their parts; the driver puts them one after the other as bytes, so
    neither a task nor the driver ever holds the table."""
    spark = lines.sparkSession
    lines.write.mode("overwrite").text(f"{path}.parts")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, parts = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.parts"))
    fs = target.getFileSystem(conf)
    fs.delete(target, True)
    out = fs.create(target, True)
    try:
        if header is not None:
            out.write(bytearray(f"{header}\n".encode()))
        for name in sorted(x.getPath().getName() for x in fs.listStatus(parts) if x.getPath().getName().startswith("part-")):
            part = fs.open(jvm.org.apache.hadoop.fs.Path(parts, name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
    finally:
        out.close()
    fs.delete(parts, True)


def write_csv(df: DataFrame, path: str, columns: list[str], order: list) -> None:
    """A CSV file with a header, LF, rows in order."""
    merged(df.orderBy(*order).select(csv_lines(df, columns).alias("value")), path, ",".join(columns))


def write_jsonl(df: DataFrame, path: str, order: list) -> None:
    """A file of JSON lines in order, nulls included."""
    merged(df.orderBy(*order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")), path)


def write_applications(report: DataFrame, folder: str) -> None:
    write_csv(report, f"{folder}/applications.csv", APPLICATION_COLUMNS, [F.desc("occurrence_count"), "identity_key"])


def write_occurrences(occ: DataFrame, folder: str) -> None:
    write_csv(occ, f"{folder}/occurrences.csv", OCCURRENCE_COLUMNS, ["identity_key", "page_url"])


def write_findings(findings: DataFrame, folder: str, vendors: list[str] | None = None) -> None:
    """findings.jsonl, and with a vendor filter findings-all-vendors.jsonl too."""
    order = ["seq", "tier", "place"]
    if vendors:
        write_jsonl(findings, f"{folder}/findings-all-vendors.jsonl", order)
        findings = findings.filter(F.lower("vendor").isin(*[v.lower() for v in vendors]))
    write_jsonl(findings, f"{folder}/findings.jsonl", order)


def write_keys(keys: DataFrame, folder: str) -> None:
    """All API keys, as JSON lines."""
    write_jsonl(keys, f"{folder}/keys.jsonl", ["api_key", "vendor"])


def as_dict(metrics: DataFrame) -> dict[str, int]:
    return {r["metric"]: r["value"] for r in metrics.collect()}


def summary(totals: DataFrame, coverage: DataFrame, buckets: DataFrame, keys: DataFrame, most_keys: int = 1000) -> str:
    """The report's numbers; of keys the first ``most_keys`` and how many there are. All keys are in keys.jsonl."""
    arcgis = {r["bucket"]: r["count"] for r in buckets.groupBy("bucket").count().collect()}
    return json.dumps({"totals": as_dict(totals), "coverage": as_dict(coverage), "arcgis": arcgis, "keys_total": keys.count(),
        "keys": [r.asDict() for r in keys.orderBy("api_key").limit(most_keys).collect()]}, indent=2, default=str)


def page(report: DataFrame, totals: DataFrame, coverage: DataFrame, keys: DataFrame, buckets: DataFrame | None = None,
    heading: str = "Map applications", most: int = 2000) -> str:
    """The report as HTML: figures, counts by vendor, kind and type, ArcGIS buckets, applications, those of the site's navigation,
    keys, and a gallery of screenshots. Lists show at most ``most`` rows; the CSV files are whole."""
    esc = lambda x: html.escape("" if x is None else str(x))

    def section(title: str, df: DataFrame, columns: list[str]) -> str:
        body = "".join("<tr>" + "".join(f"<td>{esc(r[c])}</td>" for c in columns) + "</tr>" for r in df.select(*columns).limit(most).collect())
        return f"<h2>{esc(title)}</h2><table><tr>{''.join(f'<th>{esc(c)}</th>' for c in columns)}</tr>{body}</table>" if body else ""

    by = lambda c: report.groupBy(c).agg(F.count("*").alias("applications")).orderBy(F.desc("applications"), c)
    listed = report.orderBy(F.desc("occurrence_count"), "identity_key")
    columns = ["identity_key", "vendor", "app_kind", "type", "occurrence_count", "placement_summary", "example_url"]
    chrome = F.col("placement_summary") == fixed.SUMMARY["chrome"]
    cards = "".join(f"<li><b>{v:,}</b> {esc(k.replace('_', ' '))}</li>" for k, v in {**as_dict(totals), **as_dict(coverage)}.items())
    notice = "<p>A page without findings is unknown, not free of maps: only what static rules or rendering saw is listed.</p>"
    parts = [section(f"By {name}", by(c), [c, "applications"]) for name, c in (("vendor", "vendor"), ("kind", "app_kind"), ("type", "type"))]
    if buckets is not None:
        parts.append(section("ArcGIS", buckets.groupBy("bucket").agg(F.count("*").alias("applications")).orderBy("bucket"), ["bucket", "applications"]))
    parts += [section("Applications", listed.filter(~chrome), columns), section("Site-wide", listed.filter(chrome), columns),
        section("Keys", keys.orderBy("api_key"), ["api_key", "vendor", "pages", "restriction"])]
    shots = listed.filter("screenshot_path IS NOT NULL").select("identity_key", "screenshot_path").limit(most).collect()
    gallery = "".join(f'<figure><img loading=lazy src="{esc(r[1])}"><figcaption>{esc(r[0])}</figcaption></figure>' for r in shots)
    return f"<!doctype html><meta charset=utf-8><title>{esc(heading)}</title><h1>{esc(heading)}</h1>{notice}<ul>{cards}</ul>{''.join(parts)}{'<h2>Gallery</h2>' + gallery if gallery else ''}"


def write_text(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A small file of the driver, in any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
