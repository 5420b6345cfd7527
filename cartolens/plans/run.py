"""Whole runs over a folder of crawl tables: discovery and static detection, fusion, cross-reference, report.

The folder holds what acquisition recorded, as Parquet: pages (url, http_status, content_type, final_url, html; seq, source
if known), and if there are any observations, requests, items, lookups, key_responses, loads, statuses. Fetching and
rendering themselves are outside Spark. Each step writes its tables beside them and can be run again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import load
from ..functions.urls import Scope, host
from ..operators import crawl, detect, fuse, store
from ..rules import RuleSet, compile_rules, default_rules
from ..runtime import ship
from ..sources import robots, tables
from . import export, preflight, report, xref

RUN = "command string, started_at timestamp, finished_at timestamp, result string, config_json string"


@dataclass
class Crawl:
    """A crawl folder with its configuration, rules and, if given, the text of robots.txt."""

    spark: SparkSession
    folder: str
    cfg: dict[str, Any]
    rules: RuleSet
    robots_txt: str = ""

    @classmethod
    def open(cls, spark: SparkSession, folder: str, config: dict | str | None = None, rules: dict | None = None, robots_txt: str = "", **overrides: Any) -> Crawl:
        cfg = load(config, **overrides)
        vendors = cfg["detection"]["vendors"]
        made = compile_rules(rules, vendors) if rules else default_rules(cfg["scope"].get("domain") or "", cfg["scope"].get("portal") or "", vendors)
        return cls(ship(spark), folder.rstrip("/"), cfg, made, robots_txt)

    @property
    def scope(self) -> Scope:
        return Scope.of(self.cfg)

    def has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.parquet")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}.parquet")
        return self.read(name)

    # steps
    def pages(self) -> DataFrame:
        """The recorded pages, one row a URL (the last by seq), with what may be missing filled in."""
        pages = self.read("pages")
        if "seq" not in pages.columns:
            pages = pages.withColumn("seq", F.xxhash64("url").bitwiseAND((1 << 62) - 1))
        for name, value in (("source", "crawl"), ("final_url", None)):
            if name not in pages.columns:
                pages = pages.withColumn(name, F.lit(value).cast("string"))
        return store.latest_wins(pages, ["url"], [F.col("seq"), F.xxhash64("html"), F.col("http_status")]) if self.repeats(pages) else pages

    @staticmethod
    def repeats(pages: DataFrame) -> bool:
        """Whether a URL stands in two rows; then, and only then, pages are worth a shuffle."""
        return bool(pages.groupBy("url").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count())

    def robots(self) -> robots.Robots:
        return robots.parse(self.robots_txt, self.cfg["http"]["user_agent_token"])

    def sitemaps(self) -> DataFrame | None:
        """(loc, sitemap) of the recorded sitemap documents, from those of the configuration and of robots.txt on."""
        if not self.has("sitemaps"):
            return None
        seeds = self.cfg["seeds"]
        return tables.expand_sitemaps(self.read("sitemaps"), tables.sitemap_starts(seeds["sitemaps"] or [], self.robots().sitemaps, seeds["homepage"]))

    def inventory(self, crawl_links: bool | None = None) -> DataFrame:
        """Routes pages, detects on those that are pages, finds links and sitemap URLs: writes detected, tier1, frontier, queue."""
        pages, inv = self.pages(), self.cfg["inventory"]
        scope, r = self.scope, self.robots()
        pages = pages.withColumn("final", scope.normalized(F.coalesce("final_url", "url")))
        pages = pages.withColumns({"host": host(F.col("url")), "final_host": host(F.col("final"))})
        routed = crawl.route(pages, pages.select("url"))
        fit = routed.filter("outcome = 'ok'").select("url", "html", "seq")
        seen = self.write(detect.detect_pages(fit, self.rules, keep=["seq"]), "detected")
        found = detect.policy(detect.findings_of(seen, 1, ["seq"]), self.cfg["detection"]["record_links"])
        self.write(found, "tier1")
        links = detect.links_of(seen, [F.col("seq").alias("at")])
        links = links.select(F.col("page").alias("base"), "href", F.lit("crawl").alias("source"), F.struct(F.lit(1).alias("kind"), "at", "place").alias("seq"))
        if not (inv["bfs_link_crawl"] if crawl_links is None else crawl_links):
            links = links.limit(0)
        if (listed := self.sitemaps()) is not None:
            first = F.struct(F.lit(0).alias("kind"), F.xxhash64("loc").alias("at"), F.lit(0).alias("place"))
            links = links.unionByName(listed.select(F.lit(None).cast("string").alias("base"), F.col("loc").alias("href"),
                F.lit("sitemap").alias("source"), first.alias("seq")))
        path = F.regexp_extract("url", "://[^/?#]+([^#]*)", 1)
        new = crawl.add_links(links, pages.select("url"), scope, r.allowed(path))
        self.write(crawl.capped(new, max(0, inv["max_urls"] - pages.count())), "frontier")
        hit = detect.is_hit(F.col("findings"), self.cfg["detection"]["links_trigger_render"])
        reasons = crawl.schedule(seen.select("url", "title", hit.alias("hit")), self.rules, self.cfg["scan"]["tier2_sample_rate"])
        queue = routed.select("url", "seq", "source", "http_status", "outcome").join(reasons, "url", "left")
        done = F.col("outcome") == "ok"
        status = F.when(done & (F.col("tier2_reason") == "none"), "done").when(done | (F.col("outcome") == "retry"), "pending").otherwise("skipped")
        queue = queue.withColumns({"status": status, "skip_reason": F.when(status == "skipped", F.col("outcome")), "tier1_done": done.cast("int"),
            "tier2_done": F.lit(0), "tier1_hit": F.coalesce(F.col("hit"), F.lit(False)).cast("int"), "tier2_hit": F.lit(0),
            "error": F.when(F.col("outcome") == "retry", F.concat(F.lit("HTTP "), F.coalesce(F.col("http_status").cast("string"), F.lit("error")))),
            "attempts": F.lit(1)})
        return self.write(queue.drop("outcome", "hit"), "queue")

    def due(self, limit: int | None = None, urls: list[str] | None = None) -> DataFrame:
        """(url, seq) of pages to render: those scheduled, the first ``limit`` of those not rendered yet, or the ones asked for."""
        queue = self.queue()
        if urls is not None:
            return queue.filter(F.col("url").isin(urls)).select("url", "seq")
        due = queue.filter(F.col("tier2_reason").isin("hit", "pattern", "sample", "manual"))
        return (due if limit is None else due.filter("tier2_done = 0").orderBy("attempts", "seq").limit(limit)).select("url", "seq")

    def scan(self, limit: int | None = None, urls: list[str] | None = None) -> DataFrame:
        """Fuses recorded observations of pages that are due: writes tier2, requests as stored and rendered (pages that have been
        fused). What earlier scans found on other pages stays; pages scanned again replace their findings and requests."""
        if not self.has("observations"):
            return self.read("queue").limit(0).select("url", F.lit(0).alias("hit"))
        due = self.due(limit, urls)
        seen = self.read("observations").join(due.select("url"), "url", "left_semi")
        log = crawl.request_log(self.read("requests"), self.cfg["scan"]["max_requests_per_page"])
        fused = fuse.fuse_pages(seen, log, self.rules, self.read("tier1")).join(due, "url")
        found = detect.policy(detect.findings_of(fused, 2, ["seq"]), self.cfg["detection"]["record_links"])
        hits = F.exists("findings", lambda f: (f["placement"] != "site_chrome") & (f["type"] != "map_link_only"))
        rendered = fused.select("url", hits.cast("int").alias("hit"))
        new = {"tier2": found, "rendered": rendered, "request_log": log.join(due.select("url"), "url", "left_semi")}
        if limit is not None or urls is not None:
            again = crawl.written(rendered.select("url"), f"{crawl.shared_dir(self.spark)}/again")
            new = {name: store.replace_requests(self.read(name), df, again) if self.has(name) else df for name, df in new.items()}
        done = {name: crawl.written(df, f"{crawl.shared_dir(self.spark)}/{name}") for name, df in new.items()}
        return [self.write(df, name) for name, df in done.items()][1]

    def reset(self, minutes: int | None = None) -> DataFrame:
        """The queue with rows that an interrupted run left in progress pending again: those older than ``minutes``, or all."""
        queue = self.read("queue")
        if "last_attempt_at" not in queue.columns:
            queue = queue.withColumn("last_attempt_at", F.lit(None).cast("timestamp"))
        fresh = crawl.reset_stale(queue, F.current_timestamp(), minutes or 0, minutes is None)
        return self.write(crawl.written(fresh, f"{crawl.shared_dir(self.spark)}/queue"), "queue")

    def findings(self) -> DataFrame:
        one = self.read("tier1")
        return one.unionByName(self.read("tier2")) if self.has("tier2") else one

    def queue(self) -> DataFrame:
        queue = self.read("queue")
        if not self.has("rendered"):
            return queue
        seen = self.read("rendered")
        out = queue.drop("tier2_hit", "tier2_done").join(seen, "url", "left")
        out = out.withColumns({"tier2_done": F.col("hit").isNotNull().cast("int"), "tier2_hit": F.coalesce("hit", F.lit(0))}).drop("hit")
        return out.withColumn("status", F.when(F.col("tier2_done") == 1, "done").otherwise(F.col("status")))

    def arcgis(self, apps: DataFrame, org_id: str) -> DataFrame:
        return xref.cross_reference(apps, self.read("items"), self.read("lookups"), org_id)

    def preflight(self, n: int = 12) -> tuple[DataFrame, DataFrame | None]:
        """The pages to sample, and the verdict if their loads have been recorded."""
        sample = preflight.stratified(preflight.candidates(self.read("queue").filter("status <> 'skipped'").select("url",
            "seq") if self.has("queue") else None, self.sitemaps(), self.spark), n, self.cfg["seeds"]["homepage"])
        return sample, preflight.verdict(self.read("loads")) if self.has("loads") else None

    def consent(self, verdict: str | None = None) -> bool:
        """Whether pages are to be loaded with consent: as configured, or as the verdict of the preflight says."""
        return tables.consent_mode(self.spark, self.cfg["scan"]["consent"], verdict)

    def screenshots(self) -> DataFrame:
        """(identity_key, url, container_selector, name): where each application that is no link can be captured, at its first page."""
        own = store.exemplars(store.supersede(self.findings())).filter("placement = 'main_content' AND type <> 'map_link_only'")
        first = own.groupBy("identity_key").agg(F.min_by(F.struct("url", "container_selector"), F.struct(*store.ORDER)).alias("f"))
        return first.select("identity_key", "f.*", F.concat(F.substring(F.sha1("identity_key"), 1, 16), F.lit(".jpg")).alias("name"))

    def report(self, out: str, org_id: str | None = None, probe: bool | None = None) -> dict[str, DataFrame]:
        """All tables of the report; writes applications.csv, occurrences.csv, findings.jsonl, summary.json, report.html to ``out``."""
        vendors = self.cfg["report"]["vendors"]
        stored, apps, presence = store.inventory(self.findings())
        stored, presence = self.write(stored, "findings"), self.write(presence, "chrome")
        apps = self.write(self.arcgis(apps, org_id) if org_id and self.has("items") else apps, "applications")
        queue = self.queue()
        table = report.applications_report(apps, stored, presence, vendors)
        occ = report.occurrences(stored, apps, self.read("detected"), vendors, self.cfg["report"]["include_chrome_occurrences"])
        probe = self.cfg["report"]["probe_api_keys"] if probe is None else probe
        keys = report.api_keys(stored, self.read("key_responses") if probe and self.has("key_responses") else None, vendors)
        made = {"applications": table, "occurrences": occ, "findings": stored, "keys": keys, "coverage": report.coverage(queue, stored),
            "totals": report.totals(table, occ, stored, vendors), "buckets": report.buckets(table, self.cfg["scope"].get("domain") or "^$")}
        if org_id and self.has("items"):
            made["orphaned"] = report.orphaned(self.read("items"), apps, org_id)
        export.write_applications(table, out)
        export.write_occurrences(occ, out)
        export.write_findings(stored, out, vendors)
        export.write_keys(keys, out)
        export.write_text(self.spark, out, "summary.json", export.summary(made["totals"], made["coverage"], made["buckets"], keys))
        export.write_text(self.spark, out, "report.html", export.page(table, made["totals"], made["coverage"], keys, made["buckets"]))
        return made

    @contextmanager
    def logged(self, command: str) -> Iterator[None]:
        """Notes a command in the table runs: when it began and ended, and how."""
        began, result = datetime.now(UTC), "done"
        try:
            yield
        except BaseException as e:
            result = f"{type(e).__name__}: {e}"[:500]
            raise
        finally:
            row = self.spark.createDataFrame([(command, began, datetime.now(UTC), result, json.dumps(self.cfg, default=str))], RUN)
            row.coalesce(1).write.mode("append").parquet(f"{self.folder}/runs.parquet")

    def runs(self, most: int = 3) -> DataFrame:
        """The last commands."""
        runs = self.read("runs") if self.has("runs") else self.spark.createDataFrame([], RUN)
        return runs.select("command", "started_at", "finished_at", "result").orderBy(F.desc("started_at")).limit(most)

    def status(self) -> dict[str, DataFrame]:
        queue = self.queue()
        if "last_attempt_at" not in queue.columns:
            queue = queue.withColumn("last_attempt_at", F.lit(None).cast("timestamp"))
        free = crawl.Budget(min_free_mb=self.cfg["storage"]["min_free_disk_mb"], folder=self.folder).reason(self.spark)
        flags = self.spark.createDataFrame([("blocked", self.blocked()), ("disk", free is not None)], "flag string, up boolean")
        return {**report.status(queue, self.read("pages"), self.read("pages")), "flags": flags, "runs": self.runs(), "failed": report.failed_urls(queue)}

    def blocked(self) -> bool:
        """Whether recorded fetches (host, seq, http_status) ever tripped the circuit breaker."""
        if not self.has("statuses"):
            return False
        h = self.cfg["http"]
        return bool(crawl.breaker(self.read("statuses"), h["block_window"], h["block_threshold"], "host").filter("tripped").limit(1).count())

    def run(self, out: str, org_id: str | None = None, budget: crawl.Budget | None = None, limit: int | None = None) -> dict[str, DataFrame]:
        """inventory, scan, cross-reference and report in turn; a refused crawl, a full disk, a deadline or a signal stop it between
        two steps, and the next run goes on with what is written."""
        budget = budget or crawl.Budget(min_free_mb=self.cfg["storage"]["min_free_disk_mb"], folder=self.folder)
        budget.check(self.spark)
        self.inventory()
        if self.blocked():
            raise crawl.Stopped("the crawl was refused: see statuses")
        budget.check(self.spark)
        self.scan(limit)
        budget.check(self.spark)
        return self.report(out, org_id)
