"""The crawl as data: routing of responses, scheduling of renders, request logs, breadth-first discovery, queue, health, rates."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from itertools import count
from time import monotonic

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import fixed
from ..functions.identity import in_sample
from ..functions.text import backoff_ms, is_blocked, is_html
from ..functions.urls import Scope, path_of
from ..rules import RuleSet


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, deleted when the driver ends; /tmp stands in only for a local master without
    that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:/tmp/checkpoints"
    root = f"{base.rstrip('/')}/cartolens-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return root


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def route(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``pages`` (url, http_status, content_type, final: normalised final URL, host, final_host) with ``outcome``.

    retry, http_<status>, non_html, redirected_off_host, redirect_duplicate (the final URL is another one in ``known``), ok.
    """
    status = F.col("http_status")
    if known is not None:
        names = known.select(F.col("url").alias("_known")).distinct()
        pages = pages.join(names, pages["final"] == names["_known"], "left")
        twice = F.col("_known").isNotNull() & (F.col("final") != F.col("url"))
    else:
        twice = F.lit(False)
    outcome = (
        F.when(is_blocked(status, fixed.BLOCK_STATUSES), "retry").when(status >= 400, F.concat(F.lit("http_"), status.cast("string")))
        .when(~is_html(F.col("content_type")), "non_html").when(F.col("final_host") != F.col("host"), "redirected_off_host").when(twice,
            "redirect_duplicate").otherwise("ok")
    )
    return pages.withColumn("outcome", outcome).drop("_known")


def schedule(pages: DataFrame, rules: RuleSet, rate: float, manual: Column | None = None) -> DataFrame:
    """``pages`` (url, title, hit) with tier2_reason: hit, pattern, sample, manual or none."""
    adjacent = rules.is_map_adjacent(path_of(F.col("url")), F.col("title"))
    reason = F.when(F.col("hit"), "hit").when(adjacent, "pattern").when(in_sample(F.col("url"), rate), "sample")
    if manual is not None:
        reason = reason.when(manual, "manual")
    return pages.withColumn("tier2_reason", reason.otherwise("none"))


def request_log(requests: DataFrame, most: int = 400, loose: int = 50) -> DataFrame:
    """Recorded requests (url, seq, request_url, resource_type, matched_rule) as stored.

    Unmatched ones lose query and fragment, are stored once a page and only while the page has fewer than ``most`` rows.
    Matched ones are stored once by URL without query and type, but only after a page's first ``loose`` rows.
    """
    bare = F.regexp_replace("request_url", r"[?#].*$", "")
    matched = F.col("matched_rule").isNotNull()
    key = F.when(matched, F.concat_ws("|", F.regexp_replace("request_url", r"\?.*$", ""), "resource_type")).otherwise(bare)
    by_key = Window.partitionBy("url", matched, key).orderBy("seq")
    page = Window.partitionBy("url").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    out = requests.withColumn("_n", F.row_number().over(by_key)).filter(matched | (F.col("_n") == 1))
    # while a page has few rows every matched request is stored, so its rows so far are those of the log
    out = out.withColumn("_before", F.count("*").over(page)).filter(~matched | (F.col("_n") == 1) | (F.col("_before") < loose))
    out = out.withColumn("_before", F.count("*").over(page)).filter(matched | (F.col("_before") < most))
    return out.withColumn("request_url", F.when(matched, F.col("request_url")).otherwise(bare)).drop("_n", "_before")


def add_links(frontier: DataFrame, known: DataFrame, scope: Scope, allowed: Column | None = None) -> DataFrame:
    """New URLs (url, seq, source, status, skip_reason) from links (base, href, seq): in scope, not known, first wins."""
    links = frontier.withColumn("url", scope.normalized(F.col("href"), F.col("base")))
    links = links.filter(scope.classified(F.col("url")) == "ok")
    links = links.groupBy("url").agg(F.min_by("source", "seq").alias("source"), F.min("seq").alias("seq"))
    links = links.join(known.select("url"), "url", "left_anti")
    ok = F.lit(True) if allowed is None else allowed
    return links.select("url", "seq", "source", F.when(ok, "pending").otherwise("skipped").alias("status"), F.when(~ok, "robots_disallow").alias("skip_reason"))


def capped(new: DataFrame, most: int) -> DataFrame:
    """The first ``most`` new URLs by discovery, of which those that robots.txt forbids count too."""
    return new.orderBy("seq", "url").limit(most) if new.limit(most + 1).count() > most else new


def discover(seeds: DataFrame, edges: DataFrame, max_urls: int | None = None, max_rounds: int | None = None) -> DataFrame:
    """Breadth-first search: (url, depth) of all URLs that edges (src, dst) reach from seeds (url), the nearest first.

    A round reads the newest URLs, the edges and what is known, and writes one table to the shared folder; its size comes from
    what the write counted. With ``max_urls`` the search stops when so many are known; ties of the last round go by URL, so the
    result does not depend on partitioning. It goes on until no new URL is found; a frontier left after ``max_rounds`` rounds, if
    given, is an error.
    """
    spark = seeds.sparkSession
    root = shared_dir(spark)
    edges = written(edges.select("src", "dst").distinct(), f"{root}/edges")

    def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        seen = Observation()
        return written(df.observe(seen, F.count(F.lit(1)).alias("n")), f"{root}/{name}"), seen.get["n"]

    frontier, total = counted(seeds.select("url").distinct().select("url", F.lit(0).alias("depth")), "0")
    known = frontier
    for depth in count(1):
        if max_urls is not None and total >= max_urls:
            break
        if max_rounds is not None and depth > max_rounds:
            raise ValueError(f"a frontier is left after {max_rounds} rounds")
        step = edges.join(frontier.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        frontier, n = counted(step.join(known.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth")), str(depth))
        if not n:
            break
        known, total = known.unionByName(frontier), total + n
    return known if max_urls is None or total <= max_urls else known.orderBy("depth", "url").limit(max_urls)


def breaker(statuses: DataFrame, window: int = 25, threshold: int = 8, by: str | None = None, order: str = "seq") -> DataFrame:
    """Each fetch with recent (rows in the window), blocked (refusals among them) and tripped.

    One stream in order of fetch is one task unless ``by`` (a host) parts it; streams are short next to pages.
    """
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(order).rowsBetween(1 - window, 0)
    blocked = F.sum(is_blocked(F.col("http_status"), fixed.BLOCK_STATUSES).cast("int")).over(w)
    out = statuses.withColumns({"recent": F.count("*").over(w), "blocked": blocked})
    return out.withColumn("tripped", (F.col("recent") >= min(window, threshold)) & (F.col("blocked") >= threshold))


def status_histogram(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy(F.coalesce(F.col("http_status").cast("string"), F.lit("error")).alias("status")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


def queue_state(events: DataFrame) -> DataFrame:
    """The latest state of each URL from an event log (url, seq, event, http_status, error, ts): last event wins."""
    at = F.max_by
    return events.groupBy("url").agg(at("event", "seq").alias("status"),
        at("http_status", F.when(F.col("http_status").isNotNull(), F.col("seq"))).alias("http_status"), at("error", "seq").alias("error"),
        F.count_if(F.col("event") == "in_progress").alias("attempts"), F.max("ts").alias("last_attempt_at"))


def after_failure(queue: DataFrame, max_retries: int = 3, backoff: int = 15_000, factor: int = 1) -> DataFrame:
    """Rows that just failed (attempts so far, last_attempt_at): attempts counted, failed or pending again after a backoff."""
    n = F.col("attempts") + 1
    wait = F.expr("make_interval(0, 0, 0, 0, 0, 0, _wait / 1000)")
    out = queue.withColumns({"attempts": n, "_wait": backoff_ms(n, backoff, factor).cast("decimal(18,6)")})
    out = out.withColumn("status", F.when(F.col("attempts") >= max_retries, "failed").otherwise("pending"))
    return out.withColumn("retry_after", F.when(F.col("status") == "pending", F.col("last_attempt_at") + wait)).drop("_wait")


def reset_stale(queue: DataFrame, now: Column, minutes: int = 10, everything: bool = False) -> DataFrame:
    """in_progress rows of an interrupted run are pending again: old ones, or all."""
    stale = (F.col("status") == "in_progress") & (F.lit(everything) | F.col("last_attempt_at").isNull() | (F.col("last_attempt_at") < now - F.expr(f"INTERVAL {int(minutes)} MINUTES")))
    return queue.withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))


def claim(queue: DataFrame, n: int, now: Column, tier: int | None = None, urls: list[str] | None = None) -> DataFrame:
    """The next n pending URLs that may be tried: fewest attempts, then first discovered. ``urls`` are taken whatever their turn."""
    ready = (F.col("status") == "pending") & (F.col("retry_after").isNull() | (F.col("retry_after") <= now))
    if tier == 1:
        ready &= F.col("tier1_done") == 0
    if tier == 2:
        ready &= F.col("tier2_reason").isin("hit", "pattern", "sample", "manual") & (F.col("tier2_done") == 0)
    if urls is not None:
        ready = F.col("url").isin(urls)
    return queue.filter(ready).orderBy("attempts", "seq").limit(n)


class Stopped(RuntimeError):
    """A run that ended before its work did; what was written stays, and the next run goes on from there."""


@dataclass
class Budget:
    """When a run has to stop between two steps: at a deadline, where the disk runs full, or when it is told to."""

    seconds: float | None = None
    min_free_mb: int = 0
    folder: str | None = None
    began: float = field(default_factory=monotonic)
    told: bool = False

    def stop(self, *_: object) -> None:
        """Also fit for signal.signal()."""
        self.told = True

    def reason(self, spark: SparkSession | None = None) -> str | None:
        if self.told:
            return "told to stop"
        if self.seconds is not None and monotonic() - self.began >= self.seconds:
            return "deadline"
        if self.min_free_mb and self.folder and spark is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).getStatus().getRemaining() < self.min_free_mb << 20:
                return "disk full"
        return None

    def check(self, spark: SparkSession | None = None) -> None:
        if reason := self.reason(spark):
            raise Stopped(reason)


def rate_slots(arrivals: DataFrame, interval_ms: int, host: str = "host", at: str = "t_ms") -> DataFrame:
    """When each request may start (slot_ms) if a host is asked at most every ``interval_ms``: max(arrival, last slot + interval).

    In closed form: slot_i = i * interval + max over j <= i of (arrival_j - j * interval), a running maximum.
    """
    w = Window.partitionBy(host).orderBy(at, "seq")
    i = F.row_number().over(w) - 1
    out = arrivals.withColumn("_i", i.cast("long"))
    ahead = F.max(F.col(at) - F.col("_i") * interval_ms).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("slot_ms", F.col("_i") * interval_ms + ahead).drop("_i")


def projection(done: Column, total: Column, elapsed_ms: Column) -> Column:
    """Milliseconds that the rest will take at the pace so far; null before anything is done."""
    return F.when(done > 0, (elapsed_ms / done * (total - done)).cast("long"))


QUEUE = T.StructType().add("url", "string").add("seq", "long").add("source", "string").add("status", "string").add("skip_reason", "string")
