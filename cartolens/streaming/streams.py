"""Structured Streaming forms: pages to findings as they arrive, new applications once, a circuit breaker for each host."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import fixed
from ..operators.detect import PAGE, detect_pages, findings_of
from ..operators.store import latest_wins
from ..rules import RuleSet

DETECTED = T.StructType([*PAGE.fields, T.StructField("seq", T.LongType()), T.StructField("batch", T.LongType())])


def page_stream(spark: SparkSession, folder: str, schema: str = "url string, html string, seq long", files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def findings_stream(pages: DataFrame, rules: RuleSet) -> DataFrame:
    """Findings of each page as it arrives; stateless."""
    return findings_of(detect_pages(pages, rules), 1)


def new_applications(findings: DataFrame) -> DataFrame:
    """The first finding of each identity, announced once for good: the state is one key an application, not a page."""
    return findings.dropDuplicates(["identity_key"])


def ingest(pages: DataFrame, rules: RuleSet, out: str, checkpoint: str) -> Any:
    """Detects on all pages there are and stores what each one shows now, exactly once; starts again where it stopped.

    A batch is a folder of its own, written over if it is run again; a page scanned again is in a later batch, which current()
    takes instead, also where the page has no findings any more."""

    def upsert(batch: DataFrame, number: int) -> None:
        one = latest_wins(batch, ["url"], [F.col("seq"), F.xxhash64("html")])
        detect_pages(one, rules, keep=["seq"]).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    return pages.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The findings of each page's last scan, as of findings_of()."""
    scans = spark.read.option("basePath", out).schema(DETECTED).parquet(out)
    last = scans.groupBy("url").agg(F.max_by(F.struct("findings", "seq"), "batch").alias("s")).select("url", "s.*")
    return findings_of(last, 1, ["seq"])


def breaker_stream(statuses: DataFrame, window: int = 25, threshold: int = 8) -> DataFrame:
    """Of (host, seq, http_status): host, seq, blocked, tripped for every fetch. State: the last ``window`` statuses of a host."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent: list[bool] = list(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, code in zip(rows["seq"], rows["http_status"], strict=True):
            recent = [*recent, bool(pd.isna(code) or int(code) in fixed.BLOCK_STATUSES)][-window:]
            blocked = sum(recent)
            out.append((key[0], int(seq), blocked, len(recent) >= min(window, threshold) and blocked >= threshold))
        state.update((recent,))
        yield pd.DataFrame(out, columns=["host", "seq", "blocked", "tripped"])

    slim = statuses.select("host", "seq", F.col("http_status").cast("int").alias("http_status"))
    return slim.groupBy("host").applyInPandasWithState(step, "host string, seq long, blocked int, tripped boolean", "recent array<boolean>", "append",
        GroupStateTimeout.NoTimeout)
