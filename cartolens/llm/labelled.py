"""A bounded, deterministic sample of labelled rows, for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty


def sample(labels: DataFrame, target: str, allowed: Column, per_class: int) -> tuple[DataFrame | None, dict[int, int]]:
    """Labelled ids (doc_id, y) and the class sizes among all labelled rows.

    At most ``per_class`` ids of each class 0 and 1, those with the least hash of their id, so the result does not depend on
    partitioning. Null ids or labels don't count; of repeated ids the largest label counts. None if no row qualifies.
    """
    known = labels.select("doc_id", F.col(target).cast("int").alias("y")).filter(allowed & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None, {}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.filter(F.col("y") == y).orderBy(*order).limit(per_class) for y in sorted(sizes)]
    return (picked[0] if len(picked) == 1 else picked[0].unionByName(picked[1])), sizes


def texts(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """(doc_id, y, text) of the picked ids, one row an id: of repeated ids the text of least hash, whatever the partitioning."""
    found = docs.select("doc_id", text_or_empty(F.col("text")).alias("text")).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
