"""What the operators of this subpackage share: tables, the shared folder, row keys, Arrow helpers."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; any path Spark reads will do."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share; it is deleted when the driver ends.

    Only where that setting is absent and the master is local (as in tests) a folder under /tmp stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:/tmp/checkpoints"
    root = f"{base.rstrip('/')}/cartolens-{uuid.uuid4().hex}"
    fs, path = _hadoop(spark, root)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return root


def _hadoop(spark: SparkSession, name: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def removed(spark: SparkSession, root: str, *keep: str) -> None:
    """Deletes what was written under ``root`` but for the names to keep, which go when the driver ends."""
    fs, path = _hadoop(spark, root)
    for entry in fs.listStatus(path):
        if entry.getPath().getName() not in keep:
            fs.delete(entry.getPath(), True)


def written(df: DataFrame, root: str, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{root}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> DataFrame:
    """One column ``row`` with all columns of ``df``: whatever their names, they clash with nothing that is joined to it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, columns: list[str], **replaced: Column) -> list[Column]:
    """The columns of a packed row under their names, some replaced."""
    return [replaced[c].alias(c) if c in replaced else F.col(f"row.`{c}`").alias(c) for c in columns]


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal id, modulo ``folds``; a null id counts as the empty string."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def raw(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text, b'' for null."""
    return [x or b"" for x in texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()]


def structs(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.StructArray:
    columns = list(zip(*rows, strict=True)) or [() for _ in fields]
    return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])
