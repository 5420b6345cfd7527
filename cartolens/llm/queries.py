"""The queries of this subpackage and their SQL, for the repository's entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the mix of its sources by tempered weights."""
    from . import mixing

    return mixing.mixed(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as PNG, read back and hashed."""
    from . import media

    return media.media_features(media.with_media(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every whole text; labels of one fold in five are held out."""
    from . import quality

    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return quality.scores(docs, model, fold(F.col("doc_id"), 5) == 0)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text; one fold in three is held out."""
    from . import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold(F.col("doc_id"), 3) != 1)
    return langid.predictions(docs, model, fold(F.col("doc_id"), 3) == 1)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of texts that are near in their five-word shingles."""
    from . import ngram_join

    return ngram_join.join(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every whole text and of its edited text."""
    from . import merkle

    return merkle.edit_report(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every whole text; labels of one fold in four are held out."""
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return toxicity.scores(docs, index, fold(F.col("doc_id"), 4) == 2)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a license template, with where and how much of it."""
    from . import licenses

    return licenses.report(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines of repeated three-line windows."""
    from . import linededup

    return linededup.report(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded by the 50k byte-level ranks and decoded again."""
    import public_tokenizers

    from . import bpe

    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f) and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import licenses, linededup

    return {"op9_licenses": licenses.sql(), "op10_line_dedup": linededup.SQL}
