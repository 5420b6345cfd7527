"""A training corpus from ``documents``: quality, line dedup, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs; all but the last return the columns of documents, and further ones that docs have, whatever their names.

In every stage a null text counts as an empty one and stays null, a null id, lang or source is a value of its own, very long texts
are read whole, repeated rows get the same result (each row stays a row, but for near duplicates of another id), and an empty table
gives an empty table. Ties are said with each stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolens.llm import bpe, linededup, mixing, ngram_join, quality
from cartolens.llm.common import shared_dir, table, text_or_empty, written
from cartolens.runtime import ship

#: The stages learn from and depend on tables and a tokenizer that SQL cannot express.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, rejects (a score under 0.3) go.

    Equal texts get equal scores; without labels every score is 0.5, and all documents stay."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go; so do documents of which they leave nothing.

    Of equal windows the one of the least id, then of the least text hash, then the first stays. Null and empty texts, and texts of
    fewer than three lines, have no window and stay."""
    clean = linededup.dedup(docs)
    return clean.filter((F.col("n_removed") == 0) | (F.col("text") != "")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays.

    Rows that repeat that id stay with it; documents without words (null, empty, blank texts) and rows without id stay."""
    return ngram_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix of their sources by tempered weights.

    Within a source documents go by a hash of id and text; equal rows are interchangeable."""
    return mixing.in_order(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, whole (decoding gives the text back), and file and row: the place in the mix.

    The mix is the order of the files' names and of the rows in them; docs that come from no files have null places. Null and
    empty texts have no tokens."""
    import public_tokenizers

    ship(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    text = text_or_empty(F.col("text"))
    try:
        docs = docs.withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    except AnalysisException:
        docs = docs.withColumns({"_file": F.lit(None).cast("string"), "_row": F.lit(None).cast("long")})
    coded = docs.withColumn("_text", text).withColumn("ids", bpe.encoder(ranks, pattern)(F.col("_text")))
    decoded = bpe.decoder(ranks, pattern)(F.col("ids"))
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (decoded == F.col("_text").cast("binary")).alias("whole"),
        F.col("_file").alias("file"), F.col("_row").alias("row"),
    )


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("mixing", mixing_stage), ("tokens", token_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written to the shared folder."""
    root, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), root, name)
    return STAGES[-1][1](spark, docs, sf_dir)
