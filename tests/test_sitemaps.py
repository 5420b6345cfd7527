from pyspark.sql import functions as F

from cartolens.sources import tables


def test_a_document_is_read_once_not_for_each_entry(spark):
    docs = spark.range(1).select(F.lit("m").alias("url"), F.concat(F.lit("<url><loc>https://a/"), F.col("id").cast("string"), F.lit("</loc></url>")).alias("body"))
    entries = tables.sitemap_entries(docs)
    above, below = entries._jdf.queryExecution().optimizedPlan().toString().split("Generate", 1)
    assert "RLIKE" not in above and "RLIKE" in below
    assert [tuple(r) for r in entries.collect()] == [("m", False, 0, "https://a/0")]
