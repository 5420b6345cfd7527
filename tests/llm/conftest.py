import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir",
            f"file:{tmp_path_factory.mktemp('checkpoints')}").getOrCreate()
    )


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs or whole rows."""

    def make(rows, schema=SCHEMA):
        full = [(*r, "en", "s", len(r[1] or "")) if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(full, schema)

    return make
