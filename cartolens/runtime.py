"""Sending this package to the executors' Python workers."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Bounds of what passes to a Python worker at a time: pages and texts may be long.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def _bytes(value: str) -> int:
    """A number, or a size as Spark writes it (16m, 1048576b)."""
    number = value.lower().rstrip("b")
    return int(number[:-1]) << {"k": 10, "m": 20, "g": 30}[number[-1]] if number[-1:] in ("k", "m", "g") else int(number)


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package's sources to the session's Python files, once for each application, so workers can import it.

    Besides it bounds the session's Arrow batches, by rows and bytes, unless they are smaller already.
    """
    sc = spark.sparkContext
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = _bytes(spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    if sc.applicationId not in _shipped:
        top = Path(__file__).parent
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent).as_posix())
        path = Path(tempfile.mkdtemp(prefix="cartolens-")) / "cartolens.zip"
        path.write_bytes(body.getvalue())
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)
    return spark
