"""Session settings shared by tests, the bench and interactive use."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[*]", app: str = "tarn", **more: str) -> SparkSession:
    """A session with the library's settings; ``more`` overrides them (underscores for dots)."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in more.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def settle(spark: SparkSession) -> None:
    """Turn off the partitioning that Spark 4.1 passes through unions: adaptive plans over such a union can
    fail with "Can't zip RDDs with unequal numbers of partitions" when one side was coalesced."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs inside give Python at most ``rows`` rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ship(spark: SparkSession) -> None:
    """Give Python workers on other machines this package; once for each Spark context."""
    import tempfile
    import zipfile
    from pathlib import Path

    settle(spark)
    sc = spark.sparkContext
    if getattr(sc, "_tarn_shipped", False):
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tarn-")) / "tarn.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"tarn/{p.relative_to(here)}")
    sc.addPyFile(str(path))
    sc._tarn_shipped = True
