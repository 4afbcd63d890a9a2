"""Session defaults and table access shared by every query."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the engine's defaults; a cluster brings its own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("lexmill").config("spark.driver.memory", memory)
    for key, value in (DEFAULTS | {"spark.sql.shuffle.partitions": str(cpus)} | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; Spark prunes columns and pushes filters into this scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Up to so many bytes of files for each core a scan is dealt out before heavy work on its rows.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small scan dealt out to all cores, for heavy work on each row: a file of one row group is one task otherwise. Columns are pruned and filters pushed through. Larger
    scans have tasks enough and aren't shuffled; rows are the same either way."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= cores * SPREAD_BYTES else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, for functions that run in Python there. The archive is read by the
    driver's file server, as one given with --py-files would be."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lexmill-ship-")
    archive = os.path.join(folder, "lexmill.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("lexmill") / p.relative_to(root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
