"""Session factory and checkpoint-folder handling."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def get_session(app: str = "tracelens", cpus: int | str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session instead."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or "8"
    n = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TRACELENS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bounded_batches(spark: SparkSession, rows: int = 512, size: int = 4 << 20) -> None:
    """Bound an Arrow batch by rows and bytes: 10,000 chats in one, which is Spark's default, are tens of MB of text and
    many times that as tokens. Spark reads these settings when the plan runs, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; make a local one only where it is unset (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not shared:
        shared = tempfile.mkdtemp(prefix="tracelens-ckpt-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)
