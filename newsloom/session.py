"""Session defaults for local runs; a cluster session is used as it is.

NEWSLOOM_SHARED_DIR names the folder of intermediate tables.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(app: str = "newsloom", cores: str | None = None) -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Text work is bound by CPU, and a small table often is one split.
        .config("newsloom.scanPartitions", "16")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "100000")
        .config("spark.checkpoint.dir", os.environ.get("NEWSLOOM_SHARED_DIR") or f"{tempfile.gettempdir()}/newsloom-{os.getpid()}")
        .getOrCreate()
    )
