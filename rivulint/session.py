"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


# For a cluster and a corpus of large files: few rows per columnar batch, so that a batch of
# whole files fits in memory, and adaptive splitting of skewed join partitions.
SCALE_SETTINGS = {
    "spark.sql.parquet.columnarReaderBatchSize": "256",
    "spark.sql.files.maxPartitionBytes": "64m",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


# Into how many partitions a corpus derived from a table is dealt; unset: as the table is read.
# For small tables, whose single row group would be a single task.
CORPUS_PARTITIONS = "spark.rivulint.corpus.partitions"


def build_session(app: str = "rivulint", cores: str = "*") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config(CORPUS_PARTITIONS, "8" if cores == "*" else cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one the cluster names in ``spark.checkpoint.dir``.

    A local session without that setting uses a temporary folder; on a cluster the setting is
    required, because each executor would write to a disk of its own.  The folder is removed
    when the session's JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    folder = os.path.join(base, f"rivulint-{purpose}-{uuid.uuid4().hex}")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder
