"""The same expressions over a stream of files; the check across files is in ``review``.

Rules, checks and dedup of one file need no state: a file is one row.  State is kept only for
running counts (one row per severity or language) and, where files may arrive again, for
dedup within a watermark on their arrival time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulint.operators.combine import FINDING_KEY
from rivulint.plans.profiles import audit, review_checks, scan
from rivulint.session import shared_dir

CORPUS_SCHEMA = "path string, content string, read_error string"
# Bytes of a row group in files written for a stream.
ROW_GROUP = 8 << 20


def corpus_stream(
    spark: SparkSession, folder: str, schema: str = CORPUS_SCHEMA, files_per_trigger: int = 1000,
    **options: str,
) -> DataFrame:
    """New parquet files of a folder as they appear."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .options(**options).parquet(folder)
    )


def table_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table as a stream, whether it is one file or a folder of part files."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getFileStatus(place).isDirectory():
        return corpus_stream(spark, path, schema)
    # A stream reads folders: that of the file, narrowed to its name.
    return corpus_stream(spark, str(place.getParent()), schema, pathGlobFilter=place.getName())


def write_arriving(files: DataFrame, folder: str) -> None:
    """Files for ``corpus_stream``, in row groups small enough that one file is read by several
    tasks: a batch has few files, and would else keep as few cores busy."""
    files.write.option("parquet.block.size", ROW_GROUP).parquet(folder)


def streamed_findings(files: DataFrame) -> DataFrame:
    """Findings as files arrive; an unreadable file is a finding and ends nothing."""
    return scan(files)


def streamed_audit(files: DataFrame) -> DataFrame:
    """Findings of the case-sensitive line rules as files arrive."""
    return audit(files)


def streamed_checks(files: DataFrame) -> DataFrame:
    """Findings of the whole-file checks as files arrive, without any state.

    The check across files needs them all; ``streaming.review`` keeps what that takes.
    """
    return review_checks(files)


def running_counts(findings: DataFrame, column: str) -> DataFrame:
    return findings.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def once_per_key(findings: DataFrame) -> DataFrame:
    """One finding per key for the whole life of the stream; the state grows with them."""
    return findings.dropDuplicates(FINDING_KEY)


def once_per_file(files: DataFrame, arrived: str, delay: str = "1 hour") -> DataFrame:
    """Let a path pass once within a delay on its arrival time: bounded state for endless
    feeds.  Within one file findings are already unique."""
    return files.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(["path"])


def drain_to_store(stream: DataFrame, purpose: str = "stream", mode: str = "append",
                   out: str | None = None) -> str:
    """Run what is available through to a parquet folder on shared storage; its path.

    Append goes to the exactly-once file sink; complete results are written over by each
    batch.  A stream without any data runs no batch and leaves an empty folder.
    """
    spark = stream.sparkSession
    base = shared_dir(spark, purpose)
    out = out or f"{base}/out"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option(
        "checkpointLocation", f"{base}/state"
    )
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        query = writer.foreachBatch(replace).start()
    query.awaitTermination()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    return out


def drained(stream: DataFrame, purpose: str = "stream", mode: str = "append") -> DataFrame:
    out = drain_to_store(stream, purpose, mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
