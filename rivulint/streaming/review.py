"""The review of a stream of files, kept in a table of hits by batch.

Every batch is checked in one narrow pass and written to a folder of its own, named by the
batch's number and written over if the batch is run again, so that each file counts once
however often a batch is replayed.  The folder holds check hits, function definitions, line counts
and read errors.  Whatever needs all files (the check across files, the summary) starts from
that table.

A path that arrives in a later batch replaces what was there: only the rows of a path's last batch
count.  Within a batch paths are different.

For every batch the names whose set of files it may have changed get their findings of the
check across files anew, in a feed of their own that is idempotent likewise; a name that is no
longer shared leaves a row without findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulint.operators.context import likely_among
from rivulint.operators.duplicates import shared_name_findings, written
from rivulint.operators.errors import review_read_errors
from rivulint.plans.profiles import Reviewed, definitions_of, review_hits, reviewed
from rivulint.schema import FINDING_FIELDS
from rivulint.session import shared_dir

HIT_SCHEMA = (
    "path string, n_lines long, rule_id string, line int, match_no int, word string, "
    "severity string, snippet string, read_error string, batch long"
)
UPDATE_SCHEMA = "name string, batch long, " + ", ".join(
    f"{name} {kind}" for name, kind in FINDING_FIELDS.items())


class ReviewStore:
    """Hits and updates of a reviewed stream below one folder of shared storage."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.hits_path, self.updates_path = (
            spark, f"{folder}/hits", f"{folder}/updates")

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(
            self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _read(self, path: str, schema: str) -> DataFrame:
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def hits(self, before: int | None = None, paths: DataFrame | None = None) -> DataFrame:
        """The rows of each path's last batch (of those before the given one).

        With ``paths`` those of these paths and few others; only they are shuffled.
        """
        rows = self._read(self.hits_path, HIT_SCHEMA)
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        if paths is not None:
            rows = likely_among(rows, "path", paths)
        last = rows.groupBy("path").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["path", "batch"])

    def absorb(self, files: DataFrame, batch: int) -> None:
        """Take in a batch of files; again if need be."""
        if "read_error" not in files.columns:
            files = files.withColumn("read_error", F.lit(None).cast("string"))
        checked = review_hits(files).withColumn("read_error", F.lit(None).cast("string"))
        broken = files.where(F.col("read_error").isNotNull()).select("path", "read_error")
        rows = checked.unionByName(broken, allowMissingColumns=True)
        rows.write.mode("overwrite").parquet(f"{self.hits_path}/batch={batch}")
        self._update_names(batch)

    def _update_names(self, batch: int) -> None:
        now = self.spark.read.schema(HIT_SCHEMA).parquet(
            f"{self.hits_path}/batch={batch}").drop("batch")
        paths = now.select("path").distinct()
        # Names the batch defines, and those its files defined before.
        replaced = definitions_of(self.hits(batch, paths)).join(paths, "path", "left_semi")
        touched = written(definitions_of(now).unionByName(replaced).select("name").distinct(),
                          "touched")
        earlier = self._read(self.hits_path, HIT_SCHEMA).where(F.col("batch") < batch)
        with_them = definitions_of(earlier).join(touched, "name", "left_semi").select(
            "path").distinct()
        known = definitions_of(self.hits(batch, with_them)).join(touched, "name", "left_semi")
        changed = written(known.join(paths, "path", "left_anti").select("name", "path").unionByName(
            definitions_of(now)), "changed")
        named = shared_name_findings(changed).withColumn("name", F.regexp_extract(
            "message", r"^function (\w+)\(", 1))
        none = touched.join(named.select("name").distinct(), "name", "left_anti")
        named.unionByName(none, allowMissingColumns=True).write.mode("overwrite").parquet(
            f"{self.updates_path}/batch={batch}")

    def updates(self) -> DataFrame:
        """Every batch's findings for the names it changed, with name and batch."""
        return self._read(self.updates_path, UPDATE_SCHEMA)

    def shared_name_findings(self) -> DataFrame:
        """The check across files as the updates leave it: each name's last ones."""
        rows = self.updates()
        last = rows.groupBy("name").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["name", "batch"]).where("rule_id is not null").select(
            *FINDING_FIELDS)

    def reviewed(self) -> Reviewed:
        """Findings and summary of everything absorbed, as of a batch run over it all."""
        rows = written(self.hits(), "review")
        errors = review_read_errors(rows.where("read_error is not null").select(
            "path", "read_error").withColumn("content", F.lit(None).cast("string")))
        return reviewed(rows.where("read_error is null").drop("read_error", "batch"), errors)


def drain_review(files: DataFrame, folder: str | None = None) -> ReviewStore:
    """Review what a stream of files has available; go on in ``folder`` where it was left."""
    spark = files.sparkSession
    folder = folder or shared_dir(spark, "reviewed")
    store = ReviewStore(spark, folder)
    query = (
        files.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/state")
        .foreachBatch(store.absorb).start())
    query.awaitTermination()
    return store
