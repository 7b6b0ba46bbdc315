"""Files that could not be read become findings, never exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulint.operators.detect import review_files, scan_files, scan_language
from rivulint.rules import fixed_values as fv
from rivulint.schema import as_findings


def readable(files: DataFrame) -> DataFrame:
    return files.where(F.col("read_error").isNull())


def _broken(files: DataFrame) -> DataFrame:
    return files.where(F.col("read_error").isNotNull()).select(
        "path", F.lit(0).alias("line"),
        F.concat(F.lit(fv.READ_ERROR_PREFIX), "read_error").alias("message"),
        F.lit("").alias("snippet"), F.lit("READ").alias("rule_id"),
    )


def review_read_errors(files: DataFrame) -> DataFrame:
    severity, category, fix = fv.READ_ERROR_REVIEW
    rows = _broken(review_files(files)).select(
        "*", F.lit(severity).alias("severity"), F.lit(category).alias("category"),
        F.lit(fix).alias("recommendation"), F.lit("PHP").alias("language"),
    )
    return as_findings(rows, "review")


def scan_read_errors(files: DataFrame) -> DataFrame:
    severity, type_, category, advice, sure = fv.READ_ERROR_SCAN
    rows = _broken(scan_files(files)).select(
        "*", F.lit(severity).alias("severity"), F.lit(type_).alias("type"),
        F.lit(category).alias("category"), F.lit(advice).alias("recommendation"),
        F.lit(sure).alias("confidence"),
        scan_language(F.col("path"), F.lit("")).alias("language"),
    )
    return as_findings(rows, "scan")
