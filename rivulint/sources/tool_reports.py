"""Reports of outside linters as findings.  Reports are read; no tool is ever started."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulint.rules.fixed_values import BANDIT_TYPE, PYLINT_TYPE
from rivulint.schema import as_findings
from rivulint.sources.json_items import json_items

PYLINT_ITEM = "path string, line int, symbol string, message string"
BANDIT_ISSUE = (
    "filename string, line_number int, issue_severity string, test_name string,"
    " issue_text string, code string"
)


def _or_empty(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def pylint_findings(items: DataFrame) -> DataFrame:
    """``items`` has the fields of PYLINT_ITEM, any of them missing."""
    rows = items.select(
        _or_empty("path").alias("path"), F.coalesce("line", F.lit(0)).alias("line"),
        F.lit("PYLINT").alias("rule_id"), F.lit("MEDIUM").alias("severity"),
        F.lit(PYLINT_TYPE).alias("type"), F.lit("Python").alias("language"),
        F.concat_ws(": ", _or_empty("symbol"), _or_empty("message")).alias("message"),
        F.lit("").alias("snippet"),
    )
    return as_findings(rows, "audit")


def bandit_findings(issues: DataFrame) -> DataFrame:
    """``issues`` has the fields of BANDIT_ISSUE, any of them missing."""
    rows = issues.select(
        _or_empty("filename").alias("path"),
        F.coalesce("line_number", F.lit(0)).alias("line"),
        F.lit("BANDIT").alias("rule_id"),
        F.coalesce("issue_severity", F.lit("MEDIUM")).alias("severity"),
        F.lit(BANDIT_TYPE).alias("type"), F.lit("Python").alias("language"),
        F.concat_ws(": ", _or_empty("test_name"), _or_empty("issue_text")).alias("message"),
        _or_empty("code").alias("snippet"),
    )
    return as_findings(rows, "audit")


def pylint_items(reports: DataFrame) -> DataFrame:
    """One row per item of report texts (column ``report``, each a JSON array)."""
    parsed = F.from_json("report", f"array<struct<{_as_struct(PYLINT_ITEM)}>>")
    return reports.select(F.inline(parsed))


def bandit_issues(reports: DataFrame) -> DataFrame:
    """One row per issue of report texts (column ``report``, each a JSON object)."""
    parsed = F.from_json(
        "report", f"struct<results:array<struct<{_as_struct(BANDIT_ISSUE)}>>>"
    )
    return reports.select(F.inline(parsed["results"]))


def _as_struct(ddl: str) -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (f.split() for f in ddl.split(",")))


def _parsed(items: DataFrame, schema: str) -> DataFrame:
    return items.select(F.from_json("item", schema).alias("one")).select("one.*")


def read_pylint(spark: SparkSession, path: str) -> DataFrame:
    """Report files holding a JSON array, of any size (``json_items``)."""
    return pylint_findings(_parsed(json_items(spark, path), PYLINT_ITEM))


def read_bandit(spark: SparkSession, path: str) -> DataFrame:
    """Report files holding one JSON object with the issues under ``results``, of any size."""
    return bandit_findings(_parsed(json_items(spark, path, "results"), BANDIT_ISSUE))
