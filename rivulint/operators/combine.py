"""Putting findings of several origins together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINDING_KEY = ["path", "line", "message", "type"]


def all_findings(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_of_key(findings: DataFrame, order: list[str], key: list[str] | None = None):
    """One row per key: the first by the given order columns.

    ``min_by`` combines on the map side, so a key with very many copies sends one row per
    task through the shuffle.
    """
    key = FINDING_KEY if key is None else key
    rest = [c for c in findings.columns if c not in key]
    # A missing key field equals another missing one.
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return findings.groupBy(*key).agg(first).select(*key, "first.*").select(*findings.columns)


def without_lines_of(findings: DataFrame, others: DataFrame) -> DataFrame:
    """Findings on lines the others do not report."""
    return findings.join(others.select("path", "line").distinct(), ["path", "line"], "left_anti")


def picked(findings: DataFrame, keys: DataFrame) -> DataFrame:
    """The first finding for each (path, line, message) asked for."""
    key = ["path", "line", "message"]
    return first_of_key(
        findings.join(keys.select(*key).distinct(), key, "left_semi"),
        ["severity_rank", "rule_id", "match_no"], key,
    )
