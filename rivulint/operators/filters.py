"""Narrowing and showing findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulint.functions.text import base_name

SEARCHED = ["path", "line", "message", "category", "language"]


def _fields() -> list[Column]:
    return [F.col(c).cast("string") for c in SEARCHED]


def search_joined(findings: DataFrame, needle: str = "", severity: str = "all",
                  language: str = "all") -> DataFrame:
    """Needle anywhere in the space-joined fields."""
    if severity != "all":
        findings = findings.where(F.lower("severity") == severity)
    if language != "all":
        findings = findings.where(F.col("language") == language)
    if needle:
        findings = findings.where(
            F.lower(F.concat_ws(" ", *_fields())).contains(needle.lower())
        )
    return findings


def search_fields(findings: DataFrame, needle: str = "", severity: str = "All",
                  language: str = "All") -> DataFrame:
    """Needle within one field; severity in any case."""
    if needle:
        hit = F.lit(False)
        for field in _fields():
            hit = hit | F.coalesce(F.lower(field).contains(needle.lower()), F.lit(False))
        findings = findings.where(hit)
    if severity != "All":
        findings = findings.where(F.lower("severity") == severity.lower())
    if language != "All":
        findings = findings.where(F.col("language") == language)
    return findings


def table_rows(findings: DataFrame) -> DataFrame:
    """What a findings table shows."""
    return findings.select(
        base_name(F.col("path")).alias("file"), F.col("line").cast("string").alias("line"),
        F.upper("severity").alias("severity"), "message", "language", "category",
        F.concat(F.col("confidence").cast("string"), F.lit("%")).alias("confidence"),
    )


def detail_texts(findings: DataFrame) -> DataFrame:
    """The detail record of every finding as one text."""
    detail = F.concat(
        F.lit("File: "), "path", F.lit("\nLine: "), F.col("line").cast("string"),
        F.lit("\nSeverity: "), F.upper("severity"), F.lit("\nCategory: "), "category",
        F.lit("\nType: "), F.upper("type"), F.lit("\nConfidence: "),
        F.col("confidence").cast("string"), F.lit("%\nLanguage: "), "language",
        F.lit("\n\nMessage: "), "message", F.lit("\n\nRecommendation: "), "recommendation",
    )
    return findings.select("path", "line", "rule_id", detail.alias("detail"))


def short_detail_texts(findings: DataFrame) -> DataFrame:
    """The detail record of the case-sensitive profile."""
    detail = F.concat(
        F.lit("File:   "), "path", F.lit("\nLine:   "), F.col("line").cast("string"),
        F.lit("   Language: "), "language", F.lit("\nType:   "), "type",
        F.lit("   Severity: "), "severity", F.lit("\nMessage: "), "message",
        F.lit("\nCode:   "), F.coalesce("snippet", F.lit("")),
    )
    return findings.select("path", "line", "rule_id", detail.alias("detail"))
