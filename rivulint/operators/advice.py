"""Severity names and recommendations for findings that come from outside the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulint.rules import fixed_values as fv
from rivulint.schema import severity_rank


def normal_severity(severity: Column) -> Column:
    """critical, high, medium or low; an unknown name counts as low."""
    low = F.lower(severity)
    value = F.lit("low")
    for name, target in fv.SEVERITY_ALIASES.items():
        if target != "low":
            value = F.when(low == name, F.lit(target)).otherwise(value)
    return value


def fallback_advice(message: Column, language: Column) -> Column:
    """Advice by keywords of the message, the first that occurs."""
    low = F.lower(message)
    choice = None
    for words, advice in fv.FALLBACK_ADVICE:
        test = F.lit(False)
        for word in words:
            test = test | low.contains(word)
        choice = F.when(test, F.lit(advice)) if choice is None else choice.when(test, advice)
    choice = choice.when(
        (language == "Python") & low.contains("debug"), F.lit(fv.PYTHON_DEBUG_ADVICE)
    )
    return choice.otherwise(F.lit(fv.GENERIC_ADVICE))


def with_advice(findings: DataFrame) -> DataFrame:
    """Fill empty recommendations."""
    given = F.nullif(F.col("recommendation"), F.lit(""))
    return findings.withColumn(
        "recommendation",
        F.coalesce(given, fallback_advice(F.col("message"), F.col("language"))),
    )


def with_normal_severity(findings: DataFrame) -> DataFrame:
    value = F.upper(normal_severity(F.col("severity")))
    return findings.withColumn("severity", value).withColumn(
        "severity_rank", severity_rank()
    )
