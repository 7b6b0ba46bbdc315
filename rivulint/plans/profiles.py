"""The three profiles end to end, and what is usually asked of them.

Corpora may have a ``read_error`` column; a file with one is reported where its profile does
so and is otherwise passed over.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulint.operators import analytics
from rivulint.operators.combine import all_findings
from rivulint.operators.detect import scan_files
from rivulint.operators.duplicates import shared_name_findings
from rivulint.operators.errors import readable, review_read_errors, scan_read_errors
from rivulint.operators.file_checks import (
    ALL_CHECKS, DEFINITION, check_findings, describe, file_hits, hit_rows,
)
from rivulint.operators.line_rules import audit_findings, scan_findings
from rivulint.operators.one_pass import found_rows
from rivulint.rules.fixed_values import AUDIT_RULES, SCAN_RULES, LineRule
from rivulint.schema import as_findings
from rivulint.session import shared_dir


def _parts(files: DataFrame, build, errors) -> list[DataFrame]:
    if "read_error" not in files.columns:
        return build(files)
    return [*build(readable(files)), errors(files)]


def review(files: DataFrame) -> DataFrame:
    """Whole-file PHP checks plus the check across files, from one read of the corpus."""
    return review_once(files).findings


def audit(files: DataFrame, *tool_findings: DataFrame) -> DataFrame:
    return all_findings(audit_findings(files), *tool_findings)


def scan(files: DataFrame) -> DataFrame:
    return all_findings(*_parts(
        files, lambda f: [scan_findings(scan_files(f))], scan_read_errors
    ))


def every_profile(files: DataFrame) -> DataFrame:
    """All three profiles from one read of the corpus, written as rows by profile."""
    return all_findings(*found_findings(files, AUDIT_RULES, SCAN_RULES, ALL_CHECKS, True))


def found_findings(
    files: DataFrame, audit_rules: list[LineRule], scan_rules: list[LineRule],
    checks: list[str], file_rule: bool,
) -> list[DataFrame]:
    good = readable(files) if "read_error" in files.columns else files
    rows = found_rows(good, audit_rules, scan_rules, checks, file_rule)
    out = shared_dir(files.sparkSession, "found")
    rows.write.partitionBy("profile").parquet(out)
    stored = files.sparkSession.read.schema(rows.schema).parquet(out)

    def of(profile: str) -> DataFrame:
        return stored.where(F.col("profile") == profile)

    parts = [as_findings(of(p).drop("profile", "word"), p) for p in ("audit", "scan")]
    if checks:
        hits = of("review").select(
            "path", "line", "rule_id", "match_no", "word", "severity", "snippet")
        parts += [
            as_findings(describe(hits.where(F.col("rule_id") != DEFINITION)), "review"),
            shared_name_findings(definitions_of(hits))]
    if "read_error" in files.columns:
        parts += [review_read_errors(files)] if checks else []
        parts += [scan_read_errors(files)] if file_rule else []
    return parts


def settled(findings: DataFrame, purpose: str = "findings") -> DataFrame:
    """Findings written once to the shared folder and read back.

    Findings are small beside the corpus they come from.  What looks at them more than once
    starts from here, so that the corpus is read and checked once; a lost executor costs no
    more than its own part.
    """
    spark, out = findings.sparkSession, shared_dir(findings.sparkSession, purpose)
    findings.write.parquet(out)
    return spark.read.schema(findings.schema).parquet(out)


def scan_language_matrix(files: DataFrame) -> DataFrame:
    """Language by severity: the headline table."""
    return analytics.language_matrix(scan(files))


def _summary(rows: DataFrame, *others: DataFrame) -> DataFrame:
    """Summary rows from check rows and findings that come from elsewhere."""
    columns = ["path", "severity", "category", "n_lines"]
    none = F.lit(None).cast("bigint")
    counted = all_findings(*others)
    return analytics.summary_rows(
        describe(rows, "n_lines").select(columns).unionByName(
            counted.withColumn("n_lines", none).select(columns))
    )


def review_summary_rows(files: DataFrame) -> DataFrame:
    """The review's summary."""
    return review_once(files).summary_rows


def review_summary(files: DataFrame) -> DataFrame:
    """The summary as one nested row."""
    return analytics.summary_document(review_summary_rows(files))


def review_checks(files: DataFrame) -> DataFrame:
    """The per-file checks and read errors alone: lazy, narrow, and as good for a stream.

    The check across files needs the definitions of all of them; ``review`` adds it.
    """
    return all_findings(*_parts(files, lambda f: [check_findings(f)], review_read_errors))


class Reviewed(NamedTuple):
    findings: DataFrame
    summary_rows: DataFrame


def review_once(files: DataFrame) -> Reviewed:
    """Findings and summary with a single read of the corpus.

    The checks and the function definitions of every file are written as rows to the shared
    folder in one narrow pass; the check across files, the summary and whatever is asked of
    the findings later start from that much smaller table.
    """
    rows = settled(review_hits(files), "review")
    others = []
    if "read_error" in files.columns:
        others.append(review_read_errors(files.select("path", "read_error")))
    return reviewed(rows, *others)


def review_hits(files: DataFrame) -> DataFrame:
    """What checks and the check across files need of every file, in narrow rows; lazy."""
    return hit_rows(file_hits(files, definitions=True))


def definitions_of(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("rule_id") == DEFINITION).select(F.col("word").alias("name"), "path")


def reviewed(hits: DataFrame, *others: DataFrame) -> Reviewed:
    """Findings and summary from stored rows of ``review_hits``."""
    others = [shared_name_findings(definitions_of(hits)), *others]
    checks = hits.where(F.col("rule_id") != DEFINITION)
    return Reviewed(
        all_findings(as_findings(describe(checks), "review"), *others), _summary(hits, *others)
    )
