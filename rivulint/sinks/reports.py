"""Findings as files: JSON, CSV, text, markdown rows and HTML rows.

Reports are frames of text lines with sort keys; writing sorts by range, so part files follow
one another in order and no report passes through the driver or a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulint.functions.text import html_escape
from rivulint.operators.analytics import (
    FINDING_ORDER, by_severity_filled, language_matrix, samples_per_category, sorted_findings,
)
from rivulint.schema import FINDING_FIELDS, severity_rank

CSV_COLUMNS = ["severity", "category", "file", "line", "message", "snippet", "fix"]
REPORT_SCHEMA = (
    "severity string, category string, file string, line int, message string,"
    " snippet string, fix string"
)


def stamp(time: Column, pattern: str = "yyyyMMdd_HHmmss") -> Column:
    """A report's time stamp (give it ``current_timestamp()``); only sinks show one."""
    return F.date_format(time, pattern)


def report_rows(findings: DataFrame) -> DataFrame:
    """The columns of the JSON and CSV reports, in report order."""
    return sorted_findings(findings).select(
        "severity", "category", F.col("path").alias("file"), "line", "message", "snippet",
        F.col("recommendation").alias("fix"),
    )


def write_json(findings: DataFrame, summary: DataFrame, path: str) -> None:
    report_rows(findings).write.mode("overwrite").json(f"{path}/findings")
    # One row.
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def write_csv(findings: DataFrame, path: str) -> None:
    report_rows(findings).select(*CSV_COLUMNS).write.mode("overwrite").option(
        "header", True
    ).option("escape", '"').csv(path)


def _line_rows(findings: DataFrame, lines: list[Column]) -> DataFrame:
    """Each finding as several text lines, in order; NULL lines are left out."""
    return (
        findings.select(
            *FINDING_ORDER, F.posexplode(F.array_compact(F.array(*lines))).alias("no", "value")
        )
    )


def text_report(findings: DataFrame) -> DataFrame:
    return _line_rows(findings, [
        F.format_string("[%s] %s:%d", "severity", "path", "line"),
        F.concat(F.lit("  Category: "), "category"),
        F.concat(F.lit("  Message : "), "message"),
        F.when(F.col("snippet") != "", F.concat(F.lit("  Code    : "), "snippet")),
        F.concat(F.lit("  Fix     : "), "recommendation"),
        F.lit(""),
    ])


def short_text_report(findings: DataFrame) -> DataFrame:
    return _line_rows(findings, [
        F.format_string("%s:%d [%s] %s (%s)", "path", "line", "language", "type", "severity"),
        F.concat(F.lit("  "), "message"),
        F.lit(""),
    ])


def markdown_samples(findings: DataFrame, k: int = 15) -> DataFrame:
    """(best_rank, category, sample_no, no, value): heading, samples and the rest's count."""
    samples = samples_per_category(findings, k)
    first = F.col("sample_no") == 1
    last = F.col("sample_no") == F.least(F.col("n"), F.lit(k))
    lines = F.array_compact(F.array(
        F.when(first, F.lit("")),
        F.when(first, F.format_string("### %s (%d found)", "category", "n")),
        F.when(first, F.lit("")),
        F.format_string("**[%s] %s:%d**", "severity", "path", "line"),
        F.concat(F.lit("- Issue: "), "message"),
        F.when(F.col("snippet") != "", F.concat(F.lit("- Code: `"), "snippet", F.lit("`"))),
        F.concat(F.lit("- Fix: "), "recommendation"),
        F.lit(""),
        F.when(last & (F.col("more") > 0),
               F.format_string("...and %d more instance(s).", "more")),
        F.when(last & (F.col("more") > 0), F.lit("")),
    ))
    return samples.select(
        "best_rank", "category", "sample_no", F.posexplode(lines).alias("no", "value")
    )


# The texts around the parts of a report, before each section's lines.
TEXT_HEADS = {
    "title": ["=== PHP CODE REVIEW REPORT (Text) ===", ""],
    "by_severity": ["", "-- Findings by severity --"],
    "by_category": ["", "-- Findings by category --"],
    "top_files": ["", "-- Top files with most issues --"],
    "details": ["", "-- Detailed findings --", ""],
}
MARKDOWN_HEADS = {
    "title": ["# PHP Codebase Review Report", ""],
    "by_severity": ["", "## Findings by severity", ""],
    "by_category": ["", "## Findings by category", ""],
    "top_files": ["", "## Files with the most findings", ""],
    "details": ["", "## Detailed findings (sample per category)", ""],
}
SECTIONS = ["title", "files_scanned", "lines_scanned", "total_findings", "by_severity",
            "by_category", "top_files", "details"]
DOCUMENT_ORDER = ["part", *FINDING_ORDER, "no"]


def summary_lines(rows: DataFrame, markdown: bool = False) -> DataFrame:
    """(section, rank, value): the summary rows as lines of a text or markdown report."""
    plain = "concat('- ', key, ': ', n)" if markdown else "concat('  ', key, ': ', n)"
    strong = "concat('- **', key, '**: ', n)" if markdown else plain
    # Two spaces at the end break a markdown line.
    tail = "'  '" if markdown else "''"
    return rows.selectExpr("section", "rank", f"""
        case section when 'files_scanned' then concat('Files scanned: ', n, {tail})
                     when 'lines_scanned' then concat('Lines scanned: ', n, {tail})
                     when 'total_findings' then concat('Total findings: ', n)
                     when 'by_severity' then {strong} else {plain} end as value""")


def _section_number() -> Column:
    names = F.array(*[F.lit(s) for s in SECTIONS])
    return F.array_position(names, F.col("section")).cast("int")


def _document(summary: DataFrame, details: DataFrame, heads: dict, markdown: bool) -> DataFrame:
    """Head, summary and details as lines with one common order."""
    spark = summary.sparkSession
    head_rows = [
        (SECTIONS.index(section) + 1, no - len(lines), line)
        for section, lines in heads.items() for no, line in enumerate(lines)
    ]
    fixed = spark.createDataFrame(head_rows, "part int, severity_rank int, value string")
    body = summary_lines(summary, markdown).select(
        _section_number().alias("part"), F.col("rank").alias("severity_rank"), "value"
    )
    missing = {name: F.lit(None) for name in ("path", "line", "rule_id", "match_no", "no")}
    kinds = {"path": "string", "rule_id": "string"}
    top = fixed.unionByName(body).select(
        "part", "severity_rank",
        *[v.cast(kinds.get(n, "int")).alias(n) for n, v in missing.items()], "value",
    )
    below = details.withColumn("part", F.lit(len(SECTIONS)))
    return top.select(*DOCUMENT_ORDER, "value").unionByName(
        below.select(*DOCUMENT_ORDER, "value")
    )


def text_document(summary: DataFrame, findings: DataFrame) -> DataFrame:
    """The whole text report; write it with ``write_lines(.., DOCUMENT_ORDER, ..)``."""
    return _document(summary, text_report(findings), TEXT_HEADS, False)


def markdown_document(summary: DataFrame, findings: DataFrame, k: int = 15) -> DataFrame:
    """The whole markdown report; categories by their best severity."""
    samples = markdown_samples(findings, k).select(
        F.col("best_rank").alias("severity_rank"), F.col("category").alias("path"),
        F.col("sample_no").alias("line"), F.lit("").alias("rule_id"),
        F.lit(1).alias("match_no"), "no", "value",
    )
    return _document(summary, samples, MARKDOWN_HEADS, True)


# The markup of the cells below.
def _cell(value: Column) -> Column:
    return F.concat(F.lit("<td>"), value, F.lit("</td>"))


def html_rows(findings: DataFrame) -> DataFrame:
    """Table rows of the case-sensitive profile."""
    cells = [
        html_escape(F.col("path")), F.col("line").cast("string"), F.col("language"),
        F.col("type"), F.col("severity"), html_escape(F.col("message")),
    ]
    row = F.concat(F.lit("<tr>"), *[_cell(c) for c in cells], F.lit("</tr>"))
    return findings.select(*FINDING_ORDER, row.alias("value"))


def html_finding_rows(findings: DataFrame) -> DataFrame:
    """Table rows of the case-insensitive profile; escaped like the others."""
    badge = F.concat(
        F.lit("<span class='badge-"), F.lower("severity"), F.lit("'>"), F.upper("severity"),
        F.lit("</span>"),
    )
    row = F.concat(
        F.lit("<tr>"), _cell(html_escape(F.col("path"))),
        F.lit("<td style='text-align:center;'>"), F.col("line").cast("string"), F.lit("</td>"),
        F.lit("<td class='severity-cell'>"), badge, F.lit("</td>"),
        *[_cell(html_escape(F.col(c)))
          for c in ("message", "language", "category", "recommendation")],
        F.lit("</tr>"),
    )
    return findings.select(*FINDING_ORDER, row.alias("value"))


def html_matrix_rows(matrix: DataFrame) -> DataFrame:
    """Table rows of the language matrix."""
    cells = [_cell(F.col(c).cast("string")) for c in ("critical", "high", "medium", "low")]
    row = F.concat(
        F.lit("<tr><td><span class='language-badge'>"), html_escape(F.col("language")),
        F.lit("</span></td>"), *cells, F.lit("<td><strong>"), F.col("total").cast("string"),
        F.lit("</strong></td></tr>"),
    )
    return matrix.select("language", row.alias("value"))


# What stands around the findings of the short text and the HTML reports.
SHORT_TITLE, SHORT_RULE = "Code Audit Report – {0}", "=" * 80
HTML_START = "<!DOCTYPE html><html><head><meta charset='utf-8'></head><body>"
HTML_END = "</body></html>"
AUDIT_COLUMNS = ["File", "Line", "Language", "Type", "Severity", "Message"]
SCAN_COLUMNS = ["File", "Line", "Severity", "Message", "Language", "Category", "Recommendation"]
MATRIX_COLUMNS = ["Language", "Critical", "High", "Medium", "Low", "Total"]
TOTAL_COLUMNS = ["Severity", "Findings"]


def html_table_head(columns: list[str]) -> str:
    return "<table><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"


def _in_parts(parts: list[list[str] | DataFrame]) -> DataFrame:
    """Lists of fixed lines and frames of lines one after the other, in ``DOCUMENT_ORDER``."""
    kinds = {"severity_rank": "int", "path": "string", "line": "int", "rule_id": "string",
             "match_no": "int", "no": "int"}
    fixed = [(part, no, line) for part, lines in enumerate(parts) if isinstance(lines, list)
             for no, line in enumerate(lines)]
    spark = next(p for p in parts if not isinstance(p, list)).sparkSession
    out = spark.createDataFrame(fixed, "part int, no int, value string")
    for part, frame in enumerate(parts):
        if not isinstance(frame, list):
            out = out.unionByName(frame.withColumn("part", F.lit(part)), allowMissingColumns=True)
    known = [F.col(c).cast(k).alias(c) if c in out.columns else F.lit(None).cast(k).alias(c)
             for c, k in kinds.items()]
    return out.select("part", "value", *known).select(*DOCUMENT_ORDER, "value")


def short_text_document(findings: DataFrame, time: str) -> DataFrame:
    """The whole text report of the case-sensitive profile."""
    head = [SHORT_TITLE.replace("{0}", time), SHORT_RULE, ""]
    return _in_parts([head, short_text_report(findings)])


def html_document(findings: DataFrame, time: str) -> DataFrame:
    """The whole HTML report of the case-sensitive profile."""
    title = f"<h1>{SHORT_TITLE.replace('{0}', time)}</h1>"
    return _in_parts([[HTML_START, title, html_table_head(AUDIT_COLUMNS)], html_rows(findings),
                      ["</table>", HTML_END]])


def html_total_rows(totals: DataFrame) -> DataFrame:
    """Table rows of the four severities' totals, in their order."""
    row = F.concat(F.lit("<tr>"), _cell(F.initcap("severity")),
                   _cell(F.col("n").cast("string")), F.lit("</tr>"))
    return totals.select(
        severity_rank("upper(severity)").alias("severity_rank"), row.alias("value"))


def scan_html_document(findings: DataFrame, time: str) -> DataFrame:
    """The whole HTML report of the case-insensitive profile: totals, matrix, findings.

    ``findings`` are best written down before (``profiles.settled``): three sections read them.
    """
    matrix = html_matrix_rows(language_matrix(findings)).withColumnRenamed("language", "path")
    return _in_parts([
        [HTML_START, f"<h1>Scan Report – {time}</h1>", "<h2>Findings by severity</h2>",
         html_table_head(TOTAL_COLUMNS)],
        html_total_rows(by_severity_filled(findings)),
        ["</table>", "<h2>Findings by language</h2>", html_table_head(MATRIX_COLUMNS)],
        matrix,
        ["</table>", "<h2>All findings</h2>", html_table_head(SCAN_COLUMNS)],
        html_finding_rows(findings),
        ["</table>", HTML_END],
    ])


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    lines.orderBy(*order).select("value").write.mode("overwrite").text(path)


def _sized(findings: DataFrame) -> DataFrame:
    """Findings dealt by profile and severity into partitions of the advisory size.

    Adaptive execution splits a large pair over several tasks and lets small ones share a task,
    so the number of files follows from the bytes, not from the tasks before.
    """
    return findings.hint("rebalance", "profile", "severity")


def write_store(findings: DataFrame, path: str) -> None:
    """The store later queries read: one folder per profile and severity."""
    _sized(findings).write.mode("overwrite").partitionBy("profile", "severity").parquet(path)


def read_store(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_run(findings: DataFrame, paths: DataFrame, store: str, run: int) -> None:
    """The findings of one run over some files, beside those of other runs.

    ``paths`` are all files the run looked at, so that a file without findings is known as such.
    A run replaces what earlier runs found in these files, and nothing else; it counts once its
    list of files is there, and is written over if it is run again under its number.
    """
    _sized(findings).write.mode("overwrite").partitionBy("profile", "severity").parquet(
        f"{store}/findings/run={run}")
    paths.select("path").distinct().write.mode("overwrite").parquet(f"{store}/files/run={run}")


def read_runs(spark, store: str) -> DataFrame:
    """Every file's findings of the last run that looked at it."""
    files = spark.read.schema("path string, run long").parquet(f"{store}/files")
    last = files.groupBy("path").agg(F.max("run").alias("run"))
    schema = ", ".join(f"{name} {kind}" for name, kind in FINDING_FIELDS.items())
    found = spark.read.schema(f"{schema}, run long").parquet(f"{store}/findings")
    return found.join(last, ["path", "run"]).select(*FINDING_FIELDS)
