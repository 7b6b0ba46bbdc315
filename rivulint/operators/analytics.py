"""Counting, ranking and sampling findings.

Every count is a groupBy that combines on the map side; top lists keep their limit below the
exchange; nothing gathers a whole category, file or language in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulint.functions.text import newline_count, unix_newlines
from rivulint.operators.detect import review_files
from rivulint.schema import severity_rank

LEVELS = ["critical", "high", "medium", "low"]
FINDING_ORDER = ["severity_rank", "path", "line", "rule_id", "match_no"]


def _n():
    return F.count(F.lit(1)).alias("n")


def files_and_lines(files: DataFrame) -> DataFrame:
    """(files_scanned, lines_scanned): every listed PHP file; lines of the readable ones."""
    lines = newline_count(unix_newlines(F.col("content"))) + 1
    return review_files(files).agg(
        F.count(F.lit(1)).alias("files_scanned"),
        F.coalesce(F.sum(lines.cast("bigint")), F.lit(0)).alias("lines_scanned"),
    )


def count_all(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count(F.lit(1)).alias("total_findings"))


def by_severity(findings: DataFrame) -> DataFrame:
    counts = findings.groupBy("severity").agg(_n())
    return counts.withColumn("severity_rank", severity_rank()).orderBy(
        "severity_rank", "severity"
    )


def by_severity_filled(findings: DataFrame) -> DataFrame:
    """The four levels in order, absent ones with 0: one row, one aggregate, unpivoted."""
    sums = findings.agg(*[
        F.count(F.when(F.lower("severity") == level, 1)).alias(level) for level in LEVELS
    ])
    return sums.unpivot([], LEVELS, "severity", "n")


def by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(_n()).orderBy(F.desc("n"), "category")


def by_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("path").agg(_n())


def top_files(findings: DataFrame, k: int = 20) -> DataFrame:
    return by_file(findings).orderBy(F.desc("n"), "path").limit(k)


def language_matrix(findings: DataFrame) -> DataFrame:
    """(language, total, critical, high, medium, low), sorted by language."""
    counts = (
        findings.withColumn("level", F.lower("severity"))
        .groupBy("language").pivot("level", LEVELS).agg(F.count(F.lit(1)))
        .na.fill(0, LEVELS)
    )
    total = reduce(lambda a, b: a + b, [F.col(x) for x in LEVELS])
    return counts.select("language", total.alias("total"), *LEVELS).orderBy("language")


def by_language(findings: DataFrame) -> DataFrame:
    """(language, n, largest, share): bars of a chart, highest first.

    The window runs over one row per language.
    """
    counts = findings.groupBy("language").agg(_n())
    largest = F.max("n").over(Window.partitionBy(F.lit(1)))
    return (
        counts.withColumn("largest", largest)
        .withColumn("share", F.col("n") / F.col("largest"))
        .orderBy(F.desc("n"), "language")
    )


def best_rank_per_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.min("severity_rank").alias("best_rank"))


def verdicts(findings: DataFrame, scopes: dict[str, Column] | None = None) -> DataFrame:
    """(scope, verdict, n) over all findings, or per named condition; one aggregate."""
    scopes = {"all": F.lit(True)} if scopes is None else scopes
    level = F.lower("severity")
    sums = []
    for i, test in enumerate(scopes.values()):
        sums += [
            F.count(F.when(test, 1)).alias(f"n{i}"),
            F.coalesce(F.bool_or(test & (level == "critical")), F.lit(False)).alias(f"c{i}"),
            F.coalesce(F.bool_or(test & (level == "high")), F.lit(False)).alias(f"h{i}"),
        ]
    rows = [
        F.struct(
            F.lit(name).alias("scope"),
            F.when(F.col(f"n{i}") == 0, "SUCCESS").when(F.col(f"c{i}"), "ERROR")
            .when(F.col(f"h{i}"), "WARNING").otherwise("INFO").alias("verdict"),
            F.col(f"n{i}").alias("n"),
        )
        for i, name in enumerate(scopes)
    ]
    return findings.agg(*sums).select(F.inline(F.array(*rows)))


def measures(file_rows: DataFrame) -> DataFrame:
    """(path, severity, category, measure, n) from rows of findings and files.

    ``file_rows`` has one row per finding (path, severity, category) and, riding on one row
    of each file, n_lines; a file without findings has a row with severity NULL.
    """
    one = F.lit(1).cast("bigint")
    some = [
        ("total_findings", F.col("severity").isNotNull(), one),
        ("files_scanned", F.col("n_lines").isNotNull(), one),
        ("lines_scanned", F.col("n_lines").isNotNull(), F.col("n_lines")),
    ]
    entries = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(name).alias("measure"), n.alias("n")))
        for name, test, n in some
    ]))
    return file_rows.select("path", "severity", "category", F.inline_outer(entries))


def summary_rows(file_rows: DataFrame, k: int = 20) -> DataFrame:
    """The summary of a review as rows (section, rank, key, n).

    All sections are read off one aggregate per (path, severity, category, measure) whose
    columns every section uses alike, so its exchange is reused: the corpus is scanned and
    checked once.
    """
    base = measures(file_rows).groupBy("path", "severity", "category", "measure").agg(
        F.sum("n").alias("n")
    )

    def total(name: str):
        return F.coalesce(F.sum(F.when(F.col("measure") == name, F.col("n"))), F.lit(0))

    names = ["files_scanned", "lines_scanned", "total_findings"]
    totals = base.agg(*[total(name).alias(name) for name in names]).select(
        F.inline(F.array(*[
            F.struct(F.lit(name).alias("section"), F.lit(i + 1).alias("rank"),
                     F.lit("").alias("key"), F.col(name).alias("n"))
            for i, name in enumerate(names)
        ]))
    )

    def per(column: str) -> DataFrame:
        sums = base.groupBy(F.col(column).alias("key")).agg(total("total_findings").alias("n"))
        return sums.where(F.col("n") > 0)

    def ranked(rows: DataFrame, section: str) -> DataFrame:
        # One row per category, and k files: small enough for a window.
        order = Window.partitionBy(F.lit(section)).orderBy(F.desc("n"), "key")
        return rows.select(
            F.lit(section).alias("section"), F.row_number().over(order).alias("rank"), "key", "n"
        )

    severities = per("severity").select(
        F.lit("by_severity").alias("section"),
        (severity_rank("key") + 1).alias("rank"), "key", "n",
    )
    categories = ranked(per("category"), "by_category")
    files = ranked(per("path").orderBy(F.desc("n"), "key").limit(k), "top_files")
    return reduce(DataFrame.unionByName, [totals, severities, categories, files])


def summary_document(rows: DataFrame) -> DataFrame:
    """The same as one nested row."""

    def total(name: str):
        return F.max(F.when(F.col("section") == name, F.col("n"))).alias(name)

    def pairs(name: str):
        entry = F.when(F.col("section") == name, F.struct("rank", "key", "n"))
        return F.array_sort(F.collect_list(entry))

    def as_map(name: str):
        return F.map_from_entries(
            F.transform(pairs(name), lambda e: F.struct(e["key"], e["n"]))
        ).alias(name)

    return rows.agg(
        total("files_scanned"), total("lines_scanned"), total("total_findings"),
        as_map("by_severity"), as_map("by_category"),
        F.transform(
            pairs("top_files"), lambda e: F.struct(e["key"].alias("file"), e["n"].alias("n"))
        ).alias("top_files"),
    )


def sorted_findings(findings: DataFrame) -> DataFrame:
    """By severity, file and line; rule and match number make the order total."""
    return findings.orderBy(*FINDING_ORDER)


def sorted_by(findings: DataFrame, column: str, numeric: bool = False) -> DataFrame:
    """A user's column sort: numbers as numbers (anything else as 0), text without case."""
    key = F.col(column)
    if numeric:
        order = F.when(key.cast("string").rlike(r"^\d+$"), key.cast("int")).otherwise(0)
    else:
        order = F.lower(key.cast("string"))
    return findings.orderBy(order, *FINDING_ORDER)


def samples_per_category(findings: DataFrame, k: int = 15) -> DataFrame:
    """The first k findings of every category, with the category's count and best rank.

    The rank filter keeps k rows per task and category before the exchange, so a category
    holding most findings is no hot group; its count comes from its own aggregate.
    """
    order = Window.partitionBy("category").orderBy(*FINDING_ORDER)
    first = findings.withColumn("sample_no", F.row_number().over(order)).where(
        F.col("sample_no") <= k
    )
    sums = findings.groupBy("category").agg(_n(), F.min("severity_rank").alias("best_rank"))
    # A missing category is a category too.
    sums = sums.withColumnRenamed("category", "counted")
    return (
        first.join(sums, F.col("category").eqNullSafe(F.col("counted"))).drop("counted")
        .withColumn("more", F.greatest(F.col("n") - k, F.lit(0)))
    )


