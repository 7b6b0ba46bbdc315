"""The lines around a finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulint.functions.dialect import exact_line, folded_line
from rivulint.functions.text import read_lines, unix_newlines
from rivulint.operators.detect import scan_files
from rivulint.operators.line_rules import audit_text, calls_helper, reported_lines, scan_text
from rivulint.rules.fixed_values import AUDIT_RULES, SCAN_RULES, LineRule


BITMAP_WORDS = 1 << 15


def likely_among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is in ``keys`` and few others, without a shuffle of the rows.

    The keys' hashes set bits in a bitmap of ``BITMAP_WORDS`` words of 64, at most 0.5 MB
    whatever their number; that alone is broadcast.  The exact join comes after.
    """
    marked = F.xxhash64(key)
    word = marked.bitwiseAND(F.lit(BITMAP_WORDS - 1))
    bit = F.shiftrightunsigned(marked, 32).bitwiseAND(F.lit(63)).cast("int")
    bitmap = keys.groupBy(word.alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    held = F.call_function("getbit", F.col("_bits"), bit) == 1
    return rows.join(F.broadcast(bitmap), word == F.col("_word")).where(held).drop(
        "_word", "_bits")


def _numbered(blocks: DataFrame) -> DataFrame:
    """Rows of (path, line, first, block) as one row for each line of a block."""
    return blocks.select("path", "line", "first", F.posexplode("block").alias("pos", "code")).select(
        "path", "line", (F.col("first") + F.col("pos")).cast("int").alias("context_line"),
        "code", (F.col("first") + F.col("pos") == F.col("line")).alias("is_hit"),
    )


def audit_context(files: DataFrame, before: int, after: int,
                  rules: list[LineRule] = AUDIT_RULES) -> DataFrame:
    """The lines around what ``audit`` reports: one read of the corpus, nothing is shuffled."""
    return _numbered(audit_blocks(files, before, after, rules))


def audit_blocks(files: DataFrame, before: int, after: int,
                 rules: list[LineRule] = AUDIT_RULES) -> DataFrame:
    """path, line, first and block, an array of lines, for every line ``audit`` reports."""
    return reported_lines(audit_text(files), rules, exact_line, before, after)


def scan_context(files: DataFrame, before: int, after: int,
                 rules: list[LineRule] = SCAN_RULES) -> DataFrame:
    """The lines around what ``scan`` reports, the finding on a whole file being on line 1."""
    on_file = (F.col("language") == "Python") & calls_helper(F.col("text"))
    return _numbered(reported_lines(
        scan_text(scan_files(files)), rules, folded_line, before, after, on_file))


def context_rows(findings: DataFrame, files: DataFrame, before: int, after: int) -> DataFrame:
    """(path, line, context_line, code, is_hit) for every reported line, clamped to its file.

    For findings that come from elsewhere, with line numbers alone; ``audit_context`` and
    ``scan_context`` need no join.
    The reported line numbers travel to the file, one row on either side of the join, so no
    key can be hot; the numbers of one file are fewer than its lines.  Before the join the
    corpus is narrowed, where it is read, to files that are likely reported (``likely_among``),
    so that the texts of other files do not move.
    """
    wanted = findings.where(F.col("line") > 0).groupBy("path").agg(
        F.collect_set("line").alias("wanted")
    )
    files = likely_among(files.select("path", "content"), "path", wanted)
    text = files.select("path", unix_newlines(F.col("content")).alias("text"))
    blocks = (
        text.join(wanted, "path")
        .select("path", read_lines(F.col("text")).alias("lines"), "wanted")
        .select("path", "lines", F.explode("wanted").alias("line"))
        .select(
            "path", "line",
            F.greatest(F.lit(1), F.col("line") - before).alias("first"),
            F.slice(
                "lines", F.greatest(F.lit(1), F.col("line") - before),
                F.lit(after + 1) + F.least(F.lit(before), F.col("line") - 1),
            ).alias("block"),
        )
    )
    return _numbered(blocks)


def context_texts(rows: DataFrame, style: str = "numbered") -> DataFrame:
    """The preview line as shown: ``12 >>> code`` padded, or ``12: code``."""
    if style == "padded":
        shown = F.format_string(
            "%4d %s%s", "context_line",
            F.when(F.col("is_hit"), F.lit(">>> ")).otherwise(F.lit("    ")), "code",
        )
    else:
        shown = F.concat(F.col("context_line").cast("string"), F.lit(": "), "code")
    return rows.withColumn("shown", shown)
