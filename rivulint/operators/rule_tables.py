"""Rules that come as a table instead of with the package.

Besides what a line rule has, a row may say in which manner the rule works: ``profile`` audit
(every rule reports every line it matches; case-sensitive, languages by suffix) or scan (of rules with one message and type
the first reports a line; case-insensitive, languages by suffix or content, pruned folders passed
over, with confidence), ``flags`` for its pattern and its ``ordinal`` among the rules.  Without
these columns, or where they are null, a rule is an audit rule without flags, in the order of ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulint.functions.text import rtrim_white, trim_white
from rivulint.operators.detect import scan_files
from rivulint.operators.line_rules import audit_findings, confidence, scan_findings
from rivulint.operators.one_pass import found_rows
from rivulint.operators.rule_index import IndexedRule, indexed_hits
from rivulint.rules.fixed_values import AUDIT_RULES, LineRule
from rivulint.schema import as_findings

RULE_SCHEMA = (
    "rule_id string, languages array<string>, gate string, pattern string, severity string,"
    " type string, category string, message string, recommendation string"
)
MANNER_SCHEMA = "profile string, flags string, ordinal int"
PROFILES = ("audit", "scan")
# Flags a pattern may have: ignoring case (of ASCII letters), multi-line, dot for all, comments.
FLAGS = "imsx"
# Tables of more rules go through the index; of fewer, every rule is an expression.
INDEXED_FROM = 500


def rule_table(spark: SparkSession, rules: list[LineRule] = AUDIT_RULES) -> DataFrame:
    rows = [(*r[:1], None if r.languages is None else list(r.languages), *r[2:]) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _flagged(pattern: str, flags: str | None) -> str:
    wanted = "".join(dict.fromkeys(flags or ""))
    unknown = set(wanted) - set(FLAGS)
    if unknown:
        raise ValueError(f"unknown flags {sorted(unknown)} of the rule {pattern!r}")
    if not wanted:
        return pattern
    return f"(?{wanted}{'-u' if 'i' in wanted else ''})" + pattern


def collected_rules(table: DataFrame) -> list[IndexedRule]:
    """The table's rules, on the driver to be made part of the plan, in the order they are tried.

    A rule table is configuration: its size is that of the rules written down, whatever the
    corpus.  A rule without pattern or languages applies to nothing; a language listed twice
    counts once; a null gate lets every line through.
    """
    manner = [f.split()[0] for f in MANNER_SCHEMA.split(", ")]
    there = {c.lower() for c in table.columns}
    columns = [c.split()[0] for c in RULE_SCHEMA.split(", ")]
    rows = table.select(*columns, *[
        F.col(c) if c in there else F.lit(None).alias(c) for c in manner]).collect()
    kept = []
    for row in rows:
        languages = tuple(dict.fromkeys(x for x in row.languages or () if x is not None))
        profile = row.profile or "audit"
        if profile not in PROFILES:
            raise ValueError(f"unknown profile {profile!r} of the rule {row.rule_id!r}")
        if languages and row.pattern is not None:
            rule = LineRule(row.rule_id, languages, (row.gate or "").lower(),
                            _flagged(row.pattern, row.flags), *row[4:9])
            kept.append((row.ordinal is None, row.ordinal or 0, rule.rule_id or "", row.pattern,
                         IndexedRule(profile, rule)))
    return [found for *_, found in sorted(kept, key=lambda k: k[:4])]


def table_findings(files: DataFrame, table: DataFrame, indexed_from: int = INDEXED_FROM
                   ) -> DataFrame:
    """Findings of a user's rule table; one narrow pass over the corpus for any number of rules."""
    rules = collected_rules(table)
    by_profile = {p: [r for profile, r in rules if profile == p] for p in PROFILES}
    if len(rules) > indexed_from:
        hits = indexed_hits(files, rules)
        scan = F.col("profile") == "scan"
        return as_findings(hits.withColumns({
            "snippet": F.when(scan, trim_white(F.col("code"))).otherwise(
                rtrim_white(F.col("code"))),
            "confidence": F.when(scan, confidence(
                F.col("severity"), F.col("code"), F.lower("code")))}), None)
    if not by_profile["scan"]:
        return audit_findings(files, by_profile["audit"])
    if not by_profile["audit"]:
        return scan_findings(scan_files(files), by_profile["scan"], file_rule=False)
    return as_findings(found_rows(files, by_profile["audit"], by_profile["scan"]), None)
