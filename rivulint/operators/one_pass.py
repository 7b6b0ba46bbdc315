"""Line rules of both manners and whole-file checks over one read of the corpus.

Every file is one row with up to three parts, one for each profile that looks at it: its language
there and its lines, or for the whole-file checks its hits.  Parts become rows, lines become
rows, and one array expression holds what was found; all of it is one narrow stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulint.functions.dialect import exact_line, folded_line
from rivulint.functions.matches import let, searchable
from rivulint.functions.text import (
    any_newlines, below_any, read_lines, rtrim_white, trim_white, unix_newlines,
)
from rivulint.operators.detect import audit_language, is_reviewed, scan_language
from rivulint.operators.file_checks import (
    HIT, SNIPPET_WIDTH, check_arrays, definition_hits,
)
from rivulint.operators.line_rules import (
    any_gate, calls_helper, confidence, matching_rules, per_language, rule_struct,
    rules_by_language,
)
from rivulint.rules.fixed_values import (
    HELPER_CALL, HELPER_CALL_CONFIDENCE, SCAN_PRUNED_DIRS, LineRule,
)

LINES = "array<struct<code:string,low:string>>"
NO_LINES = "cast(null as " + LINES + ")"
FIELDS = {
    "rule_id": "string", "severity": "string", "type": "string", "category": "string",
    "message": "string", "recommendation": "string", "hit_line": "int", "match_no": "int",
    "word": "string", "snippet": "string",
}
FOUND = "array<struct<" + ",".join(f"{n}:{k}" for n, k in FIELDS.items()) + ">>"


def _found(values: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(
        f"'{name}', cast({values.get(name, 'null')} as {kind})" for name, kind in FIELDS.items()
    ) + ")"


def _rule_hits(rules: list[LineRule], dialect, once: bool) -> str:
    """Rules that match the line, each as one entry."""
    six = ("rule_id", "severity", "type", "category", "message", "recommendation")
    entry = _found({name: f"r.{name}" for name in six} | {"match_no": "1"})
    return f"transform({matching_rules(rules, dialect, once)}, r -> {entry})"


def _file_hits(checks: list[str]) -> str:
    """Hits of the whole-file checks and function definitions, with the lines they are on."""
    arrays = [*check_arrays(set(checks)), definition_hits()]
    hits = f"cast(flatten(array_compact(array({', '.join(arrays)}))) as array<{HIT}>)"
    entry = _found({
        "rule_id": "h.rule_id", "severity": "h.severity", "hit_line": "h.line",
        "match_no": "h.match_no", "word": "h.word", "snippet": "get(all_lines, h.line - 1)",
    })
    placed = let("split(text, '\\n', -1)", "all_lines", f"transform(hs, h -> {entry})")
    return let(hits, "hs", f"case when size(hs) > 0 then {placed} end")


def _gated_lines(rules: list[LineRule], language: str, text: str, low: str, lines_of) -> F.Column:
    """The lines of a text that holds a gate word of its language."""
    gate = per_language(rules, lambda group: any_gate(low, group), language)
    return F.when(F.expr(gate), F.arrays_zip(
        lines_of(F.col(text)).alias("code"), lines_of(F.col(low)).alias("low")).cast(LINES))


def found_rows(
    files: DataFrame, audit_rules: list[LineRule] = (), scan_rules: list[LineRule] = (),
    checks: list[str] = (), file_rule: bool = False,
) -> DataFrame:
    """profile, path, language, line, rule fields, word, snippet and confidence of every hit.

    Function definitions come along as rows of ``DEFINITION``.  Rules without a language
    apply to nothing.
    """
    path, none = F.col("path"), F.lit(None).cast("string")
    audits, scans = bool(rules_by_language(audit_rules)), bool(rules_by_language(scan_rules))
    looked = F.when(~below_any(path, SCAN_PRUNED_DIRS), scan_language(path, F.col("content")))
    texts = files.select(
        "path", "content",
        (audit_language(path) if audits else none).alias("audit_language"),
        (F.nullif(looked, F.lit("Unknown")) if scans or file_rule else none).alias("scan_language"),
        (is_reviewed(path) if checks else F.lit(False)).alias("is_reviewed"),
        unix_newlines(F.col("content")).alias("text"),
        any_newlines(F.col("content")).alias("scan_text"),
    ).select(
        "*", F.lower("text").alias("low"), F.lower("scan_text").alias("scan_low"),
        F.expr(searchable("text")).alias("code"),
    ).select("*", F.col("low").contains("$_").alias("req"))
    none_lines, none_found = F.expr(NO_LINES), F.lit(None).cast(FOUND)

    def part(profile: str, language, lines, found, on_file=F.lit(False)) -> F.Column:
        return F.struct(F.lit(profile).alias("profile"), language.alias("language"),
                        lines.alias("lines"), found.alias("found"), on_file.alias("on_file"))

    parts = []
    if audits:
        parts.append(part("audit", F.col("audit_language"), _gated_lines(
            audit_rules, "audit_language", "text", "low", read_lines), none_found))
    if scans or file_rule:
        helper = (F.col("scan_language") == "Python") & calls_helper(F.col("scan_text"))
        lines = none_lines if not scans else _gated_lines(
            scan_rules, "scan_language", "scan_text", "scan_low", read_lines)
        parts.append(part("scan", F.col("scan_language"), lines, none_found,
                          helper if file_rule else F.lit(False)))
    if checks:
        hits = F.expr(f"case when is_reviewed then {_file_hits(list(checks))} end")
        parts.append(part("review", F.when(F.col("is_reviewed"), F.lit("PHP")), none_lines, hits))
    rows = texts.select("path", F.inline(F.array(*parts))).where(F.col("language").isNotNull())
    # A finding on the file itself is a line without code, which no text has.
    itself = F.array(F.lit(None).cast("struct<code:string,low:string>"))
    lines = F.when(F.col("on_file"), F.concat(
        F.coalesce("lines", F.array().cast(LINES)), itself)).otherwise(F.col("lines"))
    lined = rows.select("path", "profile", "language", "found", F.posexplode_outer(lines)).select(
        "path", "profile", "language", "found", (F.col("pos") + 1).cast("int").alias("line"),
        F.col("col")["code"].alias("code"), F.col("col")["low"].alias("low"))

    def gate(rules: list[LineRule]) -> str:
        return per_language(rules, lambda group: any_gate("low", group))

    cases, gates = [], ["found is not null", "(line is not null and code is null)"]
    helper_entry = _found({"match_no": "1"} | {
        name: f"r.{name}" for name in list(FIELDS)[:6]})
    if file_rule:
        cases.append("when profile = 'scan' and line is not null and code is null then "
                     f"transform(array({rule_struct(HELPER_CALL)}), r -> {helper_entry})")
    if audits:
        gates.append(f"(profile = 'audit' and {gate(audit_rules)})")
        cases.append(f"when profile = 'audit' then {_rule_hits(audit_rules, exact_line, False)}")
    if scans:
        gates.append(f"(profile = 'scan' and {gate(scan_rules)})")
        cases.append(f"when profile = 'scan' then {_rule_hits(scan_rules, folded_line, True)}")
    every = f"case {' '.join(cases)} else found end" if cases else "found"
    hits = lined.where(" or ".join(gates)).select(
        "path", "profile", "language", "line", "code", "low", F.expr(every).alias("every")).select(
        "path", "profile", "language", "line", "code", "low", F.inline_outer("every")).where(
        F.col("rule_id").isNotNull())
    on_file, scan = F.col("code").isNull(), F.col("profile") == "scan"
    review = F.col("profile") == "review"
    snippet = (
        F.when(review, F.coalesce(F.substring(trim_white(F.col("snippet")), 1, SNIPPET_WIDTH),
                                  F.lit("")))
        .when(on_file, F.lit("")).when(scan, trim_white(F.col("code")))
        .otherwise(rtrim_white(F.col("code"))))
    return hits.select(
        "profile", "path", "language",
        F.when(review, F.col("hit_line")).when(on_file, F.lit(1)).otherwise(
            F.col("line")).alias("line"),
        "rule_id", "severity", "type", "category", "message", "recommendation", "match_no", "word",
        snippet.alias("snippet"),
        F.when(scan & on_file, F.lit(HELPER_CALL_CONFIDENCE)).when(
            scan, confidence(F.col("severity"), F.col("code"), F.col("low"))).alias("confidence"),
    )

