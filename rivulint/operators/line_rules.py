"""Line rules over a corpus: one narrow pass, one finding per rule and line.

Files whose text holds none of their language's gate words never get split into lines; of the
others only lines holding a gate word meet the regular expressions, and only those of their
own language.  Nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulint.functions.dialect import (
    alternatives, exact_line, first_of_part, first_suffices, folded_line, plain_text,
)
from rivulint.functions.matches import let, quoted
from rivulint.functions.text import (
    any_newlines, file_lines, read_lines, rtrim_white, trim_white, unix_newlines,
)
from rivulint.operators.detect import audit_language, scan_language
from rivulint.rules.fixed_values import (
    AUDIT_RULES, HELPER_CALL, HELPER_CALL_CONFIDENCE, SCAN_RULES, LineRule,
)
from rivulint.schema import as_findings


def rules_by_language(rules: list[LineRule]) -> dict[str, list[LineRule]]:
    groups: dict[str, list[LineRule]] = {}
    for rule in rules:
        for language in dict.fromkeys(rule.languages):
            groups.setdefault(language, []).append(rule)
    return groups


def _gate(text: str, gate: str) -> str:
    """SQL: does the (lower-case) text hold one of the gate's words?"""

    def all_of(words: str) -> str:
        return " and ".join(f"contains({text}, {quoted(w)})" for w in words.split("&"))

    return "(" + " or ".join(all_of(words) for words in gate.split("|")) + ")"


def any_gate(text: str, rules: list[LineRule]) -> str:
    if any(not r.gate for r in rules):
        return "true"
    words = dict.fromkeys(w for r in rules for w in r.gate.split("|"))
    # A word that contains another gate word can only occur where that one does.
    return _gate(text, "|".join(w for w in words if not any(o != w and o in w for o in words)))


def per_language(rules: list[LineRule], build, column: str = "language") -> str:
    cases = " ".join(
        f"when {quoted(name)} then {build(group)}"
        for name, group in rules_by_language(rules).items()
    )
    return f"case {column} {cases} end"


def rule_struct(rule: LineRule) -> str:
    def text(value: str | None) -> str:
        return "cast(null as string)" if value is None else quoted(value)

    return (
        f"named_struct('rule_id', {text(rule.rule_id)}, 'severity', {text(rule.severity)}, "
        f"'type', {text(rule.type)}, 'category', {text(rule.category)}, "
        f"'message', {text(rule.message)}, 'recommendation', {text(rule.recommendation)})"
    )


# Shipped rules with an open end, in a form that tries each line, or each part of it, once.
_STOPPED = {"A-PY-07": (")", "*"), "A-C-04": (";", "*"), "A-C-05": (";", "+")}


def _once_through(rule: LineRule) -> str:
    if rule.rule_id in _STOPPED:
        stop, repeat = _STOPPED[rule.rule_id]
        opening, rest = rule.pattern.split(f"[^{stop}]{repeat}")
        return first_of_part(opening, stop, rest, repeat)
    return first_suffices(rule.pattern)


LINEAR_PATTERNS = {r.pattern: _once_through(r) for r in (*AUDIT_RULES, *SCAN_RULES)}


def linear(pattern: str) -> str:
    """A shipped pattern in its linear form; any other as it is."""
    return LINEAR_PATTERNS.get(pattern, pattern)


NO_LINES = "array<struct<line:string,low:string>>"
# So many rules are tested by one array expression; a language with more has several.
RULES_PER_ARRAY = 100


def candidate_lines(
    files: DataFrame, rules: list[LineRule], file_hit: Column | None = None, lines_of=file_lines
) -> DataFrame:
    """(path, language, line, code, low) of the lines holding a gate word.

    ``files`` has path, language and LF-separated text, which ``lines_of`` splits.  Where
    ``file_hit`` holds, the file adds one row without code that stands for a finding on the
    file itself.
    """

    def gated(text: str) -> Column:
        return F.expr(per_language(rules, lambda group: any_gate(text, group)))

    lowered = files.select("path", "language", "text", F.lower("text").alias("text_low"))
    lines = F.when(
        gated("text_low"),
        F.arrays_zip(
            lines_of(F.col("text")).alias("line"), lines_of(F.col("text_low")).alias("low")
        ).cast(NO_LINES),
    )
    if file_hit is not None:
        none = F.array().cast(NO_LINES)
        itself = F.array(F.lit(None).cast("struct<line:string,low:string>"))
        lines = F.concat(
            F.coalesce(lines, none), F.when(file_hit, itself).otherwise(none)
        )
    split = lowered.select("path", "language", lines.alias("lines"))
    # The outer form keeps the optimizer from evaluating the array a second time in a filter.
    return (
        split.select("path", "language", F.posexplode_outer("lines").alias("pos", "one"))
        .select(
            "path", "language", (F.col("pos") + 1).cast("int").alias("line"),
            F.col("one").getField("line").alias("code"), F.col("one").getField("low").alias("low"),
        )
        .where(gated("low") | (F.col("line").isNotNull() & F.col("code").isNull()))
    )


def _searches(rule: LineRule) -> list[str]:
    """The patterns of which one must match, for an exact rule without a gate."""
    return alternatives(rule.pattern) if linear(rule.pattern) == rule.pattern else [rule.pattern]


def exact_matches(group: list[LineRule]) -> tuple[list[str], list[str]]:
    """(searches, tests): SQL of whether each case-sensitive rule matches the column code.

    Patterns with alternatives are searched one alternative at a time: plain text as such, and
    what several rules have in common once, as ``searches``, whose results the tests take from
    an array named shared.
    """
    each = [[] if rule.gate else _searches(rule) for rule in group]
    uses: dict[str, int] = {}
    for parts in each:
        for part in dict.fromkeys(parts):
            if plain_text(part) is None:
                uses[part] = uses.get(part, 0) + 1
    shared = {part: at for at, part in enumerate(p for p, n in uses.items() if n > 1)}

    def search(part: str) -> str:
        return f"code rlike {quoted(exact_line(linear(part)))}"

    def test(part: str) -> str:
        if part in shared:
            return f"get(shared, {shared[part]})"
        text = plain_text(part)
        return search(part) if text is None else f"contains(code, {quoted(text)})"

    tests = [
        f"{_gate('low', rule.gate)} and {search(rule.pattern)}" if rule.gate
        else "(" + " or ".join(test(p) for p in sorted(parts, key=lambda p: p not in shared)) + ")"
        for rule, parts in zip(group, each)]
    return [search(part) for part in shared], tests


def joined(found: list[str]) -> str:
    """SQL of one array of the entries."""
    arrays = [f"array({', '.join(found[at:at + RULES_PER_ARRAY])})"
              for at in range(0, len(found), RULES_PER_ARRAY)]
    return f"concat({', '.join(arrays)})" if len(arrays) > 1 else arrays[0]


def exact_hits(group: list[LineRule], entry=rule_struct) -> str:
    """SQL of an array with the entry of each case-sensitive rule that matches, else null."""
    searches, tests = exact_matches(group)
    found = joined([f"case when {test} then {entry(rule)} end"
                    for rule, test in zip(group, tests)])
    return let(f"array({', '.join(searches)})", "shared", found) if searches else found


def matching_rules(rules: list[LineRule], dialect, once: bool = False) -> str:
    """SQL of the array of rules that match the columns code and low in a language."""

    def hits(group: list[LineRule]) -> str:
        if dialect is exact_line and not once:
            return exact_hits(group)
        found = []
        for i, rule in enumerate(group):
            tests = [_gate("low", rule.gate)] if rule.gate else []
            tests.append(f"code rlike {quoted(dialect(linear(rule.pattern)))}")
            tests += [
                f"not code rlike {quoted(dialect(linear(earlier.pattern)))}" for earlier in group[:i]
                if once and (earlier.message, earlier.type) == (rule.message, rule.type)
            ]
            found.append(f"case when {' and '.join(tests)} then {rule_struct(rule)} end")
        return joined(found)

    return f"array_compact({per_language(rules, hits)})"


def line_hits(
    lines: DataFrame, rules: list[LineRule], dialect, file_rule: LineRule | None = None,
    once: bool = False,
) -> DataFrame:
    """One row per line and matching rule: the line's columns plus the rule's.

    With ``once``, of rules with equal message and type only the first in the list to match a
    line reports it.  Any number of rules is one projection over one read of the lines.
    """

    found = matching_rules(rules, dialect, once)
    if file_rule is not None:
        found = f"case when code is null then array({rule_struct(file_rule)}) else {found} end"
    return (
        lines.select("path", "language", "line", "code", "low", F.expr(found).alias("hits"))
        .select("path", "language", "line", "code", "low", F.inline_outer("hits"))
        .where(F.col("rule_id").isNotNull())
    )


def confidence(severity: Column, code: Column, low: Column) -> Column:
    """How sure a scan finding is, from its severity and what its line mentions."""
    base = F.when(F.lower(severity).isin("critical", "high"), 90).otherwise(75)
    exposed = code.contains("$_") | low.contains("request") | low.contains("user")
    raised = base + F.when(exposed, 5).otherwise(0)
    return (
        F.when(code.contains("TODO"), F.greatest(F.lit(60), raised - 10))
        .otherwise(raised)
        .cast("int")
    )


def reported_lines(
    texts: DataFrame, rules: list[LineRule], dialect, before: int, after: int,
    on_file: Column | None = None,
) -> DataFrame:
    """path, line, first and block: each line a rule matches, with the lines around it.

    ``texts`` has path, language and LF-separated text.  The block is cut in the file's own row,
    for lines holding a gate word; of these only the ones that are hit go on.  Where
    ``on_file`` holds, line 1 is reported in any case.
    """
    named = on_file if on_file is not None else F.lit(False)
    lowered = texts.select("path", "language", "text", F.lower("text").alias("text_low"),
                           F.coalesce(named, F.lit(False)).alias("on_file"))
    wanted = F.expr(per_language(rules, lambda group: any_gate("text_low", group))) | F.col("on_file")
    split = lowered.select("path", "language", "on_file", *[
        F.when(wanted, read_lines(F.col(c))).alias(name)
        for c, name in (("text", "codes"), ("text_low", "lows"))])
    gate = per_language(rules, lambda group: any_gate("l", group))
    block = (f"slice(codes, greatest(1, i + 1 - {before}), "
             f"{after} + 1 + least({before}, i))")
    candidates = F.expr(
        f"array_compact(transform(lows, (l, i) -> case when {gate} or (on_file and i = 0) then "
        "named_struct('line', i + 1, 'code', get(codes, i), 'low', l, "
        f"'first', greatest(1, i + 1 - {before}), 'block', {block}) end))")
    rows = split.select("path", "language", "on_file", F.inline_outer(candidates)).where(
        F.col("line").isNotNull())
    hit = F.expr(f"size({matching_rules(rules, dialect)}) > 0")
    return rows.where(F.coalesce(hit, F.lit(False)) | (F.col("on_file") & (F.col("line") == 1))
                      ).select("path", "line", "first", "block")


def audit_text(files: DataFrame) -> DataFrame:
    """(path, language, text) of the files with a mapped suffix."""
    return files.select(
        "path", audit_language(F.col("path")).alias("language"),
        unix_newlines(F.col("content")).alias("text"),
    ).where(F.col("language").isNotNull())


def audit_findings(files: DataFrame, rules: list[LineRule] = AUDIT_RULES) -> DataFrame:
    """The case-sensitive profile over (path, content): every rule reports every line it hits."""
    if not rules_by_language(rules):
        files, rules = files.where(F.lit(False)), AUDIT_RULES
    lines = candidate_lines(audit_text(files), rules, lines_of=read_lines)
    hits = line_hits(lines, rules, exact_line)
    return as_findings(
        hits.withColumn("snippet", rtrim_white(F.col("code"))), "audit"
    )


def scan_text(files: DataFrame) -> DataFrame:
    """(path, language, text) of the files whose language is known."""
    return files.select(
        "path", scan_language(F.col("path"), F.col("content")).alias("language"),
        any_newlines(F.col("content")).alias("text"),
    ).where(F.col("language") != "Unknown")


def calls_helper(content: Column) -> Column:
    """True where a Python text calls a command helper (case-sensitive, anywhere)."""
    mentioned = F.lit(False)
    for call in (".system", ".popen", ".call", ".Popen"):
        mentioned = mentioned | content.contains(call)
    return mentioned & content.rlike(HELPER_CALL.pattern.replace(r"\b", r"(?U:\b)"))


def scan_findings(
    files: DataFrame, rules: list[LineRule] = SCAN_RULES, file_rule: bool = True
) -> DataFrame:
    """The case-insensitive profile over (path, content), in one pass.

    A finding is kept once per (file, line, message, type).  Such keys can only meet on one
    line, so ``line_hits`` settles that and no shuffle is needed.
    """
    text = scan_text(files)
    on_file = None
    if file_rule:
        on_file = (F.col("language") == "Python") & calls_helper(F.col("text"))
    lines = candidate_lines(text, rules, on_file, read_lines)
    hits = line_hits(lines, rules, folded_line, HELPER_CALL if file_rule else None, once=True)
    itself = F.col("code").isNull()
    return as_findings(
        hits.select(
            "path", "language", "rule_id", "severity", "type", "category", "message",
            "recommendation",
            F.when(itself, 1).otherwise(F.col("line")).alias("line"),
            F.when(itself, "").otherwise(trim_white(F.col("code"))).alias("snippet"),
            F.when(itself, HELPER_CALL_CONFIDENCE)
            .otherwise(confidence(F.col("severity"), F.col("code"), F.col("low")))
            .alias("confidence"),
        ),
        "scan",
    )


def helper_call_findings(files: DataFrame) -> DataFrame:
    """Only the file-level findings of the scan profile."""
    rows = scan_text(files).where(
        (F.col("language") == "Python") & calls_helper(F.col("text"))
    )
    return as_findings(
        rows.select(
            "path", "language", F.lit(1).alias("line"), F.lit("").alias("snippet"),
            F.lit(HELPER_CALL_CONFIDENCE).alias("confidence"),
            F.expr(f"inline(array({rule_struct(HELPER_CALL)}))"),
        ),
        "scan",
    )
