"""Whole-file PHP checks: every match of a pattern in a file, located by line.

All checks of a file are one array expression over its text, so the profile is a single
narrow pass.  Cheap text gates stand in front of every regular expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulint.functions.dialect import marked_part, whole_file
from rivulint.functions.matches import (
    LF, SPLIT_MARK, groups_of, has_mark, let, line_after, mark_matches, mark_parts, match_lines,
    quoted, searchable, surroundings,
)
from rivulint.functions.text import (
    WHITE, file_lines, newline_count, trim_white, unix_newlines,
)
from rivulint.operators.detect import review_files
from rivulint.rules import fixed_values as fv
from rivulint.schema import as_findings

HIT = "struct<rule_id:string,line:int,match_no:int,word:string,severity:string>"
SNIPPET_WIDTH = 300
ALL_CHECKS = [f"RV-{n:02d}" for n in range(1, 24)]
NO_LINES = "cast(array() as array<int>)"


def _hit(rule_id, line, number="1", word="''", severity="cast(null as string)") -> str:
    return (
        f"named_struct('rule_id', {quoted(rule_id)}, 'line', {line}, 'match_no', {number}, "
        f"'word', {word}, 'severity', {severity})"
    )


def _any(text: str, *words: str) -> str:
    # A word that contains another of them can only occur where that one does.
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    return "(" + " or ".join(f"contains({text}, {quoted(w)})" for w in needed) + ")"


def _per_match(rule_id, pattern, *, group=None, word=None, keep=None, window=None,
               severity=None, mark=mark_matches) -> str:
    """Hits for every match of a pattern in ``code``.

    ``group`` is the capture group giving the word and ``word`` an expression over it (``w``)
    or, without a group, the word itself; ``keep`` is a test on the match text ``t`` (on the
    window around the match when one is given as (before, after, shortest match));
    ``severity`` is an expression over the second group ``v``; ``mark`` puts the marks.
    """
    arrays = {"line": match_lines("marked")}
    if group is not None:
        arrays["w"] = groups_of("code", pattern, group)
    if severity is not None:
        arrays["v"] = groups_of("code", pattern, 2)
    if window is not None:
        arrays["t"] = surroundings("marked", *window)
    elif keep is not None:
        arrays["t"] = groups_of("code", pattern, 0)
    names = list(arrays)
    if len(names) == 1:
        items = f"transform({arrays['line']}, l -> named_struct('line', l))"
    else:
        items = "arrays_zip(" + ", ".join(arrays.values()) + ")"
    fields = ", ".join(f"'{n}', it" + (".line" if len(names) == 1 else f".`{i}`")
                       for i, n in enumerate(names))
    items = f"transform({items}, (it, ix) -> named_struct('no', ix + 1, {fields}))"
    if keep is not None:
        items = f"filter({items}, m -> {keep('m.t')})"
    found = quoted("") if word is None else word
    if group is not None:
        found = "m.w" if word is None else word("m.w")
    rank = "cast(null as string)" if severity is None else severity("m.v")
    hits = f"transform({items}, m -> {_hit(rule_id, 'm.line', 'm.no', found, rank)})"
    return let(
        mark("code", pattern), "marked",
        f"case when {has_mark('marked')} then {hits} end",
    )


def _matches(text: str, pattern: str) -> str:
    return f"({text} rlike {quoted(pattern)})"


def _function_call(names: list[str], flags: str = "") -> str:
    starts = "".join(dict.fromkeys(n[0] for n in names))
    return whole_file(fv.NB + "(" + "|".join(names) + r")\s*\(", flags, starts)


def _sql_checks(wanted: set[str]) -> str:
    """RV-01 on the first match of a line; RV-02 on lines without it, unless prepared."""
    direct = whole_file(fv.REVIEW_PATTERNS["RV-01"], "is", "siudr")
    dynamic = whole_file(fv.REVIEW_PATTERNS["RV-02"], "is", "siudr")
    first = f"array_distinct({match_lines(mark_matches('code', direct))})"
    pairs = f"arrays_zip({match_lines('dyn')}, {surroundings('dyn', 200, 400, 8)})"
    # The fields of arrays_zip over expressions are named 0, 1, ...
    unprepared = (
        f"array_distinct(transform(filter({pairs}, p -> not (contains(p.`1`, 'prepare(') "
        "and contains(p.`1`, 'bind_param'))), p -> p.`0`))"
    )
    second = let(
        mark_matches("code", dynamic), "dyn",
        f"case when {has_mark('dyn')} then array_except({unprepared}, direct_lines) "
        f"else {NO_LINES} end",
    )
    parts = []
    if "RV-01" in wanted:
        parts.append(f"transform(direct_lines, n -> {_hit('RV-01', 'n')})")
    if "RV-02" in wanted:
        parts.append(f"transform({second}, n -> {_hit('RV-02', 'n')})")
    return let(first, "direct_lines", f"concat({', '.join(parts)})")


def _command_check(name: str) -> str:
    """RV-06 for one function: its first call with request data and ``)`` later in the file.

    The greedy pattern runs to the last ``)``, so a file has at most one match, and it starts
    at the first call whenever there is one.
    """
    call = f"(?dUi-u:(?=[{name[0]}{name[0].upper()}]){fv.NB}{name}" + r"\s*\()"
    split_at_call = quoted(f"(?s)^(.*?){call}(.*)$")
    # Request data with a ``)`` somewhere behind it: request data before the last ``)``.
    # Searching for the two together would run to the end of the file at every variable.
    before_last = "left(rest, length(rest) - length(substring_index(rest, ')', -1)) - 1)"
    reached = let(
        f"regexp_extract(text, {split_at_call}, 2)", "rest",
        _matches(before_last, whole_file(fv.REQ, "i")),
    )
    hit = _hit("RV-06", line_after("prefix"), word=quoted(name))
    return let(
        f"regexp_extract(text, {split_at_call}, 1)", "prefix",
        f"case when {reached} then array({hit}) end",
    )


def _csrf_check() -> str:
    """RV-21: at most one per file, at the first complete form tag, else on line 1."""
    opening, method = fv.REVIEW_PATTERNS["RV-21"].split("[^>]*")
    anywhere, complete = (
        whole_file(marked_part(opening, ">", method, closed), "i") for closed in (False, True))
    line = let(mark_parts("code", complete), "marked",
               f"case when {has_mark('marked')} then "
               f"{line_after(f'substring_index(marked, {SPLIT_MARK}, 1)')} else 1 end")
    return (
        f"case when {_matches('code', anywhere)} and not contains(low, 'csrf') "
        f"then array({_hit('RV-21', line)}) end"
    )


def next_statement(lines: str, index: str, reach: int = 3) -> str:
    """The first line that is no blank and no comment among the ``reach`` after 0-based index."""
    strip = quoted(f"^{WHITE}+|{WHITE}+$")
    ahead = (
        f"transform(slice({lines}, {index} + 2, {reach}), s -> regexp_replace(s, {strip}, ''))"
    )
    return (
        f"get(filter({ahead}, s -> s != '' and not startswith(s, '//') "
        "and not startswith(s, '#')), 0)"
    )


def _redirect_check() -> str:
    """RV-23: a Location header whose next statement within three lines is no exit or die."""
    header = whole_file(fv.REVIEW_PATTERNS["RV-23"], "i")
    numbered = (
        f"transform(lines, (s, i) -> case when {_matches('s', header)} then "
        f"named_struct('line', i + 1, 'next', {next_statement('lines', 'i')}) end)"
    )
    ended = f"coalesce({_matches('x.next', whole_file(fv.EXIT_CALL))}, false)"
    open_ones = f"filter(array_compact({numbered}), x -> not {ended})"
    return let(
        f"split(text, {LF}, -1)", "lines",
        f"transform({open_ones}, x -> {_hit('RV-23', 'x.line')})",
    )


def check_arrays(wanted: set[str]) -> list[str]:
    """SQL of one array of hits (or NULL) per check, over the columns of ``review_text``."""
    req = "req"
    texts = fv.REVIEW_PATTERNS
    every: list[str] = []

    def add(rule_id: str, gate: str, hits: str) -> None:
        if rule_id in wanted:
            every.append(f"case when {gate} then {hits} end")

    def simple(rule_id: str, gate: str, flags: str, starts: str = "", **more) -> None:
        add(rule_id, gate,
            _per_match(rule_id, whole_file(texts[rule_id], flags, starts), **more))

    if wanted & {"RV-01", "RV-02"}:
        gate = _any("low", "select", "insert", "update", "delete", "replace", "union")
        every.append(f"case when contains(low, '$') and {gate} then {_sql_checks(wanted)} end")
    safe = whole_file(fv.XSS_SAFE, "i")
    simple("RV-03", f"{req} and {_any('low', 'echo', 'print')}", "i", "ep",
           keep=lambda t: f"not {_matches(t, safe)}")
    simple("RV-04", f"{req} and contains(low, '<?=')", "i")
    add("RV-05", _any("text", *fv.DANGEROUS_FUNCS),
        _per_match("RV-05", _function_call(fv.DANGEROUS_FUNCS), group=1))
    for name in fv.COMMAND_FUNCS:
        add("RV-06", f"{req} and contains(low, '{name}')", _command_check(name))
    add("RV-07", "contains(text, 'mysql_')",
        _per_match("RV-07", _function_call(fv.REMOVED_MYSQL_FUNCS), group=1))
    add("RV-08", _any("low", *fv.REMOVED_FUNCS),
        _per_match("RV-08", _function_call(list(fv.REMOVED_FUNCS), "i"), group=1,
                   word=lambda w: f"lower({w})"))
    simple("RV-09", f"{req} and {_any('low', 'include', 'require')}", "i", "ir", group=1)
    simple("RV-10", f"{req} and contains(low, 'location:')", "i", "h")
    for name in fv.FILE_FUNCS:
        opening = f"(?=[{name[0]}{name[0].upper()}]){fv.NB}{name}" + r"\s*\("
        pattern = whole_file(marked_part(opening, ")", fv.REQ, True), "i")
        add("RV-11", f"{req} and contains(low, '{name}') and {_any('text', '..', 'dirname')}",
            _per_match("RV-11", pattern, word=quoted(name), window=(0, 150, len(name) + 7),
                       keep=lambda w: _any(w, "..", "dirname"), mark=mark_parts))
    password = whole_file(fv.PASSWORD_WORD, "i")
    simple("RV-12", f"{_any('low', 'md5', 'sha1')} and {_any('low', 'pass', 'pwd')}", "i", "ms",
           group=1, window=(0, 120, 4), keep=lambda w: _matches(w, password))
    simple("RV-13", "contains(low, '$row') and contains(low, '==')", "i", "=$")
    simple("RV-14", "contains(text, '@')", "")
    add("RV-15", _any("text", *fv.DEBUG_FUNCS),
        _per_match("RV-15", _function_call(fv.DEBUG_FUNCS), group=1))
    placeholders = ", ".join(quoted(p) for p in fv.PLACEHOLDER_SECRETS)
    simple("RV-16", _any("low", "pass", "pwd", "secret", "key", "token"), "i", "psa", group=1,
           severity=lambda v: f"case when lower({v}) in ({placeholders}) then 'LOW' end")
    simple("RV-17", _any("low", "encrypt", "secret"), "im")
    token = whole_file(fv.TOKEN_WORD, "i")
    add("RV-18", f"{_any('text', 'rand', 'uniqid')} and "
        f"{_any('low', 'token', 'pass', 'secret', 'api', 'auth')}",
        _per_match("RV-18", _function_call(fv.WEAK_RANDOM_FUNCS), group=1, window=(80, 80, 5),
                   keep=lambda w: _matches(w, token)))
    simple("RV-19", f"{req} and contains(low, 'extract')", "i", "e")
    opening = texts["RV-20"].split(r"\s*[^)]*")[0]
    add("RV-20", f"{req} and contains(low, 'unserialize')",
        _per_match("RV-20", whole_file(marked_part(opening, ")", fv.REQ, False), "i"),
                   mark=mark_parts))
    add("RV-21", "contains(low, '<form') and contains(low, 'post')", _csrf_check())
    validator = whole_file(fv.UPLOAD_VALIDATOR, "i")
    simple("RV-22", "contains(text, 'move_uploaded_file')", "", window=(600, 200, 19),
           keep=lambda w: f"not {_matches(w, validator)}")
    add("RV-23", "contains(low, 'header') and contains(low, 'location:')", _redirect_check())
    return every


def review_text(files: DataFrame) -> DataFrame:
    """The PHP files the profile reads, newlines unified.

    ``low`` is the lower-case text for gates, ``code`` the text as patterns see it, ``req``
    whether a request variable can occur.
    """
    return (
        review_files(files)
        .select("path", unix_newlines(F.col("content")).alias("text"))
        .selectExpr("path", "text", "lower(text) as low", f"{searchable('text')} as code")
        .selectExpr("*", "contains(low, '$_') as req")
    )


# Rows of this kind carry the name of a function their file defines; they are no findings.
DEFINITION = "DEFINES"


def defined_names() -> str:
    """SQL of the distinct function names a file defines."""
    pattern = whole_file(fv.REVIEW_PATTERNS["RV-24"], "", "f")
    return f"array_distinct({groups_of('code', pattern, 1)})"


def definition_hits() -> str:
    """SQL of a row of its own for every function a file defines."""
    names = f"transform({defined_names()}, n -> {_hit(DEFINITION, '0', word='n')})"
    return f"case when contains(text, 'function') then {names} end"


def file_hits(files: DataFrame, checks=None, definitions: bool = False) -> DataFrame:
    """Per file: path, number of lines, its lines where any check hit, and the hits.

    With ``definitions`` the functions a file defines come along as rows of their own.
    """
    arrays = check_arrays(set(ALL_CHECKS if checks is None else checks))
    if definitions:
        arrays.append(definition_hits())
    hits = f"flatten(array_compact(array({', '.join(arrays)})))"
    return (
        review_text(files)
        .select(
            "path", "text",
            F.expr(f"cast({hits} as array<{HIT}>)").alias("hits"),
        )
        .select(
            "path",
            # An unreadable file counts as scanned, with no lines.
            F.coalesce(newline_count(F.col("text")) + 1, F.lit(0)).cast("bigint").alias(
                "n_lines"
            ),
            F.when(F.size("hits") > 0, file_lines(F.col("text"))).alias("lines"),
            "hits",
        )
    )


def hit_rows(per_file: DataFrame) -> DataFrame:
    """One row per hit; a file without any keeps one row with rule_id NULL.

    The file's line count rides on its first row only.
    """
    rows = per_file.select(
        "path", "n_lines", "lines", F.posexplode_outer("hits").alias("pos", "hit")
    )
    # No line for a hit on the file itself (line 0).
    code = F.get("lines", F.col("hit.line") - 1)
    return rows.select(
        "path",
        F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("n_lines")).alias("n_lines"),
        "hit.*",
        F.coalesce(F.substring(trim_white(code), 1, SNIPPET_WIDTH), F.lit("")).alias("snippet"),
    )


def describe(rows: DataFrame, *keep: str) -> DataFrame:
    """Rule texts for hit rows."""
    names = ("severity", "category", "message", "fix")
    texts = ", ".join(
        f"'{rule_id}', named_struct("
        + ", ".join(f"'{n}', {quoted(t)}" for n, t in zip(names, about)) + ")"
        for rule_id, about in fv.REVIEW_TEXTS.items()
    )
    versions = ", ".join(f"'{name}', '{since}'" for name, since in fv.REMOVED_FUNCS.items())
    version = f"coalesce(try_element_at(map({versions}), word), '')"

    def filled(template: str) -> str:
        with_word = f"replace({template}, '{{0}}', word)"
        return (
            f"case when rule_id = 'RV-08' then replace({with_word}, '{{1}}', {version}) "
            f"else {with_word} end"
        )

    return rows.selectExpr("*", f"try_element_at(map({texts}), rule_id) as about").selectExpr(
        "path", "line", "rule_id", "match_no", "snippet", "'PHP' as language",
        "coalesce(severity, about.severity) as severity", "about.category as category",
        f"{filled('about.message')} as message", f"{filled('about.fix')} as recommendation",
        *keep,
    )


def check_findings(files: DataFrame, checks=None) -> DataFrame:
    """Findings of the per-file checks (all, or the named ones)."""
    rows = hit_rows(file_hits(files, checks)).where(F.col("rule_id").isNotNull())
    return as_findings(describe(rows), "review")
