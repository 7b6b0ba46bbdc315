"""SQL that computes the registered queries' results independently, for an outside engine."""

from __future__ import annotations

import re

from rivulint.functions.text import WHITE
from rivulint.rules import fixed_values as fv
from rivulint.sources.corpus import FOLDERS, PAGE_SNIPPET, SNIPPETS

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def lit(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    def one(v):
        return str(v) if isinstance(v, int) else lit(v)

    return "VALUES " + ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


def compose(select: str, *needed: str) -> str:
    """A select with the common table expressions it needs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        body, deps = CTES[name]
        for dep in deps:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needed:
        visit(name)
    if not order:
        return select
    return "WITH " + ",\n".join(CTES[n][0] for n in order) + "\n" + select


def cte(name: str, columns: str, body: str, *deps: str) -> None:
    CTES[name] = (f"{name}{columns} AS ({body})", deps)


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def rstrip(text: str) -> str:
    return f"regexp_replace({text}, '{WHITE}+$', '')"


def newlines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')))"


def rank(severity: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in fv.SEVERITY_RANK.items())
    return f"CAST(CASE {severity} {cases} ELSE {fv.UNKNOWN_SEVERITY_RANK} END AS INTEGER)"


def pruned(path: str, dirs: list[str]) -> str:
    names = "|".join(d.replace(".", r"\.") for d in dirs)
    return f"regexp_matches({path}, '(^|/)({names})/')"


EXT = r"lower(regexp_extract(path, '(\.[^./]+)$', 1))"
SUFFIX = r"lower(regexp_extract(path, '[^/](\.[^./]+)$', 1))"
AUDIT_LANGUAGE = f"CASE {SUFFIX} " + " ".join(
    f"WHEN '{e}' THEN '{n}'" for e, n in fv.AUDIT_EXTENSIONS.items()) + " END"


def scan_language(content: str = "content") -> str:
    known = " ".join(
        f"WHEN {EXT} IN ({', '.join(lit(e) for e in exts)}) THEN '{name}'"
        for name, exts in fv.SCAN_EXTENSIONS.items())
    sniffs = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({content}), {lit(m)})" for m in marks)
        + f" THEN '{name}'" for name, marks in fv.SNIFF_MARKERS.items())
    return f"CASE {known} {sniffs} ELSE 'Unknown' END"


cte("snippets", "(sid, ext, snippet)", values(
    (i, ext, text) for i, (ext, text) in enumerate(SNIPPETS)))
cte("folders", "(fid, folder)", values(enumerate(FOLDERS)))
cte("code_files", "", """
SELECT 'repo' || (doc_id % 7) || '/' || folder || '/f' || doc_id || ext AS path,
       snippet || chr(10) || text || chr(10) || snippet || chr(10) AS content, source, doc_id
FROM documents JOIN snippets ON doc_id % 13 = sid JOIN folders ON doc_id % 10 = fid""",
    "snippets", "folders")
cte("page_files", "",
    f"SELECT url || '.html' AS path, html || {lit(PAGE_SNIPPET)} AS content FROM pages")
cte("php_files", "", f"""
SELECT path, content, string_split(content, chr(10)) AS lines FROM code_files
WHERE lower(path) LIKE '%.php' AND NOT {pruned('path', fv.REVIEW_PRUNED_DIRS)}""", "code_files")
cte("scan_files", "", f"""
SELECT * FROM code_files WHERE NOT {pruned('path', fv.SCAN_PRUNED_DIRS)}""", "code_files")


def _lines(name: str, files: str, language: str, pattern_split: str) -> None:
    cte(name, "", f"""
SELECT path, language, CAST(line AS INTEGER) AS line, code FROM (
  SELECT path, language, len(parts) AS n, unnest(parts) AS code,
         generate_subscripts(parts, 1) AS line
  FROM (SELECT path, {language} AS language, {pattern_split} AS parts FROM {files}))
WHERE NOT (line = n AND code = '')""", files)


LF_SPLIT = "string_split(content, chr(10))"
ANY_SPLIT = r"string_split_regex(content, '\r\n|[\n\x0b\x0c\r\x{85}\x{2028}\x{2029}]')"
_lines("audit_lines", "code_files", AUDIT_LANGUAGE, LF_SPLIT)
_lines("scan_lines", "scan_files", scan_language(), ANY_SPLIT)
_lines("all_scan_lines", "code_files", scan_language(), ANY_SPLIT)
_lines("page_lines", "page_files", scan_language(), ANY_SPLIT)

RULE_COLUMNS = ("(rule_id, rule_language, pattern, severity, type, category, message, "
                "recommendation)")


def rule_rows(rules, prefix=""):
    return [(r.rule_id, lang, prefix + r.pattern, r.severity.upper(), r.type, r.category,
             r.message, r.recommendation) for r in rules for lang in sorted(set(r.languages))]


cte("audit_rules", RULE_COLUMNS, values(rule_rows(fv.AUDIT_RULES)))
cte("scan_rules", RULE_COLUMNS, values(rule_rows(fv.SCAN_RULES, "(?i)")))

FIELDS = ("profile, path, line, rule_id, severity, severity_rank, type, category, language, "
          "message, snippet, recommendation, confidence")


def _hits(name: str, lines: str, rules: str, profile: str, snippet: str, sure: str) -> None:
    cte(name, "", f"""
SELECT '{profile}' AS profile, path, line, rule_id, severity, {rank('severity')} AS severity_rank,
       type, CAST(category AS VARCHAR) AS category, language, message, {snippet} AS snippet,
       CAST(recommendation AS VARCHAR) AS recommendation,
       CAST({sure} AS INTEGER) AS confidence
FROM {lines} JOIN {rules} ON language = rule_language AND regexp_matches(code, pattern)""",
        lines, rules)


BASE = ("(CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 90 ELSE 75 END + CASE WHEN "
        "contains(code, '$_') OR contains(lower(code), 'request') OR "
        "contains(lower(code), 'user') THEN 5 ELSE 0 END)")
CONFIDENCE = f"CASE WHEN contains(code, 'TODO') THEN greatest(60, {BASE} - 10) ELSE {BASE} END"


def _flagged(rules, always: str = ""):
    """Rows of (rule, flags) in the order they are tried."""
    rows = []
    for at, (rule, flags) in enumerate(rules):
        pattern = rule.pattern
        if "x" in flags:  # RE2 has no comments mode
            pattern = re.sub(r"\s+|#.*", "", pattern)
        kept = "".join(dict.fromkeys(always + flags)).replace("x", "")
        pattern = f"(?{kept})" + pattern if kept else pattern
        rows += [(rule.rule_id, lang, pattern, rule.severity.upper(), rule.type, rule.category,
                  rule.message, rule.recommendation, at) for lang in sorted(set(rule.languages))]
    return rows


RANKED_COLUMNS = RULE_COLUMNS[:-1] + ", ordinal)"


def user_rules(rules) -> None:
    """Findings of a rule table over the lines of the case-sensitive profile."""
    cte("user_rules", RANKED_COLUMNS, values(_flagged(rules)))
    _hits("user_findings", "audit_lines", "user_rules", "audit", rstrip("code"), "NULL")


def flagged_rules(audit_rules, scan_rules) -> None:
    """Findings of those and of rules with flags and in the scan manner."""
    cte("user_flagged_rules", RANKED_COLUMNS, values(_flagged(audit_rules)))
    _hits("user_flagged_findings", "audit_lines", "user_flagged_rules", "audit", rstrip("code"),
          "NULL")
    cte("user_scan_rules", RANKED_COLUMNS, values(_flagged(scan_rules, "i")))
    cte("user_scan_lines", "", """
SELECT * FROM scan_lines JOIN user_scan_rules
  ON language = rule_language AND regexp_matches(code, pattern)
QUALIFY row_number() OVER (PARTITION BY path, line, message, type ORDER BY ordinal) = 1""",
        "scan_lines", "user_scan_rules")
    cte("user_scan_findings", "", f"""
SELECT 'scan' AS profile, path, line, rule_id, severity, {rank('severity')} AS severity_rank,
       type, CAST(category AS VARCHAR) AS category, language, message, {strip('code')} AS snippet,
       CAST(recommendation AS VARCHAR) AS recommendation,
       CAST({CONFIDENCE} AS INTEGER) AS confidence FROM user_scan_lines""", "user_scan_lines")
    cte("every_user_finding", "", """
SELECT * FROM user_findings UNION ALL SELECT * FROM user_flagged_findings
UNION ALL SELECT * FROM user_scan_findings""",
        "user_findings", "user_flagged_findings", "user_scan_findings")


def word_rules(rules) -> None:
    """Findings of rules that are whole words: an equality of words instead of patterns."""
    cte("word_rules", "(rule_id, rule_language, word, message)", values(
        (r.rule_id, lang, r.pattern.replace(r"\b", ""), r.message)
        for r in rules for lang in r.languages))
    cte("word_findings", "", r"""
SELECT DISTINCT path, line, rule_id, message FROM (
  SELECT path, language, line, unnest(regexp_extract_all(code, '[\p{L}\p{M}\p{N}_]+')) AS word
  FROM audit_lines) l JOIN word_rules r ON r.rule_language = l.language AND r.word = l.word""",
        "audit_lines", "word_rules")


_hits("audit_findings", "audit_lines", "audit_rules", "audit", rstrip("code"), "NULL")
_hits("scan_line_findings", "scan_lines", "scan_rules", "scan", strip("code"), CONFIDENCE)
_hits("page_findings", "page_lines", "scan_rules", "scan", strip("code"), CONFIDENCE)

_h = fv.HELPER_CALL
cte("helper_findings", "", f"""
SELECT 'scan' AS profile, path, CAST(1 AS INTEGER) AS line, '{_h.rule_id}' AS rule_id,
       'HIGH' AS severity, CAST(1 AS INTEGER) AS severity_rank, '{_h.type}' AS type,
       {lit(_h.category)} AS category, 'Python' AS language, {lit(_h.message)} AS message,
       '' AS snippet, {lit(_h.recommendation)} AS recommendation,
       CAST({fv.HELPER_CALL_CONFIDENCE} AS INTEGER) AS confidence
FROM scan_files WHERE {scan_language()} = 'Python'
  AND regexp_matches(content, {lit(_h.pattern)})""", "scan_files")
cte("scan_findings", "",
    "SELECT * FROM scan_line_findings UNION ALL SELECT * FROM helper_findings",
    "scan_line_findings", "helper_findings")


# ---- whole-file checks ------------------------------------------------------------------
def matches(pattern: str, *groups: int) -> str:
    """path, content, lines, match_no, start_at, line, g0, g1.. of every match in php_files."""
    p = lit(pattern)
    extracted = "".join(
        f", regexp_extract_all(content, {p}, {g})[k - 1] AS g{g}" for g in (0, *groups))
    return f"""
SELECT path, content, lines, k - 1 AS match_no, length(prefix) AS start_at,
       CAST({newlines('prefix')} + 1 AS INTEGER) AS line{extracted}
FROM (SELECT *, array_to_string(segs[1:k - 1], '') AS prefix
      FROM (SELECT *, unnest(range(2, len(segs) + 1)) AS k
            FROM (SELECT path, content, lines,
                         string_split(regexp_replace(content, {p}, chr(1) || '\\0', 'g'), chr(1))
                           AS segs FROM php_files)))"""


def around(before: int, after: int) -> str:
    start = f"greatest(start_at - {before}, 0)"
    return f"substring(content, {start} + 1, start_at + {after} - {start})"


def re2(pattern: str, flags: str = "") -> str:
    """No look-behind in RE2; its \\b is ASCII, so \\b before a name says the same as NB."""
    pattern = pattern.replace(fv.NB, r"\b")
    return (f"(?{flags})" if flags else "") + pattern


def finding(rule_id: str, source: str, word: str = "''", severity: str | None = None,
            version: str = "''") -> str:
    sev, category, message, fix = fv.REVIEW_TEXTS[rule_id]

    def filled(text: str) -> str:
        return f"replace(replace({lit(text)}, '{{0}}', {word}), '{{1}}', {version})"

    return f"""
SELECT path, line, '{rule_id}' AS rule_id, {severity or lit(sev)} AS severity,
       {lit(category)} AS category, {filled(message)} AS message,
       substring({strip('lines[line]')}, 1, 300) AS snippet, {filled(fix)} AS recommendation
FROM ({source})"""


def review_check(rule_id: str) -> str:
    """The check as stated: one search per function name, first-of-line by window."""
    p = fv.REVIEW_PATTERNS
    simple = {"RV-04": "i", "RV-10": "i", "RV-13": "i", "RV-14": "", "RV-17": "im",
              "RV-19": "i", "RV-20": "i"}
    if rule_id in simple:
        return finding(rule_id, matches(re2(p[rule_id], simple[rule_id])))
    calls = {"RV-05": fv.DANGEROUS_FUNCS, "RV-07": fv.REMOVED_MYSQL_FUNCS,
             "RV-15": fv.DEBUG_FUNCS}
    if rule_id in calls:
        return " UNION ALL ".join(
            finding(rule_id, matches(re2(fv.NB + f + r"\s*\(")), lit(f))
            for f in calls[rule_id])
    direct = re2(p["RV-01"], "is")
    first = "SELECT DISTINCT path, lines, line FROM ({})"
    if rule_id == "RV-01":
        return finding(rule_id, first.format(matches(direct)))
    if rule_id == "RV-02":
        return finding(rule_id, f"""
SELECT DISTINCT path, lines, line FROM ({matches(re2(p['RV-02'], 'is'))}) d
WHERE NOT (contains({around(200, 400)}, 'prepare(')
           AND contains({around(200, 400)}, 'bind_param'))
  AND NOT EXISTS (SELECT 1 FROM ({matches(direct)}) o
                  WHERE o.path = d.path AND o.line = d.line)""")
    if rule_id == "RV-03":
        return finding(rule_id, f"""
SELECT * FROM ({matches(re2(p['RV-03'], 'i'))})
WHERE NOT regexp_matches(g0, {lit('(?i)' + fv.XSS_SAFE)})""")
    if rule_id == "RV-06":
        return " UNION ALL ".join(
            finding(rule_id, matches(re2(fv.NB + f + r"\s*\(.*" + fv.REQ + r".*\)", "is")), lit(f))
            for f in fv.COMMAND_FUNCS)
    if rule_id == "RV-08":
        return " UNION ALL ".join(
            finding(rule_id, matches(re2(fv.NB + f + r"\s*\(", "i")), lit(f), version=lit(v))
            for f, v in fv.REMOVED_FUNCS.items())
    if rule_id == "RV-09":
        return finding(rule_id, matches(re2(p["RV-09"], "i"), 1), "g1")
    if rule_id == "RV-11":
        return " UNION ALL ".join(
            finding(rule_id, f"""
SELECT * FROM ({matches(re2(fv.NB + f + r'\s*\([^)]*' + fv.REQ + r'[^)]*\)', 'i'))})
WHERE contains({around(0, 150)}, '..') OR contains({around(0, 150)}, 'dirname')""", lit(f))
            for f in fv.FILE_FUNCS)
    if rule_id == "RV-12":
        return finding(rule_id, f"""
SELECT * FROM ({matches(re2(p['RV-12'], 'i'), 1)})
WHERE regexp_matches({around(0, 120)}, {lit('(?i)' + fv.PASSWORD_WORD)})""", "g1")
    if rule_id == "RV-16":
        held = ", ".join(lit(x) for x in fv.PLACEHOLDER_SECRETS)
        return finding(rule_id, matches(re2(p["RV-16"], "i"), 1, 2), "g1",
                       f"CASE WHEN lower(g2) IN ({held}) THEN 'LOW' ELSE 'MEDIUM' END")
    if rule_id == "RV-18":
        return " UNION ALL ".join(
            finding(rule_id, f"""
SELECT * FROM ({matches(re2(fv.NB + f + r'\s*\('))})
WHERE regexp_matches({around(80, 80)}, {lit('(?i)' + fv.TOKEN_WORD)})""", lit(f))
            for f in fv.WEAK_RANDOM_FUNCS)
    if rule_id == "RV-21":
        whole = lit("(?is)^(.*?)" + p["RV-21"] + "[^>]*>")
        return finding(rule_id, f"""
SELECT path, lines,
       CAST({newlines(f'regexp_extract(content, {whole}, 1)')} + 1 AS INTEGER) AS line
FROM php_files WHERE regexp_matches(content, {lit('(?i)' + p['RV-21'])})
  AND NOT regexp_matches(content, '(?i)csrf')""")
    if rule_id == "RV-22":
        return finding(rule_id, f"""
SELECT * FROM ({matches(re2(p['RV-22']))})
WHERE NOT regexp_matches({around(600, 200)}, {lit('(?i)' + fv.UPLOAD_VALIDATOR)})""")
    if rule_id == "RV-23":
        return finding(rule_id, f"""
SELECT path, lines, line FROM ({NEXT_STATEMENTS})
WHERE is_header AND NOT coalesce(regexp_matches(next_sig, {lit(fv.EXIT_CALL)}), false)""")
    raise KeyError(rule_id)


NEXT_STATEMENTS = f"""
SELECT path, lines, line, code, is_header,
       coalesce(lead(sig, 1) OVER w, lead(sig, 2) OVER w, lead(sig, 3) OVER w) AS next_sig
FROM (SELECT path, lines, line, code,
             regexp_matches(code, {lit('(?i)' + fv.REVIEW_PATTERNS['RV-23'])}) AS is_header,
             CASE WHEN t = '' OR starts_with(t, '//') OR starts_with(t, '#') THEN NULL ELSE t END
               AS sig
      FROM (SELECT *, {strip('code')} AS t
            FROM (SELECT path, lines, unnest(lines) AS code,
                         CAST(generate_subscripts(lines, 1) AS INTEGER) AS line
                  FROM php_files)))
WINDOW w AS (PARTITION BY path ORDER BY line)"""

_sev24, _cat24, _msg24, _fix24 = fv.REVIEW_TEXTS["RV-24"]
cte("function_files", "", f"""
SELECT DISTINCT name, path FROM (
  SELECT path, unnest(regexp_extract_all(content, {lit(fv.REVIEW_PATTERNS['RV-24'])}, 1)) AS name
  FROM php_files)""", "php_files")
cte("shared_functions", "", """
SELECT name, count(*) AS n_files, min(path) AS first_path,
       string_agg(path, ', ' ORDER BY path) AS files
FROM function_files GROUP BY name HAVING count(*) > 1""", "function_files")
RV24 = f"""
SELECT first_path AS path, CAST(0 AS INTEGER) AS line, 'RV-24' AS rule_id,
       '{_sev24}' AS severity, '{_cat24}' AS category,
       'function ' || name || '() defined in ' || n_files || ' files: ' || files || '.' AS message,
       '' AS snippet, {lit(_fix24)} AS recommendation
FROM shared_functions WHERE NOT starts_with(name, '__')"""
CHECK_IDS = [f"RV-{n:02d}" for n in range(1, 24)]
for _id in CHECK_IDS:
    cte("rv" + _id[3:], "", review_check(_id), "php_files")
cte("rv24", "", RV24, "shared_functions")
_ALL = ["rv" + i[3:] for i in CHECK_IDS] + ["rv24"]
cte("review_findings", "", f"""
SELECT 'review' AS profile, path, line, rule_id, severity, {rank('severity')} AS severity_rank,
       CAST(NULL AS VARCHAR) AS type, category, 'PHP' AS language, message, snippet,
       recommendation, CAST(NULL AS INTEGER) AS confidence
FROM ({' UNION ALL '.join(f'SELECT * FROM {n}' for n in _ALL)})""", *_ALL)
cte("all_findings", "", """
SELECT * FROM review_findings UNION ALL SELECT * FROM audit_findings
UNION ALL SELECT * FROM scan_findings""", "review_findings", "audit_findings", "scan_findings")
