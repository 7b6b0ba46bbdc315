"""Every registered query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulint.checks import sql as q
from rivulint.functions.dialect import whole_file
from rivulint.functions.matches import located_matches
from rivulint.functions.text import (
    any_newlines, base_name, decode_dropping, decode_replacing, extension, file_lines,
    html_escape, newline_count, read_lines, relative_path, rtrim_white, suffix, trim_white,
    unix_newlines,
)
from rivulint.operators import advice, analytics, combine, context, filters, rule_tables
from rivulint.operators.detect import (
    audit_files, audit_language, review_files, scan_extensions, scan_files, scan_language,
)
from rivulint.operators.duplicates import (
    defining_files, duplicate_function_findings, file_lists, function_definitions, list_texts,
    shared_names, stored_definitions,
)
from rivulint.operators.errors import review_read_errors, scan_read_errors
from rivulint.operators.file_checks import check_findings, next_statement, review_text
from rivulint.operators.line_rules import (
    audit_findings, confidence, helper_call_findings, scan_findings,
)
from rivulint.plans import profiles
from rivulint.rules import fixed_values as fv
from rivulint.session import shared_dir
from rivulint.sinks import reports
from rivulint.sources import tool_reports
from rivulint.sources.corpus import (
    FOLDERS, code_files, documents_as_code, page_files, reported_files, spread_code_files,
    with_read_errors,
)
from rivulint.sources.tree import tree_corpus
from rivulint.streaming import feeds
from rivulint.streaming import review as streamed_review

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None):
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return keep


def on_code(name: str, oracle: str | None, build: Callable[[DataFrame], DataFrame]) -> None:
    """A query over the corpus derived from the documents."""
    register(name, oracle)(lambda spark, sf_dir: build(code_files(spark, sf_dir)))


FINDING = ["path", "line", "rule_id", "severity", "severity_rank", "type", "category",
           "language", "message", "snippet", "recommendation", "confidence"]
FINDING_SQL = ", ".join(FINDING)
CHECK = ["path", "line", "rule_id", "severity", "category", "message", "snippet",
         "recommendation"]
CHECK_SQL = ", ".join(CHECK)
REVIEW, AUDIT, SCAN = "review_findings", "audit_findings", "scan_findings"
BIG = "CAST(count(*) AS BIGINT)"


def _digest(text):
    return F.md5(F.encode(text, "utf-8"))


# ---- sources and lines --------------------------------------------------------------------
on_code("src1_php_files", q.compose("SELECT path FROM php_files", "php_files"),
        lambda c: review_files(c).select("path"))
on_code("src2_mapped_files", q.compose(f"""
SELECT * FROM (SELECT path, {q.AUDIT_LANGUAGE} AS language FROM code_files)
WHERE language IS NOT NULL""", "code_files"),
        lambda c: audit_files(c).select("path", "language"))
on_code("src3_unpruned_files", q.compose("SELECT path FROM scan_files", "scan_files"),
        lambda c: scan_files(c).select("path"))
on_code("src4_sorted_files", q.compose("SELECT path FROM scan_files ORDER BY path", "scan_files"),
        lambda c: scan_files(c).select("path").orderBy("path"))


@register("src4_written_tree", q.compose(f"""
SELECT regexp_extract(path, '^repo[0-9]/(.*)/f', 1) AS folder, md5(content) AS digest
FROM code_files
WHERE NOT {q.pruned("regexp_extract(path, '^repo[0-9]/(.*/)f', 1)", fv.SCAN_PRUNED_DIRS)}""",
                                         "code_files"))
def _src4_tree(spark, sf_dir):
    """The corpus as a tree of text files, a digest of a file on each line, listed by its address."""
    root, folder = shared_dir(spark, "tree"), F.regexp_extract("path", "^repo[0-9]/(.*)/f", 1)
    files = code_files(spark, sf_dir).select(folder.alias("folder"), _digest("content").alias("value"))
    for name in sorted(set(FOLDERS)):
        files.where(F.col("folder") == name).select("value").write.text(f"{root}/{name}")
    found = tree_corpus(
        spark, root if "://" in root else f"file://{root}", fv.SCAN_PRUNED_DIRS,
        keep=lambda listing: listing.where(F.col("path").endswith(".txt")))
    return found.select(
        F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder"),
        F.explode(read_lines(F.col("content"))).alias("digest"))


def _damaged(spark, sf_dir):
    """Document bytes with bad bytes, CRLF, a lone CR and a genuine U+FFFD added."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", F.concat(
        F.encode("text", "utf-8"), F.lit(bytearray(b"\x80a\xff\r\nb\rc")),
        F.encode(F.lit("�"), "utf-8"),
    ).alias("data"))


_DECODED = """
SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS n_chars
FROM (SELECT doc_id, text || {tail} AS t FROM documents)"""


@register("src5_decode_replacing", _DECODED.format(
    tail="chr(65533) || 'a' || chr(65533) || chr(10) || 'b' || chr(10) || 'c' || chr(65533)"))
def _src5(spark, sf_dir):
    text = _damaged(spark, sf_dir).select("doc_id", decode_replacing(F.col("data")).alias("t"))
    return text.select("doc_id", _digest("t").alias("digest"), F.length("t").alias("n_chars"))


@register("src6_decode_dropping", _DECODED.format(
    tail="'a' || chr(10) || 'b' || chr(10) || 'c' || chr(65533)"))
def _src6(spark, sf_dir):
    text = _damaged(spark, sf_dir).select("doc_id", decode_dropping(F.col("data")).alias("t"))
    return text.select("doc_id", _digest("t").alias("digest"), F.length("t").alias("n_chars"))


_ERROR_SQL = """
SELECT '{profile}' AS profile, path, CAST(0 AS INTEGER) AS line, '{severity}' AS severity,
       {type} AS type, '{category}' AS category,
       'Could not read file: Permission denied in ' || source AS message,
       '{fix}' AS recommendation, CAST({sure} AS INTEGER) AS confidence
FROM code_files WHERE source IN ('src3', 'src7') AND {where}"""
_scan_error = fv.READ_ERROR_SCAN


@register("src7_read_errors", q.compose(
    _ERROR_SQL.format(
        profile="review", severity="HIGH", type="CAST(NULL AS VARCHAR)", category="Read Error",
        fix=fv.READ_ERROR_REVIEW[2], sure="NULL",
        where="lower(path) LIKE '%.php' AND NOT " + q.pruned("path", fv.REVIEW_PRUNED_DIRS))
    + " UNION ALL " + _ERROR_SQL.format(
        profile="scan", severity="CRITICAL", type=f"'{_scan_error[1]}'",
        category=_scan_error[2], fix=_scan_error[3], sure=_scan_error[4],
        where="NOT " + q.pruned("path", fv.SCAN_PRUNED_DIRS)), "code_files"))
def _src7(spark, sf_dir):
    files = reported_files(spark, sf_dir)
    found = review_read_errors(files).unionByName(scan_read_errors(files))
    return found.select("profile", "path", "line", "severity", "type", "category", "message",
                        "recommendation", "confidence")


def _pylint_reports(spark, sf_dir):
    """One report text per document, with items that lack fields."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "lang", "source", "n_chars")
    even = F.col("n_chars") % 2 == 0
    item = F.struct(
        F.concat(F.lit("m/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.when(even, (F.col("n_chars") % 500).cast("int")).alias("line"),
        F.col("source").alias("symbol"), F.when(even, F.col("lang")).alias("message"),
    )
    return docs.select(F.to_json(F.array(item)).alias("report"))


_PYLINT_SQL = """
SELECT 'm/' || doc_id || '.py' AS path,
       CAST(CASE WHEN n_chars % 2 = 0 THEN n_chars % 500 ELSE 0 END AS INTEGER) AS line,
       'MEDIUM' AS severity, 'Code Review (pylint)' AS type, 'Python' AS language,
       source || ': ' || CASE WHEN n_chars % 2 = 0 THEN lang ELSE '' END AS message,
       '' AS snippet
FROM documents"""
_TOOL = ["path", "line", "severity", "type", "language", "message", "snippet"]


def _pylint(spark, sf_dir):
    return tool_reports.pylint_findings(
        tool_reports.pylint_items(_pylint_reports(spark, sf_dir)))


REPORT_FILES = 3


def _written_reports(items: DataFrame, purpose: str, head: str, tail: str) -> str:
    """Items (JSON texts) as report files of their own, each a valid JSON text."""
    spark, out = items.sparkSession, shared_dir(items.sparkSession, purpose)
    dealt = items.select(F.pmod(F.xxhash64("item"), F.lit(REPORT_FILES)).alias("file"),
                         F.lit(1).alias("place"), F.concat("item", F.lit(",")).alias("value"))
    ends = spark.range(REPORT_FILES).select(F.col("id").alias("file"), F.inline(F.array(
        F.struct(F.lit(0).alias("place"), F.lit(head).alias("value")),
        F.struct(F.lit(2).alias("place"), F.lit(f"null{tail}").alias("value")))))
    dealt.union(ends.select("file", "place", "value")).repartition("file").sortWithinPartitions(
        "file", "place").drop("place").write.partitionBy("file").option(
        "compression", "none").text(out)
    return out


@register("src8_pylint_report", _PYLINT_SQL)
def _src8(spark, sf_dir):
    items = _pylint_reports(spark, sf_dir).select(F.expr(
        "substring(report, 2, length(report) - 2)").alias("item"))
    out = _written_reports(items, "src8", "[", "]")
    return tool_reports.read_pylint(spark, f"{out}/*").select(*_TOOL)




def _bandit_issues(spark, sf_dir):
    """The fields of an issue per document, some of them missing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "lang", "source", "n_chars")
    size = F.col("n_chars")
    levels = F.array(*[F.lit(x) for x in ("LOW", "error", "HIGH", "odd")])
    issue = F.struct(
        F.concat(F.lit("m/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("filename"),
        F.when(size % 3 != 0, (size % 500).cast("int")).alias("line_number"),
        F.when(size % 5 != 0, levels[(size % 4).cast("int")]).alias("issue_severity"),
        F.col("source").alias("test_name"), F.col("lang").alias("issue_text"),
        F.when(size % 2 == 0, F.lit("eval(\"x\")")).alias("code"),
    )
    return docs.select(issue.alias("issue"))


def _bandit(spark, sf_dir):
    texts = _bandit_issues(spark, sf_dir).select(F.to_json(F.struct(
        F.array("issue", "issue").alias("results"))).alias("report"))
    return tool_reports.bandit_findings(tool_reports.bandit_issues(texts))


_BANDIT_SQL = """
SELECT 'm/' || doc_id || '.py' AS path,
       CAST(CASE WHEN n_chars % 3 <> 0 THEN n_chars % 500 ELSE 0 END AS INTEGER) AS line,
       {severity} AS severity, 'Vulnerability (bandit)' AS type, 'Python' AS language,
       source || ': ' || lang AS message,
       CASE WHEN n_chars % 2 = 0 THEN 'eval("x")' ELSE '' END AS snippet
FROM documents, (VALUES (1), (2)) twice(k)"""
_RAW_SEVERITY = ("CASE WHEN n_chars % 5 = 0 THEN 'MEDIUM' ELSE "
                 "['LOW', 'ERROR', 'HIGH', 'ODD'][n_chars % 4 + 1] END")


@register("src9_bandit_report", _BANDIT_SQL.format(severity=_RAW_SEVERITY))
def _src9(spark, sf_dir):
    items = _bandit_issues(spark, sf_dir).select(F.explode(F.array(
        F.to_json("issue"), F.to_json("issue"))).alias("item"))
    out = _written_reports(items, "src9", '{"errors": [{"filename": "x"}], "results": [', "]}")
    return tool_reports.read_bandit(spark, f"{out}/*").select(*_TOOL)


on_code("src10_table_corpus", q.compose("""
SELECT path, CAST(length(content) AS INTEGER) AS n_chars, md5(content) AS digest
FROM code_files""", "code_files"),
        lambda c: c.select("path", F.length("content").alias("n_chars"),
                           _digest("content").alias("digest")))


def _numbered(files: DataFrame, lines) -> DataFrame:
    return files.select("path", F.posexplode(lines).alias("pos", "code")).select(
        "path", (F.col("pos") + 1).cast("int").alias("line"), "code")


def _unnested(parts: str, files: str, keep_last: bool) -> str:
    drop = "" if keep_last else "WHERE NOT (line = n AND code = '')"
    return q.compose(f"""
SELECT path, CAST(line AS INTEGER) AS line, code FROM (
  SELECT path, len(parts) AS n, unnest(parts) AS code, generate_subscripts(parts, 1) AS line
  FROM (SELECT path, {parts} AS parts FROM {files})) {drop}""", files)


on_code("line1_split", _unnested(q.LF_SPLIT, "php_files", True),
        lambda c: _numbered(review_files(c), file_lines(unix_newlines(F.col("content")))))
on_code("line2_read", _unnested(q.LF_SPLIT, "code_files", False),
        lambda c: _numbered(c, read_lines(unix_newlines(F.col("content")))))
on_code("line3_any_terminator", _unnested(q.ANY_SPLIT, "scan_files", True),
        lambda c: _numbered(scan_files(c), file_lines(any_newlines(F.col("content")))))


# ---- detection ----------------------------------------------------------------------------
on_code("det1_audit_language", q.compose(
    f"SELECT path, {q.AUDIT_LANGUAGE} AS language FROM code_files", "code_files"),
        lambda c: c.select("path", audit_language(F.col("path")).alias("language")))


@register("det2_scan_language", q.compose(f"""
SELECT path, {q.scan_language()} AS language FROM (
  SELECT path, content FROM code_files UNION ALL
  SELECT 'site/' || page_id AS path, html AS content FROM pages UNION ALL
  SELECT 'talk/' || conv_id || '-' || turn AS path, text AS content FROM conversations)""",
    "code_files"))
def _det2(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.concat(F.lit("site/"), F.col("page_id").cast("string")).alias("path"),
        F.col("html").alias("content"))
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.concat(F.lit("talk/"), F.col("conv_id").cast("string"), F.lit("-"),
                 F.col("turn").cast("string")).alias("path"), F.col("text").alias("content"))
    files = code_files(spark, sf_dir).unionByName(pages).unionByName(talks)
    return files.select("path", scan_language(F.col("path"), F.col("content")).alias("language"))


def _rules_of(files: DataFrame, rules) -> DataFrame:
    """The rules each file will meet; the table has a fixed number of rows."""
    table = rule_tables.rule_table(files.sparkSession, rules).select(
        "rule_id", F.explode("languages").alias("language"))
    return files.join(F.broadcast(table), "language").select("path", "language", "rule_id")


on_code("det3_audit_rule_choice", q.compose(f"""
SELECT path, language, rule_id FROM (
  SELECT path, {q.AUDIT_LANGUAGE} AS language FROM code_files)
JOIN audit_rules ON language = rule_language""", "code_files", "audit_rules"),
        lambda c: _rules_of(audit_files(c), fv.AUDIT_RULES))
on_code("det4_scan_rule_choice", q.compose(f"""
SELECT path, language, rule_id FROM (
  SELECT path, {q.scan_language()} AS language FROM scan_files)
JOIN scan_rules ON language = rule_language""", "scan_files", "scan_rules"),
        lambda c: _rules_of(
            scan_files(c).withColumn("language", scan_language(F.col("path"), F.col("content"))),
            fv.SCAN_RULES))


# ---- line rules ---------------------------------------------------------------------------
on_code("rul_a_audit_findings", q.compose(f"SELECT {FINDING_SQL} FROM {AUDIT}", AUDIT),
        lambda c: audit_findings(c).select(*FINDING))
on_code("rul_s_scan_findings", q.compose(
    f"SELECT {FINDING_SQL} FROM scan_line_findings", "scan_line_findings"),
        lambda c: scan_findings(scan_files(c), file_rule=False).select(*FINDING))
register("rul_s_page_findings", q.compose(
    f"SELECT {FINDING_SQL} FROM page_findings", "page_findings"))(
        lambda s, d: scan_findings(page_files(s, d), file_rule=False).select(*FINDING))


def _hits_per_rule(files: DataFrame) -> DataFrame:
    """Every shipped line rule with its number of findings, none left out."""
    spark, rules = files.sparkSession, [*fv.AUDIT_RULES, *fv.SCAN_RULES]
    found = combine.all_findings(
        audit_findings(files), scan_findings(scan_files(files), file_rule=False))
    counts = found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("found"))
    every = spark.createDataFrame([(r.rule_id,) for r in rules], "rule_id string")
    return every.join(F.broadcast(counts), "rule_id", "left").select(
        "rule_id", F.coalesce("found", F.lit(0)).alias("n"))


on_code("rul_hits_per_rule", q.compose(f"""
SELECT r.rule_id, CAST(count(f.path) AS BIGINT) AS n
FROM (SELECT DISTINCT rule_id FROM audit_rules UNION SELECT DISTINCT rule_id FROM scan_rules) r
LEFT JOIN (SELECT rule_id, path FROM {AUDIT} UNION ALL
           SELECT rule_id, path FROM scan_line_findings) f ON f.rule_id = r.rule_id
GROUP BY r.rule_id""", "audit_rules", "scan_rules", AUDIT, "scan_line_findings"), _hits_per_rule)
on_code("rul_f_helper_calls", q.compose(
    f"SELECT {FINDING_SQL} FROM helper_findings", "helper_findings"),
        lambda c: helper_call_findings(scan_files(c)).select(*FINDING))
on_code("rul_c_confidence", q.compose(f"""
SELECT path, line, code, CAST({q.CONFIDENCE} AS INTEGER) AS confidence
FROM (SELECT *, CASE WHEN line % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity
      FROM all_scan_lines)""", "all_scan_lines"),
        lambda c: _numbered(c, read_lines(any_newlines(F.col("content")))).select(
            "path", "line", "code",
            confidence(F.when(F.col("line") % 2 == 0, "HIGH").otherwise("LOW"), F.col("code"),
                       F.lower("code")).alias("confidence")))
_NORMAL = ("CASE CASE WHEN n_chars % 5 = 0 THEN 'MEDIUM' ELSE "
           "['LOW', 'ERROR', 'HIGH', 'ODD'][n_chars % 4 + 1] END "
           "WHEN 'ERROR' THEN 'CRITICAL' WHEN 'ODD' THEN 'LOW' WHEN 'MEDIUM' THEN 'MEDIUM' "
           "WHEN 'HIGH' THEN 'HIGH' ELSE 'LOW' END")
register("rul_n_normal_severity", f"""
SELECT path, severity, {q.rank('severity')} AS severity_rank
FROM ({_BANDIT_SQL.format(severity=_NORMAL)})""")(
    lambda s, d: advice.with_normal_severity(_bandit(s, d)).select(
        "path", "severity", "severity_rank"))

_ADVICE_CASES = " ".join(
    "WHEN " + " OR ".join(f"contains(m, '{w}')" for w in words) + f" THEN {q.lit(text)}"
    for words, text in fv.FALLBACK_ADVICE)
_ADVICE = (f"CASE {_ADVICE_CASES} WHEN language = 'Python' AND contains(m, 'debug') "
           f"THEN {q.lit(fv.PYTHON_DEBUG_ADVICE)} ELSE {q.lit(fv.GENERIC_ADVICE)} END")
on_code("rul_m_fallback_advice", q.compose(f"""
SELECT path, line, rule_id, {_ADVICE} AS recommendation
FROM (SELECT *, lower(message) AS m FROM {AUDIT})""", AUDIT),
        lambda c: advice.with_advice(audit_findings(c)).select(
            "path", "line", "rule_id", "recommendation"))

# ---- match places -------------------------------------------------------------------------
_REQ = whole_file(fv.REQ, "i")


def _places(files: DataFrame) -> DataFrame:
    php = review_text(files)
    return php.select(
        "path", "text", F.inline_outer(located_matches("text", _REQ)).alias(
            "match_no", "start_at", "line", "match")
    ).where(F.col("match_no").isNotNull())


on_code("pos1_match_places", q.compose(f"""
SELECT path, CAST(match_no AS INTEGER) AS match_no, CAST(start_at AS INTEGER) AS start_at, line,
       g0 AS match
FROM ({q.matches(q.re2(fv.REQ, 'i'))})""", "php_files"),
        lambda c: _places(c).select("path", "match_no", "start_at", "line", "match"))
on_code("pos2_text_windows", q.compose(f"""
SELECT path, CAST(match_no AS INTEGER) AS match_no, {q.around(80, 80)} AS around
FROM ({q.matches(q.re2(fv.REQ, 'i'))})""", "php_files"),
        lambda c: _places(c).select(
            "path", "match_no",
            F.expr("substring(text, greatest(start_at - 80, 0) + 1, "
                   "start_at + 80 - greatest(start_at - 80, 0))").alias("around")))

# ---- whole-file checks --------------------------------------------------------------------
CHECK_NAMES = {
    "RV-01": "sql_injection", "RV-02": "dynamic_sql", "RV-03": "reflected_xss",
    "RV-04": "short_echo", "RV-05": "dangerous_function", "RV-06": "command_injection",
    "RV-07": "removed_mysql", "RV-08": "removed_function", "RV-09": "file_inclusion",
    "RV-10": "open_redirect", "RV-11": "path_traversal", "RV-12": "weak_hash",
    "RV-13": "password_compare", "RV-14": "error_suppression", "RV-15": "debug_statement",
    "RV-16": "hardcoded_credential", "RV-17": "hardcoded_key", "RV-18": "weak_random",
    "RV-19": "variable_injection", "RV-20": "deserialization", "RV-21": "missing_csrf",
    "RV-22": "file_upload", "RV-23": "missing_exit",
}


def _register_check(rule_id: str, name: str) -> None:
    table = "rv" + rule_id[3:]
    on_code(f"{table}_{name}", q.compose(f"SELECT {CHECK_SQL} FROM {table}", table),
            lambda c: check_findings(c, [rule_id]).select(*CHECK))


for _rule_id, _name in CHECK_NAMES.items():
    _register_check(_rule_id, _name)
on_code("rv24_duplicate_function", q.compose(f"SELECT {CHECK_SQL} FROM rv24", "rv24"),
        lambda c: duplicate_function_findings(c).select(*CHECK))
on_code("review_all_checks", q.compose(f"SELECT {CHECK_SQL} FROM {REVIEW}", REVIEW),
        lambda c: profiles.review(c).select(*CHECK))
on_code("review_once", q.compose(f"SELECT {CHECK_SQL} FROM {REVIEW}", REVIEW),
        lambda c: profiles.review_once(c).findings.select(*CHECK))

# ---- filters and projections --------------------------------------------------------------
_HAY = ("lower(concat_ws(' ', path, CAST(line AS VARCHAR), message, category, language))")
on_code("flt1_search_joined", q.compose(f"""
SELECT path, line, rule_id FROM {SCAN}
WHERE severity = 'CRITICAL' AND language = 'PHP' AND contains({_HAY}, 'risk')""", SCAN),
        lambda c: filters.search_joined(profiles.scan(c), "RISK", "critical", "PHP").select(
            "path", "line", "rule_id"))
_EACH = " OR ".join(f"contains(lower(CAST({f} AS VARCHAR)), '1')" for f in filters.SEARCHED)
on_code("flt2_search_fields", q.compose(f"""
SELECT path, line, rule_id FROM {SCAN} WHERE severity = 'HIGH' AND ({_EACH})""", SCAN),
        lambda c: filters.search_fields(profiles.scan(c), "1", "High").select(
            "path", "line", "rule_id"))
on_code("flt3_suppressed_matches", q.compose(f"""
SELECT path, line, g0 AS match, regexp_matches(g0, {q.lit('(?i)' + fv.XSS_SAFE)}) AS suppressed
FROM ({q.matches(q.re2(fv.REVIEW_PATTERNS['RV-03'], 'i'))})""", "php_files"),
        lambda c: review_text(c).select("path", F.inline_outer(located_matches(
            "text", whole_file(fv.REVIEW_PATTERNS["RV-03"], "i"))).alias(
                "match_no", "start_at", "line", "match")).where("match_no is not null").select(
            "path", "line", "match",
            F.col("match").rlike(whole_file(fv.XSS_SAFE, "i")).alias("suppressed")))
on_code("prj1_review_snippet", q.compose("""
SELECT path, CAST(line AS INTEGER) AS line, substring({}, 1, 300) AS snippet FROM (
  SELECT path, unnest(lines) AS code, generate_subscripts(lines, 1) AS line FROM php_files)"""
                                         .format(q.strip("code")), "php_files"),
        lambda c: _numbered(review_files(c), file_lines(F.col("content"))).select(
            "path", "line", F.substring(trim_white(F.col("code")), 1, 300).alias("snippet")))
on_code("prj2_line_snippets", q.compose(f"""
SELECT path, line, rule_id, snippet FROM {AUDIT} UNION ALL
SELECT path, line, rule_id, snippet FROM {SCAN}""", AUDIT, SCAN),
        lambda c: audit_findings(c).unionByName(profiles.scan(c)).select(
            "path", "line", "rule_id", "snippet"))
on_code("prj3_finding_type", q.compose(
    f"SELECT path, line, rule_id, type FROM {AUDIT}", AUDIT),
        lambda c: audit_findings(c).select("path", "line", "rule_id", "type"))
on_code("prj4_table_rows", q.compose(f"""
SELECT string_split(path, '/')[-1] AS file, CAST(line AS VARCHAR) AS line, severity, message,
       language, category, CAST(confidence AS VARCHAR) || '%' AS confidence FROM {SCAN}""", SCAN),
        lambda c: filters.table_rows(profiles.scan(c)))
on_code("prj5_detail_texts", q.compose(f"""
SELECT path, line, rule_id, 'File: ' || path || chr(10) || 'Line: ' || line || chr(10)
  || 'Severity: ' || severity || chr(10) || 'Category: ' || category || chr(10)
  || 'Type: ' || upper(type) || chr(10) || 'Confidence: ' || confidence || '%' || chr(10)
  || 'Language: ' || language || chr(10) || chr(10) || 'Message: ' || message || chr(10)
  || chr(10) || 'Recommendation: ' || recommendation AS detail
FROM {SCAN} UNION ALL
SELECT path, line, rule_id, 'File:   ' || path || chr(10) || 'Line:   ' || line
  || '   Language: ' || language || chr(10) || 'Type:   ' || type || '   Severity: ' || severity
  || chr(10) || 'Message: ' || message || chr(10) || 'Code:   ' || snippet AS detail
FROM {AUDIT}""", SCAN, AUDIT),
        lambda c: filters.detail_texts(profiles.scan(c)).unionByName(
            filters.short_detail_texts(audit_findings(c))))

# ---- joins --------------------------------------------------------------------------------
on_code("jn1_rules_by_join", q.compose(
    f"SELECT path, line, rule_id, severity, message FROM {AUDIT}", AUDIT),
        lambda c: rule_tables.table_findings(c, rule_tables.rule_table(c.sparkSession)).select(
            "path", "line", "rule_id", "severity", "message"))


def _extension_join(files: DataFrame) -> DataFrame:
    table = files.sparkSession.createDataFrame(
        list(scan_extensions().items()), "ext string, language string")
    keyed = files.select("path", extension(F.col("path")).alias("ext"))
    return keyed.join(F.broadcast(table), "ext").select("path", "ext", "language")


on_code("jn2_extension_join", q.compose(f"""
SELECT * FROM (SELECT path, {q.EXT} AS ext, {q.scan_language("''")} AS language FROM code_files)
WHERE language <> 'Unknown'""", "code_files"), _extension_join)
_CONTEXT = """
SELECT DISTINCT f.path, f.line, l.line AS context_line, l.code, l.line = f.line AS is_hit
FROM {findings} f JOIN {lines} l
  ON l.path = f.path AND l.line BETWEEN f.line - {before} AND f.line + {after}"""
on_code("jn3_context_five", q.compose(
    _CONTEXT.format(findings=AUDIT, lines="audit_lines", before=5, after=5), AUDIT),
        lambda c: context.audit_context(c, 5, 5))
on_code("jn3_context_two", q.compose(
    _CONTEXT.format(findings=SCAN, lines="scan_lines", before=2, after=2), SCAN),
        lambda c: context.scan_context(c, 2, 2))
on_code("jn3_context_shown", q.compose(
    "SELECT path, line, context_line, CASE WHEN is_hit THEN printf('%4d >>> %s', context_line, "
    "code) ELSE printf('%4d     %s', context_line, code) END AS shown FROM ("
    + _CONTEXT.format(findings=SCAN, lines="scan_lines", before=3, after=3) + ")", SCAN),
        lambda c: context.context_texts(
            context.context_rows(profiles.scan(c), c, 3, 3), "padded").select(
            "path", "line", "context_line", "shown"))


def _selected(files: DataFrame) -> DataFrame:
    found = profiles.settled(profiles.scan(files))
    return combine.picked(found, found.where("severity = 'MEDIUM'"))


on_code("jn4_selected_records", q.compose(
    f"SELECT path, line, rule_id, message FROM {SCAN} WHERE severity = 'MEDIUM'", SCAN),
        lambda c: _selected(c).select("path", "line", "rule_id", "message"))


def _lines_with(files: DataFrame, rule_id: str) -> DataFrame:
    pattern = whole_file(fv.REVIEW_PATTERNS[rule_id], "is")
    return review_text(files).select("path", F.inline_outer(located_matches("text", pattern)))


on_code("jn5_lines_not_reported", q.compose(f"""
SELECT path, line, CAST(match_no AS INTEGER) AS match_no
FROM ({q.matches(q.re2(fv.REVIEW_PATTERNS['RV-02'], 'is'))}) d
WHERE NOT EXISTS (SELECT 1 FROM rv01 o WHERE o.path = d.path AND o.line = d.line)""",
                                            "php_files", "rv01"),
        lambda c: combine.without_lines_of(
            _lines_with(c, "RV-02").where("line is not null"),
            check_findings(c, ["RV-01"])).select("path", "line", "match_no"))
on_code("jn6_files_per_function", q.compose(
    "SELECT name, CAST(n_files AS BIGINT) AS n_files, first_path FROM shared_functions",
    "shared_functions"),
        lambda c: shared_names(function_definitions(c)).select(
            "name", "n_files", "first_path"))

# ---- aggregates ---------------------------------------------------------------------------
on_code("agg1_files_scanned", q.compose(
    f"SELECT {BIG} AS files_scanned FROM php_files", "php_files"),
        lambda c: analytics.files_and_lines(c).select("files_scanned"))
on_code("agg2_lines_scanned", q.compose(
    "SELECT CAST(sum(len(lines)) AS BIGINT) AS lines_scanned FROM php_files", "php_files"),
        lambda c: analytics.files_and_lines(c).select("lines_scanned"))
register("agg3_total_findings", q.compose(
    f"SELECT {BIG} AS total_findings FROM all_findings", "all_findings"))(
    lambda s, d: analytics.count_all(profiles.every_profile(spread_code_files(s, d))))
on_code("agg4_by_severity", q.compose(
    f"SELECT severity, {q.rank('severity')} AS severity_rank, {BIG} AS n FROM {REVIEW} "
    "GROUP BY severity", REVIEW), lambda c: analytics.by_severity(profiles.review(c)))
on_code("agg4_by_severity_filled", q.compose(f"""
SELECT level AS severity, CAST(count(s.path) AS BIGINT) AS n
FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) l(level)
LEFT JOIN {AUDIT} s ON lower(s.severity) = level GROUP BY level""", AUDIT),
        lambda c: analytics.by_severity_filled(audit_findings(c)))
on_code("agg5_by_category", q.compose(
    f"SELECT category, {BIG} AS n FROM {REVIEW} GROUP BY category", REVIEW),
        lambda c: analytics.by_category(profiles.review(c)))
on_code("agg6_by_file", q.compose(
    f"SELECT path, {BIG} AS n FROM {REVIEW} GROUP BY path", REVIEW),
        lambda c: analytics.by_file(profiles.review(c)))
MATRIX_SQL = f"""
SELECT language, {BIG} AS total, """ + ", ".join(
    f"CAST(count(*) FILTER (severity = '{x.upper()}') AS BIGINT) AS {x}"
    for x in analytics.LEVELS) + f" FROM {SCAN} GROUP BY language"
on_code("agg7_language_matrix", q.compose(MATRIX_SQL, SCAN), profiles.scan_language_matrix)
on_code("agg8_by_language", q.compose(f"""
SELECT language, n, max(n) OVER () AS largest, CAST(n AS DOUBLE) / max(n) OVER () AS share
FROM (SELECT language, {BIG} AS n FROM {SCAN} GROUP BY language)""", SCAN),
        lambda c: analytics.by_language(profiles.scan(c)))
on_code("agg9_best_rank", q.compose(
    f"SELECT category, min(severity_rank) AS best_rank FROM {REVIEW} GROUP BY category", REVIEW),
        lambda c: analytics.best_rank_per_category(profiles.review(c)))


def _verdicts(files: DataFrame) -> DataFrame:
    """The verdict over all, over HTML alone and over nothing."""
    return analytics.verdicts(profiles.scan(files), {
        "all": F.lit(True), "HTML": F.col("language") == "HTML",
        "none": F.col("language") == "Cobol",
    })


_VERDICT = ("CASE WHEN count(*) = 0 THEN 'SUCCESS' WHEN bool_or(severity = 'CRITICAL') THEN "
            "'ERROR' WHEN bool_or(severity = 'HIGH') THEN 'WARNING' ELSE 'INFO' END")
on_code("agg10_verdict", q.compose(" UNION ALL ".join(
    f"SELECT '{scope}' AS scope, {_VERDICT} AS verdict, {BIG} AS n FROM {SCAN} WHERE {where}"
    for scope, where in (("all", "true"), ("HTML", "language = 'HTML'"),
                         ("none", "language = 'Cobol'"))), SCAN), _verdicts)
SUMMARY_SQL = f"""
SELECT 'files_scanned' AS section, 1 AS rank, '' AS key, {BIG} AS n FROM php_files UNION ALL
SELECT 'lines_scanned', 2, '', CAST(sum(len(lines)) AS BIGINT) FROM php_files UNION ALL
SELECT 'total_findings', 3, '', {BIG} FROM {REVIEW} UNION ALL
SELECT 'by_severity', {q.rank('severity')} + 1, severity, {BIG} FROM {REVIEW} GROUP BY severity
UNION ALL
SELECT 'by_category', row_number() OVER (ORDER BY n DESC, key), key, n
FROM (SELECT category AS key, {BIG} AS n FROM {REVIEW} GROUP BY category) UNION ALL
SELECT * FROM (
  SELECT 'top_files', row_number() OVER (ORDER BY n DESC, key) AS r, key, n
  FROM (SELECT path AS key, {BIG} AS n FROM {REVIEW} GROUP BY path)) WHERE r <= 20"""
on_code("agg11_summary", q.compose(
    f"SELECT section, CAST(rank AS INTEGER) AS rank, key, n FROM ({SUMMARY_SQL})", REVIEW),
        profiles.review_summary_rows)
on_code("agg11_summary_once", q.compose(
    f"SELECT section, CAST(rank AS INTEGER) AS rank, key, n FROM ({SUMMARY_SQL})", REVIEW),
        lambda c: profiles.review_once(c).summary_rows)
on_code("agg11_summary_row", q.compose(f"""
SELECT max(CASE WHEN section = 'files_scanned' THEN n END) AS files_scanned,
  max(CASE WHEN section = 'lines_scanned' THEN n END) AS lines_scanned,
  max(CASE WHEN section = 'total_findings' THEN n END) AS total_findings,
  string_agg(key || '=' || n, '; ' ORDER BY rank) FILTER (section = 'by_severity') AS severities,
  string_agg(key || '=' || n, '; ' ORDER BY rank) FILTER (section = 'top_files') AS files
FROM ({SUMMARY_SQL})""", REVIEW),
        lambda c: profiles.review_summary(c).select(
            "files_scanned", "lines_scanned", "total_findings",
            F.array_join(F.transform(F.map_entries("by_severity"), lambda e: F.concat(
                e["key"], F.lit("="), e["value"].cast("string"))), "; ").alias("severities"),
            F.array_join(F.transform("top_files", lambda e: F.concat(
                e["file"], F.lit("="), e["n"].cast("string"))), "; ").alias("files")))
on_code("agg12_file_lists", q.compose("""
SELECT name, CAST(n_files AS BIGINT) AS n_files, files FROM shared_functions""",
                                      "shared_functions"),
        lambda c: list_texts(stored_definitions(c)).select(
            "name", "n_files", F.col("text").alias("files")))
SMALL_PART = 50
on_code("agg12_file_parts", q.compose(f"""
SELECT name, CAST(n_files AS BIGINT) AS n_files, first_path, CAST(part AS INTEGER) AS part,
       string_agg(path, ', ' ORDER BY path) AS files
FROM (SELECT s.*, f.path, (row_number() OVER (PARTITION BY f.name ORDER BY f.path) - 1)
                          // {SMALL_PART} + 1 AS part
      FROM function_files f JOIN shared_functions s USING (name))
GROUP BY name, n_files, first_path, part""", "function_files", "shared_functions"),
        lambda c: file_lists(stored_definitions(c), SMALL_PART).select(
            "name", "n_files", "first_path", "part", F.array_join("files", ", ").alias("files")))
on_code("agg12_defining_files", q.compose("""
SELECT f.name, CAST(s.n_files AS BIGINT) AS n_files, f.path
FROM function_files f JOIN shared_functions s USING (name)""",
                                          "function_files", "shared_functions"),
        lambda c: defining_files(stored_definitions(c)))


# ---- windows, sorts, sets -----------------------------------------------------------------
def _look_ahead(files: DataFrame) -> DataFrame:
    """The next statement after each redirect header, from the lines of its own file."""
    return (
        review_text(files).where(F.col("low").contains("header"))
        .select("path", file_lines(F.col("text")).alias("lines"))
        .select("path", "lines", F.posexplode("lines").alias("pos", "code"))
        .where(F.col("code").rlike(whole_file(fv.REVIEW_PATTERNS["RV-23"], "i")))
        .select("path", (F.col("pos") + 1).cast("int").alias("line"),
                F.expr(next_statement("lines", "pos")).alias("next_sig"))
    )


on_code("win1_look_ahead", q.compose(
    f"SELECT path, line, next_sig FROM ({q.NEXT_STATEMENTS}) WHERE is_header", "php_files"),
        _look_ahead)
on_code("win2_context_block", q.compose("""
SELECT path, line, string_agg(code, chr(10) ORDER BY context_line) AS block FROM ("""
    + _CONTEXT.format(findings=AUDIT, lines="audit_lines", before=2, after=2)
    + ") GROUP BY path, line", AUDIT),
        lambda c: context.audit_blocks(c, 2, 2).select(
            "path", "line", F.array_join("block", "\n").alias("block")))
on_code("win3_first_of_line", q.compose(f"""
SELECT path, line, min(rule_id) AS rule_id FROM {SCAN} GROUP BY path, line""", SCAN),
        lambda c: combine.first_of_key(
            profiles.scan(c), ["rule_id"], ["path", "line"]).select("path", "line", "rule_id"))
_SAMPLES = f"""
SELECT category, sample_no, severity, path, line, rule_id, n, best_rank,
       greatest(n - 15, 0) AS more FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY severity_rank, path, line,
                                    rule_id, message) AS INTEGER) AS sample_no,
         CAST(count(*) OVER (PARTITION BY category) AS BIGINT) AS n,
         min(severity_rank) OVER (PARTITION BY category) AS best_rank
  FROM {REVIEW}) WHERE sample_no <= 15"""
_SAMPLE_COLUMNS = ["category", "sample_no", "severity", "path", "line", "rule_id", "n",
                   "best_rank", "more"]
on_code("win4_first_per_category", q.compose(
    f"SELECT category, sample_no, path, line, rule_id FROM ({_SAMPLES})", REVIEW),
        lambda c: analytics.samples_per_category(profiles.review_once(c).findings).select(
            "category", "sample_no", "path", "line", "rule_id"))
on_code("top2_category_samples", q.compose(_SAMPLES, REVIEW),
        lambda c: analytics.samples_per_category(profiles.review_once(c).findings).orderBy(
            "best_rank", "category", "sample_no").select(*_SAMPLE_COLUMNS))
on_code("srt1_sorted_findings", q.compose(
    f"SELECT severity_rank, path, line, rule_id, message FROM {REVIEW} "
    "ORDER BY severity_rank, path, line, rule_id", REVIEW),
        lambda c: analytics.sorted_findings(profiles.review(c)).select(
            "severity_rank", "path", "line", "rule_id", "message"))
on_code("srt2_column_sort", q.compose(
    f"SELECT line, path, rule_id FROM {AUDIT} ORDER BY line", AUDIT),
        lambda c: analytics.sorted_by(audit_findings(c), "line", True).select(
            "line", "path", "rule_id"))
on_code("srt3_sorted_paths", q.compose("SELECT path FROM code_files ORDER BY path",
                                       "code_files"),
        lambda c: c.select("path").orderBy("path"))
on_code("top1_files", q.compose(
    f"SELECT path, {BIG} AS n FROM {REVIEW} GROUP BY path ORDER BY n DESC, path LIMIT 20",
    REVIEW), lambda c: analytics.top_files(profiles.review(c)))


@register("set1_all_origins", q.compose(f"""
SELECT profile, path, line, rule_id, message FROM all_findings UNION ALL
SELECT 'audit', path, line, 'PYLINT', message FROM ({_PYLINT_SQL}) UNION ALL
SELECT 'audit', path, line, 'BANDIT', message
FROM ({_BANDIT_SQL.format(severity=_RAW_SEVERITY)})""", "all_findings"))
def _set1(spark, sf_dir):
    code = spread_code_files(spark, sf_dir)
    return combine.all_findings(
        profiles.every_profile(code), _pylint(spark, sf_dir), _bandit(spark, sf_dir)
    ).select("profile", "path", "line", "rule_id", "message")


@register("set2_first_of_key", f"""
SELECT path, line, type, message, min(severity) AS severity
FROM ({_BANDIT_SQL.format(severity=_RAW_SEVERITY)}) GROUP BY path, line, type, message""")
def _set2(spark, sf_dir):
    found = combine.all_findings(_bandit(spark, sf_dir), _bandit(spark, sf_dir))
    return combine.first_of_key(found, ["severity", "rule_id", "match_no"]).select(
        "path", "line", "type", "message", "severity")


on_code("set3_distinct_lines", q.compose(
    f"SELECT DISTINCT path, line, category FROM {REVIEW}", REVIEW),
        lambda c: profiles.review(c).select("path", "line", "category").distinct())


# ---- scalar functions ---------------------------------------------------------------------
def _docs(spark, sf_dir, *columns):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", *columns)


register("fn1_regex_search", r"SELECT doc_id, regexp_matches(text, '(?i)th\w+\s+the\b') AS found "
         "FROM documents")(lambda s, d: _docs(s, d, "text").select(
             "doc_id", F.col("text").rlike(r"(?i)th\w+\s+the(?![A-Za-z0-9_])").alias("found")))
register("fn2_regex_all", r"""
SELECT doc_id, array_to_string(regexp_extract_all(text, '([A-Z][a-z]+) ([a-z]+)', 2), '|') AS words,
       CAST(len(regexp_extract_all(text, '([A-Z][a-z]+) ([a-z]+)', 1)) AS INTEGER) AS n
FROM documents""")(lambda s, d: _docs(s, d, "text").select(
    "doc_id",
    F.array_join(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+) ([a-z]+)"), F.lit(2)), "|")
    .alias("words"),
    F.size(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+) ([a-z]+)"), F.lit(1))).alias("n")))
register("fn3_anchored_match", "SELECT doc_id, regexp_matches(text, '^(The|Is|En)[a-z ]') AS found "
         "FROM documents")(lambda s, d: _docs(s, d, "text").select(
             "doc_id", F.col("text").rlike("^(The|Is|En)[a-z ]").alias("found")))
register("fn4_newlines_to_offset", """
SELECT doc_id, CAST(length(p) - length(replace(p, chr(10), '')) + 1 AS INTEGER) AS line
FROM (SELECT doc_id, substring(text, 1, n_chars // 2) AS p FROM documents)""")(
    lambda s, d: _docs(s, d, "text", "n_chars").select(
        "doc_id", (newline_count(F.expr("substring(text, 1, cast(n_chars div 2 as int))")) + 1)
        .cast("int").alias("line")))
register("fn5_clamped_slice", """
SELECT doc_id, substring(text, greatest(o - 200, 0) + 1, o + 400 - greatest(o - 200, 0)) AS part
FROM (SELECT doc_id, text, n_chars % 700 AS o FROM documents)""")(
    lambda s, d: _docs(s, d, "text", "n_chars").withColumn(
        "o", (F.col("n_chars") % 700).cast("int")).select("doc_id", F.expr(
            "substring(text, greatest(o - 200, 0) + 1, o + 400 - greatest(o - 200, 0))"
        ).alias("part")))
register("fn6_trims", f"""
SELECT doc_id, {q.strip("w")} AS both_sides, {q.rstrip("w")} AS right_side
FROM (SELECT doc_id, chr(9) || chr(160) || ' ' || lang || ' ' || chr(8195) || source || chr(12288)
      || chr(11) || ' ' AS w FROM documents)""")(
    lambda s, d: _docs(s, d, "lang", "source").select("doc_id", F.concat(
        F.lit("\t\xa0 "), "lang", F.lit("  "), "source", F.lit("　\x0b ")).alias("w"))
    .select("doc_id", trim_white(F.col("w")).alias("both_sides"),
            rtrim_white(F.col("w")).alias("right_side")))
register("fn7_case", "SELECT doc_id, md5(lower(text)) AS low, upper(lang) AS up FROM documents")(
    lambda s, d: _docs(s, d, "text", "lang").select(
        "doc_id", F.md5(F.encode(F.lower("text"), "utf-8")).alias("low"),
        F.upper("lang").alias("up")))
register("fn8_contains", """
SELECT doc_id, contains(text, 'tion') AS has, starts_with(text, 'T') AS begins,
       ends_with(text, '.') AS ends FROM documents""")(
    lambda s, d: _docs(s, d, "text").select(
        "doc_id", F.col("text").contains("tion").alias("has"),
        F.col("text").startswith("T").alias("begins"), F.col("text").endswith(".").alias("ends")))
on_code("fn9_extension", q.compose(
    f"SELECT path, {q.EXT} AS ext, {q.SUFFIX} AS suffix FROM code_files", "code_files"),
        lambda c: c.select("path", extension(F.col("path")).alias("ext"),
                           suffix(F.col("path")).alias("suffix")))
on_code("fn10_path_parts", q.compose("""
SELECT path, string_split(path, '/')[-1] AS name,
       CASE WHEN starts_with(path, 'repo3/') THEN substring(path, 7) ELSE path END AS below
FROM code_files""", "code_files"),
        lambda c: c.select("path", base_name(F.col("path")).alias("name"),
                           relative_path(F.col("path"), "repo3").alias("below")))
register("fn11_join_strings", "SELECT doc_id, concat_ws(' | ', lang, source, CAST(n_chars AS "
         "VARCHAR)) AS joined FROM documents")(
    lambda s, d: _docs(s, d, "lang", "source", "n_chars").select("doc_id", F.concat_ws(
        " | ", "lang", "source", F.col("n_chars").cast("string")).alias("joined")))
register("fn12_lookup_default", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE 'other' END
  AS named FROM documents""")(
    lambda s, d: _docs(s, d, "lang").select("doc_id", F.coalesce(F.try_element_at(F.create_map(
        F.lit("en"), F.lit("English"), F.lit("fr"), F.lit("French")), "lang"), F.lit("other"))
        .alias("named")))
register("fn13_clamps", """
SELECT doc_id, greatest(60, n_chars - 10) AS low, least(500, n_chars + 5) AS high,
       CAST(n_chars AS DOUBLE) / 1000 AS ratio FROM documents""")(
    lambda s, d: _docs(s, d, "n_chars").select(
        "doc_id", F.greatest(F.lit(60), F.col("n_chars") - 10).alias("low"),
        F.least(F.lit(500), F.col("n_chars") + 5).alias("high"),
        (F.col("n_chars").cast("double") / 1000).alias("ratio")))
ESCAPED = ("replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', "
           "'&gt;'), '\"', '&quot;'), '''', '&#x27;')")
register("fn14_html_escape", f"SELECT page_id, md5({ESCAPED.format('html')}) AS digest FROM pages")(
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select(
        "page_id", F.md5(F.encode(html_escape(F.col("html")), "utf-8")).alias("digest")))
register("fn15_json_parse", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select(
        "event_id", F.from_json("props", "k int")["k"].alias("k")))
register("fn16_membership", "SELECT doc_id, lang IN ('de', 'fr') AS found FROM documents")(
    lambda s, d: _docs(s, d, "lang").select("doc_id", F.col("lang").isin("de", "fr").alias(
        "found")))
register("fn17_time_stamps", """
SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%Y-%m-%d %H:%M') AS shown
FROM events""")(lambda s, d: s.read.parquet(f"{d}/events.parquet").select(
    "event_id", reports.stamp(F.col("ts")).alias("stamp"),
    reports.stamp(F.col("ts"), "yyyy-MM-dd HH:mm").alias("shown")))


# ---- streams ------------------------------------------------------------------------------
def _document_stream(spark, sf_dir):
    """The documents table as a stream of files."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return feeds.table_stream(spark, f"{sf_dir}/documents.parquet", schema)


def _streamed(spark, sf_dir):
    return feeds.streamed_findings(documents_as_code(_document_stream(spark, sf_dir)))


register("str1_streamed_findings", q.compose(f"SELECT {FINDING_SQL} FROM {SCAN}", SCAN))(
    lambda s, d: feeds.drained(_streamed(s, d).select(*FINDING), "str1"))
register("str2_running_severity", q.compose(
    f"SELECT severity, {BIG} AS n FROM {SCAN} GROUP BY severity", SCAN))(
    lambda s, d: feeds.drained(
        feeds.running_counts(_streamed(s, d), "severity"), "str2", "complete"))
register("str2_running_language", q.compose(
    f"SELECT language, {BIG} AS n FROM {SCAN} GROUP BY language", SCAN))(
    lambda s, d: feeds.drained(
        feeds.running_counts(_streamed(s, d), "language"), "str2", "complete"))
register("str3_stream_dedup", q.compose(
    f"SELECT DISTINCT path, line, message, type FROM {SCAN}", SCAN))(
    lambda s, d: feeds.drained(feeds.once_per_key(
        _streamed(s, d).unionByName(_streamed(s, d))).select("path", "line", "message", "type"),
        "str3"))


@register("str4_stream_errors", q.compose(f"""
SELECT path, line, rule_id, message FROM {SCAN} s
WHERE NOT EXISTS (SELECT 1 FROM code_files c WHERE c.path = s.path
                  AND c.source IN ('src3', 'src7')) UNION ALL
SELECT path, CAST(0 AS INTEGER), 'READ', 'Could not read file: Permission denied in ' || source
FROM scan_files WHERE source IN ('src3', 'src7')""", SCAN, "scan_files", "code_files"))
def _str4(spark, sf_dir):
    documents = _document_stream(spark, sf_dir)
    files = with_read_errors(documents_as_code(documents, "source"))
    found = feeds.streamed_findings(files).select("path", "line", "rule_id", "message")
    return feeds.drained(found, "str4")


register("str1_streamed_audit", q.compose(f"SELECT {FINDING_SQL} FROM {AUDIT}", AUDIT))(
    lambda s, d: feeds.drained(feeds.streamed_audit(
        documents_as_code(_document_stream(s, d))).select(*FINDING), "str1"))
register("str1_streamed_checks", q.compose(
    f"SELECT {FINDING_SQL} FROM {REVIEW} WHERE rule_id <> 'RV-24'", REVIEW))(
    lambda s, d: feeds.drained(feeds.streamed_checks(
        documents_as_code(_document_stream(s, d))).select(*FINDING), "str1"))


def _once_per_file(spark, sf_dir):
    """Every file twice in the feed, a minute apart by its own clock."""
    both = [documents_as_code(_document_stream(spark, sf_dir), "doc_id").withColumn(
        "arrived", F.timestamp_seconds(F.lit(60 * k) + F.col("doc_id") % 600)) for k in (0, 1)]
    once = feeds.once_per_file(both[0].unionByName(both[1]), "arrived", "2 hours")
    return feeds.drained(feeds.streamed_findings(once.select("path", "content")).select(
        *FINDING), "str3")


register("str3_once_per_file", q.compose(f"SELECT {FINDING_SQL} FROM {SCAN}", SCAN))(
    _once_per_file)


STREAMED_FILES, FILES_A_BATCH = 12, 4


def _review_store(spark, sf_dir):
    """The corpus as a folder of files, reviewed in several batches, one of them twice."""
    folder = shared_dir(spark, "arriving")
    # A corpus read in more tasks than that arrives in as many times the files, not in larger ones.
    tasks = spark.read.parquet(f"{sf_dir}/documents.parquet").rdd.getNumPartitions()
    times = max(1, -(-tasks // STREAMED_FILES))
    files = code_files(spark, sf_dir).repartition(STREAMED_FILES * times, "path")
    feeds.write_arriving(files, folder)
    stream = feeds.corpus_stream(
        spark, folder, "path string, content string", files_per_trigger=FILES_A_BATCH * times)
    store = streamed_review.drain_review(stream)
    again = spark.read.schema(streamed_review.HIT_SCHEMA).parquet(store.hits_path).where(
        "batch = 1").select("path").distinct()
    store.absorb(spark.read.parquet(folder).join(again, "path", "left_semi"), 1)
    return store


register("str5_streamed_review", q.compose(f"SELECT {FINDING_SQL} FROM {REVIEW}", REVIEW))(
    lambda s, d: _review_store(s, d).reviewed().findings.select(*FINDING))
register("str5_streamed_duplicates", q.compose(f"SELECT {CHECK_SQL} FROM rv24", "rv24"))(
    lambda s, d: _review_store(s, d).shared_name_findings().select(*CHECK))


# ---- rules as data ------------------------------------------------------------------------
def _user_rule(rule_id, languages, pattern, message, gate=None):
    return fv.LineRule(rule_id, languages, gate, pattern, "low", "User", "User", message, "Look")


# Equal messages, a pattern of the empty line, null gates, repeated and no languages, and more
# rules than one array expression takes.
USER_RULES = [
    *fv.AUDIT_RULES,
    _user_rule("U-1", ("Python", "JavaScript"), "eval", "evaluates", "eval"),
    _user_rule("U-2", ("Python", "Python", "JavaScript"), r"eval\(", "evaluates", "eval"),
    _user_rule("U-3", ("PHP", "C"), r"^\s*$", "blank"),
    _user_rule("U-4", None, "eval", "nowhere"),
    *[_user_rule(f"U-N{n:03}", ("Java", "C"), rf"[a-z]{n % 23}\b|\({n}\)", f"number {n}")
      for n in range(230)],
]
# Rules in the scan manner: equal messages, so that the first of the ordinals reports a line, one
# type apart, a pattern of its own case; and rules of the audit manner with flags.
USER_SCAN_RULES = [
    (_user_rule("V-9", ("Python", "JavaScript", "PHP"), r"EVAL\s*\(", "evaluates", "eval"), ""),
    (_user_rule("V-1", ("Python", "PHP"), "eval|exec", "evaluates"), "i"),
    (_user_rule("V-2", ("Python",), r"request\.", "evaluates", "request"), ""),
    (_user_rule("V-3", ("Python",), "os", "evaluates")._replace(type="Other"), ""),
    (_user_rule("V-4", ("C/C++", "Java", "HTML"), r"[a-z]+\(\s*[\"a-z]", "calls"), ""),
    (_user_rule("V-5", ("HTML", "CSS", "PHP"), r"^\s*$", "blank"), ""),
    (_user_rule("V-6", ("PHP",), r"\bECHO\b", "says"), "i"),
]
USER_FLAGGED_RULES = [
    (_user_rule("W-1", ("Python", "Java"), r"\bDEBUG\s*=|STRING", "flagged"), "i"),
    (_user_rule("W-2", ("PHP",), "  function \\s+ LOAD  # by any case", "flagged"), "ix"),
    (_user_rule("W-3", ("JavaScript",), "console.log", "flagged", "console"), "s"),
]


def _both_manners(spark) -> DataFrame:
    """The rules of both manners as one table, out of order."""
    plain = rule_tables.rule_table(spark, USER_RULES)
    rows = [(*r[:1], list(r.languages), *r[2:], profile, flags, at)
            for profile, flagged in (("audit", USER_FLAGGED_RULES), ("scan", USER_SCAN_RULES))
            for at, (r, flags) in enumerate(flagged)]
    manner = spark.createDataFrame(
        rows[::-1], f"{rule_tables.RULE_SCHEMA}, {rule_tables.MANNER_SCHEMA}")
    return manner.unionByName(plain, allowMissingColumns=True)


q.user_rules([(r, "") for r in USER_RULES if r.languages])
_USER_SQL = "SELECT profile, path, line, rule_id, severity, type, message, snippet, confidence FROM {}"
_USER = ["profile", "path", "line", "rule_id", "severity", "type", "message", "snippet",
         "confidence"]
on_code("ext1_rule_table", q.compose(
    "SELECT path, line, rule_id, severity, type, message, snippet FROM user_findings",
    "user_findings"),
        lambda c: rule_tables.table_findings(
            c, rule_tables.rule_table(c.sparkSession, USER_RULES)).select(
            "path", "line", "rule_id", "severity", "type", "message", "snippet"))
q.flagged_rules(USER_FLAGGED_RULES, USER_SCAN_RULES)
on_code("ext1_both_manners", q.compose(_USER_SQL.format("every_user_finding"),
                                       "every_user_finding"),
        lambda c: rule_tables.table_findings(c, _both_manners(c.sparkSession)).select(*_USER))
on_code("ext1_both_manners_indexed", q.compose(_USER_SQL.format("every_user_finding"),
                                               "every_user_finding"),
        lambda c: rule_tables.table_findings(
            c, _both_manners(c.sparkSession), indexed_from=0).select(*_USER))
# As many rules as there are pairs of these syllables, each a whole word in some languages.
SYLLABLES = ("the of and to in is that it for was on are as with at be by or an er re ti es ing ed "
             "on en st ion le nd ha ou sh wh ea ly ble de la le et les des en un du une que qui "
             "par au eau re ti tre ment ion der die und den von zu das mit sich ein ung ver ge "
             "be sch el los se del las con do ar os as").split()
SYLLABLES = list(dict.fromkeys(SYLLABLES))
WORD_LANGUAGES = [("Python", "PHP"), ("JavaScript",), ("C", "Java"), ("HTML", "CSS")]


def _word_rules() -> list[fv.LineRule]:
    pairs = [(a, b) for a in SYLLABLES for b in SYLLABLES]
    return [_user_rule(f"X-{n:05}", WORD_LANGUAGES[n % 4], rf"\b{a}{b}\b", f"word {n}")
            for n, (a, b) in enumerate(pairs)]


q.word_rules(_word_rules())
on_code("jn1_indexed_rules", q.compose(
    "SELECT path, line, rule_id, message FROM word_findings", "word_findings"),
        lambda c: rule_tables.table_findings(
            c, rule_tables.rule_table(c.sparkSession, _word_rules())).select(
            "path", "line", "rule_id", "message"))
on_code("ext2_findings_per_file", q.compose(f"""
SELECT path, {BIG} AS n, min(line) AS first_line, max(confidence) AS surest
FROM {SCAN} GROUP BY path""", SCAN),
        lambda c: profiles.scan(c).groupBy("path").agg(
            F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"),
            F.max("confidence").alias("surest")))

# ---- sinks --------------------------------------------------------------------------------
_REPORT_SQL = ("SELECT severity, category, path AS file, line, message, snippet, recommendation "
               f"AS fix FROM {REVIEW}")


@register("snk1_json_report", q.compose(_REPORT_SQL, REVIEW))
def _snk1(spark, sf_dir):
    found, out = profiles.review_once(code_files(spark, sf_dir)), shared_dir(spark, "snk1")
    reports.write_json(
        found.findings, analytics.summary_document(found.summary_rows), out)
    return spark.read.schema(reports.REPORT_SCHEMA).json(f"{out}/findings")


def _joined_entries(name: str):
    return F.array_join(F.transform(F.map_entries(name), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), "; ")


@register("snk1_json_summary", q.compose(f"""
SELECT max(CASE WHEN section = 'files_scanned' THEN n END) AS files_scanned,
  max(CASE WHEN section = 'lines_scanned' THEN n END) AS lines_scanned,
  max(CASE WHEN section = 'total_findings' THEN n END) AS total_findings,
  string_agg(key || '=' || n, '; ' ORDER BY rank) FILTER (section = 'by_severity') AS severities,
  string_agg(key || '=' || n, '; ' ORDER BY rank) FILTER (section = 'by_category') AS categories,
  string_agg(key || '=' || n, '; ' ORDER BY rank) FILTER (section = 'top_files') AS files
FROM ({SUMMARY_SQL})""", REVIEW))
def _snk1_summary(spark, sf_dir):
    """The summary as it stands in the written report."""
    found, out = profiles.review_once(code_files(spark, sf_dir)), shared_dir(spark, "snk1")
    summary = analytics.summary_document(found.summary_rows)
    reports.write_json(found.findings, summary, out)
    return spark.read.schema(summary.schema).json(f"{out}/summary").select(
        "files_scanned", "lines_scanned", "total_findings",
        _joined_entries("by_severity").alias("severities"),
        _joined_entries("by_category").alias("categories"),
        F.array_join(F.transform("top_files", lambda e: F.concat(
            e["file"], F.lit("="), e["n"].cast("string"))), "; ").alias("files"))


@register("snk2_csv_report", q.compose(_REPORT_SQL, REVIEW))
def _snk2(spark, sf_dir):
    out = shared_dir(spark, "snk2")
    reports.write_csv(profiles.review(code_files(spark, sf_dir)), out)
    back = spark.read.schema(reports.REPORT_SCHEMA).option("header", True).option(
        "escape", '"').csv(out)
    return back.na.fill("", ["snippet"])


def _text_sql(lines: list[str], source: str) -> str:
    """Texts of a report's findings, line by line."""
    parts = ", ".join(lines)
    return q.compose(f"""
SELECT path, line, rule_id, value FROM (
  SELECT path, line, rule_id, unnest(list_filter([{parts}], lambda v: v IS NOT NULL)) AS value
  FROM {source})""", source)


on_code("snk3_text_report", _text_sql([
    "'[' || severity || '] ' || path || ':' || line", "'  Category: ' || category",
    "'  Message : ' || message",
    "CASE WHEN snippet <> '' THEN '  Code    : ' || snippet END",
    "'  Fix     : ' || recommendation", "''"], REVIEW),
        lambda c: reports.text_report(profiles.review(c)).select(
            "path", "line", "rule_id", "value"))
on_code("snk3_text_summary", q.compose(f"""
SELECT section, CAST(rank AS INTEGER) AS rank, CASE section
  WHEN 'files_scanned' THEN 'Files scanned: ' || n WHEN 'lines_scanned' THEN 'Lines scanned: ' || n
  WHEN 'total_findings' THEN 'Total findings: ' || n ELSE '  ' || key || ': ' || n END AS value
FROM ({SUMMARY_SQL})""", REVIEW),
        lambda c: reports.summary_lines(profiles.review_summary_rows(c)))
on_code("snk4_short_text_report", _text_sql([
    "path || ':' || line || ' [' || language || '] ' || type || ' (' || severity || ')'",
    "'  ' || message", "''"], AUDIT),
        lambda c: reports.short_text_report(audit_findings(c)).select(
            "path", "line", "rule_id", "value"))
_MARKDOWN_SQL = f"""
SELECT category, sample_no, value FROM (
  SELECT category, sample_no, unnest(list_filter([
    CASE WHEN sample_no = 1 THEN '' END,
    CASE WHEN sample_no = 1 THEN '### ' || category || ' (' || n || ' found)' END,
    CASE WHEN sample_no = 1 THEN '' END,
    '**[' || severity || '] ' || path || ':' || line || '**', '- Issue: ' || message,
    CASE WHEN snippet <> '' THEN '- Code: `' || snippet || '`' END,
    '- Fix: ' || recommendation, '',
    CASE WHEN sample_no = least(n, 15) AND n > 15
         THEN '...and ' || (n - 15) || ' more instance(s).' END,
    CASE WHEN sample_no = least(n, 15) AND n > 15 THEN '' END],
    lambda v: v IS NOT NULL)) AS value
  FROM ({_SAMPLES.replace("rule_id, n,", "rule_id, message, snippet, recommendation, n,", 1)}))"""
on_code("snk5_markdown_samples", q.compose(_MARKDOWN_SQL, REVIEW),
        lambda c: reports.markdown_samples(profiles.review_once(c).findings).select(
            "category", "sample_no", "value"))


def _head_sql(heads: dict[str, list[str]], tail: str, item: str, strong: str) -> str:
    fixed = q.values((reports.SECTIONS.index(s) + 1, line)
                     for s, lines in heads.items() for line in lines)
    number = " ".join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(reports.SECTIONS))
    return f"""
SELECT CAST(part AS INTEGER) AS part, value FROM ({fixed}) fixed(part, value) UNION ALL
SELECT CAST(CASE section {number} END AS INTEGER), CASE section
  WHEN 'files_scanned' THEN 'Files scanned: ' || n || '{tail}'
  WHEN 'lines_scanned' THEN 'Lines scanned: ' || n || '{tail}'
  WHEN 'total_findings' THEN 'Total findings: ' || n
  WHEN 'by_severity' THEN {strong} ELSE {item} END FROM ({SUMMARY_SQL})"""


def _ordered(document: DataFrame) -> DataFrame:
    return document.orderBy(*reports.DOCUMENT_ORDER).select("part", "value")


_PLAIN, _ITEM = "'  ' || key || ': ' || n", "'- ' || key || ': ' || n"
on_code("snk3_text_document", q.compose(
    _head_sql(reports.TEXT_HEADS, "", _PLAIN, _PLAIN) + f"""
UNION ALL SELECT 8, unnest(list_filter([
  '[' || severity || '] ' || path || ':' || line, '  Category: ' || category,
  '  Message : ' || message, CASE WHEN snippet <> '' THEN '  Code    : ' || snippet END,
  '  Fix     : ' || recommendation, ''], lambda v: v IS NOT NULL)) FROM {REVIEW}""", REVIEW),
        lambda c: _ordered(reports.text_document(*reversed(profiles.review_once(c)))))
on_code("snk5_markdown_document", q.compose(
    _head_sql(reports.MARKDOWN_HEADS, "  ", _ITEM, "'- **' || key || '**: ' || n")
    + f" UNION ALL SELECT 8, value FROM ({_MARKDOWN_SQL})", REVIEW),
        lambda c: _ordered(reports.markdown_document(*reversed(profiles.review_once(c)))))
_AUDIT_ROWS = f"""
SELECT path, line, rule_id, '<tr><td>' || {ESCAPED.format('path')} || '</td><td>' || line
  || '</td><td>' || language || '</td><td>' || type || '</td><td>' || severity || '</td><td>'
  || {ESCAPED.format('message')} || '</td></tr>' AS value FROM {AUDIT}"""
on_code("snk6_html_rows", q.compose(_AUDIT_ROWS, AUDIT),
        lambda c: reports.html_rows(audit_findings(c)).select(
            "path", "line", "rule_id", "value"))
_SCAN_ROWS = f"""
SELECT path, line, rule_id, '<tr><td>' || {ESCAPED.format('path')}
  || '</td><td style=''text-align:center;''>' || line
  || '</td><td class=''severity-cell''><span class=''badge-' || lower(severity) || '''>'
  || severity || '</span></td><td>' || {ESCAPED.format('message')} || '</td><td>'
  || {ESCAPED.format('language')} || '</td><td>' || {ESCAPED.format('category')} || '</td><td>'
  || {ESCAPED.format('recommendation')} || '</td></tr>' AS value FROM {SCAN}"""
on_code("snk7_html_finding_rows", q.compose(_SCAN_ROWS, SCAN),
        lambda c: reports.html_finding_rows(profiles.scan(c)).select(
            "path", "line", "rule_id", "value"))
_MATRIX_ROWS = f"""
SELECT language, '<tr><td><span class=''language-badge''>' || language || '</span></td><td>'
  || critical || '</td><td>' || high || '</td><td>' || medium || '</td><td>' || low
  || '</td><td><strong>' || total || '</strong></td></tr>' AS value FROM ({MATRIX_SQL})"""
on_code("snk7_html_matrix_rows", q.compose(_MATRIX_ROWS, SCAN),
        lambda c: reports.html_matrix_rows(profiles.scan_language_matrix(c)))


TIME = "2026-01-02 03:04"


def _fixed_lines(parts: dict[int, list[str]]) -> str:
    rows = q.values((part, line) for part, lines in parts.items() for line in lines)
    return f"SELECT CAST(part AS INTEGER) AS part, value FROM ({rows}) fixed(part, value)"


on_code("snk4_short_text_document", q.compose(
    _fixed_lines({0: [f"Code Audit Report – {TIME}", "=" * 80, ""]}) + f"""
UNION ALL SELECT 1, unnest([path || ':' || line || ' [' || language || '] ' || type || ' ('
  || severity || ')', '  ' || message, '']) FROM {AUDIT}""", AUDIT),
        lambda c: _ordered(reports.short_text_document(audit_findings(c), TIME)))
on_code("snk6_html_document", q.compose(
    _fixed_lines({0: [reports.HTML_START, f"<h1>Code Audit Report – {TIME}</h1>",
                      reports.html_table_head(reports.AUDIT_COLUMNS)],
                  2: ["</table>", reports.HTML_END]}) + f"""
UNION ALL SELECT 1, value FROM ({_AUDIT_ROWS})""", AUDIT),
        lambda c: _ordered(reports.html_document(audit_findings(c), TIME)))
on_code("snk7_html_document", q.compose(
    _fixed_lines({0: [reports.HTML_START, f"<h1>Scan Report – {TIME}</h1>",
                      "<h2>Findings by severity</h2>",
                      reports.html_table_head(reports.TOTAL_COLUMNS)],
                  2: ["</table>", "<h2>Findings by language</h2>",
                      reports.html_table_head(reports.MATRIX_COLUMNS)],
                  4: ["</table>", "<h2>All findings</h2>",
                      reports.html_table_head(reports.SCAN_COLUMNS)],
                  6: ["</table>", reports.HTML_END]}) + f"""
UNION ALL SELECT 1, '<tr><td>' || level || '</td><td>' || count(s.path) || '</td></tr>'
FROM (VALUES ('Critical'), ('High'), ('Medium'), ('Low')) l(level)
LEFT JOIN {SCAN} s ON lower(s.severity) = lower(level) GROUP BY level
UNION ALL SELECT 3, value FROM ({_MATRIX_ROWS})
UNION ALL SELECT 5, value FROM ({_SCAN_ROWS})""", SCAN),
        lambda c: _ordered(reports.scan_html_document(
            profiles.settled(profiles.scan(c)), TIME)))


@register("snk8_finding_store", q.compose(
    f"SELECT profile, {FINDING_SQL} FROM all_findings", "all_findings"))
def _snk8(spark, sf_dir):
    out = shared_dir(spark, "snk8")
    reports.write_store(profiles.every_profile(spread_code_files(spark, sf_dir)), out)
    return reports.read_store(spark, out).select("profile", *FINDING)


@register("snk8_incremental_store", q.compose(f"""
SELECT profile, {FINDING_SQL} FROM all_findings
WHERE profile = 'audit' OR NOT contains(path, '/src/')""", "all_findings"))
def _snk8_incremental(spark, sf_dir):
    """A run over all files, then one over those of a folder, by the case-sensitive rules alone."""
    store, files = shared_dir(spark, "snk8"), code_files(spark, sf_dir)
    every = profiles.every_profile(spread_code_files(spark, sf_dir))
    reports.write_run(every, files, store, 0)
    some = files.where(F.col("path").contains("/src/"))
    for _ in range(2):  # once more under the same number
        reports.write_run(profiles.audit(some), some, store, 1)
    return reports.read_runs(spark, store).select("profile", *FINDING)
