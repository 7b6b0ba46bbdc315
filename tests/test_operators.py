"""Detection, dedup, context, analytics and duplicates on small hand-made inputs."""

from collections import Counter

from pyspark.sql import functions as F

from rivulint.checks import queries
from rivulint.functions.text import decode_dropping
from rivulint.operators import analytics, combine, context, duplicates, filters
from rivulint.operators.advice import fallback_advice, normal_severity
from rivulint.operators.detect import audit_files, review_files, scan_files, scan_language
from rivulint.operators.duplicates import (
    defining_files, duplicate_function_findings, file_lists, function_definitions,
)
from rivulint.operators.line_rules import audit_findings
from rivulint.plans import profiles
from rivulint.schema import FINDING_FIELDS, as_findings
from rivulint.sources.corpus import code_files


def test_detection(corpus):
    files = corpus(
        ("a/B.PY", ""), ("x.b/Makefile", ""), ("tool", "<?php 1"), ("page", "a </HTML>"),
        ("blob", "zz"), (".php", ""), ("a/.hidden.js", ""), ("h.hpp", ""), ("m.phtml", ""),
        ("vendor/a.php", ""), ("myvendor/a.php", ""), ("dist/x.css", ""), ("dist", ""))
    language = {r[0]: r[1] for r in files.select(
        "path", scan_language(F.col("path"), F.col("content"))).collect()}
    assert language["a/B.PY"] == "Python" and language["x.b/Makefile"] == "Unknown"
    assert language["tool"] == "PHP" and language["page"] == "HTML"
    assert language["blob"] == "Unknown" and language["h.hpp"] == "C/C++"
    assert language["m.phtml"] == "PHP" and language["a/.hidden.js"] == "JavaScript"
    assert {r.path for r in review_files(files).collect()} == {".php", "myvendor/a.php"}
    assert {r.path for r in audit_files(files).collect()} == {
        "a/B.PY", "a/.hidden.js", "vendor/a.php", "myvendor/a.php", "dist/x.css"}
    assert not {"vendor/a.php", "dist/x.css"} & {r.path for r in scan_files(files).collect()}
    assert "dist" in {r.path for r in scan_files(files).collect()}


def _found(spark, *rows):
    frame = spark.createDataFrame(
        list(rows), "path string, line int, rule_id string, severity string, type string,"
        " category string, language string, message string, confidence int")
    return as_findings(
        frame.withColumn("snippet", F.lit("")).withColumn("recommendation", F.lit("fix")), "scan")


def test_dedup_keeps_first_and_is_idempotent(spark):
    rows = _found(
        spark, ("a", 1, "R2", "low", None, "c", "Py", "m", 1),
        ("a", 1, "R1", "high", None, "c", "Py", "m", 2), ("a", 2, "R1", "high", "t", "c", "Py", "m", 2))
    once = combine.first_of_key(rows, ["rule_id"])
    assert sorted((r.line, r.rule_id, r.severity) for r in once.collect()) == [
        (1, "R1", "HIGH"), (2, "R1", "HIGH")]
    again = combine.first_of_key(once, ["rule_id"])
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, once.collect()))


def test_counts_add_up(spark, corpus):
    files = corpus(*[(f"p{i}.php", "<?php eval($_GET['a']);\n" * (i + 1)) for i in range(9)],
                   ("q.php", "x"), ("z.py", "eval(1)\nprint(2)"))
    found = profiles.scan(files)
    total = analytics.count_all(found).first()[0]
    assert total == sum(r.n for r in analytics.by_severity(found).collect())
    assert total == sum(r.total for r in analytics.language_matrix(found).collect())
    filled = analytics.by_severity_filled(found).collect()
    assert [r.severity for r in filled] == analytics.LEVELS
    assert total == sum(r.n for r in filled)
    top = analytics.top_files(profiles.review(files), 3).collect()
    assert [r.path for r in top] == ["p8.php", "p7.php", "p6.php"]
    doc = profiles.review_summary(files).first()
    assert (doc.files_scanned, doc.lines_scanned) == (10, 9 + sum(range(1, 10)) + 1)
    assert doc.total_findings == sum(doc.by_severity.values()) == sum(doc.by_category.values())
    assert doc.top_files[0].file == "p8.php"
    assert list(doc.by_severity) == ["CRITICAL"]


def test_one_read_gives_the_same(corpus):
    files = corpus(("a.php", "<?php function f() {} eval($x);"), ("b.php", "function f(){}\n"),
                   ("c.php", "x\ny"), ("d.php", "print_r($_GET);"))
    once = profiles.review_once(files)
    assert Counter(map(tuple, once.findings.collect())) == Counter(
        map(tuple, profiles.review(files).collect()))
    assert Counter(map(tuple, once.summary_rows.collect())) == Counter(
        map(tuple, profiles.review_summary_rows(files).collect()))


def test_summary_of_nothing(corpus):
    doc = profiles.review_summary(corpus(("a.txt", "x"))).first()
    assert (doc.files_scanned, doc.lines_scanned, doc.total_findings) == (0, 0, 0)
    assert doc.by_category == {} and doc.top_files == []


def test_verdict(corpus):
    def verdict(*files):
        return analytics.verdicts(profiles.scan(corpus(*files))).first().verdict

    assert verdict(("a.py", "x = 1")) == "SUCCESS"
    assert verdict(("a.html", "<body onload=\"go()\">")) == "INFO"
    assert verdict(("a.py", "DEBUG = True")) == "WARNING"
    assert verdict(("a.py", "DEBUG = True\neval(x)")) == "ERROR"


def test_samples_keep_findings_without_category(corpus):
    files = corpus(("a.py", "print(1)\n" * 20))
    rows = analytics.samples_per_category(audit_findings(files)).collect()
    assert [(r.line, r.n, r.more) for r in sorted(rows, key=lambda r: r.line)][0] == (1, 20, 5)
    assert len(rows) == 15


def test_context_is_clamped(corpus):
    files = corpus(("a.py", "print(1)\nb\nc\nd\ne\nf\ng\nprint(2)"))
    rows = context.context_rows(audit_findings(files), files, 5, 5).collect()
    first = sorted((r.context_line, r.code, r.is_hit) for r in rows if r.line == 1)
    assert [x[0] for x in first] == [1, 2, 3, 4, 5, 6] and first[0][2]
    last = sorted((r.context_line, r.is_hit) for r in rows if r.line == 8)
    assert [x[0] for x in last] == [3, 4, 5, 6, 7, 8] and last[-1][1]
    shown = context.context_texts(context.context_rows(audit_findings(files), files, 1, 1))
    assert "8: print(2)" in [r.shown for r in shown.collect()]


def test_hot_function_name_is_listed_whole(corpus):
    files = corpus(*[(f"d/f{i:03d}.php", "function hot() {} function __x() {}")
                     for i in range(60)], ("a.php", "function hot(){} function one(){}"))
    (row,) = duplicate_function_findings(files).collect()
    assert row.path == "a.php" and " 61 files: a.php, d/f000.php, " in row.message
    paths = sorted(["a.php"] + [f"d/f{i:03d}.php" for i in range(60)])
    assert row.message.endswith(": " + ", ".join(paths) + ".")
    # In parts, put together again; and with more parts than one text holds.
    (parted,) = duplicate_function_findings(files, listed=3).collect()
    assert parted == row
    several = sorted(duplicate_function_findings(files, listed=3, parts=4).collect(),
                     key=lambda r: r.match_no)
    assert [r.match_no for r in several] == list(range(1, 7))
    listed = [p for r in several for p in r.message.split(": ")[1][:-1].split(", ")]
    assert listed == paths and {r.path for r in several} == {"a.php"}
    every = defining_files(function_definitions(files)).where("name = 'hot'").collect()
    assert sorted((r.n_files, r.path) for r in every) == [
        (61, p) for p in sorted(["a.php"] + [f"d/f{i:03d}.php" for i in range(60)])]


def test_name_in_more_files_than_are_listed_counts_once(spark):
    files = spark.range(10_050).select(
        F.format_string("d/f%05d.php", "id").alias("path"),
        F.lit("function hot() {}").alias("content"))
    found = profiles.review_once(files)
    (row,) = found.findings.collect()
    assert (row.rule_id, row.path) == ("RV-24", "d/f00000.php")
    assert " 10050 files: " in row.message and row.message.count(", ") == 10_049
    assert analytics.count_all(found.findings).first()[0] == 1
    assert [r.n for r in analytics.top_files(found.findings).collect()] == [1]
    total = {(r.section, r.key): r.n for r in found.summary_rows.collect()}
    assert 1 in total.values()


def test_a_hot_name_is_ranked_in_many_tasks(spark, monkeypatch):
    """A third of all definitions are of one name: every task ranks its share of them."""
    stored = {}

    def keep(rows, purpose, write=duplicates.written):
        stored[purpose] = write(rows, purpose)
        return stored[purpose]

    monkeypatch.setattr(duplicates, "written", keep)
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("f"), (F.col("id") % 5_000).cast("string"))).alias("name"),
        F.format_string("p/%06d.php", "id").alias("path"))
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")
    try:
        ranked = duplicates.ranked_files(rows.repartition(8))
    finally:
        spark.conf.unset(merged)
    tasks = stored["ranked"].where("name = 'hot'").groupBy("task").count().collect()
    assert len(tasks) >= 3 and max(r["count"] for r in tasks) < 6_000
    got = [(r.place, r.path) for r in ranked.where("name = 'hot'").orderBy("place").collect()]
    assert got == [(i, f"p/{3 * i:06d}.php") for i in range(10_000)]
    lists = file_lists(rows, 400).where("name = 'hot'").collect()
    assert sorted(r.part for r in lists) == list(range(1, 26))
    assert {len(r.files) for r in lists} == {400}


def test_file_lists_hold_every_file(spark, monkeypatch):
    files = spark.range(10_050).select(
        F.format_string("d/f%05d.php", "id").alias("path"),
        F.lit("function hot() {}").alias("content"))
    monkeypatch.setattr(queries, "code_files", lambda spark, sf_dir: files)
    paths = [f"d/f{i:05d}.php" for i in range(10_050)]
    (row,) = queries.QUERIES["agg12_file_lists"](spark, "").collect()
    assert (row.name, row.n_files, row.files) == ("hot", 10_050, ", ".join(paths))
    rows = queries.QUERIES["agg12_defining_files"](spark, "").collect()
    assert sorted((r.name, r.n_files, r.path) for r in rows) == [("hot", 10_050, p) for p in paths]


def test_filters(spark):
    rows = _found(
        spark, ("src/a.py", 12, "R", "critical", "t", "Code", "Python", "Use of eval", 90),
        ("src/b.js", 3, "R", "low", "t", "Misc", "JavaScript", "console", 75))
    assert filters.search_joined(rows, "12 use").count() == 1
    assert filters.search_fields(rows, "12 use").count() == 0
    assert filters.search_joined(rows, "", "low").count() == 1
    assert filters.search_fields(rows, "EVAL", "CRITICAL", "Python").count() == 1
    shown = filters.table_rows(rows).where("file = 'a.py'").first()
    assert (shown.line, shown.confidence) == ("12", "90%")
    assert "\n\nMessage: Use of eval\n\n" in filters.detail_texts(rows).first().detail


def test_severity_and_advice(spark):
    frame = spark.createDataFrame(
        [("ERROR", "SQL shell", "C"), ("warning", "debug on", "Python"), ("odd", "debug on", "C"),
         ("Info", "innerHTML", "C"), ("high", "a key", "C")], "s string, m string, l string")
    rows = frame.select(normal_severity(F.col("s")), fallback_advice(F.col("m"), F.col("l")))
    names, texts = zip(*rows.collect())
    assert names == ("critical", "medium", "low", "low", "high")
    assert texts[0].startswith("Use parameterized") and texts[1].startswith("Disable debug")
    assert texts[2].startswith("Review the context") and texts[4].startswith("Move secrets")


def test_sorts(spark):
    rows = _found(spark, *[(f"f{n}", n, "R", s, "t", "c", "Py", "m", 1)
                           for n, s in ((10, "low"), (9, "critical"), (100, "high"))])
    assert [r.line for r in analytics.sorted_findings(rows).collect()] == [9, 100, 10]
    assert [r.line for r in analytics.sorted_by(rows, "line", True).collect()] == [9, 10, 100]
    assert [r.path for r in analytics.sorted_by(rows, "path").collect()] == ["f10", "f100", "f9"]


def test_schema_is_shared(corpus):
    files = corpus(("a.php", "<?php eval($x);"))
    for build in (profiles.review, profiles.audit, profiles.scan):
        assert build(files).dtypes == list(FINDING_FIELDS.items())


def test_bad_bytes_are_dropped_and_nothing_else(spark):
    texts = ["plain", "�", "", "1�0", "�1", "é"]
    data = [t.encode() for t in texts] + [b"a\xff\xef\xbf\xbdb\xc3("]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, d binary").select(
        "i", decode_dropping(F.col("d")).alias("t")).collect()
    assert [r.t for r in sorted(rows)] == [*texts, "a�b("]


def test_review_reads_the_corpus_once(spark):
    from rivulint.operators.file_checks import file_hits, hit_rows

    files = code_files(spark, "/root/testdata/sf0.001")

    def reads(df):
        return df._jdf.queryExecution().executedPlan().toString().count("documents.parquet")

    # The one narrow pass, and nothing of the corpus behind what starts from its rows.
    assert reads(hit_rows(file_hits(files, definitions=True))) == 1
    found = profiles.review_once(files)
    for df in (found.findings, found.summary_rows, profiles.review(files),
               analytics.by_severity(profiles.review(files)),
               analytics.sorted_findings(profiles.review(files))):
        assert reads(df) == 0


def test_context_moves_no_file_without_findings(spark, corpus):
    files = corpus(*[(f"d/{i}.py", "print(1)\n" * 3 if i % 50 == 0 else "x\n") for i in range(400)])
    found = audit_findings(files)
    likely = context.likely_among(files, "path", found.select("path").distinct())
    assert {f"d/{i}.py" for i in range(0, 400, 50)} <= {r.path for r in likely.collect()}
    assert likely.count() <= 12
    plan = likely._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
