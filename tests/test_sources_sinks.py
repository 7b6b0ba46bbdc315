"""Directory trees, tool reports, report files and streams."""

import csv
import glob
import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rivulint.operators.detect import review_files
from rivulint.operators.errors import review_read_errors, scan_read_errors
from rivulint.plans import profiles
from rivulint.rules.fixed_values import SCAN_PRUNED_DIRS
from rivulint.schema import as_findings
from rivulint.session import CORPUS_PARTITIONS
from rivulint.sinks import reports
from rivulint.sources.corpus import code_files, spread_code_files, table_corpus
from rivulint.sources.json_items import json_items
from rivulint.sources.tool_reports import read_bandit, read_pylint
from rivulint.sources.tree import list_tree, read_tree, tree_corpus
from rivulint.streaming import feeds

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def tree(tmp_path):
    files = {
        "pkg/__init__.py": b"eval(1)\r\nexec(2)\rx", "pkg/.hidden.js": b"eval(1)",
        "_x.php": b"<?php eval($x);", "B.PY": b"\xffeval(3)\xc3(", "vendor/a.php": b"eval(",
        "node_modules/m/a.js": b"eval(1)", ".git/x.py": b"eval(1)", "dist/a.css": b"!important",
        "empty.py": b"", "noext": b"<?php eval($x);", "blob.bin": bytes(range(256)),
        "deep/a/b/c/d/e.py": b"eval(4)",
    }
    for name, data in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return tmp_path


def test_tree(spark, tree):
    every = {r.path: r for r in tree_corpus(spark, str(tree)).collect()}
    assert len(every) == 12
    assert every["pkg/__init__.py"].content == "eval(1)\nexec(2)\nx"
    assert every["B.PY"].content == "�eval(3)�("
    assert every["empty.py"].content == "" and every["empty.py"].read_error is None
    kept = tree_corpus(spark, str(tree), SCAN_PRUNED_DIRS, bad_bytes="drop")
    found = Counter((r.path, r.line) for r in profiles.scan(kept).collect()
                    if r.rule_id.endswith("-01"))
    assert found == Counter({
        ("pkg/__init__.py", 1): 1, ("pkg/.hidden.js", 1): 1, ("_x.php", 1): 1, ("B.PY", 1): 1,
        ("noext", 1): 1, ("deep/a/b/c/d/e.py", 1): 1})
    assert {r.path: r.content for r in kept.collect()}["B.PY"] == "eval(3)("
    php = tree_corpus(spark, str(tree), keep=review_files)
    assert [r.path for r in php.collect()] == ["_x.php"]


def test_tree_needs_a_directory(spark, tmp_path):
    with pytest.raises(Exception, match="not a directory"):
        tree_corpus(spark, str(tmp_path / "none")).collect()


def test_unreadable_file_is_a_finding(spark, tree):
    (tree / "gone.php").symlink_to(tree / "nowhere.php")
    (tree / "bad.php").write_bytes(b"x")
    frame = spark.createDataFrame(
        [("bad.php", None, "Permission denied"), ("ok.py", "eval(1)", None)],
        "path string, content string, read_error string")
    (row,) = review_read_errors(frame).collect()
    assert (row.severity, row.category, row.line) == ("HIGH", "Read Error", 0)
    assert row.message == "Could not read file: Permission denied"
    doc = profiles.review_summary(frame).first()
    assert (doc.files_scanned, doc.lines_scanned, doc.total_findings) == (1, 0, 1)
    assert {r.rule_id for r in profiles.scan(frame).collect()} == {"READ", "S-PY-01"}
    (row,) = scan_read_errors(frame).collect()
    assert (row.severity, row.type, row.language, row.confidence) == (
        "CRITICAL", "error", "PHP", 95)


def test_tree_with_what_cannot_be_read(spark, tmp_path):
    from rivulint.sources.tree import Subtree, TreeReader, tree_corpus

    (tmp_path / "a.php").write_text("x")
    (tmp_path / "gone.php").symlink_to(tmp_path / "nowhere.php")
    (tmp_path / "round.php").symlink_to(tmp_path / "round.php")
    os.mkfifo(tmp_path / "pipe.php")
    (tmp_path / "sub").mkdir()
    (tmp_path / "linked").symlink_to(tmp_path / "sub")
    rows = {r.path: r for r in tree_corpus(spark, str(tmp_path), tasks=2).collect()}
    assert set(rows) == {"a.php", "gone.php", "round.php"}
    assert rows["a.php"].read_error is None
    assert "No such file" in rows["gone.php"].read_error and rows["round.php"].read_error
    assert {r.path for r in review_read_errors(
        spark.createDataFrame(list(rows.values()))).collect()} == {"gone.php", "round.php"}
    # A folder that vanished or may not be listed is passed over.
    reader = TreeReader(str(tmp_path), [], 4)
    assert list(reader.read(Subtree(str(tmp_path / "missing"), True))) == []
    assert reader._subfolders(str(tmp_path / "missing")) == []


def test_shared_folder(spark, tmp_path):
    from types import SimpleNamespace

    from rivulint.session import shared_dir

    def session(**settings):
        known = {k.replace("_", "."): v for k, v in settings.items()}
        return SimpleNamespace(conf=SimpleNamespace(get=known.get), sparkContext=spark.sparkContext)

    with pytest.raises(ValueError):
        shared_dir(session(spark_master="spark://host:7077"), "x")
    with pytest.raises(ValueError):
        shared_dir(session(spark_master="local-cluster[2,1,1024]"), "x")
    assert shared_dir(session(spark_master="local[4]"), "x")
    assert shared_dir(session(spark_master="yarn", spark_checkpoint_dir=str(tmp_path)), "x"
                      ).startswith(str(tmp_path))


def test_tool_reports(spark, tmp_path):
    (tmp_path / "pylint.json").write_text(json.dumps([
        {"path": "a.py", "line": 3, "symbol": "unused", "message": "Unused x"}, {"line": 1},
        {"path": "b.py"}]))
    rows = {(r.path, r.line, r.message) for r in read_pylint(
        spark, str(tmp_path / "pylint.json")).collect()}
    assert rows == {("a.py", 3, "unused: Unused x"), ("", 1, ": "), ("b.py", 0, ": ")}
    (tmp_path / "bandit.json").write_text(json.dumps({"errors": [], "results": [
        {"filename": "a.py", "line_number": 2, "issue_severity": "HIGH", "test_name": "t",
         "issue_text": "bad", "code": "2 eval(x)\n"}, {"filename": "b.py"}]}))
    rows = {(r.path, r.line, r.severity, r.message, r.snippet) for r in read_bandit(
        spark, str(tmp_path / "bandit.json")).collect()}
    assert rows == {("a.py", 2, "HIGH", "t: bad", "2 eval(x)\n"), ("b.py", 0, "MEDIUM", ": ", "")}


def _parts(folder, kind):
    return sorted(glob.glob(f"{folder}/part-*{kind}"))


def test_report_files(spark, corpus, tmp_path):
    files = corpus(("a.php", "<?php\n$password = 'say \"hi\", now';\neval($_GET['x']);\n"))
    found = profiles.review(files)
    order = [tuple(r) for r in reports.report_rows(found).collect()]
    reports.write_csv(found, f"{tmp_path}/csv")
    rows = [r for p in _parts(f"{tmp_path}/csv", "csv") for r in list(
        csv.reader(open(p, newline="")))[1:]]
    assert [(r[0], r[2], int(r[3]), r[5]) for r in rows] == [
        (r[0], r[2], r[3], r[5]) for r in order]
    reports.write_json(found, profiles.review_summary(files), f"{tmp_path}/json")
    rows = [json.loads(x) for p in _parts(f"{tmp_path}/json/findings", "json") for x in open(p)]
    assert [r["message"] for r in rows] == [r[4] for r in order]
    (summary,) = [json.loads(x) for p in _parts(f"{tmp_path}/json/summary", "json")
                  for x in open(p)]
    assert summary["total_findings"] == len(order)
    lines = reports.text_report(found)
    reports.write_lines(lines, reports.FINDING_ORDER + ["no"], f"{tmp_path}/text")
    text = "".join(open(p).read() for p in _parts(f"{tmp_path}/text", "txt"))
    assert text.startswith("[CRITICAL] a.php:3\n  Category: ")
    assert "  Code    : eval($_GET['x']);\n  Fix     : " in text
    whole = reports.text_document(profiles.review_summary_rows(files), found)
    reports.write_lines(whole, reports.DOCUMENT_ORDER, f"{tmp_path}/whole")
    text = "".join(open(p).read() for p in _parts(f"{tmp_path}/whole", "txt"))
    assert text.startswith(
        "=== PHP CODE REVIEW REPORT (Text) ===\n\nFiles scanned: 1\nLines scanned: 4\n"
        "Total findings: 2\n\n-- Findings by severity --\n  CRITICAL: 1\n  MEDIUM: 1\n\n"
        "-- Findings by category --\n")
    assert "\n-- Detailed findings --\n\n[CRITICAL] a.php:3\n" in text
    whole = reports.markdown_document(profiles.review_summary_rows(files), found)
    lines = [r.value for r in whole.orderBy(*reports.DOCUMENT_ORDER).collect()]
    start = lines.index("## Detailed findings (sample per category)")
    assert lines[start:start + 6] == [
        "## Detailed findings (sample per category)", "", "", "### Dangerous Function (1 found)",
        "", "**[CRITICAL] a.php:3**"]
    reports.write_store(found, f"{tmp_path}/store")
    assert reports.read_store(spark, f"{tmp_path}/store").count() == len(order)


def test_html_is_escaped(corpus):
    row = reports.html_rows(profiles.audit(corpus(("a<b>.py", "print('x')")))).first()
    assert row.value.startswith("<tr><td>a&lt;b&gt;.py</td><td>1</td>")


def test_stream_equals_batch(spark, tmp_path):
    code = code_files(spark, SMALL)
    code.repartition(5).write.parquet(f"{tmp_path}/in")
    batch = table_corpus(spark, f"{tmp_path}/in")
    want = Counter(map(tuple, profiles.scan(batch).collect()))
    stream = feeds.corpus_stream(spark, f"{tmp_path}/in", "path string, content string",
                                 files_per_trigger=1)
    found = feeds.streamed_findings(stream)
    assert Counter(map(tuple, feeds.drained(found).collect())) == want
    counts = feeds.drained(feeds.running_counts(found, "language"), mode="complete")
    have = {r.language: r.n for r in counts.collect()}
    assert sum(have.values()) == sum(want.values())


def test_tables_stream_as_one_file_or_as_a_folder(spark, tmp_path):
    """A table of part files gives the same rows as one of a single file."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    want = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    want.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (SMALL, str(tmp_path)):
        stream = feeds.table_stream(spark, f"{folder}/documents.parquet", schema)
        have = feeds.drained(stream.select("doc_id", "text"))
        assert Counter(map(tuple, have.collect())) == Counter(map(tuple, want.collect()))


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_stream_without_data_gives_no_rows(spark, tmp_path, mode):
    (tmp_path / "in").mkdir()
    stream = feeds.corpus_stream(spark, f"{tmp_path}/in", "path string, n int")
    rows = feeds.running_counts(stream, "path") if mode == "complete" else stream
    assert feeds.drained(rows, mode=mode).count() == 0


def test_stream_lets_a_file_pass_once(spark, tmp_path):
    rows = [("a.py", "eval(1)", "2024-01-01 00:00:00"), ("a.py", "eval(1)", "2024-01-01 00:05:00"),
            ("b.py", "eval(1)", "2024-01-01 00:01:00")]
    frame = spark.createDataFrame(rows, "path string, content string, t string")
    frame.selectExpr("path", "content", "cast(t as timestamp) as arrived").repartition(3).write.parquet(
        f"{tmp_path}/in")
    stream = feeds.corpus_stream(
        spark, f"{tmp_path}/in", "path string, content string, arrived timestamp", 1)
    once = feeds.once_per_file(stream, "arrived")
    found = feeds.drained(feeds.streamed_findings(once.select("path", "content")))
    assert Counter(r.path for r in found.collect()) == Counter({"a.py": 1, "b.py": 1})


def test_reports_of_any_size_are_read_in_blocks(spark, tmp_path):
    """Files divided anywhere: in strings, keys and nested values."""
    rng = random.Random(1)

    def text():
        return "".join(rng.choice('ab,{}[]:"\\ é\n') for _ in range(rng.randrange(30)))

    want: dict = {None: [], "results": []}
    for k in range(6):
        items = [{"code": text(), "n": k, "cwe": {"id": [1, {"x": text()}]}, "t": text()}
                 for _ in range(rng.randrange(60))]
        whole = {"errors": [{"filename": text()}], "metrics": {"a,b": {"q": 1}, "c": {"results": [{}]}},
                 "results": items, "generated": text(), "more": [{"z": 1}]}
        for field, value in ((None, items), ("results", whole)):
            folder = tmp_path / str(field)
            folder.mkdir(exist_ok=True)
            (folder / f"{k}.json").write_text(json.dumps(
                value, indent=rng.choice([None, 2]), ensure_ascii=bool(k % 2)))
            want[field] += [json.dumps(i, sort_keys=True) for i in items]
    settings = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxPartitionBytes": "50"}
    for size in ("50", "700", "1000000"):
        settings["spark.sql.files.maxPartitionBytes"] = size
        for name, value in settings.items():
            spark.conf.set(name, value)
        try:
            for field in want:
                found = json_items(spark, str(tmp_path / str(field)), field)
                have = [json.dumps(json.loads(r.item), sort_keys=True) for r in found.collect()]
                assert sorted(have) == sorted(want[field])
        finally:
            for name in settings:
                spark.conf.unset(name)


def test_odd_reports(spark, tmp_path):
    for k, content in enumerate(["", "[]", "null", "[null, 3, \"a,{b\"]", '{"results": []}', "[{\"path\": \"open"]):
        (tmp_path / f"{k}.json").write_text(content)
    assert json_items(spark, str(tmp_path)).count() == 0
    assert json_items(spark, str(tmp_path), "results").count() == 0


def test_runs_replace_only_their_own_files(spark, corpus, tmp_path):
    store = str(tmp_path / "store")
    first = corpus(("a.py", "eval(1)"), ("b.py", "print(1)"), ("c.py", "exec(1)"))
    reports.write_run(profiles.audit(first), first, store, 0)
    again = corpus(("a.py", "nothing"), ("d.py", "gets(eval(1))"))
    for _ in range(2):
        reports.write_run(profiles.audit(again), again, store, 1)
    rows = reports.read_runs(spark, store).collect()
    assert sorted((r.path, r.rule_id) for r in rows) == [
        ("b.py", "A-PY-06"), ("c.py", "A-PY-01"), ("d.py", "A-PY-02")]


def test_files_of_the_store_follow_from_its_bytes(spark, tmp_path):
    """Many tasks before, few findings: few files; a large pair is split."""
    few = as_findings(spark.range(2_000).repartition(64).select(
        F.concat(F.lit("p"), "id").alias("path"), F.lit(1).alias("line"), F.lit("R").alias("rule_id"),
        F.when(F.col("id") % 4 == 0, "LOW").otherwise("HIGH").alias("severity"),
        F.lit("m").alias("message")), "scan")
    reports.write_store(few, str(tmp_path / "few"))
    assert len(list((tmp_path / "few").rglob("part-*"))) <= 8
    assert reports.read_store(spark, str(tmp_path / "few")).count() == 2_000


def test_a_tree_by_its_address(spark, tree):
    """Through a file system named by a scheme: the same files, pruning and errors."""
    here = {r.path: (r.content, r.read_error is None) for r in tree_corpus(
        spark, str(tree), SCAN_PRUNED_DIRS).collect()}
    there = {r.path: (r.content, r.read_error is None) for r in tree_corpus(
        spark, f"file://{tree}/", SCAN_PRUNED_DIRS).collect()}
    # A link that leads nowhere is a file to one and nothing to the other.
    assert there == {p: found for p, found in here.items() if p in there} and len(there) >= 4
    assert all(os.path.islink(tree / p) for p in set(here) - set(there))
    with pytest.raises(Exception, match="not a directory"):
        list_tree(spark, f"file://{tree}/none").collect()


def test_a_file_that_is_gone_when_it_is_read(spark, tmp_path):
    for name in ("a.py", "b.py"):
        (tmp_path / name).write_text("eval(1)")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        names = spark.createDataFrame(
            [(n, str(tmp_path / n)) for n in ("a.py", "b.py", "gone.py")],
            "path string, full_path string")
        rows = {r.path: (r.content_bytes, r.read_error) for r in read_tree(
            names, root=root if "://" in root else "").collect()}
        assert rows["a.py"] == (b"eval(1)", None) and rows["gone.py"][0] is None
        assert "gone.py" in rows["gone.py"][1]


def test_corpus_of_one_row_group_is_dealt_over_all_cores(spark):
    setting = spark.conf.get(CORPUS_PARTITIONS)
    spark.conf.unset(CORPUS_PARTITIONS)
    try:
        files = spread_code_files(spark, SMALL)
        tasks = files.select(F.spark_partition_id().alias("task")).distinct().count()
        assert tasks > spark.sparkContext.defaultParallelism
        assert Counter(map(tuple, files.collect())) == Counter(
            map(tuple, code_files(spark, SMALL).collect()))
    finally:
        spark.conf.set(CORPUS_PARTITIONS, setting)
