"""All profiles from one read give what each gives alone."""

from collections import Counter

from pyspark.sql import functions as F

from rivulint.operators import context
from rivulint.operators.combine import all_findings
from rivulint.operators.file_checks import ALL_CHECKS
from rivulint.operators.one_pass import found_rows
from rivulint.plans import profiles
from rivulint.rules.fixed_values import AUDIT_RULES, SCAN_RULES
from rivulint.schema import FINDING_FIELDS
from rivulint.sources.corpus import code_files, page_files

SF_DIR = "/root/testdata/sf0.001"
ODD = [
    ("a.py", "import os\nos.system(x)\reval(1)\r\nsubprocess.call(a, shell=True)", None),
    ("dist/a.py", "eval(1)\x0bexec(2)", None), ("vendor/a.php", "<?php eval($_GET['x']);", None),
    ("tool", "<?php\neval($x);\n", None), ("empty.php", "", None), ("null.php", None, None),
    ("gone.php", None, "no permission"), ("gone.py", None, "no permission"),
    ("b.php", "<?php function f() {}\n  header('Location: x');\n\necho $_GET['a'];", None),
    ("c.php", "<?php function f() {}\x01\x02 print_r($_POST); $password = 'abcdef';\n", None),
    ("d.html", "<form method='post'>\n<body onload='x'>", None), ("e.unknown", "nothing", None)]


def rows_of(findings):
    return Counter(tuple(r[c] for c in FINDING_FIELDS) for r in findings.collect())


def test_one_read_equals_three(spark):
    odd = spark.createDataFrame(ODD, "path string, content string, read_error string")
    none = F.lit(None).cast("string").alias("read_error")
    files = code_files(spark, SF_DIR).select("*", none).unionByName(
        page_files(spark, SF_DIR).select("*", none)).unionByName(odd)
    whole = profiles.every_profile(files)
    good = files.where("read_error is null").drop("read_error")
    alone = all_findings(profiles.review(files), profiles.audit(good), profiles.scan(files))
    have = rows_of(whole)
    assert have == rows_of(alone)
    assert {p for p, *_ in have} == {"review", "audit", "scan"}


def test_the_corpus_is_scanned_once_and_nothing_moves(spark, tmp_path):
    spark.createDataFrame(ODD, "path string, content string, read_error string").drop(
        "read_error").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    rows = found_rows(files, AUDIT_RULES, SCAN_RULES, ALL_CHECKS, True)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "MapIn" not in plan
    # What every profile starts from is the written rows: no further look at the corpus.
    whole = profiles.every_profile(files)._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path) not in whole


def test_only_what_is_asked_for(corpus):
    files = corpus(*[r[:2] for r in ODD if r[1] is not None])
    assert {r.profile for r in found_rows(files, audit_rules=AUDIT_RULES).collect()} == {"audit"}
    assert {r.profile for r in found_rows(files, scan_rules=SCAN_RULES).collect()} == {"scan"}
    helper = found_rows(files, file_rule=True).collect()
    assert [(r.rule_id, r.path, r.line, r.snippet) for r in helper] == [("S-PY-FILE", "a.py", 1, "")]
    assert {r.profile for r in found_rows(files, checks=["RV-05"]).collect()} == {"review"}


def test_context_is_cut_where_the_hit_is(spark, corpus, tmp_path):
    lines = [f"l{i}" for i in range(1, 12)]
    lines[3], lines[8] = "eval(x)", "os.system(y)"
    files = corpus(("a.py", "\n".join(lines) + "\n"), ("b.py", "subprocess.call(\nx"), ("c.php", ""),
                   ("d.py", None), ("e.js", "nothing"), ("f.py", "import os\rprint(1)"))
    for built, found in ((context.audit_context(files, 2, 3), profiles.audit(files)),
                         (context.scan_context(files, 5, 1), profiles.scan(files))):
        before, after = (2, 3) if found.first().profile == "audit" else (5, 1)
        joined = context.context_rows(found, files, before, after)
        assert Counter(map(tuple, built.collect())) == Counter(map(tuple, joined.collect()))
    files.write.parquet(str(tmp_path / "files"))
    stored = spark.read.parquet(str(tmp_path / "files"))
    for built in (context.audit_context(stored, 5, 5), context.scan_context(stored, 5, 5)):
        plan = built._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan
