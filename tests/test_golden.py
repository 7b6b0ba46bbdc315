"""Every rule family has a hit and a near miss on the snippets."""

from collections import Counter

import pytest

from rivulint.operators.file_checks import check_findings
from rivulint.operators.line_rules import audit_findings, scan_findings
from rivulint.plans import profiles
from rivulint.sources.corpus import SNIPPETS

AUDIT = {
    0: "A-PY-02@2 A-PY-04@3 A-PY-06@8 A-PY-11@4", 1: "A-PY-03@3 A-PY-05@7 A-PY-07@6 A-PY-10@1 "
    "A-PY-01@8 A-PY-08@9 A-PY-09@10",
    3: "A-JS-01@5 A-JS-02@1 A-JS-03@2 A-JS-04@3 A-JS-05@4",
    4: "A-JAVA-01@5 A-JAVA-02@2 A-JAVA-03@3 A-JAVA-05@1 A-JAVA-04@6",
    5: "A-C-01@1 A-C-02@3 A-C-03@4 A-C-04@5 A-C-05@6 A-C-06@2", 6: "A-HTML-03@2 A-HTML-01@6 A-HTML-02@7",
    7: "A-CSS-01@1 A-CSS-02@1", 8: "A-PHP-02@3 A-PHP-02@4 A-PHP-05@6", 9: "A-PHP-01@9",
    12: "A-PHP-03@8 A-PHP-04@9",
}
SCAN = {
    0: "S-PY-01@2 S-PY-06@4 S-PY-09@7 S-PY-10@3 S-PY-FILE@1",
    1: "S-PY-03@4 S-PY-04@3 S-PY-05@2 S-PY-07@1 S-PY-08@5 S-PY-FILE@1 S-PY-02@8",
    3: "S-JS-01@5 S-JS-02@2 S-JS-03@1 S-JS-04@4", 4: "S-JAVA-01@2 S-JAVA-02@4 S-JAVA-03@1",
    5: "S-C-01@1 S-C-02@2 S-C-03@3 S-C-04@7", 6: "S-HTML-01@1 S-HTML-02@3 S-HTML-03@4 S-HTML-01@7",
    7: "S-CSS-01@1 S-CSS-02@1", 8: "S-PHP-02@5 S-PHP-05@6", 9: "S-PHP-03@9", 11: "S-PHP-06@2",
    12: "S-PHP-01@8 S-PHP-02@9 S-PHP-04@10",
}
REVIEW = {
    8: "RV-01@2 RV-03@3 RV-05@5 RV-06@5 RV-09@6",
    9: "RV-14@2 RV-16@4 RV-16@5 RV-12@6 RV-13@7 RV-15@7 RV-18@8 RV-07@9 RV-23@10",
    10: "RV-21@1 RV-04@2 RV-22@3 RV-19@4 RV-20@4 RV-11@5",
    12: "RV-17@2 RV-10@3 RV-02@5 RV-08@6 RV-05@8 RV-05@9 RV-06@9",
}


@pytest.fixture
def snippets(corpus):
    return corpus(*[(f"r/s{i}{ext}", text) for i, (ext, text) in enumerate(SNIPPETS)])


@pytest.mark.parametrize("build, expected", [
    (audit_findings, AUDIT), (scan_findings, SCAN), (check_findings, REVIEW)])
def test_golden(snippets, build, expected):
    have = Counter((r.path, r.rule_id, r.line) for r in build(snippets).collect())
    want = Counter(
        (f"r/s{sid}{SNIPPETS[sid][0]}", *hit.split("@")) for sid, hits in expected.items()
        for hit in hits.split())
    assert have == Counter({(p, r, int(n)): k for (p, r, n), k in want.items()})


def test_confidence(snippets):
    sure = {(r.path, r.rule_id): r.confidence for r in scan_findings(snippets).collect()}
    assert sure["r/s0.py", "S-PY-10"] == 70
    assert sure["r/s1.py", "S-PY-04"] == 95
    assert sure["r/s8.php", "S-PHP-02"] == 95
    assert sure["r/s7.css", "S-CSS-02"] == 75
    assert sure["r/s0.py", "S-PY-FILE"] == 82


def test_placeholder_secret_is_low(snippets):
    rows = check_findings(snippets, ["RV-16"]).collect()
    assert {(r.line, r.severity) for r in rows} == {(4, "LOW"), (5, "MEDIUM")}


def test_duplicate_function(snippets):
    (row,) = profiles.review(snippets).where("rule_id = 'RV-24'").collect()
    assert (row.path, row.line) == ("r/s10.php", 0)
    assert row.message == "function load() defined in 2 files: r/s10.php, r/s9.php."


def test_sample_file(corpus):
    text = ("public class SampleVuln {\n    public static void main(String[] a) {\n"
            "        Runtime.getRuntime().exec(\"echo hello\");\n    }\n}\n")
    files = corpus(("sample.java", text))
    (row,) = scan_findings(files).collect()
    assert (row.rule_id, row.line, row.severity, row.confidence) == (
        "S-JAVA-01", 3, "CRITICAL", 90)
    (row,) = audit_findings(files).collect()
    assert (row.rule_id, row.line) == ("A-JAVA-02", 3)
