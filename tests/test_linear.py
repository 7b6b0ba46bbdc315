"""Open-ended patterns: the same matches as plain search, in time proportional to the text."""

import random
import re
import time
from collections import Counter

import pytest

from rivulint.operators.file_checks import check_findings
from rivulint.operators.line_rules import LINEAR_PATTERNS, audit_findings, scan_findings
from rivulint.rules import fixed_values as fv

EXTENSION = {"Python": "py", "Java": "java", "C": "c", "C++": "cpp", "PHP": "php", "HTML": "html",
             "JavaScript": "js", "CSS": "css", "C/C++": "cc"}
OPEN_RULES = [r for r in (*fv.AUDIT_RULES, *fv.SCAN_RULES) if LINEAR_PATTERNS[r.pattern] != r.pattern]
PIECES = {
    "A-PY-07": ["def f", "def f(", "def f()", " ", "(", ")", ":", "a", ") : "],
    "A-PY-08": ["HttpResponse", " (", "request.GET", "x", "request"],
    "A-PY-10": ["SECRET_KEY", " =", "=", "'", '"', "k"],
    "A-JAVA-03": [".executeQuery", "(", ' "', '"', "+", "a"],
    "A-JAVA-04": [".executeUpdate", "(", ' "', '"', "+", "a"],
    "A-C-04": ["malloc", " (", "(", ";", " ", "a"], "A-C-05": ["free", "(", "(;", ";", " ", "a"],
    "A-PHP-02": ["echo", " ", "$_GET", "a", "$_GE"], "A-PHP-05": ["include", " (", "(", "$", "a"],
    "A-JS-03": ["innerHTML", " =", "=", "+", "a"],
    "A-HTML-01": ["<script", " ", ">", "<!--", "\t<!--", "a"],
    "S-PY-03": ["subprocess.call", "subprocess.Popen", "xsubprocess.call", "(", "shell = true", "a"],
    "S-PY-07": ["secret_key", "= ", "'", '"', "k"],
    "S-PHP-04": ["$_GET", "$_GETS", " query", "select", "xselect", "."],
    "S-PHP-05": ["include", "include_once", "xrequire", "require", " (", "$", "a"],
    "S-JAVA-02": ["Statement", " ", "=", ' "', '"', "+", "a"],
}


def made(pieces, seed, count=400, longest=9):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, longest)))
            for _ in range(count)]


def test_every_open_rule_is_tested():
    assert {r.rule_id for r in OPEN_RULES} == set(PIECES)


@pytest.mark.parametrize("rule", OPEN_RULES, ids=lambda r: r.rule_id)
def test_lines_as_plain_search_finds_them(corpus, rule):
    audit = rule in fv.AUDIT_RULES
    lines = made(PIECES[rule.rule_id], rule.rule_id)
    files = corpus((f"a.{EXTENSION[rule.languages[0]]}", "\n".join(lines)))
    build = audit_findings if audit else scan_findings
    have = sorted(r.line for r in build(files, [rule]).collect() if r.rule_id == rule.rule_id)
    want = [n for n, x in enumerate(lines, 1)
            if re.search(rule.pattern, x, 0 if audit else re.IGNORECASE)]
    assert have == want and want


def plain_matches(pattern, text):
    return Counter(text.count("\n", 0, m.start()) + 1
                   for m in re.finditer(pattern, text, re.IGNORECASE))


@pytest.mark.parametrize("seed", range(4))
def test_calls_and_tags_as_plain_search_finds_them(corpus, seed):
    calls = ["fopen", "xfopen", "FOPEN ", "unserialize", "my_unserialize", "(", ")", "\n", "$_GET", "$_POST",
             "..", "readfile", " ", "a", "file", "unlink", "fopen(", "unserialize("]
    tags = ["<form", "<FORM ", "<forms ", "method=", " method = ", "'post'", '"POST"', ">", "\n", " ", "a"]
    texts = {f"c{i}.php": x for i, x in enumerate(made(calls, seed, 300, 40))}
    texts |= {f"t{i}.php": x for i, x in enumerate(made(tags, seed + 50, 300, 30))}
    have = Counter((r.path, r.rule_id, r.line, r.message) for r in check_findings(
        corpus(*texts.items()), ["RV-11", "RV-20", "RV-21"]).collect())
    want = Counter()
    for path, text in texts.items():
        for name in fv.FILE_FUNCS:
            for m in re.finditer(fv.NB + name + r"\s*\([^)]*" + fv.REQ + r"[^)]*\)", text, re.I):
                near = text[m.start(): m.start() + 150]
                if ".." in near or "dirname" in near:
                    want[path, "RV-11", text.count("\n", 0, m.start()) + 1, name] += 1
        for line, n in plain_matches(fv.REVIEW_PATTERNS["RV-20"], text).items():
            want[path, "RV-20", line, ""] += n
        form = fv.REVIEW_PATTERNS["RV-21"]
        if re.search(form, text, re.I) and "csrf" not in text.lower():
            m = re.search(form + "[^>]*>", text, re.I)
            want[path, "RV-21", text.count("\n", 0, m.start()) + 1 if m else 1, ""] += 1
    def named(message):
        found = re.search(r"\b(" + "|".join(fv.FILE_FUNCS) + r")\(\)", message)
        return found[1] if found else ""
    have = Counter({(p, r, n, named(m) if r == "RV-11" else ""): c for (p, r, n, m), c in have.items()})
    assert have == want and len({r for _, r, _, _ in want}) == 3


def seconds(build, corpus, path, unit, count):
    files = corpus((path, unit * count)).cache()
    files.count()
    best = 9e9
    for _ in range(2):
        start = time.perf_counter()
        build(files).write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    files.unpersist()
    return best


@pytest.mark.parametrize("path, unit, only", [
    ("a.php", "fopen( $_GET ..\n", ["RV-11"]), ("a.php", "unserialize( $_ \n", ["RV-20"]),
    ("a.php", "<form method=post \n", ["RV-21"]), ("a.py", "def f( :", "A-PY-07"),
    ("a.c", "malloc( ", "A-C-04"), ("a.c", "free( ;x ", "A-C-05"), ("a.js", "innerHTML = ", "A-JS-03"),
    ("a.py", "HttpResponse( ", "A-PY-08"), ("a.php", "echo ", "A-PHP-02")])
def test_time_is_in_proportion(corpus, path, unit, only):
    """One, two and four times the openings, none of them closed."""
    if isinstance(only, str):
        rule = next(r for r in fv.AUDIT_RULES if r.rule_id == only)
        def build(files):
            return audit_findings(files, [rule])
    else:
        def build(files):
            return check_findings(files, only)
    count = 20_000
    one, two, four = (seconds(build, corpus, path, unit, count * k) for k in (1, 2, 4))
    # Quadratic time would be 16 times as much; a plan has a fixed cost besides.
    assert four < 6 * one + 0.5, (one, two, four)
