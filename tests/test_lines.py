"""Line rules: gates, dialects, line ends and the rule-table routes."""

import re
from collections import Counter

import pytest

from rivulint.functions.text import file_lines, read_lines, unix_newlines
from rivulint.operators import rule_tables
from rivulint.operators.line_rules import audit_findings, scan_findings
from rivulint.rules.fixed_values import AUDIT_RULES, SCAN_RULES, LineRule

SAMPLES = [
    "exec (x)", "éexec(x)", "_exec(", "exec\xa0(", "EVAL(", "x = Pickle.Load(y)", "assert x",
    "print (1)", "def f(a, b) :  ", "HttpResponse(a.request.GET)", "a.raw (", "SECRET_KEY='k'",
    "DEBUG=True", "debug = true", "System.out.println", "catch (Exception e) { }",
    "x.executeQuery( \"a\" + b", "gets(", "fgets(", "scanf (\"%s\"", "malloc(1);", "free(p);  ",
    "echo $x . $_GET", "include ($x", "innerHTML = a + b", "console.log (", "<script >x<!--",
    "<script a> <!--", "onclick = 'javascript:", "<a  href=\"javascript:", "expression (",
    "!important", "# todo", "<!-- TODO", "except :", "subprocess.call(a, shell = True",
    "yaml.load(", "input (", "$_POST['a'] . 'select'", "require_once ($a", "error_reporting (0)",
    "Statement s = \"a\" + b", "<script src", "ONLOAD='", "", "   ", "\u2028", "mysql_query (",
    "document.write(", "localStorage.setItem(", "os.system (", "strcpy (", "sprintf(", "Shell_Exec(",
    "pickle.loads(x)", "eval (", "Runtime.getRuntime().exec(", "x.executeUpdate(\"a\" + b",
    "document.write (", "exec(", "include($a", "system(",
]
EXTENSION = {"Python": ".py", "Java": ".java", "C": ".c", "C++": ".cpp", "PHP": ".php",
             "JavaScript": ".js", "HTML": ".html", "CSS": ".css", "C/C++": ".cc"}


@pytest.mark.parametrize("rules, flags, build", [
    (AUDIT_RULES, 0, audit_findings), (SCAN_RULES, re.IGNORECASE, scan_findings)])
def test_rules_find_what_plain_search_finds(corpus, rules, flags, build):
    languages = sorted({x for r in rules for x in r.languages})
    # The case-insensitive profile has ASCII spaces; there NBSP is no space.
    samples = [s for s in SAMPLES if s != "\u2028" and not (flags and "\xa0" in s)]
    files = corpus(*[(f"a/{i}{EXTENSION[x]}", "\n".join(samples))
                     for i, x in enumerate(languages)])
    have = Counter((r.path, r.rule_id, r.line) for r in build(files).collect()
                   if r.rule_id != "S-PY-FILE")
    want = Counter()
    for i, language in enumerate(languages):
        for rule in rules:
            if language in rule.languages:
                for n, text in enumerate(samples, 1):
                    if re.search(rule.pattern, text, flags):
                        want[f"a/{i}{EXTENSION[language]}", rule.rule_id, n] += 1
    assert have == want
    assert len({r for _, r, _ in want}) >= len(rules) - 3


@pytest.mark.parametrize("rules, flags", [(AUDIT_RULES, 0), (SCAN_RULES, re.IGNORECASE)])
def test_gates_never_hide_a_match(rules, flags):
    for rule in rules:
        for text in SAMPLES:
            if re.search(rule.pattern, text, flags):
                assert any(all(w in text.lower() for w in g.split("&"))
                           for g in rule.gate.split("|")), rule.rule_id


def test_line_ends(spark, corpus):
    files = corpus(("a.py", "eval(1)\r\neval(2)\reval(3)\x0ceval(4)\u2028eval(5)\x85eval(6)\n"),
                   ("empty.py", ""))
    assert sorted(r.line for r in scan_findings(files).collect()) == [1, 2, 3, 4, 5, 6]
    rows = audit_findings(files).collect()
    assert sorted(r.line for r in rows) == [1, 2, 3]
    text = unix_newlines(files["content"])
    sizes = {r[0]: (len(r[1]), len(r[2])) for r in files.select(
        "path", file_lines(text), read_lines(text)).collect()}
    assert sizes == {"a.py": (4, 3), "empty.py": (1, 0)}


def test_same_message_is_reported_once_per_line(corpus):
    def rule(rule_id, pattern):
        return LineRule(rule_id, ("Python",), "", pattern, "low", "review", "c", "same", "r")

    rows = scan_findings(corpus(("a.py", "aa\nab\nb")), [rule("A", "a"), rule("B", "b")], False)
    assert sorted((r.line, r.rule_id) for r in rows.collect()) == [(1, "A"), (2, "A"), (3, "B")]


def test_rule_table_finds_what_the_rules_find(spark, corpus):
    files = corpus(*[(f"a/{i}{e}", "\n".join(SAMPLES)) for i, e in enumerate(EXTENSION.values())])

    def rows(found):
        return Counter((r.path, r.line, r.rule_id, r.snippet, r.severity) for r in found.collect())

    assert rows(rule_tables.table_findings(files, rule_tables.rule_table(spark))) == rows(
        audit_findings(files))


def test_rule_table_of_a_user(spark, corpus):
    def rule(rule_id, pattern, languages=("Python",), gate=None):
        return LineRule(rule_id, languages, gate, pattern, "low", "t", "c", "same", "r")

    rules = [rule("U1", "eval"), rule("U2", r"eval\("), rule("U3", r"^\s*$"),
             rule("U4", "z", None), rule("U5", None), rule("U6", "z", ("Python", "Python", None)),
             *[rule(f"V{n:03}", f"={n}=") for n in range(250)]]
    files = corpus(("a.py", "x = eval(y)\n\nz = 1\n"), ("b.py", ""), ("c.py", "=7==249=="))
    found = rule_tables.table_findings(files, rule_tables.rule_table(spark, rules)).collect()
    assert sorted((r.path, r.rule_id, r.line) for r in found) == [
        ("a.py", "U1", 1), ("a.py", "U2", 1), ("a.py", "U3", 2), ("a.py", "U6", 3),
        ("c.py", "V007", 1), ("c.py", "V249", 1)]
    assert rule_tables.table_findings(files, rule_tables.rule_table(spark, [])).count() == 0


def test_findings_do_not_depend_on_partitioning(corpus):
    files = corpus(*[(f"a/{i}.py", "\n".join(SAMPLES)) for i in range(20)])
    one = Counter(map(tuple, scan_findings(files.coalesce(1)).collect()))
    assert one == Counter(map(tuple, scan_findings(files.repartition(7)).collect()))
