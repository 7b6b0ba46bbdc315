"""Rule tables: manners, flags, order, and the index against the expressions."""

import re
import string
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rivulint.operators import rule_tables
from rivulint.operators.rule_index import literals_of, required_literals
from rivulint.plans import profiles
from rivulint.rules.fixed_values import AUDIT_RULES, SCAN_RULES, LineRule
from rivulint.schema import FINDING_FIELDS

SCHEMA = f"{rule_tables.RULE_SCHEMA}, {rule_tables.MANNER_SCHEMA}"


def row(rule_id, pattern, profile=None, flags=None, ordinal=None, languages=("Python",),
        message="m", gate=None, type_="t"):
    return (rule_id, list(languages), gate, pattern, "high", type_, "c", message, "r", profile,
            flags, ordinal)


def found(spark, files, rows, indexed_from):
    table = spark.createDataFrame(rows, SCHEMA)
    return sorted((r.profile, r.path, r.line, r.rule_id, r.snippet, r.confidence or 0) for r in
                  rule_tables.table_findings(files, table, indexed_from).collect())


BOTH = pytest.mark.parametrize("indexed_from", [0, 500])


@BOTH
def test_each_rule_works_in_its_manner(spark, corpus, indexed_from):
    files = corpus(("a.py", "  Eval(user) \nother\n\n"), ("dist/b.py", "eval(1)"),
                   ("note", "<?php\nEVAL(1)"))
    rows = [row("A", r"eval\("), row("B", "eval", flags="i"), row("C", r"EVAL\(", "scan", languages=("Python", "PHP")),
            row("D", "^$", "scan", message="blank"), row("E", "user", "scan", languages=["PHP"])]
    assert found(spark, files, rows, indexed_from) == [
        ("audit", "a.py", 1, "B", "  Eval(user)", 0),
        ("audit", "dist/b.py", 1, "A", "eval(1)", 0), ("audit", "dist/b.py", 1, "B", "eval(1)", 0),
        ("scan", "a.py", 1, "C", "Eval(user)", 95), ("scan", "a.py", 3, "D", "", 90),
        ("scan", "note", 2, "C", "EVAL(1)", 90)]


@BOTH
def test_the_first_by_ordinal_reports_a_line(spark, corpus, indexed_from):
    files = corpus(("a.py", "alpha beta\nbeta\nalpha"))
    rows = [row("Z", "alpha", "scan", ordinal=1), row("A", "beta", "scan", ordinal=2),
            row("T", "beta", "scan", ordinal=3, type_="other"), row("N", "alpha", "scan")]
    got = [(r[2], r[3]) for r in found(spark, files, rows, indexed_from)]
    assert got == [(1, "T"), (1, "Z"), (2, "A"), (2, "T"), (3, "Z")]
    # In the audit manner every rule reports.
    got = found(spark, files, [(*r[:9], "audit", *r[10:]) for r in rows], indexed_from)
    assert len(got) == 8


def test_unknown_manners_are_refused(spark):
    for bad in (row("A", "x", flags="q"), row("A", "x", "nothing")):
        with pytest.raises(ValueError):
            rule_tables.collected_rules(spark.createDataFrame([bad], SCHEMA))


def test_empty_and_useless_tables(spark, corpus):
    files = corpus(("a.py", "x"))
    for indexed_from in (0, 500):
        for rows in ([], [row("A", None)], [row("A", "x", languages=[])]):
            assert found(spark, files, rows, indexed_from) == []


def test_both_routes_agree_for_the_shipped_rules(spark, corpus):
    samples = ["eval(x)", "EVAL (x)", "print(1)", "gets(a); malloc(3);", "<script>x", "innerHTML = a + b",
               "x.executeQuery(\"a\" + b", "$_GET['a'] . 'select'", "# TODO", "", "   ", "a b", "exec(\x0b"]
    files = corpus(*[(f"a/{i}.{ext}", "\n".join(samples)) for i, ext in enumerate(
        ["py", "js", "java", "c", "html", "css", "php", "cc"])], ("empty.py", ""), ("x.py", None))
    rows = [(r.rule_id, list(r.languages), r.gate, r.pattern, r.severity, r.type, r.category, r.message,
             r.recommendation, profile, None, i)
            for profile, rules in (("audit", AUDIT_RULES), ("scan", SCAN_RULES))
            for i, r in enumerate(rules)]
    table = spark.createDataFrame(rows, SCHEMA)
    direct, indexed = (Counter(tuple(r[f] for f in FINDING_FIELDS) for r in
                               rule_tables.table_findings(files, table, n).collect())
                       for n in (500, 0))
    assert direct == indexed and len(direct) > 20
    shipped = Counter(tuple(r[f] for f in FINDING_FIELDS) for r in profiles.all_findings(
        profiles.audit(files), profiles.scan(files)).collect() if r.rule_id != "S-PY-FILE")
    assert direct == shipped


def test_the_plan_does_not_grow_with_the_rules(spark, corpus):
    """As many expressions for 5,000 rules as for ten."""
    files = corpus(("a.py", "word12 word4999x word77"))

    def plan(n):
        table = spark.createDataFrame([row(f"R{i}", rf"\bword{i}\b") for i in range(n)], SCHEMA)
        out = rule_tables.table_findings(files, table, 5)
        return out, out._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")

    (_, few), (out, many) = plan(10), plan(5_000)
    assert few == many
    assert sorted(r.rule_id for r in out.collect()) == ["R12", "R77"]


@pytest.mark.parametrize("pattern, want", [
    (r"eval\s*\(", ("eval",)), (r"\bfoo\.barb(az)?qu+x", ("foo.barb",)), ("abc|defg", ("abc", "defg")),
    ("ab|cdef", ()), ("abcd?efg*", ("abc",)), ("a{0,2}bcd", ("bcd",)), ("[abc]def(ghi|j)", ("def",)),
    (r"[]x]abc[^]y]", ("abc",)), ("(?i)Select", ("select",)), ("(?x) a b c", ()), (r"\Qabc\E", ()),
    ("é|x", ()), ("abcéfgh", ("abc",)), (r"(a(b)c)xyz\)w", ("xyz)w",)), ("", ()), ("abc+?def", ("abc",))])
def test_literals_of_patterns(pattern, want):
    assert required_literals(pattern) == want


def test_literals_of_gates():
    def literals(gate, pattern="x"):
        return literals_of(LineRule("R", ("Python",), gate, pattern, "low", "t", None, "m", None))

    assert literals("def&return|class") == ("return", "class")
    assert literals("de|class") == () and literals("") == () and literals("abc", "defgh") == ("defgh",)


PIECES = ["a", "bc", "Abc", "xyz", ".", "\\.", "\\w", "[abc]", "[^x]", "(de|f)", "(gh)", "?", "*", "+",
          "{0,1}", "{2}", "|", "^", "$", "\\b", "-", "foo"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=8).map("".join),
       st.text(alphabet=string.ascii_letters[:8] + "xyzo.-", max_size=12),
       st.lists(st.sampled_from(["abc", "Abc", "xyz", "foo", "de", "gh", ".", "-", "a", "bc"]),
                max_size=6).map("".join))
def test_every_match_holds_a_literal(pattern, text, other):
    try:
        compiled = re.compile(pattern, re.IGNORECASE)
    except re.error:
        return
    literals = required_literals(pattern)
    for subject in (text, other, text + other):
        if literals and compiled.search(subject):
            assert any(x in subject.lower() for x in literals), (pattern, subject, literals)


def test_rules_with_alternatives_in_common(spark, corpus):
    """Shared alternatives are searched once a line, plain ones as text; hits are those of the
    patterns as they stand, also in the index."""
    from rivulint.functions.dialect import alternatives, plain_text
    from rivulint.operators.line_rules import exact_matches

    assert alternatives(r"a[|]b|c\|d|(e|f)|g") == ["a[|]b", r"c\|d", "(e|f)", "g"]
    for whole in (r"(?i)a|b", r"(a)|b\1", r"\Qa|b\E", "[]|]a|b", "ab"):
        assert alternatives(whole) == [whole]
    assert [plain_text(p) for p in (r"\(5\)", "a b", "a.b", r"a\b", "", r"\\d")] == [
        "(5)", "a b", None, None, None, "\\d"]
    patterns = [r"[a-z]{3}\b|\(1\)", r"[a-z]{3}\b|\(2\)", r"\d{2}|\(3\)", r"x|", r"\(1\)|\.\.", "a|b"]
    rules = [LineRule(f"Z-{i}", ("Java",), None, p, "low", "T", "C", f"m{i}", "r")
             for i, p in enumerate(patterns)]
    searches, _ = exact_matches(rules)
    assert len(searches) == 1
    lines = ["abc", "A (1)", "(2) 1", "(3", "7 77", "..", "", "é (1)", "ABC.", "b"]
    files = corpus(("f.java", "\n".join(lines)))
    table = rule_tables.rule_table(spark, rules)
    want = {(n + 1, f"Z-{i}") for n, line in enumerate(lines) for i, p in enumerate(patterns)
            if re.search(p, line)}
    for indexed_from in (500, 0):
        found = rule_tables.table_findings(files, table, indexed_from=indexed_from)
        assert {(r.line, r.rule_id) for r in found.collect()} == want


def test_whole_words_inside_others_are_no_candidates():
    """Neighbours of ASCII settle that a word is part of another; any others go to the pattern."""
    from rivulint.operators.rule_index import _automaton, _candidates

    held = _automaton({"abc": ([1], []), "bcd": ([], [2])})
    text = "xabc\nabc\nabcd abc_ (abc)\néabc\nabc1\nABC."
    assert [(line, numbers) for line, _, numbers in _candidates(text, held, [])] == [
        (2, [1]), (3, [1, 2]), (4, [1]), (6, [1])]
