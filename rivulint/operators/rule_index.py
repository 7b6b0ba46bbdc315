"""Large rule tables: an index from required literals to rules.

A rule that matches a line needs certain characters in it.  The longest run of plain characters that every
match must hold is read off the pattern (or off the rule's gate); where a pattern has alternatives,
one run of each.  All runs form one automaton (Aho-Corasick), which finds those of a whole file in
one walk, whatever the number of rules.  Only lines with a run go on, each with the few
rules it may match; their patterns are then searched by the same regular expressions as in a
table of few rules.  A rule without such a run is a candidate on every line of its languages.

The plan does not grow with the rules: patterns are one literal array, which a line's candidates look
their own up in; the other fields come by a broadcast join with the table, which is configuration and
is on the driver in any case.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulint.functions.dialect import exact_line, folded_line
from rivulint.functions.matches import let, quoted
from rivulint.functions.text import any_newlines, below_any, unix_newlines
from rivulint.operators.detect import audit_language, scan_language
from rivulint.operators.line_rules import exact_hits, linear
from rivulint.rules.fixed_values import SCAN_PRUNED_DIRS, LineRule

SHORTEST_LITERAL = 3
COMMENTS = re.compile(r"\(\?[a-zA-Z]*x")
CANDIDATES = ("profile string, path string, language string, line int, code string, "
              "candidates array<int>")


class IndexedRule(NamedTuple):
    """A rule in the manner of its profile; numbers follow the order rules are tried in."""
    profile: str
    rule: LineRule


# --- literals that a match must hold ---------------------------------------------------------

def _closing(pattern: str, at: int) -> int:
    """The place behind the group or class that begins at ``at``."""
    opened, depth = pattern[at], 0
    if opened == "[":
        at += 1
        at += pattern.startswith("^", at)
        at += pattern.startswith("]", at)
        while at < len(pattern) and pattern[at] != "]":
            at = _closing(pattern, at) if pattern[at] == "[" else at + 1 + (pattern[at] == "\\")
        return at + 1
    while at < len(pattern):
        if pattern[at] == "[":
            at = _closing(pattern, at)
            continue
        depth += (pattern[at] == "(") - (pattern[at] == ")")
        at += 1 + (pattern[at] == "\\")
        if not depth:
            break
    return at


def required_literals(pattern: str) -> tuple[str, ...]:
    """Lower-case runs of which every match holds at least one; none where that is not known."""
    if "\\Q" in pattern or COMMENTS.search(pattern):
        return ()
    branches: list[list[str]] = [[""]]
    runs, at = branches[0], 0
    while at < len(pattern):
        char, width = pattern[at], 1
        plain = None
        if char == "\\":
            width, plain = 2, pattern[at + 1: at + 2]
            plain = None if plain.isalnum() else plain
        elif char in "([":
            width = _closing(pattern, at) - at
        elif char == "|":
            runs = [""]
            branches.append(runs)
        elif char not in "^$.":
            plain = char
        at += width
        # A quantifier that allows none takes the character away; any ends the run.
        quantifier = pattern[at: at + 1] if pattern[at: at + 1] in tuple("?*+{") else ""
        if quantifier:
            at = pattern.find("}", at) + 1 if quantifier == "{" else at + 1
            at += pattern[at: at + 1] in ("?", "+")
        if plain and plain.isascii() and quantifier in ("", "+"):
            runs[-1] += plain.lower()
        if quantifier or not plain or not plain.isascii():
            runs.append("")
    longest = [max(runs, key=len) for runs in branches]
    return tuple(dict.fromkeys(longest)) if min(map(len, longest)) >= SHORTEST_LITERAL else ()


def literals_of(rule: LineRule) -> tuple[str, ...]:
    """The literals of the pattern; else those of the gate, which says the same in plain text."""
    found = required_literals(rule.pattern)
    if not found and rule.gate:
        longest = [max(words.split("&"), key=len) for words in rule.gate.lower().split("|")]
        if all(len(x) >= SHORTEST_LITERAL and x.isascii() for x in longest):
            return tuple(longest)
    return found


# --- candidates ------------------------------------------------------------------------------

# A whole word: a hit with a letter, digit or underscore of ASCII beside it cannot be one.
# So many audit rules of a language that have no literal are expressions of their own.
MOST_FIXED = 1000
WHOLE_WORD = re.compile(r"\\b([A-Za-z0-9_]+)\\b")
WORD_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def _automaton(words: dict[str, tuple[list[int], list[int]]]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, (whole, inside) in words.items():
        found.add_word(word, (len(word), whole, inside))
    found.make_automaton()
    return found


def _candidates(text: str, numbers_at, always: list[int], every: bool = False
                ) -> Iterator[tuple[int, str, list[int]]]:
    """(line, code, rules that may match it) of the lines that have any, or of every line."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    found: dict[int, set[int]] = {}
    if always or every:
        found = {i: set(always) for i in range(len(lines))}
    if numbers_at is not None:
        low = text.lower()
        starts, at = [0], low.find("\n")
        while at >= 0:
            starts.append(at + 1)
            at = low.find("\n", at + 1)
        size = len(low)
        for end, (length, whole, inside) in numbers_at.iter(low):
            if whole and (end < length or low[end - length] not in WORD_CHARACTERS) and (
                    end + 1 == size or low[end + 1] not in WORD_CHARACTERS):
                found.setdefault(bisect_right(starts, end) - 1, set()).update(whole)
            if inside:
                found.setdefault(bisect_right(starts, end) - 1, set()).update(inside)
    for line in sorted(found):
        if line < len(lines):
            yield line + 1, lines[line], sorted(found[line])


def fixed_rules(rules: list[IndexedRule]) -> dict[str, list[int]]:
    """By language, the audit rules without a literal: every line is searched for them anyway, so
    their patterns are constants of the plan."""
    fixed: dict[str, list[int]] = {}
    for number, (profile, rule) in enumerate(rules):
        if profile == "audit" and not literals_of(rule):
            for language in dict.fromkeys(rule.languages):
                fixed.setdefault(language, []).append(number)
    return {k: numbers for k, numbers in fixed.items() if len(numbers) <= MOST_FIXED}


def candidate_rows(files: DataFrame, rules: list[IndexedRule]) -> DataFrame:
    """Lines with the numbers of the rules they may match, from one read of the corpus.

    Of a language with ``fixed_rules`` every line, without the numbers of these.
    """
    fixed = fixed_rules(rules)
    words: dict[tuple[str, str], dict[str, tuple[list[int], list[int]]]] = {}
    always: dict[tuple[str, str], list[int]] = {}
    for number, (profile, rule) in enumerate(rules):
        literals = literals_of(rule)
        for language in dict.fromkeys(rule.languages):
            key = profile, language
            if not literals and profile == "audit" and language in fixed:
                always.setdefault(key, [])
            elif not literals:
                always.setdefault(key, []).append(number)
            for word in literals:
                whole, inside = words.setdefault(key, {}).setdefault(word, ([], []))
                (whole if WHOLE_WORD.fullmatch(rule.pattern) else inside).append(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = {key: _automaton(held) for key, held in words.items()}
        for batch in batches:
            out = []
            for profile, path, language, text in zip(*(c.to_pylist() for c in batch.columns)):
                key = profile, language
                out += [(profile, path, language, *row) for row in _candidates(
                    text, automata.get(key), always.get(key, []), key in always)]
            names = [f.split(" ")[0] for f in CANDIDATES.split(", ")]
            kinds = [pa.string()] * 3 + [pa.int32(), pa.string(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)],
                names=names)

    path = F.col("path")
    known = {key: [lang for profile, lang in set(words) | set(always) if profile == key]
             for key in ("audit", "scan")}
    looked = F.when(~below_any(path, SCAN_PRUNED_DIRS), scan_language(path, F.col("content")))
    parts = []
    for profile, language, text in (
        ("audit", audit_language(path), unix_newlines(F.col("content"))),
        ("scan", looked, any_newlines(F.col("content"))),
    ):
        if known[profile]:
            parts.append(F.struct(
                F.lit(profile).alias("profile"), path.alias("path"),
                F.when(language.isin(known[profile]), language).alias("language"),
                text.alias("text")))
    texts = files.select(F.inline(F.array(*parts))).where(
        F.col("language").isNotNull() & F.col("text").isNotNull())
    return texts.mapInArrow(run, CANDIDATES)


def _numbers_of(numbered: list[tuple[int, LineRule]]) -> str:
    """SQL of an array of the numbers of the rules that match, else null."""
    bare = [rule._replace(gate=None, rule_id=str(n)) for n, rule in numbered]
    return exact_hits(bare, lambda rule: rule.rule_id)


def indexed_hits(files: DataFrame, rules: list[IndexedRule]) -> DataFrame:
    """profile, path, language, line, code and the rule's fields of every match."""
    dialects = {"audit": exact_line, "scan": folded_line}
    patterns = [dialects[profile](linear(rule.pattern)) for profile, rule in rules]
    # Of scan rules with one message and type only the first reports a line.
    kinds: dict[tuple, int] = {}
    kind_of = [kinds.setdefault((rule.message, rule.type) if profile == "scan" else (number,), number)
               for number, (profile, rule) in enumerate(rules)]
    rows = candidate_rows(files, rules).withColumns({
        "patterns": F.expr(f"from_json({quoted(json.dumps(patterns))}, 'array<string>')"),
        "kinds": F.expr(f"from_json({quoted(json.dumps(kind_of))}, 'array<int>')")})
    searched = "filter(candidates, n -> code rlike get(patterns, n))"
    fixed = fixed_rules(rules)
    if fixed:
        # Gates are left to the patterns here as they are for the other rules.
        cases = " ".join(
            f"when {quoted(language)} then " + _numbers_of([(n, rules[n].rule) for n in numbers])
            for language, numbers in fixed.items())
        searched = (f"concat({searched}, coalesce(case when profile = 'audit' then array_compact("
                    f"case language {cases} end) end, array()))")
    matched = rows.withColumn("matched", F.expr(searched)).where("size(matched) > 0")
    # Every audit rule is a kind of its own; of scan rules, in order of kind, those that begin one.
    by_kind = "array_sort(transform(matched, n -> struct(get(kinds, n) as kind, n as n)))"
    firsts = let(by_kind, "ks", "transform(filter(ks, (k, i) -> i = 0 or "
                 "get(ks, i - 1).kind <> k.kind), k -> k.n)")
    first = matched.select(
        "profile", "path", "language", "line", "code", F.explode(F.expr(
            f"case when profile = 'audit' then matched else {firsts} end")).alias("number"))
    fields = ("rule_id", "severity", "type", "category", "message", "recommendation")
    table = files.sparkSession.createDataFrame(
        [(n, *(getattr(rule, f) for f in fields)) for n, (_, rule) in enumerate(rules)],
        "number int, " + ", ".join(f"{f} string" for f in fields))
    return first.join(F.broadcast(table), "number").drop("number")
