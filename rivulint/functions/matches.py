"""All matches of a pattern in a text, with their places, inside one column expression.

Spark has no function for match positions.  A mark is put in front of every match with one
``regexp_replace``; the places are then read off the marked text: the number of marks per
line gives line numbers, the pieces between marks give offsets and surrounding text.  No row
is exploded and nothing is shuffled; the work is linear in the text.

The builders return SQL text rather than ``Column`` objects: the expressions are large and
parsing one text is far cheaper than thousands of calls into the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\x01"
# A mark that occurs in the text itself is shown to the patterns as this other control
# character; no pattern tells the two apart and no snippet is taken from that copy.
UNMARK = "\x02"
BLOCK = 1024


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


LF, SPLIT_MARK = quoted("\n"), quoted(MARK)


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` inside ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def searchable(content: str) -> str:
    return f"replace({content}, {SPLIT_MARK}, {quoted(UNMARK)})"


def mark_matches(content: str, pattern: str) -> str:
    """``content`` must be ``searchable``."""
    return f"regexp_replace({content}, {quoted(pattern)}, {quoted(MARK + '$0')})"


def mark_parts(content: str, pattern: str) -> str:
    """Marks matches of a pattern whose two groups are the text before a match and the match."""
    return f"regexp_replace({content}, {quoted(pattern)}, {quoted('$1' + MARK + '$2')})"


def has_mark(marked: str) -> str:
    return f"contains({marked}, {SPLIT_MARK})"


def groups_of(content: str, pattern: str, group: int) -> str:
    return f"regexp_extract_all({content}, {quoted(pattern)}, {group})"


def match_lines(marked: str) -> str:
    """1-based line of every match, in order."""
    # Most lines have no mark; a search settles those without copying them.
    return (
        f"flatten(array_compact(transform(split({marked}, {LF}, -1), (ln, ix) -> "
        f"case when {has_mark('ln')} then array_repeat("
        f"ix + 1, length(ln) - length(replace(ln, {SPLIT_MARK}, ''))) end)))"
    )


def newline_count(text: str) -> str:
    return f"(length({text}) - length(replace({text}, {LF}, '')))"


def line_after(prefix: str) -> str:
    return f"({newline_count(prefix)} + 1)"


def _fold(values: str) -> str:
    return (
        f"aggregate({values}, named_struct('total', 0, 'out', cast(array() as array<int>)), "
        "(st, v) -> named_struct('total', st.total + v, "
        "'out', concat(st.out, array(st.total + v))), st -> st.out)"
    )


def prefix_sums(numbers: str) -> str:
    """Running totals of an int array, folded block by block so that copying stays linear."""
    block = _fold(f"slice(nums, blk * {BLOCK} + 1, {BLOCK})")
    blocks = f"transform(sequence(0, cast(ceil(size(nums) / {BLOCK}) as int) - 1), blk -> {block})"
    ends = _fold("transform(blks, b -> element_at(b, -1))")
    joined = (
        f"flatten(zip_with(blks, concat(array(0), slice({ends}, 1, size(blks) - 1)), "
        "(b, base) -> transform(b, v2 -> v2 + base)))"
    )
    long_form = let(blocks, "blks", joined)
    return let(
        numbers, "nums",
        f"if(size(nums) <= {BLOCK}, {_fold('nums')}, {long_form})",
    )


def located_matches(content: str, pattern: str) -> Column:
    """array<struct<match_no, start_at, line, text>> of all matches, NULL without any."""
    marked = mark_matches(searchable(content), pattern)
    texts = groups_of(searchable(content), pattern, 0)
    before = "slice(segs, 1, size(segs) - 1)"
    offsets = prefix_sums(f"transform({before}, s -> length(s))")
    lines = prefix_sums(f"transform({before}, s -> {newline_count('s')})")
    places = (
        f"zip_with({offsets}, {lines}, "
        "(o, n) -> named_struct('start_at', o, 'line', n + 1))"
    )
    found = (
        f"transform(zip_with({places}, {texts}, (p, t) -> named_struct('p', p, 't', t)), "
        "(m, i) -> named_struct('match_no', i + 1, 'start_at', m.p.start_at, "
        "'line', m.p.line, 'text', m.t))"
    )
    return F.expr(let(
        f"split({marked}, {SPLIT_MARK}, -1)", "segs",
        f"case when size(segs) > 1 then {found} end",
    ))


def surroundings(marked: str, before: int, after: int, shortest: int) -> str:
    """Text from ``before`` characters ahead of each match start to ``after`` behind it.

    Every match has at least ``shortest`` characters, so only a fixed number of neighbouring
    pieces can reach into a window.
    """
    n_after = -(-after // shortest) + 1
    n_before = -(-before // shortest) + 1
    heads = f"transform(segs, s -> left(s, {after}))"
    right = f"left(array_join(slice(heads, k + 1, {n_after}), ''), {after})"
    if before == 0:
        window = f"transform(sequence(1, size(segs) - 1), k -> {right})"
        return let(f"split({marked}, {SPLIT_MARK}, -1)", "segs", let(heads, "heads", window))
    tails = f"transform(segs, s -> right(s, {before}))"
    first = f"greatest(1, k + 1 - {n_before})"
    left = f"right(array_join(slice(tails, {first}, k + 1 - {first}), ''), {before})"
    window = f"transform(sequence(1, size(segs) - 1), k -> concat({left}, {right}))"
    return let(
        f"split({marked}, {SPLIT_MARK}, -1)", "segs",
        let(heads, "heads", let(tails, "tails", window)),
    )
