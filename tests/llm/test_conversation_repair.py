"""Conversation repair against a plain version."""

from __future__ import annotations

import random

import duckdb
import pytest
from plain_repair import damage, report

from rivulint.llm import conversation_repair, queries

FIELDS = "conv_id long, turn long, role string, text string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
           "repaired_sha256"]


def as_report(df):
    found = df.collect()
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found}
    assert len(out) == len(found)
    return out


def repaired(spark, rows, fields=FIELDS):
    df = spark.createDataFrame(rows, fields)
    return as_report(conversation_repair.repair(df, df))


def random_rows(seed, conversations=400, longest=9):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Cut off", "  ", "", "Why? ", "a.\n", "Sure.", "Ok", None, "b."]
    return [(conv, rng.choice([None, 1, 2, 3, 3, 4, 7, i]),
             rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
             rng.choice(texts))
            for conv in range(conversations) for i in range(rng.randrange(longest))]


def plain_nulls(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rows = random_rows(seed)
    rows += [(None, *r[1:]) for r in rows[:12]]
    assert repaired(spark, rows) == report(rows, plain_nulls(rows))


def test_damaged_conversations_of_the_tables(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM "
                          f"'/root/testdata/{sf}/conversations.parquet'").fetchall()
        have = as_report(queries.QUERIES["op13_conversation_repair"](spark, f"/root/testdata/{sf}"))
        assert have == report(rows, list(damage(rows)))


def test_long_conversations_are_chained_from_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", 3)
    rows = random_rows(3, conversations=12, longest=60)
    # A third of all rows in one conversation, and a third of it the same row.
    rows += [(99, i % 40, "assistant" if i % 2 else "user", f"t{i % 3}.") for i in range(150)]
    rows += [(99, 5, "user", "Again and again.")] * 75
    assert repaired(spark, rows) == report(rows, plain_nulls(rows))


def test_small_cases(spark):
    rows = [(1, 0, "user", "Hi."),                                    # an answer is missing
            (2, 0, "system", "Be."), (2, 1, "user", "Q?"), (2, 2, "assistant", "A."),
            (3, 0, "assistant", "A."), (3, 1, "assistant", "B."),
            (4, 0, "user", " "), (5, 0, "system", "Only.")]
    got = repaired(spark, rows)
    assert {c: r[5:7] for c, r in got.items()} == {
        1: (2, "D"), 2: (0, "KKK"), 3: (1, "RK"), 4: (2, "D"), 5: (2, "D")}
    assert repaired(spark, []) == {}


def test_a_conversation_that_loses_all_rows(spark):
    some = spark.createDataFrame([(7, 1, "user", "x.")], FIELDS)
    got = as_report(conversation_repair.repair(some, some.where("false")))
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert got == {7: (0, 0, 0, 0, 0, 0, "", empty)}


def test_other_columns_and_long_texts(spark):
    rows = [(1, 0, "user", "long " * 200_000 + ".", 1, "x"), (1, 1, "assistant", "A.", 2, "y")]
    got = repaired(spark, rows, FIELDS + ", block long, digest string")
    plain = [r[:4] for r in rows]
    assert got == report(plain, plain)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Q."), (1, 2, "user", "Q."), (1, 3, "tool", "T."),
            (2, 0, "user", "only")]
    df = spark.createDataFrame(rows, FIELDS)
    got = sorted(map(tuple, conversation_repair.repaired_turns(df).collect()))
    assert got == [("v1", 0, "system", "S."), ("v1", 1, "user", "Q."), ("v1", 2, "assistant", "T.")]


def test_both_directions_agree_with_every_path():
    """All edit sequences of short blocks, by hand."""
    def ways(tokens, state, end, cost=0, audit="", run=0):
        if not tokens and state == end:
            yield cost, audit
        if not tokens:
            return
        if run < 3:
            to = conversation_repair.AFTER[state][conversation_repair.TURN[state][0]]
            yield from ways(tokens, to, end, cost + 5, audit + "I", run + 1)
        for edit, step, to in conversation_repair._steps(tokens[0], state):
            yield from ways(tokens[1:], to, end, cost + step, audit + edit)

    rng = random.Random(5)
    for _ in range(300):
        tokens = "".join(rng.choice("suaSUAx-") for _ in range(rng.randrange(1, 5)))
        for a in range(4):
            for b in range(4):
                assert conversation_repair.cheapest(tokens, a, b) == min(
                    ways(tokens, a, b), default=None), (tokens, a, b)
