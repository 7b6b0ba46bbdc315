"""Repair of conversation structure by bidirectional Dijkstra over an edit lattice.

A conversation in order should read ``(s?(ua)+)?`` by the initials of its roles: an optional
system turn, then user and assistant in turns, or nothing at all.  Its rows are faulty where they
are blank, where role and text were seen earlier, and where they end without ``.``, ``!`` or ``?``.
Edits keep a row (0), give it the role user or assistant (1), delete it (2; blank and repeated
rows must go) or insert an empty turn (5); a truncated row that stays costs 5 more.  The cheapest
edits are taken, of equal ones those whose initials K, R, D, I are the least as text.

Search.  A node of the lattice is (rows consumed, state of the pattern); the audit fixes the path.
A forward and a reverse heap settle nodes by cost; when their tops exceed the best crossing
together, all crossings of that cost have been seen, and the least concatenated audit wins.
Within one cost nodes are settled along the lattice, so the least audit of a node is known
when it is settled.

Scale.  Rows that are equal in all columns are one row with a count from the start.  Rows travel
without their texts, with a digest.  They are range-partitioned by conversation and turn, so a
conversation of any size lies in many tasks, and cut into blocks of ``BLOCK`` rows.  A block gives
the cheapest audit for each state it may be entered and left in; equal blocks are searched once
per task.  Blocks of a conversation are then chained in order: for each state the chain knows the
cost, the rank of its audit among the states' and the state before, a few bytes a block.  Every
block's audit ends with a row's edit, so none is the beginning of another and ranks decide
exactly.  Texts move once, at the end, and meet their edits in order in a stream that holds one
row; that stream is one task for one conversation because SHA-256 is sequential.

Null, empty and repeated: a null role or text is one space, so such a text is blank; a null turn
comes first; a null conv_id is a conversation of its own; rows equal in conv_id and turn are
ordered by role and then by a digest of their texts; an empty table gives no row; a conversation
without any row left is reported with zeros, an empty audit and the hash of the empty string.
A text of any length is one value and is read whole.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulint.llm.common import keyed_join, settled

BLOCK, REMEMBERED = 128, 1 << 15
GLYPH = r"[^\x20\x09-\x0D]"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
# States of the pattern: nothing yet, after s, after u, after a; where each role leads.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT},
         ASSISTANT: {"u": USER}}
# What is inserted, or given to a row, at a state is fixed by the pattern.
TURN = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
# Inserted turns that complete the pattern from a state.
ENDING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
GONE = "-"
FAULTS = ("blank", "duplicate", "truncated")


def damaged(conversations: DataFrame) -> DataFrame:
    """Test damage: by the checksum of conversation and turn a row is dropped, emptied, shorn of
    its sentence ends, repeated or made a user's."""
    space = F.lit(" ")
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space)
                               for c in ("conv_id", "turn")])
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"),
        text.alias("text"), (F.crc32(named) % 20).alias("kind")).where("kind <> 0").select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(
            F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
            F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(
            F.array(F.lit(0)))).alias("copy")).drop("copy")


# --- the lattice of one block ---------------------------------------------------------------

def _steps(token: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) for a row: its role's initial, in capitals if truncated, or gone."""
    yield DELETE, COST[DELETE], state
    if token != GONE:
        extra = TRUNCATED_COST if token.isupper() else 0
        kept = AFTER[state].get(token.lower())
        if kept is not None:
            yield KEEP, COST[KEEP] + extra, kept
        yield REROLE, COST[REROLE] + extra, AFTER[state][TURN[state][0]]


def _forward_edges(tokens: str, node: tuple[int, int]) -> Iterator[tuple[str, int, tuple[int, int]]]:
    at, state = node
    if at < len(tokens):
        # Inserts stand before a row; those behind the last row belong to the ending.
        yield INSERT, COST[INSERT], (at, AFTER[state][TURN[state][0]])
        for edit, cost, after in _steps(tokens[at], state):
            yield edit, cost, (at + 1, after)


def _reverse_edges(tokens: str, node: tuple[int, int]) -> Iterator[tuple[str, int, tuple[int, int]]]:
    at, state = node
    if at < len(tokens):
        for before in AFTER:
            if AFTER[before][TURN[before][0]] == state:
                yield INSERT, COST[INSERT], (at, before)
    if at:
        for before in AFTER:
            for edit, cost, after in _steps(tokens[at - 1], before):
                if after == state:
                    yield edit, cost, (at - 1, before)


class _Search:
    """One direction: settles nodes by cost, and within a cost along the lattice."""

    def __init__(self, tokens: str, source: tuple[int, int], edges, sign: int):
        self.tokens, self.edges, self.sign = tokens, edges, sign
        self.known, self.settled = {source: (0, "")}, set()
        self.heap = [(0, sign * source[0], source)]

    def top(self) -> int | None:
        while self.heap and (self.heap[0][2] in self.settled
                             or self.known[self.heap[0][2]][0] < self.heap[0][0]):
            heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def settle(self) -> tuple[tuple[int, int], list[tuple[str, int, tuple[int, int]]]]:
        """Settle the node on top; it and the edges that leave it in this direction."""
        node = heappop(self.heap)[2]
        self.settled.add(node)
        cost, audit = self.known[node]
        out = list(self.edges(self.tokens, node))
        for edit, step, other in out:
            found = (cost + step, audit + edit if self.sign > 0 else edit + audit)
            if other not in self.known or found < self.known[other]:
                if other not in self.known or found[0] < self.known[other][0]:
                    heappush(self.heap, (found[0], self.sign * other[0], other))
                self.known[other] = found
        return node, out


def cheapest(tokens: str, entry: int, end: int) -> tuple[int, str] | None:
    """(cost, least audit) of the cheapest edits that lead from state ``entry`` to state ``end``."""
    ahead = _Search(tokens, (0, entry), _forward_edges, 1)
    back = _Search(tokens, (len(tokens), end), _reverse_edges, -1)
    if not tokens:
        return (0, "") if entry == end else None
    best, crossings = None, []
    while True:
        tops = ahead.top(), back.top()
        # An exhausted side has settled all it can reach; so all crossings have been met.
        if None in tops or (best is not None and sum(tops) > best):
            break
        side, other = (ahead, back) if tops[0] <= tops[1] else (back, ahead)
        node, out = side.settle()
        for edit, step, far in out:
            if far in other.settled:
                u, v = (node, far) if side is ahead else (far, node)
                cost = ahead.known[u][0] + step + back.known[v][0]
                if best is None or cost < best:
                    best, crossings = cost, []
                if cost == best:
                    crossings.append((u, edit, v))
    if best is None:
        return None
    return best, min(ahead.known[u][1] + edit + back.known[v][1] for u, edit, v in crossings)


@lru_cache(maxsize=REMEMBERED)
def block_table(tokens: str, entries: tuple[int, ...]) -> tuple[tuple[int, int, int, str], ...]:
    """(entry, exit, cost, audit) of every way through a block."""
    found = ((a, b, cheapest(tokens, a, b)) for a in entries for b in AFTER)
    return tuple((a, b, *way) for a, b, way in found if way is not None)


def applied(tokens: str, entry: int, audit: str) -> Iterator[tuple[list[str], str, str | None]]:
    """For each row: the turns inserted before it, its edit and the role it is given, if any."""
    state, inserted, rows = entry, [], iter(tokens)
    for edit in audit:
        if edit == INSERT:
            inserted.append(TURN[state])
            state = AFTER[state][TURN[state][0]]
            continue
        token = next(rows)
        role = TURN[state] if edit == REROLE else None
        yield inserted, edit, role
        inserted = []
        if edit == REROLE:
            state = AFTER[state][role[0]]
        elif edit == KEEP:
            state = AFTER[state][token.lower()]


# --- rows, blocks and chains ----------------------------------------------------------------

def _conversation() -> Column:
    return F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n"))


def _digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def _plain(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(_conversation().alias("conv"), F.col("turn").cast("long").alias("turn"),
                       role.alias("role"), text.alias("text"), _digest(role, text).alias("digest"))


def flagged_rows(rows: DataFrame) -> DataFrame:
    """conv, turn, role, digest, times and fault: each different row once, without its text."""
    last = F.regexp_extract("text", rf"({GLYPH})[\x20\x09-\x0D]*\z", 1)
    light = _plain(rows).select(
        "conv", "turn", "role", "digest",
        F.when(last == "", F.lit(0)).when(last.isin(".", "!", "?"), F.lit(2)).otherwise(
            F.lit(1)).alias("end"))
    copies = settled(light.groupBy("conv", "turn", "role", "digest", "end").agg(
        F.count(F.lit(1)).alias("times")), "conversation-rows")
    # A null turn is the least in a struct.
    firsts = settled(copies.groupBy("conv", "digest").agg(
        F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")), "first-turns")
    later = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return keyed_join(copies, firsts, ["conv", "digest"]).select(
        "conv", "turn", "role", "digest", "times",
        F.when(F.col("end") == 0, "blank").when(later, "duplicate").when(
            F.col("end") == 1, "truncated").alias("fault"))


BLOCK_FIELDS = ("conv string, block long, tokens string, entries array<int>, first string, "
                "last string, illegal long, extra long, turns array<long>, roles array<string>, "
                "digests array<string>, times array<long>, per_row array<int>")
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _block(conv: str, number: int, entries: tuple[int, ...], rows: list[tuple]) -> tuple:
    tokens, per_row, illegal, extra, before = [], [], 0, 0, None
    for _, role, _, times, fault in rows:
        initial = role[:1]
        if before is not None and (before, initial) not in LEGAL:
            illegal += 1
        illegal += times - 1
        before = initial
        gone = fault in ("blank", "duplicate")
        # All copies of a row but the first are repeated; they cost alike whatever else is done.
        repeated = times > 1 and not gone
        token = initial if initial in ("s", "u", "a") else "x"
        tokens.append(GONE if gone else token.upper() if fault == "truncated" else token)
        if repeated:
            tokens.append(GONE)
        per_row.append(2 if repeated else 1)
        extra += COST[DELETE] * (times - per_row[-1])
    turns, roles, digests, times, _ = map(list, zip(*rows))
    return (conv, number, "".join(tokens), list(entries), rows[0][1][:1], before, illegal, extra,
            turns, roles, digests, times, per_row)


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(),
             "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
             "array<string>": pa.list_(pa.string())}
    names, types = zip(*(f.split(" ") for f in fields.split(", ")))
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, k in zip(columns, types)], names=list(names))


def _in_batches(rows: Iterator[tuple], fields: str, size: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, fields)
            held = []
    yield _batch(held, fields)


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def blocks(flagged: DataFrame) -> DataFrame:
    """Rows in order, cut into blocks; a block's number grows along its conversation."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40

        def made() -> Iterator[tuple]:
            nonlocal number
            # Only the first conversation of a task may have begun before it.
            entries: tuple[int, ...] = tuple(AFTER)
            for conv, rows in groupby(_tuples(batches), key=lambda r: r[0]):
                held: list[tuple] = []
                for row in rows:
                    held.append(row[1:])
                    if len(held) == BLOCK:
                        yield _block(conv, number, entries, held)
                        held, number, entries = [], number + 1, tuple(AFTER)
                if held:
                    yield _block(conv, number, entries, held)
                    number += 1
                entries = (START,)

        yield from _in_batches(made(), BLOCK_FIELDS, 64)

    order = ["conv", "turn", "role", "digest"]
    placed = flagged.select(*order, "times", "fault").repartitionByRange(
        *order).sortWithinPartitions(*order)
    return placed.mapInArrow(cut, BLOCK_FIELDS)


CHAIN_FIELDS = "conv string, block long, entry int, exit int, ending int, cost long, illegal long"


def _chained(conv: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    """The states at which the cheapest audit enters and leaves every block."""
    # state: (cost, rank of its audit); before: per block the entry of each exit, 4 if none.
    labels, numbers, before = {START: (0, 0)}, [], bytearray()
    illegal, extra, last = 0, 0, None
    for _, number, tokens, entries, first, final, wrong, more in rows:
        found: dict[int, tuple] = {}
        for entry, out, cost, audit in block_table(tokens, tuple(entries)):
            if entry in labels:
                way = (labels[entry][0] + cost, labels[entry][1], audit, entry)
                found[out] = min(found.get(out, way), way)
        ranks = {s: r for r, s in enumerate(sorted(found, key=lambda s: found[s][1:3]))}
        labels = {s: (found[s][0], ranks[s]) for s in found}
        numbers.append(number)
        before += bytes(found[s][3] if s in found else 4 for s in AFTER)
        illegal += wrong + (last is not None and (last, first) not in LEGAL)
        extra, last = extra + more, final
    cost, _, state = min((c + COST[INSERT] * ENDING[s], r, s) for s, (c, r) in labels.items())
    exits = []
    for at in range(len(numbers) - 1, -1, -1):
        exits.append(state)
        state = before[4 * at + state]
    for at, out in enumerate(reversed(exits)):
        ends = at == len(numbers) - 1
        yield (conv, numbers[at], before[4 * at + out], out, ENDING[out] if ends else 0,
               cost + extra if ends else None, illegal if ends else None)


def chained(cut: DataFrame) -> DataFrame:
    """entry, exit and, at a conversation's last block, ending, cost and illegal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for conv, rows in groupby(_tuples(batches), key=lambda r: r[0]):
                yield from _chained(conv, rows)
        yield from _in_batches(made(), CHAIN_FIELDS)

    light = cut.select("conv", "block", "tokens", "entries", "first", "last", "illegal", "extra")
    return light.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(
        run, CHAIN_FIELDS)


EDIT_FIELDS = ("conv string, turn long, role string, digest string, inserted array<string>, "
               "edit string, times long, given string, after array<string>, cost long, "
               "illegal long")


def row_edits(cut: DataFrame, chains: DataFrame) -> DataFrame:
    """What is done to each row: turns inserted before and after it, its edit and new role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for (conv, tokens, entries, turns, roles, digests, times, per_row, entry, out, ending,
                 cost, illegal) in _tuples(batches):
                audit = next(w[3] for w in block_table(tokens, tuple(entries))
                             if w[:2] == (entry, out))
                done, state, after = applied(tokens, entry, audit), out, []
                for _ in range(ending):
                    after.append(TURN[state])
                    state = AFTER[state][TURN[state][0]]
                for at, several in enumerate(per_row):
                    inserted, edit, given = next(done)
                    ends = at == len(per_row) - 1
                    if several == 2:
                        # Turns may be inserted before the copies that go, too; the cheapest
                        # least audit has none there, since D comes before I.
                        more, _, _ = next(done)
                        assert not more
                    yield (conv, turns[at], roles[at], digests[at], inserted, edit, times[at],
                           given, after if ends else [], cost if ends else None,
                           illegal if ends else None)
        yield from _in_batches(made(), EDIT_FIELDS)

    return cut.drop("illegal").join(chains.drop("conv"), "block").select(
        "conv", "tokens", "entries", "turns", "roles", "digests", "times", "per_row", "entry",
        "exit", "ending", "cost", "illegal").mapInArrow(run, EDIT_FIELDS)


RECENT = 4096


def _without_recent_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops a row that this task has just passed on; the reader of the stream needs one."""
    seen: set = set()
    for batch in batches:
        kept = []
        for at, key in enumerate(zip(*(batch.column(c).to_pylist()
                                       for c in ("conv", "turn", "digest")))):
            if key not in seen:
                if len(seen) >= RECENT:
                    seen.clear()
                seen.add(key)
                kept.append(at)
        yield batch.take(pa.array(kept, pa.int32()))


def edited_stream(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits, each followed by the text of its row, in order within a conversation."""
    columns = [f.split(" ") for f in EDIT_FIELDS.split(", ")]
    texts = _plain(rows).select("conv", "turn", "role", "digest", "text").mapInArrow(
        _without_recent_copies, "conv string, turn long, role string, digest string, text string")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in columns[4:]]
    both = edits.select("*", F.lit(None).cast("string").alias("text")).union(
        texts.select("conv", "turn", "role", "digest", *none, "text"))
    # A row's edit, which has no text, is before its texts.
    return both.repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest",
                                                         F.col("text").isNotNull())


def _turns(rows: Iterator[tuple]) -> Iterator[tuple[str, int, str | None, str | None, tuple]]:
    """(edit, times, role, text, edit row) for the edits of a conversation, in order.

    Role and text are those of the turn that results, null where none does.
    """
    edit = None
    after: list[str] = []
    for row in rows:
        if row[-1] is None:
            edit, waiting = row, True
            for role in row[4]:
                yield INSERT, 1, role, "", row
            if row[5] == DELETE:
                yield DELETE, row[6], None, None, row
            after = row[8] or after
        elif waiting and edit[5] != DELETE:
            waiting = False
            yield edit[5], 1, edit[7] or edit[2], row[-1], edit
            if edit[6] > 1:
                yield DELETE, edit[6] - 1, None, None, edit
    for role in after:
        yield INSERT, 1, role, "", edit


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv, position (from 0), role and text of the repaired conversations."""
    fields = "conv string, position long, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for conv, group in groupby(_tuples(batches), key=lambda r: r[0]):
                kept = ((role, text) for _, _, role, text, _ in _turns(group) if role is not None)
                yield from ((conv, i, *turn) for i, turn in enumerate(kept))
        yield from _in_batches(made(), fields)

    return edited_stream(rows, _edits(rows)[1]).mapInArrow(run, fields)


def _edits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    flagged = settled(flagged_rows(rows), "flagged-rows")
    cut = settled(blocks(flagged), "conversation-blocks")
    return flagged, row_edits(cut, settled(chained(cut), "block-chains"))


def repair(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A report on every conv_id of ``conversations``, whose rows to repair are ``rows``."""
    flagged, edits = _edits(rows)
    fields = "conv string, illegal long, cost long, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for conv, group in groupby(_tuples(batches), key=lambda r: r[0]):
                audit, digest, cost, illegal, first = [], hashlib.sha256(), None, None, True
                for edit, times, role, text, row in _turns(group):
                    audit.append(edit * times)
                    if role is not None:
                        digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                        first = False
                    if row[9] is not None:
                        cost, illegal = row[9], row[10]
                yield conv, illegal, cost, "".join(audit), digest.hexdigest()
        yield from _in_batches(made(), fields, 16)

    repaired = edited_stream(rows, edits).mapInArrow(run, fields)
    counts = flagged.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"),
                   F.lit(0)).alias("gaps"),
        *[F.sum(_faulty(f)).alias(f) for f in FAULTS])
    every = conversations.select("conv_id").distinct().withColumn("conv", _conversation())
    out = every.join(counts, "conv", "left").join(repaired, "conv", "left")
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
                     for c in ("gaps", *FAULTS, "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _faulty(fault: str) -> Column:
    """Rows whose first fault this is; all copies of a row but the first are repeated."""
    is_blank = F.coalesce(F.col("fault") == "blank", F.lit(False))
    is_it = F.coalesce(F.col("fault") == fault, F.lit(False))
    if fault == "blank":
        return F.when(is_it, F.col("times")).otherwise(F.lit(0))
    if fault == "truncated":
        return F.when(is_it, F.lit(1)).otherwise(F.lit(0))
    return F.when(is_blank, F.lit(0)).when(is_it, F.col("times")).otherwise(F.col("times") - 1)
