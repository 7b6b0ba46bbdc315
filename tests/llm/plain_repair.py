"""A plain version of conversation repair: whole tables of audits, one row after the other."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")


def damage(rows):
    """rows of (conv_id, turn, role, text)"""
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (2 if kind == 3 else 1)


def faults(rows):
    seen = set()
    for _, role, text in rows:
        last = LAST.search(text)
        if not last:
            yield "blank"
        elif (role, text) in seen:
            yield "duplicate"
        else:
            yield None if last[1] in ".!?" else "truncated"
        seen.add((role, text))


def mend(rows, wrong):
    """(cost, audit, turns): the least of all, by a table of the states after each row."""
    def inserted(table):
        for _ in range(4):
            for state, (cost, audit, turns) in list(table.items()):
                for initial, role in (("u", "user"), ("a", "assistant")):
                    to = NEXT.get((state, initial))
                    if to is not None:
                        way = (cost + 5, audit + "I", turns + [(role, "")])
                        table[to] = min(table.get(to, way), way, key=lambda w: w[:2])
        return table

    table = inserted({0: (0, "", [])})
    for (_, role, text), fault in zip(rows, wrong):
        after = {}
        for state, (cost, audit, turns) in table.items():
            ways = [(state, (cost + 2, audit + "D", turns))]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                for to_role, edit, price in (
                        (role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    to = NEXT.get((state, to_role[:1]))
                    if to is not None:
                        ways.append((to, (cost + price + more, audit + edit,
                                          turns + [(to_role, text)])))
            for to, way in ways:
                after[to] = min(after.get(to, way), way, key=lambda w: w[:2])
        table = inserted(after)
    return min((table[s] for s in (0, 3) if s in table), key=lambda w: w[:2])


def report(original, rows):
    """{conv_id: the columns after it}"""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role, text))
    out = {}
    for conv in {r[0] for r in original}:
        group = sorted(groups[conv], key=lambda r: (
            r[0] is not None, r[0] or 0, r[1],
            hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        wrong = list(faults(group))
        turns = {r[0] for r in group if r[0] is not None}
        pairs = [(a[1][:1], b[1][:1]) for a, b in zip(group, group[1:])]
        cost, audit, mended = mend(group, wrong)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, wrong.count("blank"),
            wrong.count("duplicate"), wrong.count("truncated"),
            sum(p not in {("s", "u"), ("u", "a"), ("a", "u")} for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in mended).encode()).hexdigest())
    return out
