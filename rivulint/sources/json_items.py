"""The objects of a JSON array in files of any size, read by many tasks.

A report is often one line: a single array, or an object with the array under a key.  Spark can
divide such a file only at characters, so it is read as text divided at commas, and what a
task has to know about the place where its block begins is found first:

1. Every block is walked under both assumptions, that it begins inside a string or outside, and gives
   how it ends in either case: inside or outside, how much deeper, and the last key at each depth.
2. These rows, one a block, are folded along each file; every block's true beginning is then known.
3. Blocks are walked again and give the objects that lie in them whole, and the two pieces at
   their ends, which are put together along the file.

A task holds one record and one object at a time.  A backslash never stands before the comma that
ends a record, so escapes are never divided.  Objects that are not closed are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|"|[{}\[\]:]', re.DOTALL)
ENDS = ("path string, block long, closed boolean, open boolean, deeper_closed int, "
        "deeper_open int, keys_closed map<int,string>, keys_open map<int,string>")
STARTS = "path string, block long, open boolean, depth int, key string"
# A piece of an object that a block holds whole, begins, only continues or ends.
PIECES = "path string, block long, kind string, item string"
WHOLE, HEAD, MIDDLE, TAIL = "whole", "head", "middle", "tail"


class _Walk:
    """Where in a JSON text one is, record by record."""

    def __init__(self, inside: bool, depth: int, keys: dict[int, str] | None = None):
        self.inside, self.depth, self.keys, self.last = inside, depth, keys or {}, ""

    def tokens(self, record: str) -> Iterator[tuple[str, int, int]]:
        """(bracket, its start, its end) with ``depth`` as before it; keeps track of the rest."""
        at = 0
        if self.inside:
            end = REST_OF_STRING.match(record)
            if end is None:
                return
            self.inside, at, self.last = False, end.end(), ""
        for found in TOKEN.finditer(record, at):
            token = found[0]
            if token == '"':
                # A string that goes on behind the comma; what follows in this record is in it.
                self.inside = True
                return
            if token[0] == '"':
                self.last = token
            elif token == ":":
                self.keys[self.depth] = self.last
            else:
                yield token, found.start(), found.end()
                self.depth += 1 if token in "[{" else -1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """((path, block), records) for the blocks of a task, one after the other."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    for key, group in groupby(rows(), key=lambda r: r[:2]):
        yield key, (r[2] for r in group)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (path, block), records in _blocks(batches):
        walks = [_Walk(inside, 0) for inside in (False, True)]
        for record in records:
            for walk in walks:
                for _ in walk.tokens(record):
                    pass
        closed, opened = walks
        maps = pa.map_(pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array([path]), pa.array([block], pa.int64()),
             pa.array([closed.inside]), pa.array([opened.inside]),
             pa.array([closed.depth], pa.int32()), pa.array([opened.depth], pa.int32()),
             pa.array([list(closed.keys.items())], maps),
             pa.array([list(opened.keys.items())], maps)],
            names=[f.split(" ")[0] for f in ENDS.replace("map<int,string>", "map").split(", ")])


def _folded(ends: pd.DataFrame) -> pd.DataFrame:
    """Where each block of a file truly begins."""
    inside, depth, key, out = False, 0, "", []
    for row in ends.sort_values("block").itertuples():
        out.append((row.path, row.block, inside, depth, key))
        keys = dict(row.keys_open if inside else row.keys_closed)
        # Keys are counted from the block's own beginning; those of the outermost object count.
        key = keys.get(1 - depth, key)
        deeper = row.deeper_open if inside else row.deeper_closed
        inside = bool(row.open if inside else row.closed)
        depth += deeper
    return pd.DataFrame(out, columns=["path", "block", "open", "depth", "key"])


def _cut(field: str | None):
    """Objects and pieces of objects of every block."""
    level, wanted = (1, None) if field is None else (2, f'"{field}"')

    def pieces(records: Iterator[str], walk: _Walk) -> Iterator[tuple[str, str]]:
        # Inside an object from the beginning: the piece ends one that began before.
        held: list[str] | None = [] if walk.depth > level and (
            wanted is None or walk.keys.get(1) == wanted) else None
        began = False
        for record in records:
            start = 0
            for token, first, end in walk.tokens(record):
                in_array = wanted is None or walk.keys.get(1) == wanted
                if token == "{" and walk.depth == level and in_array:
                    held, began, start = [], True, first
                elif token == "}" and walk.depth == level + 1 and held is not None:
                    held.append(record[start:end])
                    yield (WHOLE if began else TAIL), ",".join(held)
                    held = None
            if held is not None:
                held.append(record[start:])
        if held is not None:
            yield (HEAD if began else MIDDLE), ",".join(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        for (path, block, inside, depth, key), group in groupby(rows(), key=lambda r: r[:5]):
            walk = _Walk(inside, depth, {1: key})
            found: list[tuple] = []
            for kind, item in pieces((r[5] for r in group), walk):
                found.append((path, block, kind, item))
                if len(found) == 1000:
                    yield pa.RecordBatch.from_pylist(
                        [dict(zip(("path", "block", "kind", "item"), f)) for f in found])
                    found = []
            if found:
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("path", "block", "kind", "item"), f)) for f in found])

    return run


def _joined(pieces: pd.DataFrame) -> pd.DataFrame:
    """Pieces of a file's divided objects put together."""
    out, held = [], None
    for row in pieces.sort_values(["block", "place"]).itertuples():
        if row.kind == HEAD:
            held = [row.item]
        elif held is not None:
            held.append(row.item)
            if row.kind == TAIL:
                out.append((row.path, ",".join(held)))
                held = None
    return pd.DataFrame(out, columns=["path", "item"])


def json_items(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """(path, item): the objects of the files' arrays, or of the arrays under ``field``, as text."""
    records = spark.read.text(path, lineSep=",").select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"), "value")
    starts = records.mapInArrow(_ends, ENDS).groupBy("path").applyInPandas(_folded, STARTS)
    # One row for each block of a file, of some hundred megabytes.
    known = records.join(F.broadcast(starts), ["path", "block"]).select(
        "path", "block", "open", "depth", "key", "value")
    pieces = known.mapInArrow(_cut(field), PIECES)
    # A tail stands before a head of the same block.
    place = F.when(F.col("kind") == HEAD, 1).otherwise(0)
    divided = pieces.where(F.col("kind") != WHOLE).withColumn("place", place).groupBy(
        "path").applyInPandas(_joined, "path string, item string")
    return pieces.where(F.col("kind") == WHOLE).select("path", "item").union(divided)
