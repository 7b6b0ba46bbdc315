"""Sequences of a fixed length packed along a space-filling curve.

Every document's token ids are hashed into a vector, the vector is projected to a few
dimensions, and its cell there gets its number along a Hilbert curve.  Documents are ordered by
that number and laid one after the other; the line is cut every ``length`` tokens, so that
neighbours on the curve share sequences and nothing is padded.  What is left at the end, shorter
than a sequence, is cut into sequences whose sizes are powers of two, which need no padding.

Null, empty and repeated: a null text counts as empty and is the end id alone; repeated rows and
equal documents lie beside each other as documents of their own; a null doc_id stays null; an
empty table gives no piece.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulint.llm.common import settled
from rivulint.llm.word_tokens import encoder

DIMENSIONS, BITS, SEED = 4, 8, 7
# Vectors are standardised over all documents; the curve covers this many deviations each way.
SPAN = 3.0

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, hilbert long")


def projection(size: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """Where each token id is sent: hashed features times a Gaussian projection."""
    return np.random.default_rng(seed).standard_normal((size, dimensions)).astype("float32")


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Numbers of the cells (rows of non-negative coordinates) along a Hilbert curve.

    The coordinates are turned into the curve's transposed index by undoing its rotations
    and reflections bit by bit, for all rows at once; its bits are then interleaved.
    """
    x = cells.T.astype(np.int64).copy()
    n, top = len(x), 1 << (bits - 1)
    bit = top
    while bit > 1:
        low = bit - 1
        for i in range(n):
            on = (x[i] & bit) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, bit = np.zeros_like(x[0]), top
    while bit > 1:
        turn ^= np.where((x[n - 1] & bit) > 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    number = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            number = (number << 1) | ((x[i] >> bit) & 1)
    return number


def summer(size: int = 1 << 16):
    """A function that gives the summed projections of arrays of token ids, a row for each."""
    sent = projection(size).astype("float64").T.copy()

    def summed(arrays: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        out, begin = np.empty((len(arrays), len(sent))), 0
        while begin < len(arrays):
            # So many texts as have about a million tokens, and one in any case.
            end, held = begin, 0
            while end < len(arrays) and (end == begin or held + lengths[end] <= 1 << 20):
                held += lengths[end]
                end += 1
            ids = np.concatenate(arrays[begin: end])
            ids = ids if ids.itemsize == 2 else ids & (size - 1)
            starts = np.cumsum(lengths[begin: end]) - lengths[begin: end]
            for d, column in enumerate(sent):
                out[begin: end, d] = np.add.reduceat(column.take(ids), starts)
            begin = end
        return out

    return summed


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """row, doc_id, ids (bytes), width, n_tokens and the projected vector of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, summed = encoder(tokenizer, end_id), summer()
        size = int(encode.width[-1])
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for at in range(0, len(texts), 256):
                ids = [encode.encode(t.as_py()) for t in texts.slice(at, 256)]
                arrays = [np.frombuffer(b, encode.width) for b in ids]
                lengths = np.array([len(a) for a in arrays])
                vectors = summed(arrays, lengths) / np.sqrt(lengths)[:, None]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(at, 256), batch.column("doc_id").slice(at, 256),
                     pa.array(ids, pa.binary()), pa.array([size] * len(ids), pa.int32()),
                     pa.array(lengths, pa.int64()),
                     pa.ListArray.from_arrays(
                         np.arange(len(ids) + 1, dtype="int32") * DIMENSIONS, vectors.ravel())],
                    names=["row", "doc_id", "ids", "width", "n_tokens", "vector"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, ids binary, width int, n_tokens long, "
                                "vector array<double>")


def _curve(table: DataFrame) -> DataFrame:
    """row, doc_id, n_tokens and hilbert; the spread of each dimension is taken over all rows."""
    parts = [F.col("vector")[d] for d in range(DIMENSIONS)]
    spread = table.agg(*[F.avg(p) for p in parts], *[F.stddev_pop(p) for p in parts]).first()
    middle = np.array([m or 0.0 for m in spread[:DIMENSIONS]])
    deviation = np.array([d or 1.0 for d in spread[DIMENSIONS:]])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").flatten().to_numpy().reshape(-1, DIMENSIONS)
            unit = ((vectors - middle) / deviation + SPAN) / (2 * SPAN)
            cells = np.clip(unit * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("row", "doc_id", "n_tokens")],
                 pa.array(hilbert(cells))], names=["row", "doc_id", "n_tokens", "hilbert"])

    return table.select("row", "doc_id", "n_tokens", "vector").mapInArrow(
        number, "row long, doc_id long, n_tokens long, hilbert long")


def _positions(curve: DataFrame) -> DataFrame:
    """row, hilbert and position: the tokens before a document along the curve.

    The documents' numbers, not their ids, are sorted by range; equal numbers are told apart by
    the row, so no cell of the curve is too large for a task.  Sums run within the sorted
    partitions; the partitions' own bases are a running sum over one row each.
    """
    spark = curve.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            counts = batch.column("n_tokens").to_numpy()
            sums = np.cumsum(counts) + before
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("part", "row", "hilbert", "n_tokens")],
                 pa.array(sums - counts)], names=["part", "row", "hilbert", "n_tokens", "within"])
            before = int(sums[-1]) if len(sums) else before

    ordered = (curve.repartitionByRange(parts, "hilbert", "row")
               .sortWithinPartitions("hilbert", "row")
               .withColumn("part", F.spark_partition_id())
               .select("part", "row", "hilbert", "n_tokens"))
    placed = settled(ordered.mapInArrow(
        running, "part int, row long, hilbert long, n_tokens long, within long"), "curve")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("part").agg(F.sum("n_tokens").alias("tokens")).select(
        "part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return placed.join(bases, "part").select(
        "row", "hilbert", (F.col("base") + F.col("within")).alias("position"))


def tail_sizes(total: int, length: int) -> list[int]:
    """The powers of two that make up what is left after the whole sequences."""
    left = total % length
    return [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096) -> DataFrame:
    """One row per piece of a document in a sequence; every token lies in exactly one piece.

    Documents are encoded once, into a table in the shared folder; it then meets its rows'
    positions by one join on the row number, and cuts itself.
    """
    table = settled(encoded(docs, tokenizer, end_id), "encoded")
    positions = _positions(_curve(table))
    total = table.agg(F.sum("n_tokens")).first()[0] or 0
    whole = total - total % length
    ends = whole + np.cumsum([0, *tail_sizes(total, length)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(c) for c in ("doc_id", "ids", "width", "position", "hilbert")]
            for doc_id, ids, width, position, number in zip(*columns):
                doc_id, position, number = doc_id.as_py(), position.as_py(), number.as_py()
                tokens = np.frombuffer(ids.as_buffer(), f"<u{width.as_py()}").astype("<u4")
                start = 0
                while start < len(tokens):
                    at = position + start
                    if at < whole:
                        sequence, begin, end = at // length, at - at % length, 0
                        end = begin + length
                    else:
                        last = int(np.searchsorted(ends, at, side="right")) - 1
                        sequence, begin, end = whole // length + last, ends[last], ends[last + 1]
                    size = int(min(end - at, len(tokens) - start))
                    out.append((doc_id, start, size,
                                zlib.crc32(tokens[start: start + size].tobytes()), len(tokens),
                                int(sequence), int(at - begin), number))
                    start += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 8)],
                names=[c.split()[0] for c in PIECES.split(", ")])

    return table.select("row", "doc_id", "ids", "width").join(positions, "row").select(
        "doc_id", "ids", "width", "position", "hilbert").mapInArrow(cut, PIECES)
