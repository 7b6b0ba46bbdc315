"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned on a bounded sample of the vectors so that the signs of the rotated
components are balanced binary codes with little quantisation error; further bits are signs along
random directions.  Codes are cut into substrings, one table each.  Vectors meet in a table where
their substrings differ in at most ``2 * FLIPS`` bits: each vector is entered under its substring
and under every one that differs in ``FLIPS`` bits, so that two such vectors share an entry.
Pairs that meet and differ in no more bits than pairs at the threshold do are compared by cosine
of the original vectors in double precision; only those at the threshold or above are links.

Length and number of substrings follow from the data and their number.  Pairs at the threshold are
made from the sample.  For every length the tables are counted that make ``RECALL`` of them meet;
a longer substring needs more tables but lets fewer strangers meet.  Of all lengths that with the
least work is taken, where work is entries plus chance meetings, n times the chance that random
substrings meet.  So substrings lengthen with log2(n), and the strangers a vector meets grow far
slower than n (13, 54 and 260 at a background cosine of 0 and 10^4, 10^6 and 10^8 vectors).  Where
vectors share a direction, pairs at the threshold are not much closer than any others; then
substrings are short and many meet, by the same rule and the same path.

Scale.  Equal vectors are one class from the start.  Every pair has one place, the least entry
they share in their first common table, where it is counted; an entry with more than ``BLOCK``
rows is split into blocks of which every two meet in a task of their own.  A first pass over codes alone drops the rows that
meet no near code, so vectors travel only for those that do; a task passes on counts per vector
and the components it finds, never the pairs.

The sample bounds only what is learned: every vector is coded, entered and searched.  Recall is
that of the codes, about ``RECALL`` for links at the threshold and more for closer ones.

Null, empty and repeated: vectors that are null, zero, empty or hold null or non-finite components
link with nothing; vectors of each length are searched on their own (a search for each length
that several vectors have); repeated rows are vectors of their own and link; a null vec_id stays
null and is never the least of its component; an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulint.llm.common import (block_pairs, connected_components, grouped_in_order, local_stars,
                                 settled, steps_within, whole_groups)

SAMPLE = 20_000
BITS, FLIPS = 64, 1
# Random bits to choose tables from, and the lengths that are tried.
POOL, LENGTHS = 2048, range(4, 41)
RECALL, TRIED = 0.97, 2_000
# What a chance meeting costs, beside an entry of a vector in a table.
MEETING = 0.25
ROUNDS, SEED, BLOCK = 30, 5, 256
GROUP = ["table", "key", "low", "high"]


def learn_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS,
                   seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal directions turned for the least quantisation error."""
    mean = sample.mean(0)
    centred = sample - mean
    _, _, directions = np.linalg.svd(centred.T @ centred)
    kept = directions[: min(bits, sample.shape[1])].T
    # Fewer dimensions than bits: further bits are random directions.
    rng = np.random.default_rng(seed)
    extra = rng.standard_normal((sample.shape[1], bits - kept.shape[1]))
    flat = centred @ kept
    turn, _ = np.linalg.qr(rng.standard_normal((kept.shape[1], kept.shape[1])))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
        turn = (left @ right).T
    return mean, np.hstack([kept @ turn, extra])


def codes(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray, length: int) -> np.ndarray:
    """The sign bits of unit vectors as a row of substrings of so many bits each."""
    bits = (vectors - mean) @ projection >= 0
    return bits.reshape(len(vectors), -1, length) @ (1 << np.arange(length, dtype=np.int64))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(1, dtype=np.int64)


def pairs_at(threshold: float, sample: np.ndarray, seed: int = SEED
             ) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sampled unit vectors with others at the threshold: any way off, and the sample's ways."""
    rng = np.random.default_rng(seed)
    x = sample[rng.permutation(len(sample))[:TRIED]]
    made = []
    for way in (rng.standard_normal(x.shape), sample[rng.integers(0, len(sample), len(x))]):
        way = way - (way * x).sum(1, keepdims=True) * x
        length = np.sqrt((way * way).sum(1, keepdims=True))
        some = length[:, 0] > 1e-6
        if some.any():
            y = threshold * x[some] + np.sqrt(max(0.0, 1 - threshold ** 2)) * (way / np.where(
                length > 0, length, 1))[some]
            made.append((x[some], y))
    return made


class Codes(NamedTuple):
    """How vectors are coded: tables of ``length`` bits, and how far apart near codes may be."""
    mean: np.ndarray
    projection: np.ndarray
    length: int
    radius: int

    @property
    def tables(self) -> int:
        return self.projection.shape[1] // self.length

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return codes(vectors, self.mean, self.projection, self.length)


def chance(length: int) -> float:
    """How likely random substrings differ in at most two bits."""
    return (1 + length + length * (length - 1) / 2) / 2 ** length


def learn_codes(sample: np.ndarray, threshold: float, count: int) -> Codes:
    """The codes with the least work for so many vectors that reach the recall."""
    mean, first = learn_rotation(sample)
    rng = np.random.default_rng(SEED + 1)
    projection = np.hstack([first, rng.standard_normal((sample.shape[1], POOL - BITS))])
    differ = [((x - mean) @ projection >= 0) != ((y - mean) @ projection >= 0)
              for x, y in pairs_at(threshold, sample)]
    best: tuple[float, int, int] | None = None
    for length in LENGTHS:
        most = POOL // length
        needed = 1
        for wrong in differ:
            apart = wrong[:, : most * length].reshape(len(wrong), most, length).sum(2)
            met = (apart <= 2 * FLIPS).cumsum(1) > 0
            recall = met.mean(0)
            # No table in the pool may be enough; shorter substrings then are.
            needed = max(needed, int(np.argmax(recall >= RECALL)) + 1
                         if recall[-1] >= RECALL else most + 1)
        if needed <= most:
            work = needed * (1 + length + MEETING * count * chance(length))
            best = min(best or (work, length, needed), (work, length, needed))
    _, length, tables = best or (0.0, LENGTHS[0], 1)
    bits = length * tables
    radius = max((int(np.ceil(np.quantile(w[:, :bits].sum(1), 0.999))) for w in differ), default=0)
    return Codes(mean, projection[:, :bits], length, radius + 1)


def _unit(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    # By the largest component first, so that squares neither overflow nor vanish.
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """The rows that can link."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                     & (F.abs(x) != float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return vectors.where(F.col("embedding").isNotNull() & sound & some)


def _place(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table, key) of the first table where codes a and b meet, and the least entry shared."""
    apart = np.bitwise_count((a ^ b).view(np.uint64))
    met = apart <= 2 * FLIPS
    table = np.where(met.any(1), met.argmax(1), -1)
    rows = np.arange(len(a))
    x, y = a[rows, table], b[rows, table]
    different, apart = x ^ y, apart[rows, table]
    one = different & -different  # the lowest differing bit
    # At distance 2 the shared entries are x with either bit flipped; at 1, x and y; at 0, x and
    # all around it, of which the least has the highest set bit taken away.
    top = np.where(x > 0, 1 << (np.frexp(x.astype(np.float64))[1] - 1).clip(0), 0)
    least = np.where(apart == 2, np.minimum(x ^ one, x ^ (different ^ one)),
                     np.where(apart == 1, np.minimum(x, y), x ^ top))
    return table, least


def _near(rows: pa.Table, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs that are near by code and have their place in this group."""
    table, key = (rows.column(c).to_numpy() for c in ("table", "key"))
    flat = rows.column("code").combine_chunks().flatten().to_numpy()
    code = flat.reshape(rows.num_rows, len(flat) // max(1, rows.num_rows))
    own, low, high = (rows.column(c).to_numpy() for c in ("own", "low", "high"))
    for i, j in steps_within(group):
        # Blocks that meet compare across; within a block rows meet once, in (own, own).
        near = (own[i] != own[j]) | (low[i] == high[i])
        near &= _apart(code[i], code[j]) <= radius
        i, j = i[near], j[near]
        if len(i):
            at, least = _place(code[i], code[j])
            here = (at == table[i]) & (least == key[i])
            yield i[here], j[here]


def _met(radius: int):
    """The rows that meet a near code in their group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, GROUP):
            kept = np.zeros(rows.num_rows, dtype=bool)
            for i, j in _near(rows, group, radius):
                kept[i] = kept[j] = True
            yield from rows.filter(pa.array(kept)).to_batches()
    return run


def _linked(threshold: float, width: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, GROUP):
            unit = _unit(rows.column("embedding").combine_chunks(), width)
            ids, copies = rows.column("class").to_numpy(), rows.column("copies").to_numpy()
            counts, found = np.zeros(len(ids), dtype=np.int64), []
            for i, j in _near(rows, group, radius):
                close = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
                i, j = i[close], j[close]
                np.add.at(counts, i, copies[j])
                np.add.at(counts, j, copies[i])
                found.append((ids[i], ids[j]))
            some = np.flatnonzero(counts)
            if len(some):
                u, v = local_stars(*[np.concatenate(side) for side in zip(*found)])
                none = pa.nulls(len(u), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pa.array(ids[some]), pa.array(u)]),
                     pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(v)]),
                     pa.concat_arrays([pa.array(counts[some]), none])],
                    names=["u", "v", "links"])
    return run


def vector_links(classes: DataFrame, width: int, threshold: float, count: int) -> DataFrame:
    """(u, v, links): rows with v are links between classes, as stars; others count u's links.

    ``classes`` has class, embedding (of one length) and copies, one row per distinct vector.
    """
    drawn = classes.select("embedding").orderBy(F.xxhash64("class")).limit(SAMPLE).toArrow()
    learned = learn_codes(_unit(drawn.column("embedding").combine_chunks(), width), threshold, count)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = learned.of(_unit(batch.column("embedding"), width))
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * learned.tables
            yield pa.RecordBatch.from_arrays(
                [batch.column("class"), pa.ListArray.from_arrays(ends, code.ravel())],
                names=["class", "code"])

    code = classes.select("class", "embedding").mapInArrow(coded, "class long, code array<long>")
    # A vector is entered under its substring and under all that differ in a bit.
    masks = F.array(*[F.lit(m).cast("long") for m in (0, *(1 << b for b in range(learned.length)))])
    keyed = code.select("class", "code", F.posexplode("code").alias("table", "part")).select(
        "class", "code", "table", "part", F.explode(masks).alias("mask")).select(
        "class", "code", "table", F.col("part").bitwiseXOR(F.col("mask")).alias("key"))
    met = block_pairs(keyed, ["table", "key"], F.xxhash64("class"), BLOCK)
    columns = [*GROUP, "own", "class", "code"]
    kept = grouped_in_order(met.select(*columns), GROUP).mapInArrow(
        _met(learned.radius),
        "table int, key long, low long, high long, own long, class long, code array<long>")
    carried = kept.join(classes, "class").select(*columns, "copies", "embedding")
    return grouped_in_order(carried, GROUP).mapInArrow(
        _linked(threshold, width, learned.radius), "u long, v long, links long")


def near_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                             F.col("embedding").cast("array<double>").alias("embedding"))
    classes = settled(
        usable(vectors).groupBy("embedding").agg(F.count(F.lit(1)).alias("copies"),
                                       F.min("vec_id").alias("least"))
        .withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    found = vectors.sparkSession.createDataFrame([], "u long, v long, links long")
    sizes = classes.groupBy(F.size("embedding").alias("width")).count().where("count > 1")
    for size in sizes.orderBy("width").collect():
        some = classes.where(F.size("embedding") == size.width).select(
            "class", "embedding", "copies")
        found = found.union(settled(
            vector_links(some, size.width, threshold, size["count"]), "vector-links"))
    counts = found.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("v is not null").select("u", "v"), "vector-groups")
    rooted = (classes.join(roots, F.col("class") == F.col("node"), "left")
              .join(counts, F.col("class") == F.col("u"), "left")
              .select("embedding", "copies", "least", F.coalesce("root", "class").alias("root"),
                      F.coalesce("links", F.lit(0)).alias("links")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    known = rooted.join(least, "root").select(
        "embedding", "component", (F.col("links") + F.col("copies") - 1).alias("links"))
    out = vectors.join(known, "embedding", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
