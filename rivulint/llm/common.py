"""Helpers shared by the operators: scratch tables, row keys and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulint.operators.keyed import HOT_SHARE, keyed_join
from rivulint.session import shared_dir

__all__ = ["HOT_SHARE", "block_pairs", "connected_components", "fresh_name", "grouped_in_order",
           "keyed_join", "local_stars", "row_key", "settled", "steps_within", "whole_groups"]


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once to the folder all executors share, and read back from there.

    Cuts the lineage: a lost executor costs the tasks that read, not the work that wrote.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*columns: str) -> Column:
    """A key of a row that is the same in every scan of the table, null or not."""
    return F.xxhash64(*[F.col(c) for c in columns])


def fresh_name(df: DataFrame, wanted: str) -> str:
    """A column name that does not clash, in any case, with those the table has."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def _symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _towards_least(pairs: DataFrame, purpose: str) -> DataFrame:
    """Each pair (u, v) of a written table with the least of u and all its partners."""
    least = settled(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"),
                                           F.count(F.lit(1)).alias("n")), purpose)
    return keyed_join(pairs, least, ["u"])


def _are_stars(pairs: DataFrame) -> bool:
    """Whether every node points to one other, which points to none."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("points")).union(
        pairs.select(F.col("v"), F.lit(0)))
    points = ends.groupBy("node").agg(F.sum("points").alias("out"), F.min("points").alias("least"))
    # A node with out = 1 and least = 0 points to one and is pointed at.
    return not points.where("out > 1 or (out = 1 and least = 0)").take(1)


def connected_components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, root) for every node of an edge; root is the least node reachable.

    ``edges`` has columns u and v of one orderable type; nulls and loops are left out.
    Alternates two rewirings until every node points to the least of its component: larger
    neighbours to the least one around (large star), then smaller neighbours likewise (small
    star).  A hub's least neighbour is found with map-side aggregation and broadcast to its
    edges, which stay where they are (``keyed_join``).  Each half of a round is written to the
    shared folder, so lineage does not grow and no lost executor costs more than that.
    """
    pairs = edges.select("u", "v").where("u <> v")
    pairs = settled(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .distinct(), purpose)
    while not _are_stars(pairs):
        large = _towards_least(_symmetric(pairs), purpose).where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        small = _towards_least(settled(large, purpose), purpose)
        small = small.select("u", F.col("m").alias("v")).union(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        pairs = settled(small.distinct(), purpose)
    roots = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the links a-b within a task, as (member, least member) without the least.

    A task that sees very many links between few values so passes on fewer links than values.
    """
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = places[: len(a)], places[len(a):]
    label = np.arange(len(nodes))
    while True:
        lu, lv = label[u], label[v]
        open_ = lu != lv
        if not open_.any():
            break
        u, v, lu, lv = u[open_], v[open_], lu[open_], lv[open_]
        np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def block_pairs(keyed: DataFrame, keys: list[str], deal: Column, block: int) -> DataFrame:
    """Rows whose key others share, with ``own``, ``low`` and ``high``: blocks of ``block`` rows.

    A key of many rows is dealt into blocks, and every two blocks (and each with itself) make a
    group (low, high) of at most about two blocks: no group is unbounded, whatever the key.
    """
    shared = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / block)
    dealt = keyed.join(shared, keys).withColumn("own", F.pmod(deal, blocks)).withColumn(
        "_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return dealt.withColumns({"low": F.least("own", "_other"), "high": F.greatest("own", "_other")}
                             ).drop("_n", "_other")


def grouped_in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a group side by side, for a function that walks over groups."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]
                 ) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and each row's group number, from batches in the keys' order."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        new = np.ones(table.num_rows, dtype=bool)
        columns = [table.column(k).to_numpy() for k in keys]
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        last = int(np.flatnonzero(new)[-1])
        held = table.slice(last)
        if last:
            yield table.slice(0, last), np.cumsum(new)[:last]
    if held is not None:
        yield held, np.zeros(held.num_rows, dtype=np.int64)


def steps_within(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, i + k) of rows of one group, for k = 1, 2, ...: all pairs, one step at a time."""
    at, step = np.arange(len(group)), 0
    while True:
        step += 1
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return
        yield at, at + step
