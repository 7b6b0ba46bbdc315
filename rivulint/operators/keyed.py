"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1_000


def keyed_join(rows: DataFrame, values: DataFrame, keys: list[str],
               share: int = HOT_SHARE) -> DataFrame:
    """Rows with the columns of ``values``, which has one row and ``n``, its number of rows, a key.

    Keys of more than 1/``share`` of all rows, of which there are fewer than ``share``, are
    broadcast, so that their rows stay where they are; the rows of all others are shuffled, and no
    task can get more than that share for one key.  Both sides are read more than once: they
    should be written tables.  Keys must not be null.
    """
    total = values.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * share > total
    hot = values.where(is_hot)
    few = rows.join(F.broadcast(hot.drop("n")), keys)
    others = values.where(~is_hot)
    if others.isEmpty():
        return few
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return few.unionByName(rest.join(others.drop("n"), keys))
