"""Documents in random order over shards, by a two-pass external shuffle.

First pass: a seeded hash of the row scatters the documents uniformly into buckets small enough
for a task's memory.  Second pass: each bucket is put in a canonical order, shuffled by
Fisher-Yates with a generator seeded by the bucket, and written.  The buckets one after the other
are a random permutation of all documents; shard s holds the ranks from s*N/shards to
(s+1)*N/shards, so counts differ by one at most and a bucket lies in one or two shards.

Null, empty and repeated: a null text has no bytes; rows that are the same in doc_id and text
are shuffled like any others (their order among themselves cannot be seen); an empty table gives
no row.  Other columns are carried into the files; columns named shard or slot are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulint.session import shared_dir

SEED = 20_011
BUCKET_BYTES = 24 << 20
OVERHEAD = 8


def _size():
    return (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + OVERHEAD).cast("long")


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = SEED,
                 bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the shuffled documents as Parquet, one folder per shard, each file in slot order.

    The texts are shuffled once.  Buckets are counted over a hash per row; their bases, one row
    for each bucket, are broadcast.  Spark sorts a task's buckets into their canonical order, so
    that the function sees them batch by batch and holds no text but a batch's, only the
    shuffled places of the bucket it is at.
    """
    total = docs.agg(F.count(F.lit(1)), F.sum(_size())).first()
    rows, buckets = total[0], max(1, -(-(total[1] or 0) // bucket_bytes))
    dealt = docs.withColumn(
        "_deal", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")))
    dealt = dealt.withColumn("_bucket", F.pmod(F.col("_deal"), F.lit(buckets)))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows")).withColumn(
        "_base", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()),
                           T.StructField("slot", T.LongType())])
    names = docs.columns

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, at, places = None, 0, None
        for batch in batches:
            numbers, counts, bases = (batch.column(c).to_numpy()
                                      for c in ("_bucket", "_rows", "_base"))
            rank = np.empty(batch.num_rows, dtype=np.int64)
            starts = np.flatnonzero(np.diff(numbers, prepend=numbers[:1] - 1))
            for start, end in zip(starts, [*starts[1:], len(numbers)]):
                if numbers[start] != bucket:
                    bucket, at = numbers[start], 0
                    # permutation() is a Fisher-Yates shuffle of the places.
                    order = np.random.default_rng([seed, int(bucket)]).permutation(counts[start])
                    places = np.empty_like(order)
                    places[order] = np.arange(len(order))
                rank[start: end] = bases[start] + places[at: at + end - start]
                at += end - start
            shard = (rank * shards + shards - 1) // rows
            shard = np.where(shard * rows // shards > rank, shard - 1, shard)
            shard = np.where((shard + 1) * rows // shards <= rank, shard + 1, shard)
            slot = rank - shard * rows // shards
            out = batch.select(names)
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(shard.astype("int32")), pa.array(slot)],
                names=[*names, "shard", "slot"])

    ordered = dealt.join(F.broadcast(bases), "_bucket").repartition("_bucket").sortWithinPartitions(
        "_bucket", "_deal", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    ordered.mapInArrow(placed, schema).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Documents written to shards and read back, with shard and slot."""
    spark = docs.sparkSession
    path = shared_dir(spark, "shards")
    clash = {"shard", "slot", "_deal", "_bucket"} & {c.lower() for c in docs.columns}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in clash])
    write_shards(docs, path, shards, seed)
    schema = T.StructType([*docs.schema.fields, T.StructField("slot", T.LongType()),
                           T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)
