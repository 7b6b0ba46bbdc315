"""Near-duplicate documents by SimHash, with candidates pruned along a ring of segments.

A fingerprint has 64 bits over the document's shingles of three words.  Two fingerprints link
at three or fewer differing bits.

Candidates.  The 64 bits are a ring of eight segments.  If the whole ring differs in at most
t = 3 bits, then from some segment on every chain of l consecutive segments differs in at most
l*t/8 bits (were it not so, chains over budget would cover the ring and exceed t).  For chains
of 1 to 8 segments those budgets are 0 0 1 1 1 2 2 3.  So the first two segments of the right
chain are equal and of the next three at most one differs: linked fingerprints share a key of
four whole segments (32 bits) under one of 8 starts times 3 left-out segments.  Within a key,
pairs are dropped whose chain exceeds a budget, before the full Hamming check.

Scale.  Equal fingerprints are one value from the start, so copies cost nothing.  A key held by
more than ``BLOCK`` values is split into blocks, every two of which meet in a task of their own;
a task passes on, for the components it finds, one link per value and never all pairs.
Components of these links are the components of all links.

Null, empty and repeated: a null or wordless text has fingerprint zero, linked like any other;
repeated rows are documents of their own; a document with a null doc_id takes part and is never
the least of its component unless it is alone with nulls; an empty table gives no row.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulint.llm.common import (block_pairs, connected_components, fresh_name, grouped_in_order,
                                 local_stars, row_key, settled, steps_within, whole_groups)

SHINGLE, SEED, DISTANCE = 3, 42, 3
SEGMENTS, SEGMENT_BITS = 8, 8
BUDGETS = [length * DISTANCE // SEGMENTS for length in range(1, SEGMENTS + 1)]
KEY_CHAIN = 5
BLOCK = 256
LONG_TEXT = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned number."""
    words = text.lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words), b"", b""]
        shingles, count = [words[0]], 1
    else:
        shingles = map(b"%b %b %b".__mod__, zip(words, words[1:], words[2:]))
        count = len(words) - SHINGLE + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, count)
    for at in range(0, count, LONG_TEXT):
        part = hashes[at: at + LONG_TEXT].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """document (key), doc_id and fingerprint (the 64 bits as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            bits = np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("document"), batch.column("doc_id"),
                 pa.array(bits.view(np.int64))], names=["document", "doc_id", "fingerprint"])

    return docs.select(row_key("doc_id", "text").alias("document"),
                       F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        run, "document long, doc_id long, fingerprint long")


def chain_keys() -> list[tuple[int, int]]:
    """(start, mask) of every key: the segments of a chain that stay equal.

    The chain of ``KEY_CHAIN`` segments allows ``BUDGETS[KEY_CHAIN - 1]`` differing segments,
    none of them among the first segments whose own budget is zero.
    """
    fixed = BUDGETS.count(0)
    keys = []
    for start in range(SEGMENTS):
        for out in combinations(range(fixed, KEY_CHAIN), BUDGETS[KEY_CHAIN - 1]):
            mask = 0
            for place in set(range(KEY_CHAIN)) - set(out):
                segment = (start + place) % SEGMENTS
                mask |= ((1 << SEGMENT_BITS) - 1) << (segment * SEGMENT_BITS)
            keys.append((start, mask))
    return keys


def within_budgets(different: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether every chain from ``start`` on keeps to its budget."""
    counts = np.bitwise_count(different.astype("<u8").view(np.uint8).reshape(-1, SEGMENTS))
    turned = np.take_along_axis(
        counts, (start[:, None] + np.arange(SEGMENTS)) % SEGMENTS, axis=1)
    return (np.cumsum(turned, axis=1) <= BUDGETS).all(1)


GROUP = ["table", "key", "low", "high"]


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within groups, as stars."""
    starts = np.array([s for s, _ in chain_keys()])
    for rows, group in whole_groups(batches, GROUP):
        bits, table = rows.column("fingerprint").to_numpy(), rows.column("table").to_numpy()
        found = []
        for i, j in steps_within(group):
            different = (bits[i] ^ bits[j]).view(np.uint64)
            near = within_budgets(different, starts[table[i]])
            near &= np.bitwise_count(different) <= DISTANCE
            if near.any():
                found.append((bits[i[near]], bits[j[near]]))
        if found:
            u, v = local_stars(*[np.concatenate(side) for side in zip(*found)])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def links(values: DataFrame) -> DataFrame:
    """(u, v) links whose components are those of all fingerprints at ``DISTANCE`` or less.

    ``values`` has one row per distinct fingerprint.
    """
    bits = F.col("fingerprint")
    masks = [m - (1 << 64) if m >= 1 << 63 else m for _, m in chain_keys()]
    keyed = values.select("fingerprint", F.posexplode(F.array(
        *[bits.bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("table", "key"))
    met = block_pairs(keyed, ["table", "key"], F.xxhash64("fingerprint"), BLOCK)
    return grouped_in_order(met.select(*GROUP, "fingerprint"), GROUP).mapInArrow(
        _block_links, "u long, v long")


def _roots(marked: DataFrame) -> DataFrame:
    """fingerprint and root, the least fingerprint its links reach."""
    values = marked.select("fingerprint").distinct()
    roots = connected_components(links(values), "fingerprint-groups")
    return values.join(roots, values.fingerprint == roots.node, "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (signed long) and component_id, the least doc_id reachable."""
    marked = settled(with_fingerprints(docs), "fingerprints")
    rooted = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).join(
        _roots(marked), "fingerprint")
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(groups, "root").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, one row of each group: that with the least doc_id, null counting last.

    Rows of one doc_id are told apart by a hash of their text; of rows equal in both any stays.
    """
    marked = settled(with_fingerprints(docs), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "document")
    key = fresh_name(docs, "_document")
    name = fresh_name(docs, "_kept")
    kept = (marked.groupBy("fingerprint").agg(F.min(order).alias("first"))
            .join(_roots(marked), "fingerprint").groupBy("root").agg(F.min("first").alias("first"))
            .select(F.col("first.document").alias(name)))
    return (docs.withColumn(key, row_key("doc_id", "text"))
            .join(kept, F.col(key) == F.col(name), "left_semi")
            .dropDuplicates([key]).drop(key))
