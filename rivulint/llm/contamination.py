"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Texts are sets of shingles of five words (words: runs of letters or digits, lower case; a text
of fewer words has one shingle, all of it).  An item is found in a document that holds at least
``threshold`` of its shingles, however long the document is; for items of fewer than five words
documents also offer their shingles of those lengths.

Search.  Items are partitioned by size, at powers of two.  An item keeps the least k of its
shingles by hash, its bottom-k MinHash, where k is one more than the shingles an item of its
partition may lack: an item of q shingles of which a document holds at least t*q lacks at most
(1-t)*q, so one of its k minima is always in that document and no find is lost.  Documents run
all their shingles against a bitmap of those minima; one without a hit goes no further.  Of the
others, the shingles that are in a bitmap of all items' shingles meet the items by their text,
and a find is a document-item pair with enough shingles counted exactly.

Both bitmaps have a fixed size (2 MB), whatever the number of items, and are the only things
broadcast; with very many items they let more through, and the join still decides.  A passage in
a third of all documents gives a row per document and shingle, which the join splits if skewed
and the count combines before its shuffle.

Null, empty and repeated: a null or wordless text has no shingle, finds nothing and is not
found; items equal in text are found separately; of rows with one doc_id, or items with one
item_id, the pair with more shingles counts; an empty table on either side gives no row.  Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulint.llm.common import fresh_name, row_key

SHINGLE, THRESHOLD = 5, 0.8
BITMAP_BITS = 1 << 24
REMEMBERED = 150_000
WORD = re.compile(r"[^\W_]+")
# Odd multipliers that tell a shingle's words' places apart.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                   0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingle_hashes(words: list[str], known: dict[str, int], size: int = SHINGLE) -> np.ndarray:
    """A hash for each shingle of so many words, in order; none of fewer words."""
    if len(words) < size or not words:
        return np.empty(0, dtype=np.uint64)
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    count = len(words) - size + 1
    mixed = np.zeros(count, dtype=np.uint64)
    for place in range(size):
        mixed += each[place: place + count] * PLACES[place]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def minima(size: int, threshold: float) -> int:
    """How many minima an item of so many shingles keeps, by its size partition."""
    upper = 1 << max(0, size - 1).bit_length()
    return min(size, int((1 - threshold) * upper + 1e-9) + 1)


def item_shingles(items: DataFrame, threshold: float) -> DataFrame:
    """item, item_id, shingle, place (in a bitmap), size, minimum (whether it is one) and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            out = []
            for key, item, text in zip(*(batch.column(c).to_pylist()
                                         for c in ("item", "item_id", "text"))):
                words = WORD.findall((text or "").lower())
                width = min(SHINGLE, len(words))
                hashes = shingle_hashes(words, known, width).tolist()
                distinct = {" ".join(words[i: i + width]): h for i, h in enumerate(hashes)}
                ranked = sorted(distinct, key=lambda s: (distinct[s], s))
                kept = set(ranked[: minima(len(ranked), threshold)]) if ranked else set()
                out += [(key, item, s, distinct[s] % BITMAP_BITS, len(ranked), s in kept, width)
                        for s in ranked]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(),
                     pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)],
                names=["item", "item_id", "shingle", "place", "size", "minimum", "words"])

    return items.select(row_key("item_id", "text").alias("item"),
                        F.col("item_id").cast("long").alias("item_id"),
                        F.col("text").cast("string").alias("text")).distinct().mapInArrow(
        run, "item long, item_id long, shingle string, place long, size long, minimum boolean, "
             "words int")


def _bitmap(places: DataFrame) -> np.ndarray:
    """The set of places as bits; at most BITMAP_BITS / 64 words come to the driver."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """document (key), doc_id, item_id, matched, size and containment of every find."""
    spark = docs.sparkSession
    shingles = item_shingles(items, threshold)
    # At most as many lengths as a shingle has words.
    widths = sorted({SHINGLE} | {r.words for r in shingles.select("words").distinct().collect()})
    whole = spark.sparkContext.broadcast(_bitmap(shingles))
    least = spark.sparkContext.broadcast(_bitmap(shingles.where("minimum")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, every, first = _WordHashes(), whole.value, least.value

        def held(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
            return (bitmap[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1) > 0

        for batch in batches:
            out: list[tuple] = []
            texts = batch.column("text")
            for at in range(len(texts)):
                words = WORD.findall((texts[at].as_py() or "").lower())
                offered = [(n, shingle_hashes(words, known, n) & np.uint64(BITMAP_BITS - 1))
                           for n in widths]
                if not any(held(first, places).any() for _, places in offered):
                    continue
                key, doc = batch.column("document")[at].as_py(), batch.column("doc_id")[at].as_py()
                hits = {" ".join(words[i: i + n]) for n, places in offered
                        for i in np.flatnonzero(held(every, places)).tolist()}
                out += [(key, doc, s) for s in hits]
            kinds = [pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, kinds)],
                names=["document", "doc_id", "shingle"])

    hits = docs.select(row_key("doc_id", "text").alias("document"),
                       F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        run, "document long, doc_id long, shingle string")
    met = hits.join(shingles.select("item", "item_id", "shingle", "size", "minimum"), "shingle")
    pairs = met.groupBy("document", "doc_id", "item", "item_id", "size").agg(
        F.countDistinct("shingle").alias("matched"), F.bool_or("minimum").alias("candidate"))
    return pairs.where("candidate").where(
        F.col("matched") + 1e-9 >= threshold * F.col("size")).select(
        "document", "doc_id", "item_id", "matched", "size",
        (F.col("matched") / F.col("size")).alias("containment"))


def without_contaminated(docs: DataFrame, items: DataFrame,
                         threshold: float = THRESHOLD) -> DataFrame:
    """The documents in which no item is found."""
    name = fresh_name(docs, "_found")
    found = contaminated(docs, items, threshold).select(F.col("document").alias(name)).distinct()
    return docs.join(found, row_key("doc_id", "text") == F.col(name), "left_anti")
