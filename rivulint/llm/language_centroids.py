"""Language of a text by the nearest of several centroids per language.

A text's letters, in lower case and with one blank for everything between its words, give byte
n-grams of two and three, hashed into ``BUCKETS`` features; counts are damped (1 + log), weighted
by inverse document frequency and brought to unit length.  Each language has up to ``CENTROIDS``
centroids, found by clustering unit vectors (spherical k-means); a text gets the language of the
centroid with the highest cosine.  A text farther from it than nearly all texts it was learned
from is marked as rejected.

Document frequencies are counted over every learning text.  Only the clustering works on a
sample, of at most ``SAMPLE_PER_LANGUAGE`` texts a language, drawn by a hash; each language is
clustered in a task of its own, whose size that sample bounds.  What comes to the driver is one
row per feature and per centroid.

Null, empty and repeated: a text that is null or has no letter is ``und`` with score 0; rows with
a null language teach nothing; a null doc_id counts as the empty text in the fold; repeated rows
each get a row; with no language to learn from every text is ``und``; an empty table gives no
row.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

BUCKETS, CENTROIDS, SAMPLE_PER_LANGUAGE = 4096, 4, 400
# More than there are languages; bounds the table of their counts, which is broadcast.
LANGUAGES = 10_000
ROUNDS, SEED, REJECTED_SHARE = 12, 3, 0.005
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
# Texts are counted in parts of so many bytes, to bound what one of them takes.
PART = 1 << 22


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams; None where there is no letter."""
    words = LETTERS.findall(text.lower()) if text else []
    if not words:
        return None
    data = np.frombuffer(f" {' '.join(words)} ".encode(), dtype=np.uint8)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(data), PART):
        part = data[at: at + PART + 2].astype(np.uint32)
        pairs = (part[:-1] << np.uint32(8)) | part[1:]
        triples = (pairs[:-1] << np.uint32(8)) | part[2:]
        for grams in (pairs[: PART], triples + np.uint32(1 << 24)):
            mixed = grams * np.uint32(2654435761)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(2246822519)
            counts += np.bincount(mixed >> np.uint32(20), minlength=BUCKETS)
    return counts


def unit_rows(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    damped = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * weights
    return damped / np.maximum(np.linalg.norm(damped, axis=1, keepdims=True), 1e-12)


def cluster(rows: np.ndarray, count: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, each row's cosine to its own): k-means on the unit sphere."""
    rng = np.random.default_rng(seed)
    centres = rows[[rng.integers(len(rows))]]
    while len(centres) < min(count, len(rows)):
        # The next seed is drawn by its distance from those there are.
        away = np.maximum(1 - (rows @ centres.T).max(1), 0) + 1e-12
        centres = np.vstack([centres, rows[rng.choice(len(rows), p=away / away.sum())]])
    for _ in range(ROUNDS):
        own = (rows @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    return centres, (rows @ centres.T).max(1)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null doc_id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def _document_frequencies(texts: DataFrame) -> np.ndarray:
    """How many texts hold each feature, and last how many texts have a letter at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts = ngram_counts(text.as_py())
                if counts is not None:
                    held[:-1] += counts > 0
                    held[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS + 1)), pa.array(held)],
                                         names=["feature", "texts"])

    sums = texts.select("text").mapInArrow(run, "feature long, texts long").groupBy(
        "feature").agg(F.sum("texts").alias("texts")).toArrow()
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    out[sums.column("feature").to_numpy()] = sums.column("texts").to_numpy()
    return out


def _sample(known: DataFrame) -> DataFrame:
    """At most SAMPLE_PER_LANGUAGE texts of each language, those least by a hash of the row.

    Languages are counted first and thinned by the hash to little more than is wanted, so that
    the ranking of a language that has most of the rows sees few of them.
    """
    full = 1 << 30
    share = (F.lit(1.5 * SAMPLE_PER_LANGUAGE * full) / F.col("count")).cast("long")
    most = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select(
        "lang", F.least(F.lit(full), share).alias("_most"))
    keyed = known.withColumn("_draw", F.xxhash64("doc_id", "text")).join(
        F.broadcast(most), "lang").where(
        F.col("_draw").bitwiseAND(F.lit(full - 1)) < F.col("_most"))
    order = Window.partitionBy("lang").orderBy("_draw")
    return keyed.withColumn("_rank", F.row_number().over(order)).where(
        F.col("_rank") <= SAMPLE_PER_LANGUAGE).select("lang", "text")


def learn(known: DataFrame) -> dict:
    """weights, languages, centroids and least cosines, from doc_id, text and lang."""
    known = known.where("lang is not null and text is not null")
    frequencies = _document_frequencies(known)
    weights = np.log((1 + frequencies[-1]) / (1 + frequencies[:-1])) + 1

    def clustered(key: tuple, group: pa.Table) -> pa.Table:
        counts = [c for c in map(ngram_counts, group.column("text").to_pylist()) if c is not None]
        rows, least = np.empty((0, BUCKETS)), []
        if counts:
            units = unit_rows(np.array(counts), weights)
            rows, cosines = cluster(units, CENTROIDS)
            least = [float(np.quantile(cosines, REJECTED_SHARE))] * len(rows)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(rows), pa.string()),
                         "centre": pa.array(list(rows), pa.list_(pa.float64())),
                         "least": pa.array(least, pa.float64())})

    found = _sample(known).groupBy("lang").applyInArrow(
        clustered, "lang string, centre array<double>, least double").collect()
    found.sort(key=lambda r: r.lang)
    return {"weights": weights, "languages": [r.lang for r in found],
            "centres": np.array([r.centre for r in found]).reshape(-1, BUCKETS),
            "least": np.array([r.least for r in found])}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score (cosine to the nearest centroid) and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        centres = known["centres"].T.copy()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                counts = [ngram_counts(t.as_py()) for t in part.column("text")]
                some = [i for i, c in enumerate(counts) if c is not None]
                names, scores = [UNKNOWN] * len(counts), np.zeros(len(counts))
                rejected = np.ones(len(counts), dtype=bool)
                if some and known["languages"]:
                    cosines = unit_rows(np.array([counts[i] for i in some]),
                                        known["weights"]) @ centres
                    best = cosines.argmax(1)
                    scores[some] = np.clip(cosines[np.arange(len(some)), best], 0, 1)
                    rejected[some] = scores[some] < known["least"][best]
                    for i, b in zip(some, best):
                        names[i] = known["languages"][b]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names), pa.array(scores),
                     pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean")


def identified(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Every text's language by a model learned from all folds but one.

    The general operator's answer for a rejected text is ``und``: ``lang_pred`` where not
    ``rejected``.
    """
    fold = remainder(F.col("doc_id"), folds)
    model = learn(docs.select("doc_id", "text", "lang").where(fold != held))
    return predict(docs, model).withColumn("held_out", fold == held)
