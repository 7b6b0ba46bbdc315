"""Token ids in length-delimited binary records, with a separate offset index.

A file is a run of records, each of

    8 bytes   length of the body, little-endian
    4 bytes   masked crc32 of those 8 bytes
    n bytes   the body
    4 bytes   masked crc32 of the body
    1 byte    line feed

and a body of

    8 bytes   doc_id, signed little-endian (with one flag byte before it: 1 if it is not null)
    1 byte    bytes an id takes, 2 or 4
    the ids, little-endian

A checksum is masked as in other record formats (rotated right by 15 bits, plus 0xA282EAD8), so
that checksums of data that hold checksums stay sound.  Spark's text writer puts the files down:
its commit protocol makes a task that is repeated or lost harmless, on any file system Spark
knows.  It ends every record with the line feed; readers go by lengths and never search for it.

The index has a row per record: file, ordinal, byte offset and length, doc_id, tokens and the
tokens before it.  With it any records can be fetched in any order.

Null, empty and repeated: a null text counts as empty and gives the end id alone; rows with the
same doc_id are records of their own, ordered by their text; a null doc_id comes first; an empty
table gives no record.  Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulint.llm.word_tokens import encoder
from rivulint.session import shared_dir

# Fixed values of the record format.
HEAD, CHECK, END = 8, 4, b"\n"
MASK_DELTA = 0xA282EAD8

FILE_BYTES = 32 << 20

INDEX_SCHEMA = ("file string, ordinal long, offset long, length long, doc_id long, "
                "n_tokens long, ids_crc32 long, tokens_before_in_file long")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One record without its line feed."""
    body = struct.pack("<?qB", doc_id is not None, doc_id or 0, width) + ids
    head = struct.pack("<Q", len(body))
    return b"".join((head, struct.pack("<I", masked_crc(head)), body,
                     struct.pack("<I", masked_crc(body))))


def unframe(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """doc_id, ids and the place after the record that begins at ``at``."""
    head = bytes(data[at: at + HEAD])
    (length,) = struct.unpack("<Q", head)
    (check,) = struct.unpack_from("<I", data, at + HEAD)
    if check != masked_crc(head):
        raise ValueError(f"length of the record at byte {at} does not match its checksum")
    start = at + HEAD + CHECK
    body = bytes(data[start: start + length])
    (check,) = struct.unpack_from("<I", data, start + length)
    if len(body) != length or check != masked_crc(body):
        raise ValueError(f"body of the record at byte {at} does not match its checksum")
    known, doc_id, width = struct.unpack_from("<?qB", body)
    ids = np.frombuffer(body, dtype=f"<u{width}", offset=10)
    return doc_id if known else None, ids, start + length + CHECK + len(END)


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int,
                  file_bytes: int = FILE_BYTES) -> None:
    """Encode every whole text and write the records in ascending doc_id order.

    Files hold ascending ranges of doc_id, each of about ``file_bytes`` of text, so that a file
    fits in a task that reads it.  One shuffle, of the texts, by range; encoding and framing run
    in its reducers, so ids are never shuffled.
    """
    text_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    files = max(docs.sparkSession.sparkContext.defaultParallelism, -(-text_bytes // file_bytes))

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end_id)
        width = int(encode.width[-1])
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").cast(pa.binary())
            for at in range(0, len(ids), 256):
                rows = zip(ids[at: at + 256], texts.slice(at, 256))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([frame(i, encode.encode(t.as_py()), width) for i, t in rows],
                              pa.binary())], names=["record"])

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                           F.col("text").cast("string").alias("text"))
               .repartitionByRange(files, "doc_id", F.xxhash64("text"))
               .sortWithinPartitions("doc_id", "text"))
    (ordered.mapInArrow(framed, "record binary")
     .select(F.col("record").cast("string").alias("record"))
     .write.option("lineSep", END.decode()).option("compression", "none").text(path))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """The index, made by walking over the records; every checksum is verified on the way."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file"), batch.column("content")):
                data, at, before, rows = memoryview(content.as_buffer()), 0, 0, []
                while at < len(data):
                    doc_id, ids, after = unframe(data, at)
                    rows.append((name.as_py(), len(rows), at, after - at, doc_id, len(ids),
                                 zlib.crc32(ids.astype("<u4").tobytes()), before))
                    at, before = after, before + len(ids)
                if rows:
                    kinds = [pa.string(), *[pa.int64()] * 7]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                        names=[c.split()[0] for c in INDEX_SCHEMA.split(", ")])

    return _files(spark, path).mapInArrow(walk, INDEX_SCHEMA)


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``, the tokens of all records before one, over all files in order.

    The running sum is over one row per file; a file's rows then take their file's base.
    """
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("tokens"))
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("base"))
    return (index.join(bases, "file")
            .withColumn("start", F.col("base") + F.col("tokens_before_in_file")).drop("base"))


def write_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """The separate offset index as a table at ``index_path``."""
    scan_records(spark, path).write.parquet(index_path)
    return with_starts(spark.read.parquet(index_path))


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Tokens of the indexed records in ``wanted`` (any rows of the index): a shuffled read.

    Rows meet their file and are cut out of it by offset and length alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content, places in zip(batch.column("content"), batch.column("places")):
                data = memoryview(content.as_buffer())
                for place in places.as_py():
                    doc_id, ids, _ = unframe(data, place["offset"])
                    out.append((doc_id, ids.astype("int32").tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()),
                 pa.array([r[1] for r in out], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    places = wanted.groupBy("file").agg(
        F.collect_list(F.struct("offset", "length")).alias("places"))
    return (_files(spark, path).join(places, "file").select("content", "places")
            .mapInArrow(cut, "doc_id long, ids array<int>"))


def encoded_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Records written and read back: doc_id, start, n_tokens, ids_crc32 and the place."""
    spark = docs.sparkSession
    path = shared_dir(spark, "records")
    write_records(docs, path, tokenizer, end_id)
    return write_index(spark, path, shared_dir(spark, "record-index"))


def record_number(file: str) -> int:
    """The file's place in the order of doc_id."""
    return int(re.match(r"part-(\d+)", file)[1])
