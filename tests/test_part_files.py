"""Streams over documents kept as a folder of part files, against an outside SQL engine."""

import duckdb
import pytest
from compare import difference
from pyspark.sql import functions as F

from rivulint.checks.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
STREAMS = [
    "str2_running_severity", "str4_stream_errors", "str3_stream_dedup", "str3_once_per_file",
    "str1_streamed_findings", "str1_streamed_checks",
]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3).write.parquet(
        f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", STREAMS)
def test_stream_over_part_files(spark, parts, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{parts}/documents.parquet/*.parquet'")
    assert difference(QUERIES[name](spark, str(parts)), con, ORACLES[name]) is None


def _without(spark, tmp_path, column):
    """Part files whose documents lack a column's value in every third row, and their tables."""
    value = F.when(F.col("doc_id") % 3 != 0, F.col(column))
    spark.read.parquet(f"{SMALL}/documents.parquet").withColumn(column, value).repartition(
        3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return con


def test_stream_of_files_of_no_known_source(spark, tmp_path):
    name = "str4_stream_errors"
    con = _without(spark, tmp_path, "source")
    assert difference(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", STREAMS)
def test_stream_over_missing_texts(spark, tmp_path, name):
    con = _without(spark, tmp_path, "text")
    assert difference(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]) is None
