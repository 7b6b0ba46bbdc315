"""Review of a stream: many batches, replays, files that arrive again."""

import glob
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rivulint.checks import queries
from rivulint.operators.duplicates import duplicate_function_findings
from rivulint.plans import profiles
from rivulint.schema import FINDING_FIELDS
from rivulint.session import shared_dir
from rivulint.streaming import feeds
from rivulint.streaming.review import ReviewStore, drain_review

FILES = "path string, content string, read_error string"
FIRST = [("a.php", "<?php function f() {}\neval($x);", None),
         ("b.php", "<?php function f() {} function g() {}", None),
         ("c.php", "<?php header('Location: /x');\necho 1;", None),
         ("e.php", None, "no permission"), ("x.py", "print(1)", None)]
SECOND = [("d.php", "<?php function g() {} print_r($_GET);", None),
          ("b.php", "<?php function h() {}", None)]
THIRD = [("e.php", "<?php function h() {}", None), ("a.php", None, "gone")]


def rows_of(findings):
    return Counter(tuple(r[c] for c in FINDING_FIELDS) for r in findings.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, FILES)


def latest(*batches):
    return list({r[0]: r for batch in batches for r in batch}.values())


@pytest.fixture
def store(spark):
    return ReviewStore(spark, shared_dir(spark, "store"))


def test_batches_equal_one_review(spark, store):
    batches = [FIRST, SECOND, THIRD]
    for number, batch in enumerate(batches):
        store.absorb(frame(spark, batch), number)
        so_far = frame(spark, latest(*batches[: number + 1]))
        whole = profiles.review_once(so_far)
        assert rows_of(store.reviewed().findings) == rows_of(whole.findings)
        assert rows_of(store.shared_name_findings()) == rows_of(
            duplicate_function_findings(so_far.where("read_error is null")))
        assert Counter(map(tuple, store.reviewed().summary_rows.collect())) == Counter(
            map(tuple, whole.summary_rows.collect()))


def test_a_replayed_batch_changes_nothing(spark, store):
    for number, batch in enumerate([FIRST, SECOND, THIRD]):
        store.absorb(frame(spark, batch), number)
    before = rows_of(store.reviewed().findings), rows_of(store.shared_name_findings())
    store.absorb(frame(spark, THIRD), 2)
    store.absorb(frame(spark, THIRD), 2)
    assert (rows_of(store.reviewed().findings), rows_of(store.shared_name_findings())) == before
    assert {r.batch for r in store.updates().select("batch").distinct().collect()} == {0, 1, 2}


def test_a_name_no_longer_shared_is_taken_back(spark, store):
    store.absorb(frame(spark, FIRST), 0)
    assert [r.message for r in store.shared_name_findings().collect()] == [
        "function f() defined in 2 files: a.php, b.php."]
    store.absorb(frame(spark, [("b.php", "<?php", None)]), 1)
    assert store.shared_name_findings().count() == 0
    gone = store.updates().where("batch = 1").collect()
    assert {(r.name, r.rule_id) for r in gone} == {("f", None), ("g", None)}


def test_nothing_absorbed(store):
    assert store.updates().count() == 0 and store.reviewed().findings.count() == 0


def test_a_stream_goes_on_where_it_was_left(spark):
    source, folder = shared_dir(spark, "arriving"), shared_dir(spark, "reviewed")

    def stream():
        return feeds.corpus_stream(spark, source, FILES, files_per_trigger=1)

    frame(spark, FIRST).coalesce(1).write.parquet(source)
    drain_review(stream(), folder)
    frame(spark, SECOND).coalesce(1).write.mode("append").parquet(source)
    store = drain_review(stream(), folder)
    whole = profiles.review(frame(spark, latest(FIRST, SECOND)))
    assert rows_of(store.reviewed().findings) == rows_of(whole)


def test_lazy_checks_write_nothing_while_planning(spark, monkeypatch):
    def no_writes(*_):
        raise AssertionError("a plan must not write")

    monkeypatch.setattr(profiles, "shared_dir", no_writes)
    found = profiles.review_checks(frame(spark, FIRST))
    whole = profiles.review_checks(frame(spark, FIRST)).where(F.col("rule_id") == "RV-23")
    assert whole.count() == 1 and "Exchange" not in found._jdf.queryExecution().toString()


def test_audit_on_a_stream(spark):
    source = shared_dir(spark, "arriving")
    frame(spark, FIRST).write.parquet(source)
    stream = feeds.streamed_audit(feeds.corpus_stream(spark, source, FILES))
    assert rows_of(feeds.drained(stream)) == rows_of(profiles.audit(frame(spark, FIRST)))


def test_arriving_files_are_read_by_several_tasks(spark, tmp_path):
    """One file of some MB has several row groups, so that a batch of it is no single task."""
    words = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(k)), 256) for k in range(16)])
    files = spark.range(0, 24_000, 1, 1).select(
        F.col("id").cast("string").alias("path"), words.alias("content"))
    feeds.write_arriving(files, f"{tmp_path}/in")
    (one,) = tmp_path.glob("in/*.parquet")
    assert pq.ParquetFile(one).num_row_groups > 1


def test_larger_corpora_arrive_in_more_files(spark, monkeypatch):
    seen, stream = {}, feeds.corpus_stream

    def watched(spark, folder, schema, files_per_trigger):
        seen["files"], seen["batch"] = len(glob.glob(f"{folder}/*.parquet")), files_per_trigger
        return stream(spark, folder, schema, files_per_trigger)

    monkeypatch.setattr(feeds, "corpus_stream", watched)
    small = {"spark.sql.files.maxPartitionBytes": "10000", "spark.sql.files.openCostInBytes": "0"}
    before = {name: spark.conf.get(name) for name in small}
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        store = queries._review_store(spark, "/root/testdata/sf0.001")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert seen["files"] > queries.STREAMED_FILES and seen["batch"] * 3 >= seen["files"]
    assert store.hits().select("batch").distinct().count() == 3
