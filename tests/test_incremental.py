from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folio.operators.incremental import CommitConflict, IncrementalStore, changed_files, replayed, resolved_path, to_process


def log(spark, rows):
    return spark.createDataFrame(rows, "seq long, v string")


def test_each_record_once_and_failures_leave_nothing(spark, tmp_path):
    store = IncrementalStore(spark, f"file://{tmp_path}/s")
    assert store.run(log(spark, [(1, "a"), (2, "b"), (2, "b2")]), lambda d: d) == 0
    assert store.run(log(spark, [(1, "a"), (2, "b")]), lambda d: d) is None

    def broken(d):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.run(log(spark, [(3, "c")]), broken)
    assert store.watermark() == 2
    assert store.run(log(spark, [(1, "a"), (3, "c"), (4, "d")]), lambda d: d) == 1
    assert sorted(r.v for r in store.read().collect()) == ["a", "b", "b2", "c", "d"]


def test_failure_between_output_and_commit_is_repeated(spark, tmp_path):
    store = IncrementalStore(spark, f"file://{tmp_path}/s")
    commit, store.commit = store.commit, None
    with pytest.raises(TypeError):
        store.run(log(spark, [(1, "a")]), lambda d: d)
    store.commit = commit
    assert store.watermark() is None and store.vacuum() == 1
    store.run(log(spark, [(1, "a")]), lambda d: d)
    assert store.read().count() == 1


def test_second_commit_of_a_number_conflicts(spark, tmp_path):
    store = IncrementalStore(spark, f"file://{tmp_path}/s")
    store.commit(0, 5, "x")
    with pytest.raises(CommitConflict):
        store.commit(0, 6, "y")


def test_upper_limit_is_fixed_and_nulls_have_no_place(spark, tmp_path):
    store = IncrementalStore(spark, f"file://{tmp_path}/s")
    seen = []
    store.run(log(spark, [(1, "a"), (None, "n")]), lambda d: seen.append(d.count()) or d)
    assert seen == [1] and store.commits()[0]["unnumbered"] == 1
    assert store.run(log(spark, [(None, "n")]), lambda d: d) is None
    assert store.run(log(spark, []), lambda d: d) is None


def test_resolved_path(spark):
    paths = [("/a//b/./c/../d",), ("/../x",), ("/a/..",), (None,), ("/a/b/",), ("",)]
    got = [r[0] for r in spark.createDataFrame(paths, "p string").select(resolved_path(F.col("p"))).collect()]
    assert got == ["/a/b/d", "/x", "/", None, "/a/b", "/"]


T = "trace_id long, src_path string, src_sha256 string, written_at timestamp, received_at timestamp"


def test_runs_in_parts_give_the_same_files(spark, tmp_path):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, "/a/x", "AA", t(1), t(1)), (2, "/a/./x", "bb", t(2), t(2)), (3, "/a/y", None, t(3), t(3)), (4, "/a/y", "cc", t(1), t(1)), (5, "/a/x", "aa", t(1), t(4)), (5, "/a/x", "aa", t(1), t(4)), (6, "/b", "dd", None, t(5))]
    trace = spark.createDataFrame(rows, T)
    meta = spark.createDataFrame([("/a/x", "bb", t(1)), ("/a/y", "cc", None)], "src_path string, src_sha256 string, built_at timestamp")
    want = {("/a/y", "cc")}
    assert {tuple(r) for r in to_process(trace, meta).collect()} == want
    root = f"file://{tmp_path}/p5"
    changed_files(spark, trace.filter("received_at <= '2024-01-02'"), meta, root)
    assert {tuple(r) for r in changed_files(spark, trace, meta, root).collect()} == want
    assert {tuple(r) for r in replayed(spark, trace, meta, f"file://{tmp_path}/r").collect()} == want
    assert changed_files(spark, trace.limit(0), meta.limit(0), f"file://{tmp_path}/empty").count() == 0
    assert replayed(spark, trace.limit(0), meta.limit(0), f"file://{tmp_path}/empty2").count() == 0


def test_rows_of_one_instant_that_become_visible_later_are_seen_once(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 0, 0, 0, 7)
    store = IncrementalStore(spark, f"file://{tmp_path}/s")
    log_of = lambda ids: spark.createDataFrame([(i, at) for i in ids], "id long, at timestamp")
    assert store.run(log_of([5]), lambda d: d, "at", "id") == 0
    assert store.run(log_of([5]), lambda d: d, "at", "id") is None
    assert store.run(log_of([5, 2, 9]), lambda d: d, "at", "id") == 1
    assert store.run(log_of([5, 2, 9, 1]), lambda d: d, "at", "id") == 2
    assert sorted(r.id for r in store.read().collect()) == [1, 2, 5, 9]


def test_trace_in_twelve_runs_by_arrival_loses_and_repeats_nothing(spark, sf, tmp_path):
    trace = spark.read.parquet(f"{sf}/trace.parquet")
    store = IncrementalStore(spark, f"file://{tmp_path}/s")
    times = sorted(r[0] for r in trace.select("received_at").distinct().collect())
    for k in range(1, 13):
        now = times[min(len(times) - 1, len(times) * k // 12)]
        store.run(trace.filter(F.col("received_at") <= F.lit(now)), lambda d: d, "received_at", "trace_id")
    assert len(store.commits()) == 12
    assert store.read().count() == trace.count()
    assert store.read().exceptAll(trace).count() == 0
