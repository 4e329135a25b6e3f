"""The bucket store, the facet index and the change table on small fixtures."""

from __future__ import annotations

import os
import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import facets, store
from tidemark.operators.buckets import BucketStore, Conflict
from tidemark.operators.facet_index import IndexedStore
from tidemark.plans import queries, registry
from tidemark.streaming.changes import CurrentTable, kept_up, kind

SF = "/root/testdata/sf0.001"


def made(spark, path, n=400, buckets=100, **how):
    rows = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit(datetime(2024, 1, 1)).alias("createdAt"), F.lit(datetime(2024, 1, 1)).alias("updatedAt"))
    return BucketStore(spark, str(path), rows.schema, ["k"], buckets, **how).start(rows)


def files(path, version):
    return sorted(d for d in os.listdir(f"{path}/v={version}") if d.startswith("bucket="))


def test_an_upsert_reads_and_writes_touched_buckets_only(spark, tmp_path):
    rows = made(spark, tmp_path)
    new = spark.createDataFrame([(1, 10), (2, 20), (1000, 30), (399, 1)], "k long, v long")
    own = rows.touched(new)
    assert len(own) <= 4
    latest = rows.latest()
    rows.upsert(new, datetime(2024, 2, 1), "v")
    assert files(tmp_path, 1) == sorted(f"bucket={b}" for b in own)
    assert {b for b, v in rows.latest().items() if v == 1} == set(own) and rows.latest(before=1) == latest
    got = {r["k"]: (r["v"], r["createdAt"].month, r["updatedAt"].month) for r in rows.current().collect()}
    assert len(got) == 401 and got[1] == (10, 1, 2) and got[1000] == (30, 2, 2) and got[3] == (6, 1, 1)
    # a read by keys opens no other bucket
    some = rows.current(spark.createDataFrame([(1,), (5000,)], "k long"))
    assert {p.split("bucket=")[1].split("/")[0] for p in some.inputFiles()} <= {str(b) for b in rows.touched(spark.createDataFrame([(1,), (5000,)], "k long"))}
    assert [r["k"] for r in some.collect()] == [1]


def test_a_large_bucket_has_several_files(spark, tmp_path):
    merged = "spark.sql.adaptive.coalescePartitions.enabled"  # else small parts are one task's
    spark.conf.set(merged, "false")
    try:
        made(spark, tmp_path, n=4000, buckets=2, parts=4)
    finally:
        spark.conf.unset(merged)
    assert all(len([f for f in os.listdir(f"{tmp_path}/v=0/{b}") if f.endswith(".parquet")]) > 1 for b in files(tmp_path, 0))


def test_an_uncommitted_version_is_written_anew(spark, tmp_path):
    rows = made(spark, tmp_path)
    new = spark.createDataFrame([(1, 10)], "k long, v long")

    class Lost(BucketStore):
        def commit(self, *a, **b):
            raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        Lost(spark, str(tmp_path), rows.schema, ["k"], 100).upsert(new, datetime(2024, 2, 1), "v")
    assert rows.version() == 0 and rows.current().where("k = 1").first()["v"] == 2
    rows.upsert(spark.createDataFrame([(7, 70)], "k long, v long"), datetime(2024, 2, 1), "v")
    assert {r["k"]: r["v"] for r in rows.current().where("k in (1, 7)").collect()} == {1: 2, 7: 70}


def test_a_second_writer_of_a_version_fails(spark, tmp_path):
    rows = made(spark, tmp_path)
    with pytest.raises(Conflict):
        rows.commit(0, buckets=[1])
    assert len(rows.log()) == 1 and not [f for f in os.listdir(f"{tmp_path}/_log") if f.startswith(".0-")]


def test_what_no_state_needs_is_removed(spark, tmp_path):
    rows = made(spark, tmp_path, buckets=4)
    for k in range(6):
        rows.upsert(spark.createDataFrame([(1, k)], "k long, v long"), datetime(2024, 2, 1 + k), "v")
    before = sorted(map(tuple, rows.current().collect()))
    assert rows.vacuum() == [1, 2, 3, 4, 5]
    assert sorted(map(tuple, rows.current().collect())) == before
    assert len(rows.log()) == 1 and len(files(tmp_path, 0)) == 3 and len(files(tmp_path, 6)) == 1
    rows.upsert(spark.createDataFrame([(2, 9)], "k long, v long"), datetime(2024, 3, 1), "v")
    assert rows.current().where("k = 2").first()["v"] == 9 and rows.current().count() == 400


def test_merge_deletes_inserts_and_missing_rows(spark, tmp_path):
    rows = made(spark, tmp_path, n=10, buckets=3)
    source = spark.createDataFrame([(1, 1, 0, True), (2, 5, 0, False), (2, 6, 1, False), (50, 1, 0, False), (51, 1, 0, True), (None, 3, 0, False)], "k long, v long, at long, gone boolean")
    rows.merge(source, ["at"], deleted=F.col("n.gone"))
    assert {r["k"]: r["v"] for r in rows.current().collect()} == {k: 6 if k == 2 else 2 * k for k in range(10) if k != 1}
    rows.merge(source, ["at"], inserted={}, deleted=F.col("n.gone"))
    assert {50, None} < {r["k"] for r in rows.current().collect()} and rows.current().where("k = 51").isEmpty()
    assert rows.insert_missing(spark.createDataFrame([(3, 99)], "k long, v long"), "v") == []
    rows.insert_missing(spark.createDataFrame([(3, 99), (77, 2), (77, 1)], "k long, v long"), "v")
    assert {r["k"]: r["v"] for r in rows.current().where("k in (3, 77)").collect()} == {3: 6, 77: 1}
    # a null is a key like any other
    rows.merge(spark.createDataFrame([(None, 4, 0)], "k long, v long, at long"), ["at"], inserted={})
    assert rows.insert_missing(spark.createDataFrame([(None, 5)], "k long, v long"), "v") == []
    assert [r["v"] for r in rows.current().where("k is null").collect()] == [4]
    rows.update(spark.createDataFrame([(None,)], "k long"), {"v": F.col("v") + 1})
    assert [r["v"] for r in rows.current(spark.createDataFrame([(None,)], "k long")).collect()] == [5]
    version = rows.version()
    assert rows.delete(F.col("v") == -1) == [] and rows.version() == version
    rows.delete(F.col("v") >= 10)
    assert rows.current().where("v >= 10").isEmpty()


def test_empty_stores(spark, tmp_path):
    empty = BucketStore(spark, str(tmp_path), spark.createDataFrame([], "k long, v long").schema, ["k"]).start()
    assert empty.current().count() == 0 and empty.delete(F.col("v") > 0) == [] and empty.merge(empty.current(), ["v"], inserted={}) == []
    empty.merge(spark.createDataFrame([(1, 2)], "k long, v long"), ["v"], inserted={})
    assert [tuple(r) for r in empty.current().collect()] == [(1, 2)]


def test_bits_count_as_rows_do(spark, tmp_path):
    r = random.Random(4)
    values = {"A": ["x", "y", "", None], "B": ["1", "2", "3", None]}
    data = [(k, r.choice(values["A"]), r.choice(values["B"]), r.random() < 0.7, r.random()) for k in range(3000)]
    rows = spark.createDataFrame(data, "k long, A string, B string, on boolean, w double")
    index = IndexedStore(spark, str(tmp_path), rows.schema, ["k"], ["A", "B"], F.col("on"), buckets=3).start(rows)
    domains = {"A": ["x", "y", "_null", "none"], "B": ["1", "2", "3"]}

    def same(data, asked, least=None):
        keep = [d for d in data if d[3] and all(dict(A=d[1], B=d[2])[c] in vs for c, vs in asked.items()) and (least is None or d[4] >= least)]
        hits = index.matching(asked, *([F.col("w") >= least] if least is not None else []))
        got = {(x["facet"], x["value"]): x["n"] for x in index.counts(hits, domains).collect()}
        a, b = Counter(d[1] or "_null" for d in keep), Counter(d[2] for d in keep)
        assert got == {("total", ""): len(keep)} | {("A", v): a[v] for v in domains["A"]} | {("B", v): b[v] for v in domains["B"]}
        assert sorted(x["k"] for x in index.rows(hits).collect()) == sorted(d[0] for d in keep)

    same(data, {})
    same(data, {"A": ["x", "y"], "B": ["2"]}, 0.25)
    same(data, {"A": ["none"]})
    same(data, {"B": []})
    changes = [(k, "x", "3", k % 2 == 0, 0.5) for k in range(0, 6000, 50)]
    touched = index.merge(spark.createDataFrame(changes, rows.schema), ["w"], inserted={})
    data = [d for d in data if d[0] % 50] + changes
    same(data, {"A": ["x"], "B": ["3", "1"]}, 0.5)
    # only touched buckets have new bits
    assert {int(d[7:]) for d in os.listdir(tmp_path / "_bits/v=1") if d.startswith("bucket=")} == set(touched)
    index.delete(F.col("A") == "x")
    same([d for d in data if d[1] != "x"], {"B": ["3"]})
    index.vacuum()
    same([d for d in data if d[1] != "x"], {"A": ["y"]})
    assert not (tmp_path / "_bits/v=1").exists()


def test_blocks_beyond_one(spark, tmp_path):
    """More rows in a bucket than a bitmap has bits."""
    rows = spark.range(70_000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("A"))
    index = IndexedStore(spark, str(tmp_path), rows.schema, ["k"], ["A"], buckets=1).start(rows)
    hits = index.matching({"A": ["x"]})
    assert index.index(["A"]).select("block").distinct().count() == 3
    assert {(r["facet"], r["value"]): r["n"] for r in index.counts(hits, {"A": ["x", "y"]}).collect()} == {("total", ""): 23334, ("A", "x"): 23334, ("A", "y"): 0}
    assert index.rows(hits).where("k % 3 <> 0").isEmpty() and index.rows(hits).count() == 23334


def test_facet_counts_of_the_query_are_those_of_the_scan(spark):
    rows = registry.QUERIES["t09_facet_index"](spark, SF).where("phase = 'before'").drop("phase").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, registry.QUERIES["a01_facet_counts"](spark, SF).collect()))


def test_no_row_is_read_for_counts_by_facets(spark, tmp_path):
    rows = queries.postings(spark, SF)
    index = IndexedStore(spark, str(tmp_path), rows.schema, ["JobID"], list(queries.DOMAINS), facets.live(), buckets=2).start(rows)
    hits = index.matching({"Experience": ["5-LOW"]})
    assert all("/_bits/" in f for f in index.counts(hits, queries.DOMAINS).inputFiles() if f.startswith("file"))


# the change table


def table_of(spark, path, snapshot=None, **how):
    schema = spark.createDataFrame([], "k long, n long").schema
    return CurrentTable(spark, str(path), schema, ["k"], kind(F.col("op")) == "delete", "n", 4, kind(F.col("op")) == "reconcile", snapshot, **how)


def batch_of(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, n long, op string")


def state(table):
    return sorted(map(tuple, table.current().collect()))


def test_reconcile_takes_the_snapshot_once(spark, tmp_path):
    truth = [spark.createDataFrame([(1, 9), (8, 9)], "k long, n long")]
    table = table_of(spark, tmp_path, lambda: truth[0]).start()
    table.apply(batch_of(spark, (1, 1, "insert"), (2, 2, "insert"), (3, 3, "update"), (3, 4, "delete")), 0)
    assert state(table) == [(1, 1), (2, 2)]
    table.apply(batch_of(spark, (None, None, "drop"), (5, 5, "insert")), 1)
    assert state(table) == [(1, 9), (8, 9)]
    truth[0] = truth[0].limit(0)
    table.apply(batch_of(spark, (None, None, "drop")), 1)  # repeated: done before
    table.apply(batch_of(spark, (8, 10, "delete"), (4, 11, "replace")), 2)
    assert state(table) == [(1, 9), (4, 11)]


def test_the_log_and_old_versions_do_not_grow(spark, tmp_path):
    table = table_of(spark, tmp_path, tidy=3).start()
    for n in range(12):
        table.apply(batch_of(spark, (n % 5, n, "insert")), n)
    again = table_of(spark, tmp_path, tidy=3)
    assert state(again) == [(0, 10), (1, 11), (2, 7), (3, 8), (4, 9)]
    assert len(os.listdir(tmp_path / "_log")) < 14 and again.has_batch(11) and not again.has_batch(12)


def test_a_failing_stream_is_refreshed_and_started_anew(spark, tmp_path):
    """The second batch fails once; the poll refreshes, waits and goes on."""
    feed, table = tmp_path / "feed", table_of(spark, tmp_path / "t").start()
    for n in range(3):
        batch_of(spark, (n, n, "insert")).coalesce(1).write.mode("append").parquet(str(feed))
    changes = spark.readStream.schema("k long, n long, op string").option("maxFilesPerTrigger", 1).parquet(str(feed))
    failed, refreshed, apply = [], [], table.apply

    def sometimes(batch, number):
        if number == 1 and not failed:
            failed.append(number)
            raise OSError("lost")
        apply(batch, number)

    table.apply = sometimes
    kept_up(lambda: table.follow(changes), lambda: refreshed.append(state(table)), first_wait=0.01)
    assert failed == [1] and refreshed == [[(0, 0)]] and state(table) == [(0, 0), (1, 1), (2, 2)]


def test_marks_of_a_poll(spark):
    from tidemark.streaming.changes import changed_mark

    rows = spark.createDataFrame([(1,), (2,)], "t long")
    mark = changed_mark(rows, "t", None)
    assert mark == (2, 2) and changed_mark(rows, "t", mark) is None and changed_mark(rows.where("t = 1"), "t", mark) == (1, 1)


# rows of a run's log, lists and outdated rows


def test_lists_logs_and_outdated_rows(spark, tmp_path):
    (tmp_path / "l.txt").write_text("Alpha\nalpha \n# no\nbeta-1\n")
    assert sorted(r["value"] for r in store.listed(spark, str(tmp_path / "l.txt"), "^[a-z0-9-]+$").collect()) == ["alpha", "beta-1"]
    rows = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 3, 30),), (None,)], "ts timestamp")
    for _ in range(2):
        store.appended(rows, str(tmp_path / "log"))
    logged = spark.read.parquet(str(tmp_path / "log"))
    assert logged.count() == 6 and logged.where(store.outdated("ts", datetime(2024, 4, 1))).count() == 2
