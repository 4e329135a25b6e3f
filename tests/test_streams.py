"""Counters, limits and rows with a time to live, over streams of small batches."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.streaming import counters

EVENTS = "id long, ts timestamp, who string"
START = datetime(2024, 1, 1)


def written(spark, path, *batches):
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(path))


def stream(spark, path):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_counters_are_raised_once_by_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, START, "a"), (2, START, "a"), (3, START + timedelta(days=1), "b"), (4, None, "b")], EVENTS)
    held = counters.DailyCounters(spark, str(tmp_path)).start()
    held.increment(rows, "ts", "who", 0)
    again = counters.DailyCounters(spark, str(tmp_path))  # after a restart
    again.increment(rows, "ts", "who", 0)
    again.increment(rows, "ts", "who", 1, F.col("id"))
    again.put(spark.createDataFrame([(date(2024, 1, 2), "b", 100)], "day date, field string, n long"))
    got = {(r["day"], r["field"]): r["n"] for r in again.current().collect()}
    assert got == {(date(2024, 1, 1), "a"): 5, (date(2024, 1, 2), "b"): 100, (None, "b"): 5}


def plain(rows, limit):
    """id -> whether the key had that many in the hour before."""
    out, held = {}, {}
    for i, t, who in sorted(rows, key=lambda r: (r[1], r[0])):
        times = held.setdefault(who, [])
        out[i] = sum(x >= t - timedelta(hours=1) for x in times) >= limit
        times.append(t)
    return out


def test_limits_of_rows_in_any_order_within_the_delay(spark, tmp_path):
    r = random.Random(5)
    rows = [(k, START + timedelta(minutes=r.randrange(5) + 4 * k), r.choice(["hot", "hot", "a", "b"])) for k in range(300)]
    shuffled = sorted(rows, key=lambda x: x[1] + timedelta(minutes=r.randrange(50)))
    late = (900, START + timedelta(minutes=3), "hot")
    end = (999, START + timedelta(days=9), "clock")
    written(spark, tmp_path / "feed", shuffled[:100], shuffled[100:200], [(1000, START + timedelta(minutes=850), "a")], [late, *shuffled[200:]], [end])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for limit in (1, 3):
        found = counters.limited(stream(spark, tmp_path / "feed"), "who", "ts", "id", limit, "1 hour")
        found.writeStream.option("checkpointLocation", f"{state}{limit}").option("path", f"{out}{limit}").format("parquet").trigger(availableNow=True).start().awaitTermination()
        got = {x["id"]: x["limited"] for x in spark.read.schema(counters.LIMITED).parquet(f"{out}{limit}").collect()}
        wanted = plain([*rows, (1000, START + timedelta(minutes=850), "a")], limit)
        # the late row is left out; the last one waits for the watermark
        assert got == wanted


def test_late_and_repeated_rows_of_windows(spark, tmp_path):
    hour = lambda h, k: (k, START + timedelta(hours=h), "a")
    days = [[hour(1, 1), hour(30, 2)], [hour(60, 3), hour(80, 4)], [hour(80, 4), hour(81, 5)], [hour(2, 6), hour(79, 7)]]
    written(spark, tmp_path / "feed", *days)
    totals = counters.Totals(spark, str(tmp_path / "totals")).start()
    totals.follow(counters.daily_counts(stream(spark, tmp_path / "feed"), "ts", "who", "1 day", "id")).awaitTermination()
    got = {r["day"].day: r["n"] for r in totals.current().collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 3}


def test_rows_live_for_a_time(spark, tmp_path):
    rows = [(k, START + timedelta(minutes=20 * k), "a") for k in range(10)]
    written(spark, tmp_path / "feed", rows[2:6], [rows[0], *rows[6:]])
    log = counters.LiveLog(spark, str(tmp_path / "log"), spark.createDataFrame([], EVENTS).schema, ["id"], "ts", timedelta(hours=1))
    log.start()
    log.follow(stream(spark, tmp_path / "feed")).awaitTermination()
    assert sorted(r["id"] for r in log.current().collect()) == [7, 8, 9]
    log.apply(spark.createDataFrame([rows[3]], EVENTS), 1)  # a batch that has been committed
    assert log.current().count() == 3


def test_empty_batches(spark, tmp_path):
    empty = spark.createDataFrame([], EVENTS)
    held = counters.DailyCounters(spark, str(tmp_path / "c")).start()
    held.increment(empty, "ts", "who", 0)
    assert held.current().count() == 0 and held.has_batch(0)
