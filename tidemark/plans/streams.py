"""Queries over streams of the events: who is who, counters, limits and rows that expire."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import arrivals
from tidemark.plans.queries import query, table
from tidemark.plans.stores import folder
from tidemark.streaming import counters

col = F.col


def requests_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as requests: cookies, addresses and prints of two kinds, each now and then missing."""
    e, k, user = col("event_id"), F.get_json_object("props", "$.k").cast("long"), col("user_id")
    mark = F.when(e % 3 == 1, F.concat(F.lit("old"), (user % 50).cast("string"))).when(e % 3 == 2, F.lpad((user % 50).cast("string"), 32, "x"))
    return table(spark, sf_dir, "events").select(
        e.alias("request"), col("ts").cast("timestamp").alias("ts"), F.when(e % 4 != 0, F.concat(F.lit("v"), user.cast("string"))).alias("vid"),
        F.when(e % 17 != 0, F.concat(F.lit("ip"), (k % 40).cast("string"))).alias("ip"), mark.alias("print"),
    )


@query("m16_visitors")
def visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request with its visitor.  What one finds depends on all before it, so there is no SQL twin: a plain loop tests it."""
    return arrivals.resolved(requests_of(spark, sf_dir))


def fed(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """The events as a stream of one file a part, in order; a part is a condition on the events."""
    events, path = table(spark, sf_dir, "events").withColumn("ts", col("ts").cast("timestamp")), folder(spark, "feed")
    last = events.agg(F.max("event_id")).first()[0] or 0
    for part in parts:
        events.where(part.replace("$half", str(last // 2)).replace("$late", str(last // 100))).coalesce(1).write.mode("append").parquet(path)  # a file a trigger
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("a14_increments", "SELECT CAST(ts AS DATE) AS day, event_type AS field, count(*) AS n FROM events GROUP BY ALL")
def increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counters raised by two batches, of which one comes again."""
    held = counters.DailyCounters(spark, folder(spark, "counters")).start()
    feed = fed(spark, sf_dir, "event_id <= $half", "event_id > $half")

    def twice(batch: DataFrame, number: int) -> None:
        for _ in range(2):  # as after a failure between the commit and the stream's own record
            held.increment(batch, "ts", "event_type", number)

    feed.writeStream.foreachBatch(twice).option("checkpointLocation", f"{held.path}/_state").trigger(availableNow=True).start().awaitTermination()
    return held.current()


LATE = "event_id > (SELECT max(event_id) // 100 FROM events)"


@query("a14_windows", f"SELECT CAST(ts AS DATE) AS day, event_type AS field, count(*) AS n FROM events WHERE {LATE} GROUP BY ALL")
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by event time: the second half comes twice, and the first events too late."""
    feed = fed(spark, sf_dir, "event_id > $late and event_id <= $half", "event_id > $half", "event_id > $half", "event_id <= $late")
    totals = counters.Totals(spark, folder(spark, "totals")).start()
    totals.follow(counters.daily_counts(feed, "ts", "event_type", "20 days", "event_id")).awaitTermination()
    return totals.current()


@query("a22_limited", f"""SELECT event_id AS id, coalesce(lag(ts, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 1 HOUR, false) AS limited
 FROM events WHERE {LATE} QUALIFY ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")  # fmt: skip
def limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a user with two others in the hour before, as a stream gives them: all up to its watermark."""
    feed = fed(spark, sf_dir, "event_id > $late and event_id <= $half", "event_id > $half or event_id <= $late")
    path = folder(spark, "limited")
    found = counters.limited(feed, "user_id", "ts", "event_id", 2, "1 day")
    found.writeStream.option("checkpointLocation", f"{path}-state").option("path", path).format("parquet").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counters.LIMITED).parquet(path)


@query("t10_live_log", "SELECT event_id, user_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def live_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that have not expired, kept by a stream."""
    feed = fed(spark, sf_dir, "event_id <= $half", "event_id > $half").select("event_id", "user_id", "ts")
    log = counters.LiveLog(spark, folder(spark, "log"), feed.schema, ["event_id"], "ts", timedelta(days=3))
    log.start()
    log.follow(feed).awaitTermination()
    return log.current().withColumn("ts", col("ts").cast("timestamp_ntz"))
