"""Counters and limits over event streams: daily counters, a rate limit of the last hour, rows with a time to live."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemark.operators.buckets import BucketStore

HOUR_US = 3_600_000_000


class DailyCounters(BucketStore):
    """(day, field, n) in a store: increments are added, and a batch that comes again adds nothing.

    A batch's own sums are made before they meet the stored ones, so a batch of any size costs
    a row for each day and field there.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 4) -> None:
        super().__init__(spark, path, spark.createDataFrame([], "day date, field string, n long").schema, ["day", "field"], buckets)

    def increment(self, events: DataFrame, ts: str, field: str, number: int, count: Column | None = None) -> None:
        sums = events.groupBy(F.to_date(ts).alias("day"), F.col(field).alias("field")).agg(F.sum(F.lit(1) if count is None else count).cast("long").alias("n"))
        self.merge(sums, ["n"], {"n": F.col("o.n") + F.col("n.n")}, {}, batch=number)

    def put(self, values: DataFrame) -> None:
        """Sets counters (day, field, n) to values."""
        self.merge(values, ["n"], {}, {})


def daily_counts(events: DataFrame, ts: str, field: str, delay: str, key: str | None = None) -> DataFrame:
    """(day, field, n) of a stream, by event time: rows later than ``delay`` behind the latest are left out, and repeats of ``key`` within it.

    The state is a row for each open day and field, and the keys of the last ``delay``.
    """
    timed = events.withWatermark(ts, delay)
    once = timed.dropDuplicatesWithinWatermark([key]) if key else timed
    counted = once.groupBy(F.window(ts, "1 day").alias("w"), F.col(field).alias("field")).agg(F.count("*").alias("n"))
    return counted.select(F.to_date("w.start").alias("day"), "field", "n")


class Totals(BucketStore):
    """(day, field, n) as a windowed stream last gave them: totals replace, so a repeated batch changes nothing."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 4) -> None:
        super().__init__(spark, path, spark.createDataFrame([], "day date, field string, n long").schema, ["day", "field"], buckets)

    def follow(self, counts: DataFrame):  # noqa: ANN201
        put = lambda rows, number: self.merge(rows, ["n"], {}, {}, batch=number)
        return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{self.path}/_state").trigger(availableNow=True).start()


LIMITED = "id long, limited boolean"
TIMES = "times array<long>, ts array<long>, ids array<long>"


def judged(times: list[int], ready: list[tuple[int, int]], limit: int, span: int) -> tuple[list[bool], list[int]]:
    """For rows in order whether ``limit`` earlier ones lie in the time before; and the last ``limit`` times."""
    out, held = [], list(times)
    for t, _ in ready:
        out.append(len(held) >= limit and held[-limit] >= t - span)
        held = [*held[-limit + 1 :], t] if limit > 1 else [t]
    return out, held


def limited(events: DataFrame, key: str, ts: str, id_col: str, limit: int, delay: str, span: int = HOUR_US) -> DataFrame:
    """(id, limited) of a stream: whether a key had ``limit`` rows or more in the hour before a row.

    A row is judged when the watermark, ``delay`` behind the latest row, has passed it, so rows
    may come in any order within ``delay``; later ones are left out.  A key's state is its rows
    of the last ``delay`` and its last ``limit`` times, and ends ``span`` after its last row.
    Rows without a key are not limited, and not given.
    """

    def each(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() * 1000
        times, at, ids = map(list, state.get) if state.exists else ([], [], [])
        for rows in batches:
            own = rows["t"].to_numpy()
            # at a timeout there is no row
            at += own[own >= mark].tolist()
            ids += rows["id"].to_numpy()[own >= mark].tolist()
        waiting = sorted(zip(at, ids, strict=True))
        ready = [x for x in waiting if x[0] < mark]
        waiting = waiting[len(ready) :]
        said, times = judged(times, ready, limit, span)
        if waiting or (times and times[-1] + span >= mark):
            state.update((times, [t for t, _ in waiting], [i for _, i in waiting]))
            until = min([t for t, _ in waiting], default=times[-1] + span if times else 0)
            state.setTimeoutTimestamp(max(until, mark) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"id": [i for _, i in ready], "limited": said})

    own = events.where(F.col(key).isNotNull()).withWatermark(ts, delay)
    rows = own.select(F.col(key).alias("key"), ts, F.unix_micros(ts).alias("t"), F.col(id_col).cast("long").alias("id"))
    return rows.groupBy("key").applyInPandasWithState(each, LIMITED, TIMES, "append", GroupStateTimeout.EventTimeTimeout)


class LiveLog(BucketStore):
    """Rows that live for some time: each batch adds its own and takes out what is older than the latest row less the time to live."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], ts: str, ttl: timedelta, buckets: int = 4) -> None:
        super().__init__(spark, path, schema, key, buckets)
        self.ts, self.ttl = ts, ttl

    def apply(self, batch: DataFrame, number: int) -> None:
        if self.has_batch(number):
            return
        self.merge(batch, [self.ts], {}, {}, batch=number)
        self.delete(F.col(self.ts) <= F.lit(self.latest_ts()) - F.lit(self.ttl))

    def latest_ts(self):  # noqa: ANN201
        return self.current().agg(F.max(self.ts)).first()[0]

    def follow(self, rows: DataFrame):  # noqa: ANN201
        return rows.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.path}/_state").trigger(availableNow=True).start()
