"""Caps, first-wins dedup and orders over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import shuffle


def cap_per_group(rows: DataFrame, group: Column, cap: int, *order: Column) -> DataFrame:
    """The first ``cap`` rows of each group.  Spark limits each group before the shuffle."""
    by = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= cap).drop("_n")


def first_per_key(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The first row of each key, by an aggregate that is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    best = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_b")
    return rows.groupBy(*key).agg(best).select(*key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def round_robin(rows: DataFrame, group: str, groups: list[str], cap: int, *order: Column) -> DataFrame:
    """Takes one row of each group in turn, in the order of ``groups``, up to ``cap``."""
    near = cap_per_group(rows.where(F.col(group).isin(groups)), F.col(group), cap, *order)
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    place = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col(group))
    return near.withColumn("turn", turn).withColumn("place", place).orderBy("turn", "place").limit(cap)


def trailing_count(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """``events`` with the number of the key's events in the trailing time, itself included."""
    by = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n_trailing", F.count("*").over(by))


def at_least_or_all(rows: DataFrame, narrow: Column, least: int) -> DataFrame:
    """The narrowed rows if there are ``least`` of them, else all rows."""
    hits = rows.where(narrow).limit(least).count()
    return rows.where(narrow) if hits >= least else rows


def placed(rows: DataFrame, path: str, *order: str) -> DataFrame:
    """``rows`` with ``place``, their number from 0 in a total order.

    A range sort deals the rows out, which are written to the new folder ``path`` with their number
    in their partition; what is before a partition is a running sum over one row a partition.
    """
    held = rows.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    held.withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id").write.parquet(path)
    held = rows.sparkSession.read.parquet(path)
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return held.join(before, "_part").withColumn("place", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def daily_order(rows: DataFrame, key: str, day: str, path: str) -> DataFrame:
    """(pos, key) of all rows in the day's order: places by ``key``, permuted row by row; only the number of rows is in the driver."""
    found = placed(rows.select(key), path, key)
    return found.select(shuffle.permuted(F.col("place"), max(found.count(), 1), day).alias("pos"), key)


def listed_order(rows: list, day: str) -> list:
    """A list that fits one machine in the exact daily order."""
    return [rows[k] for k in shuffle.permutation(len(rows), day)]
