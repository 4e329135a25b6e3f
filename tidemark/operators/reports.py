"""Reports: counts by condition, tallies over known names, freshness, top lists, digests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ranking import cap_per_group


def counted(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the number of rows that meet each condition; one pass."""
    return rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()])


def zero_filled(spark: SparkSession, names: list[str], rows: DataFrame, column: str) -> DataFrame:
    """(column, n) for each of ``names``, zeros too; other values are left out."""
    counts = rows.where(F.col(column).isin(names)).groupBy(column).agg(F.count("*").alias("_n"))
    known = spark.createDataFrame([(n,) for n in names], f"{column} string")
    return known.join(counts, column, "left").select(column, F.coalesce("_n", F.lit(0)).alias("n"))


def labelled(rows: DataFrame, column: str, labels: dict[str, str]) -> DataFrame:
    """``rows`` with place and label of the column's known names."""
    names = F.array(*[F.lit(n) for n in labels])
    text = F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), F.col(column))
    return rows.withColumns({"place": F.array_position(names, F.col(column)), "label": text})


def top_and_rest(rows: DataFrame, column: str, n: int) -> DataFrame:
    """(column, n): the most frequent values, ties by name, and "(others)" with the number of rows left."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), column).limit(n)
    rest = counts.join(top.select(F.col(column).alias("_top")), F.col(column).eqNullSafe(F.col("_top")), "left_anti")
    return top.unionByName(rest.agg(F.lit("(others)").alias(column), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def freshness(rows: DataFrame, ts: str, as_of: datetime, warn_hours: int = 30, fail_hours: int = 48) -> DataFrame:
    """One row: ok, warn or fail by the age of the latest row; without rows warn."""
    hours = (F.unix_micros(F.lit(as_of)) - F.unix_micros(F.max(ts).cast("timestamp"))) / 3_600_000_000
    return rows.agg(hours.alias("hours")).select(
        F.when(F.col("hours") > fail_hours, "fail").when((F.col("hours") > warn_hours) | F.col("hours").isNull(), "warn").otherwise("ok").alias("status")
    )


def rollup(checks: DataFrame, *by: str) -> DataFrame:
    """One row (or one a group): down if a critical check failed, degraded if any is not ok, else operational."""
    down = F.bool_or(F.col("critical") & (F.col("status") == "fail"))
    return checks.groupBy(*by).agg(F.when(down, "down").when(F.bool_or(F.col("status") != "ok"), "degraded").otherwise("operational").alias("overall"))


def yields(boards: DataFrame, board: str, hit: Column, sample: str, n: int = 3) -> DataFrame:
    """(board, hits, total, sample): rows that fit, all rows, and the first ``n`` distinct samples of those that fit.

    The samples are cut down by a window before they are put together.
    """
    rows = boards.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    sums = rows.groupBy(board).agg(F.count_if("_hit").alias("hits"), F.count("*").alias("total"))
    own = cap_per_group(rows.where("_hit").select(board, sample).distinct(), F.col(board), n, F.col(sample))
    some = own.groupBy(board).agg(F.array_join(F.array_sort(F.collect_list(sample)), ",").alias("sample"))
    return sums.join(some, board, "left").withColumn("sample", F.coalesce("sample", F.lit("")))


def batches(rows: DataFrame, group: Column, size: int, *order: Column) -> DataFrame:
    """``rows`` with the number of the batch of ``size`` rows that each belongs to, by group."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("batch", F.floor((n - 1) / size))


def digest(users: DataFrame, postings: DataFrame, user: str, wanted: str, category: str, cap: int, *order: Column) -> DataFrame:
    """(user, category, posting columns): the newest postings of the categories that each user wants.

    The postings are capped by category first, so that a user gets ``cap`` of each at most.
    """
    best = cap_per_group(postings, F.col(category), cap, *order)
    asked = users.select(user, F.explode(F.array_distinct(wanted)).alias("_c"))
    return asked.join(best, F.col("_c") == F.col(category)).drop("_c")


def directory(scraped: DataFrame, manual: DataFrame, profiles: DataFrame, key) -> DataFrame:  # noqa: ANN001
    """Scraped companies (name, n) and manual ones (name) that were not scraped, with their profiles (key, description).

    ``key`` makes the profile's key from a name.  The branch number keeps the two orders apart.
    """
    known = scraped.select(F.lower("name").alias("_k"))
    rest = manual.join(known, F.lower("name") == F.col("_k"), "left_anti").select("name", F.lit(0).cast("long").alias("n"), F.lit(1).alias("branch"))
    both = scraped.select("name", "n", F.lit(0).alias("branch")).unionByName(rest)
    own = profiles.withColumnsRenamed({"key": "_key"})
    return both.join(own, key(F.col("name")) == F.col("_key"), "left").drop("_key")
