"""Accounts: who a request belongs to, what a code is worth, how much is left of a week."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolved(requests: DataFrame, users: DataFrame) -> DataFrame:
    """``requests`` (external_id, email) with user_id and by: external_id, email or new.

    Two equi-joins instead of one on either key; of users that share a key the smallest
    user_id wins.  Null keys match nobody.
    """
    out = requests
    for key in ("external_id", "email"):
        own = users.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("user_id").alias(f"_{key}"))
        out = out.join(own, key, "left")
    by = F.when(F.col("_external_id").isNotNull(), "external_id").when(F.col("_email").isNotNull(), "email").otherwise("new")
    return out.withColumns({"user_id": F.coalesce("_external_id", "_email"), "by": by}).drop("_external_id", "_email")


def code_outcome(as_of: datetime, found: Column, expires: Column, used: Column, limit: Column) -> Column:
    """not_found, expired, exhausted or valid, in that order; open ends never expire."""
    return (
        F.when(~F.coalesce(found, F.lit(False)), "not_found")
        .when(expires < F.lit(as_of), "expired")
        .when(used >= limit, "exhausted")
        .otherwise("valid")
    )


def metered(uses: DataFrame, who: str, ts: str, limit: int, *ties: str) -> DataFrame:
    """``uses`` with ``allowed``: the first ``limit`` of each account and week."""
    by = Window.partitionBy(who, F.date_trunc("week", ts)).orderBy(ts, *ties)
    return uses.withColumn("allowed", F.row_number().over(by) <= limit)


def conversions(events: DataFrame, who: str, ts: str) -> DataFrame:
    """(day, n): visitors by the day of their first conversion, each counted once."""
    first = events.where(F.col(who).isNotNull()).groupBy(who).agg(F.min(ts).alias("_first"))
    return first.groupBy(F.to_date("_first").alias("day")).agg(F.count("*").alias("n"))


def saved_postings(users: DataFrame, postings: DataFrame, who: str, saved: str) -> DataFrame:
    """Each account's saved postings that still exist, with the time of saving.

    ``saved`` is an array of structs (JobID, savedAt).
    """
    each = users.select(who, F.explode(saved).alias("_s")).select(who, "_s.JobID", "_s.savedAt")
    return each.join(postings, "JobID")
