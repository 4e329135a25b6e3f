"""Locations and accounts on small fixtures with nulls, ties and empty tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import accounts, location


def test_places(spark):
    places = ["Berlin", "Remote, Berlin", "Paris", "Rio de Janeiro", "Düsseldorf", "MÜNCHEN", "Odense", "", None]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(places)], "i int, p string").select(
        "i", location.mentions_germany(F.col("p")).alias("m"), location.surely_german(F.col("p")).alias("s")
    )
    found = sorted(rows.collect())
    assert [r.m for r in found] == [True, True, False, True, True, True, False, False, False]
    assert [r.s for r in found] == [True, False, False, False, True, True, False, False, False]


def test_resolution_prefers_external_id(spark):
    users = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "z"), (4, None, None)], "user_id int, external_id string, email string")
    asked = spark.createDataFrame([(1, "a", "y"), (2, "q", "y"), (3, None, None), (4, "q", "q")], "r int, external_id string, email string")
    found = accounts.resolved(asked, users).select("r", "user_id", "by").collect()
    assert sorted(tuple(r) for r in found) == [(1, 1, "external_id"), (2, 2, "email"), (3, None, "new"), (4, None, "new")]
    assert accounts.resolved(asked.limit(0), users).count() == 0
    assert {r.by for r in accounts.resolved(asked, users.limit(0)).collect()} == {"new"}


def test_code_outcomes_in_order(spark):
    codes = spark.createDataFrame(
        [(1, None, None, None, None), (2, True, datetime(2023, 1, 1), 9, 9), (3, True, None, 9, 9), (4, True, datetime(2025, 1, 1), 8, 9), (5, True, None, 1, None)],
        "i int, found boolean, expires timestamp, used int, most int",
    )
    outcome = accounts.code_outcome(datetime(2024, 1, 1), *[F.col(c) for c in ("found", "expires", "used", "most")])
    found = codes.select("i", outcome.alias("o")).orderBy("i").collect()
    assert [r.o for r in found] == ["not_found", "expired", "exhausted", "valid", "valid"]


def test_meter_starts_anew_each_week(spark):
    days = [1, 2, 3, 8, 9]  # 1 January 2024 is a Monday
    uses = spark.createDataFrame([(1, datetime(2024, 1, d)) for d in days], "u int, ts timestamp")
    found = accounts.metered(uses, "u", "ts", 2).orderBy("ts").collect()
    assert [r.allowed for r in found] == [True, True, False, True, True]


def test_saved_postings_that_are_gone_drop_out(spark):
    users = spark.sql("select 1 u, array(named_struct('JobID', 5, 'savedAt', 1), named_struct('JobID', 6, 'savedAt', 2)) s union all select 2, null")
    postings = spark.createDataFrame([(5, "c")], "JobID int, Company string")
    found = accounts.saved_postings(users, postings, "u", "s").select("u", "JobID", "savedAt", "Company").collect()
    assert [tuple(r) for r in found] == [(1, 5, 1, "c")]
