"""Landed pages, schema tables over JSON, and the digest, on small fixtures."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import digest, schemas
from tidemark.sources import paged

# pages


def test_when_another_page_follows():
    assert not paged.goes_on(0, 0, 20, 100) and not paged.goes_on(0, 0, 20, until_empty=True)
    assert paged.goes_on(5, 0, 20, 6) and not paged.goes_on(5, 20, 20, 25)
    assert paged.goes_on(20, 0, 20) and not paged.goes_on(19, 0, 20) and paged.goes_on(1, 0, 20, until_empty=True)


def board(path, name, pages):
    (path / f"board={name}").mkdir(parents=True)
    lines = [json.dumps({"offset": 2 * k, "total": total, "jobs": [{"id": j} for j in jobs]}) for k, (total, jobs) in enumerate(pages)]
    (path / f"board={name}" / "part-0.txt").write_text("\n".join(lines) + "\n")


@pytest.mark.parametrize(
    ("rule", "wanted"),
    [("total", {"a": [1, 2, 3], "b": [1, 2], "c d": [1]}), ("full", {"a": [1, 2, 3], "b": [1, 2, 3, 4], "c d": [1]}), ("until_empty", {"a": [1, 2, 3, 4, 5], "b": [1, 2, 3, 4], "c d": [1, 2, 3]})],
)
def test_pages_stop_by_the_rule(spark, tmp_path, rule, wanted):
    board(tmp_path, "a", [(3, [1, 2]), (3, [3]), (3, [4, 5])])
    board(tmp_path, "b", [(2, [1, 2]), (99, [3, 4]), (2, []), (2, [9])])
    board(tmp_path, "c%20d", [(1, [1]), (1, [2, 3])])
    got: dict = {}
    for r in paged.read(spark, str(tmp_path), 2, rule).orderBy("board", "offset", "position").collect():
        got.setdefault(r["board"], []).append(json.loads(r["job"])["id"])
    assert got == wanted


def test_filters_on_boards_reach_the_source(spark, tmp_path):
    for name in "abcd":
        board(tmp_path, name, [(1, [1])])
    rows = paged.read(spark, str(tmp_path), 2)
    assert rows.rdd.getNumPartitions() == 4
    some = rows.where(F.col("board").isin("b", "c") & (F.col("position") == 0))
    assert some.rdd.getNumPartitions() == 2 and {r["board"] for r in some.collect()} == {"b", "c"}
    one = rows.where("board = 'd'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1
    assert rows.where("board = 'none'").count() == 0


def test_landed_rows_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"b{k % 7}/x") for k in range(200)] + [(900, None)], "id long, b string")
    paged.land(rows, F.col("b"), F.to_json(F.struct("id")), str(tmp_path / "p"), "id", 7)
    got = paged.read(spark, str(tmp_path / "p"), 7).orderBy("board", "offset", "position").collect()
    wanted = sorted((r["b"], r["id"]) for r in rows.collect() if r["b"])
    assert [(r["board"], json.loads(r["job"])["id"]) for r in got] == wanted
    assert {r["offset"] % 7 for r in got} == {0} and max(r["position"] for r in got) == 6


# schemas


def made(spark, texts, fields):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(schemas.validated(schemas.parsed(F.col("t")), fields).alias("x"))
    return [r["x"] and r["x"].asDict(recursive=True) for r in df.collect()]


def test_broken_input_is_null(spark):
    assert made(spark, [None, "", "{", "[1]", "null", "7", '"{}"'], schemas.REQUIREMENTS) == [None] * 7


def test_every_type_where_another_is_wanted(spark):
    values = ["1", "1.5", '"t"', "true", "null", "[1]", "{}"]
    fields = (schemas.Field("n", "number"), schemas.Field("f", "flag", default=False), schemas.Field("t", default="-"), schemas.Field("a", "texts"), schemas.Field("e", allowed=("t",)))
    got = made(spark, [f'{{"n": {v}, "f": {v}, "t": {v}, "a": {v}, "e": {v}}}' for v in values], fields)
    assert [x["n"] for x in got] == [1.0, 1.5, None, None, None, None, None]
    assert [x["f"] for x in got] == [False, False, False, True, False, False, False]
    assert [x["t"] for x in got] == ["-", "-", "t", "-", "-", "-", "-"]
    assert [x["e"] for x in got] == [None, None, "t", None, None, None, None] and all(x["a"] == [] for x in got)
    assert got[4]["errors"] == [] and got[2]["errors"] == ["n: no number", "f: no flag", "a: no texts"] and got[0]["errors"] == ["f: no flag", "t: no text", "a: no texts", "e: no text"]


def test_loose_types(spark):
    got = made(spark, ['{"JobID": 7, "SalaryMin": true, "SalaryMax": "1e3", "IsRemote": "TRUE", "GermanRequired": 0, "isEntryLevel": {}, "PostedDate": "x", "JobTitle": " t "}', '{"JobID": null, "SalaryMax": "", "PostedDate": 0}'], schemas.POSTING)
    one, two = got
    assert (one["JobID"], one["SalaryMin"], one["SalaryMax"], one["IsRemote"], one["GermanRequired"], one["isEntryLevel"], one["JobTitle"]) == ("7", 1.0, 1000.0, False, False, True, "t")
    assert one["PostedDate"] is None and one["errors"] == ["PostedDate: no date"]
    assert (two["JobID"], two["SalaryMax"], two["PostedDate"], two["Company"]) == (None, None, datetime(1970, 1, 1), "N/A")


def test_pay_is_usable_or_absent(spark):
    cases = {
        '{"salary_min": 5, "salary_interval": "hourly", "salary_currency": "usd"}': (5.0, None, "USD", "hourly"),
        '{"salary_min": 4, "salary_interval": "hourly", "salary_currency": "USD"}': (None,) * 4,
        '{"salary_min": 50000, "salary_max": 2000000, "salary_currency": "EUR"}': (None,) * 4,
        '{"salary_max": 50000, "salary_interval": "weekly", "salary_currency": "EUR"}': (None, 50000.0, "EUR", "yearly"),
        '{"salary_min": 50000}': (None,) * 4, '{"salary_min": "50000", "salary_currency": "EUR"}': (None,) * 4,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select(schemas.pay_of(schemas.parsed(F.col("t"))).alias("p"))
    assert [tuple(r["p"]) for r in df.collect()] == list(cases.values())


# the digest


def plain(users, rows):
    """The mails, one user after the other."""
    out = {}
    ranked = sorted(rows, key=lambda r: (-r[2].timestamp(), r[1]))
    for user, wanted in users:
        queues = {c: [r[1] for r in ranked if r[0] == c][:50] for c in dict.fromkeys(wanted or [])}
        queues = {c: q for c, q in queues.items() if q}
        total, chosen, n = sum(map(len, queues.values())), {c: [] for c in queues}, 0
        while n < 8 and any(queues.values()):
            for c, q in queues.items():
                if q and n < 8:
                    chosen[c].append(q.pop(0))
                    n += 1
        if n:
            out[user] = (total, n, [(c, i) for c, own in chosen.items() for i in own])
    return out


def test_digests_are_those_of_a_plain_loop(spark):
    r = random.Random(6)
    rows = [(r.choice("AAAAAABBBCD"), k, datetime(2024, 1, 1) + timedelta(hours=r.randrange(50))) for k in range(150)]
    users = [(k, r.choice([None, [], ["A"], ["B", "A"], ["A", "B"], ["D", "Z", "C"], ["Z"], ["A", "A", "D"], list("DCBA")])) for k in range(60)]
    own = digest.messages(spark.createDataFrame(users, "u long, desiredCategories array<string>"), spark.createDataFrame(rows, "c string, i long, t timestamp"), "c", "i", F.desc("t"), F.col("i").asc())
    got = {x["u"]: (x["total"], x["shown"], [tuple(p) for p in x["picks"]]) for x in own.collect()}
    assert got == plain(users, rows)
    assert {x["subject"] for x in own.where("shown = 8").collect()} == {"Your weekly job digest — 8 new roles in Germany"}


def test_lists_are_picked_for_once(spark):
    """The rows that are picked do not follow the number of users."""
    users = spark.range(5000).select(F.col("id").alias("u"), F.array(F.lit("A"), F.lit("B")).alias("desiredCategories"))
    rows = spark.createDataFrame([("A", k, datetime(2024, 1, 1)) for k in range(99)], "c string, i long, t timestamp")
    found = digest.picked(users.select(F.col("desiredCategories").alias("wanted")).distinct(), rows, "c", "i", F.col("i").asc())
    assert [(r["total"], len(r["picks"])) for r in found.collect()] == [(50, 8)]
    assert digest.messages(users, rows, "c", "i", F.col("i").asc()).count() == 5000
