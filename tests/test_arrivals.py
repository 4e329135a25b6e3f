"""Visitors found or made, against a plain loop over all requests."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import arrivals, groups
from tidemark.plans import registry
from tidemark.plans.streams import requests_of

SF = "/root/testdata/sf0.001"
SCHEMA = "request long, ts timestamp, vid string, ip string, print string"


def plain(requests, limit):
    """One request after the other, over all visitors: the rules as they are written."""
    visitors, log, out = [], [], {}
    for n, (request, ts, *signals) in enumerate(sorted(requests, key=lambda r: (r[1], r[0]))):
        vid, ip, mark = (s or None for s in signals)
        found, how = None, "found"
        if not vid and not mark and ip:
            found = next((v for v in visitors if v["ip"] == ip and not v["vid"] and not v["print"]), None)
        elif vid or mark:
            recent = sorted(visitors, key=lambda v: -v["seen"])
            hits = lambda v: sum(bool(x) and v[k] == x for k, x in (("vid", vid), ("ip", ip), ("print", mark)))  # noqa: B023, E731
            found = next((v for v in recent if hits(v) >= 2), None) or next((v for v in recent if vid and v["vid"] == vid), None)
            if not found and ip:
                fresh = ts - timedelta(minutes=10)
                found = next((v for v in recent if v["ip"] == ip and not v["vid"] and not v["print"] and not v["flagged"] and v["made"] >= fresh), None)
                how = "claimed" if found else how
        if found:
            found["seen"] = n
            found["vid"] = found["vid"] or vid
            if mark and (not found["print"] or len(found["print"]) < 32 <= len(mark)):
                found["print"] = mark
            found["ip"] = found["ip"] or ip
        else:
            how = "created"
            flagged = bool(ip) and sum(i == ip and t >= ts - timedelta(hours=1) for i, t in log) >= limit
            found = {"id": request, "vid": vid, "ip": ip, "print": mark, "seen": n, "made": ts, "flagged": flagged}
            visitors.append(found)
            if ip and not (flagged and not vid and not mark):
                log.append((ip, ts))
        out[request] = (found["id"], how, found["flagged"])
    return out


def got(df):
    return {r["request"]: (r["visitor"], r["how"], r["flagged"]) for r in df.collect()}


@pytest.mark.parametrize(("seed", "limit"), [(1, 2), (2, 5), (3, 30)])
def test_visitors_are_those_of_a_plain_loop(spark, seed, limit):
    r = random.Random(seed)
    old, new = [f"old{k}" for k in range(6)], [f"{k}".rjust(32, "x") for k in range(6)]
    rows, now = [], datetime(2024, 1, 1)
    for k in range(1500):
        now += timedelta(seconds=r.choice([0, 1, 30, 200, 900]))
        signals = (r.choice([None, "", f"u{k}", f"u{k}", *"abcdefghijklmnop"]), r.choice([None, *"123456789", "hot", "hot"]), r.choice([None, None, *old, *new]))
        if r.random() < 0.3:
            signals = (None, signals[1], "")
        rows.append((k, now, *signals))
    wanted = plain(rows, limit)
    df = spark.createDataFrame(r.sample(rows, len(rows)), SCHEMA).repartition(3)
    assert got(arrivals.resolved(df, limit)) == wanted


def test_claims_and_flags(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [(1, at(0), None, "a", None), (2, at(1), None, "a", None), (3, at(9), "v", "a", None), (4, at(10), None, "a", None), (5, at(21), "w", "a", None)]
    rows += [(6, at(22), "x", "a", None), (7, at(23), None, "a", None), (8, at(90), "y", "a", None), (9, at(91), None, None, None), (10, at(92), None, None, None)]
    found = got(arrivals.resolved(spark.createDataFrame(rows, SCHEMA), 3))
    assert found == plain(rows, 3)
    assert found[3] == (1, "claimed", False) and found[5] == (5, "created", False) and found[6] == (6, "created", True) and found[10] == (10, "created", False)


def test_a_pair_from_two_requests_joins_groups(spark):
    """Address of one request and print of another: a third, which shares neither cookie nor pair with them, finds the visitor."""
    at = lambda k: datetime(2024, 1, 1, k)
    rows = [(1, at(1), "v", "home", None), (2, at(2), "v", "cafe", "f" * 32), (3, at(3), None, "home", "f" * 32), (4, at(4), "w", "home", "f" * 32), (5, at(5), "w", "cafe", None)]
    wanted = plain(rows, 20)
    assert wanted[4][0] == 1
    assert got(arrivals.resolved(spark.createDataFrame(rows, SCHEMA))) == wanted


def test_crowds_share_an_address_or_a_print_without_one_group(spark):
    rows = [(k, datetime(2024, 1, 1), f"v{k}", "office" if k % 2 else f"ip{k}", f"p{k}" if k % 2 else "stock") for k in range(200)]
    found = arrivals.by_signals(spark.createDataFrame(rows, SCHEMA))
    assert found.select("group").distinct().count() == 200
    assert got(arrivals.resolved(spark.createDataFrame(rows, SCHEMA))) == plain(rows, arrivals.LIMIT)


def test_no_requests(spark):
    assert arrivals.resolved(spark.createDataFrame([], SCHEMA)).collect() == []


def test_all_events_like_a_plain_loop(spark):
    rows = [tuple(r) for r in requests_of(spark, SF).select("request", "ts", "vid", "ip", "print").collect()]
    assert got(registry.QUERIES["m16_visitors"](spark, SF)) == plain(rows, arrivals.LIMIT)


def test_groups_of_long_chains_and_hot_keys(spark):
    n = 60
    chain = [(k, k + 1) for k in range(n)] + [(1000 + k, 1000) for k in range(1, 400)] + [(5000, 5000)]
    nodes = spark.createDataFrame([(k,) for k in {x for e in chain for x in e}], "node long")
    got = {r["node"]: r["group"] for r in groups.connected(nodes, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(n + 1)} | {k: 1000 for k in range(1000, 1400)} | {5000: 5000}
