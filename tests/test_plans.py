"""Every query of the posting engine against DuckDB, and the small fixtures."""

from __future__ import annotations

import glob
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import names, shuffle
from tidemark.operators import facets, ranking, store, visitors
from tidemark.plans import queries
from tidemark.plans import registry as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: None if v is None else round(v, 6) if isinstance(v, float) else str(v)
    return sorted(columns), sorted([str(clean(r[k])) for k in order] for r in data)


@pytest.mark.parametrize("key", sorted(plans.ORACLE_SQL))
def test_like_duckdb(spark, duck, key):
    ours = plans.QUERIES[key](spark, SF)
    theirs = duck.sql(plans.ORACLE_SQL[key])
    assert rows(ours.columns, ours.collect()) == rows(theirs.columns, theirs.fetchall())


def test_known_shuffle():
    assert shuffle.fnv1a("2026-01-01") == 2049302883
    draw = shuffle.mulberry32(shuffle.fnv1a("2026-01-01"))
    assert [next(draw) for _ in range(3)] == pytest.approx([0.638679139316082, 0.6510864510200918, 0.2738958189729601])
    assert shuffle.permutation(10, "2026-01-01") == [0, 4, 8, 3, 7, 1, 9, 2, 5, 6]


def test_retention(spark):
    now = datetime(2026, 1, 1, 12)
    table = [
        ("1", "Test Site", "active", 7, 8), ("2", "Test Site", "active", 25, 30), ("3", "Test Site", "active", 90, 100), ("4", "Curated", "active", None, 60),
        ("5", "Test Site", "rejected", None, 8), ("6", "Test Site", "rejected", None, 3), ("7", "Test Site", "rejected", 14, 15), ("8", "Test Site", "rejected", 9, 10),
        ("9", "Test Site", "pending_review", None, 15), ("10", "Test Site", "pending_review", None, 5), ("11", "Test Site", "active", None, 15), ("12", "Test Site", "active", None, 5),
    ]
    ago = lambda d: None if d is None else now - timedelta(days=d)
    df = spark.createDataFrame([(i, s, t, ago(a), ago(b)) for i, s, t, a, b in table], "JobID string, sourceSite string, Status string, reviewedAt timestamp, updatedAt timestamp")
    gone = {r[0] for r in df.where(store.expired(now, "Test Site")).select("JobID").collect()}
    assert gone == {"5", "7", "9", "11"}


def test_counts_add_up(spark):
    all_rows = queries.postings(spark, SF).where(facets.live())
    counts = {(r["facet"], r["value"]): r["n"] for r in facets.facet_counts(all_rows, queries.DOMAINS).collect()}
    assert sum(n for (f, _), n in counts.items() if f == "Category") == counts["total", ""] == all_rows.count()


def test_literal_search_and_salary(spark):
    df = spark.createDataFrame([("C++ dev", 1.0, None), ("Cxx dev", None, None)], "JobTitle string, SalaryMin double, SalaryMax double").withColumns({"Company": F.lit(None), "Location": F.lit("")})
    assert df.where(facets.contains_text("c++")).count() == 1
    assert df.where(facets.salary_overlaps(0.5, 2)).count() == 1
    assert df.where(facets.salary_overlaps(2, 3)).count() == 0


def test_company_names(spark):
    known = {
        "Databricks GmbH": "databricks", "Databricks, Inc.": "databricks", "Databricks B.V.": "databricks", "Databricks U.K. Limited": "databricks u.k",
        "Databricks SARL": "databricks", "Trade Republic": "trade republic", "N26 GmbH": "n26", "Delivery Hero SE": "delivery hero", "Airbnb": "airbnb",
        "Celonis SE": "celonis", "HelloFresh AG": "hellofresh", "Stripe, Inc.": "stripe", "Personio GmbH & Co. KG": "personio", "MongoDB, Inc.": "mongodb",
        "Elastic N.V.": "elastic", "Visa": "vi", "Enterprise": "enterpri", "Texas": "tex", "": "",
    }
    df = spark.createDataFrame([(n,) for n in [*known, None]], "n string").select("n", names.company_key(F.col("n")).alias("k"))
    assert {r["n"]: r["k"] for r in df.collect()} == known | {None: ""}


def test_entity_keys_and_fingerprints(spark):
    from tidemark.functions import text

    rows = [("Staff Software Engineer", c, "Berlin, Germany") for c in ("Databricks GmbH", "Databricks, Inc.", "Databricks B.V.")]
    rows += [("Product Manager", "Databricks GmbH", "Berlin, Germany"), ("Staff Software Engineer", "Databricks GmbH", "Munich, Germany"), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, c string, p string").select(names.entity_key(F.col("t"), F.col("c"), F.col("p")))
    keys = [r[0] for r in df.collect()]
    assert len(set(keys[:3])) == 1 and len(set(keys)) == 4 and keys[-1] == "||"
    prints = spark.createDataFrame([("a", " \n" + "x" * 499 + " y"), ("A ", "x" * 499 + " z"), ("a", "w")], "t string, d string")
    got = [r[0] for r in prints.select(text.fingerprint(F.col("t"), F.lit("c"), F.col("d"))).collect()]
    assert got[0] == got[1] != got[2]


def test_change_table_restarts_and_skips_what_is_committed(spark, tmp_path):
    from tidemark.streaming.changes import CurrentTable, kind, matters

    schema = spark.createDataFrame([], "k long, n long, gone boolean").schema
    table = lambda: CurrentTable(spark, str(tmp_path / "t"), schema, ["k"], F.col("gone"), "n")
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    one = table()
    one.start(batch())
    one.apply(batch((1, 1, False), (2, 1, False), (2, 2, True)), 0)
    two = table()  # a new object on the same folder
    two.start(batch())
    two.apply(batch((9, 9, False)), 0)  # committed before: skipped
    two.apply(batch((3, 3, False), (1, 4, True)), 1)
    assert sorted((r["k"], r["n"]) for r in table().current().collect()) == [(3, 3)]
    ops = spark.createDataFrame([("insert", None), ("update", ["scrapedAt"]), ("update", ["Status.x"]), ("delete", None), ("drop", None), ("noop", None)], "o string, f array<string>")
    assert [tuple(r) for r in ops.select(kind(F.col("o")), matters(F.col("o"), F.col("f"))).collect()] == [
        ("upsert", True), ("upsert", False), ("upsert", True), ("delete", True), ("reconcile", True), (None, True)]


def test_skill_tie_is_the_published_hash(spark):
    from tidemark.operators import skills

    def tie(key, seed):
        h = 0
        for c in key:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        x = ((h ^ seed) * 2654435761) & 0xFFFFFFFF
        x ^= x >> 15
        return x - (1 << 32) if x >> 31 else x

    keys = ["1", "77", "a-long-identifier-of-a-posting-0123456789", "zzzzzzzzzz"]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select(skills.daily_tie(F.col("k"), 20260101))
    assert [r[0] for r in df.collect()] == [tie(k, 20260101) for k in keys]


def test_unchanged_boards_are_skipped(spark):
    now = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "board string, k string")
    empty = spark.createDataFrame([], "board string, hash string, n long")
    state = store.changed_boards(now, empty, "board", "k")
    assert state.count() == 2
    more = now.unionByName(spark.createDataFrame([("b", "9")], "board string, k string"))
    assert [r["board"] for r in store.changed_boards(more, state, "board", "k").collect()] == ["b"]


def test_least_or_all(spark):
    df = spark.range(10)
    assert ranking.at_least_or_all(df, F.col("id") < 3, 3).count() == 3
    assert ranking.at_least_or_all(df, F.col("id") < 3, 4).count() == 10


def test_daily_order_is_a_permutation_of_places(spark):
    for n in (1, 2, 3, 5, 10, 97, 100, 1000, 20_011):
        a, b, _, steps = shuffle.feistel(n, "2026-01-01")
        assert n <= a * b < n + a and steps >= 1
        got = [r[0] for r in spark.range(n).select(shuffle.permuted(F.col("id"), n, "2026-01-01")).collect()]
        assert sorted(got) == list(range(n))
        if n > 90:
            assert sum(abs(k - p) < n / 20 for k, p in enumerate(got)) < n / 5  # far from the order of places
            other = [r[0] for r in spark.range(n).select(shuffle.permuted(F.col("id"), n, "2026-01-02")).collect()]
            assert sum(x == y for x, y in zip(got, other, strict=True)) < n / 10
    assert ranking.listed_order(list("abcdefghij"), "2026-01-01") == list("aeidhbjcfg")


def test_places_are_numbered_over_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(k * 7919 % 1000, "x") for k in range(1000)], "k long, s string").repartition(7)
    got = ranking.placed(rows, str(tmp_path / "p"), "k")
    assert sorted((r["place"], r["k"]) for r in got.collect()) == [(k, k) for k in range(1000)]
    assert ranking.daily_order(rows.limit(0), "k", "2026-01-01", str(tmp_path / "q")).count() == 0


def test_hashes_of_names(spark):
    df = spark.createDataFrame([("2026-01-01",), ("",), ("é日",)], "t string").select(shuffle.fnv1a_of(F.col("t")))
    assert [r[0] for r in df.collect()] == [shuffle.fnv1a(t) for t in ("2026-01-01", "", "é日")]


def test_slugs_take_the_first_free_name(spark):
    import random

    r = random.Random(2)
    slugs = ["a", "a", "a-2", *(r.choice(["a", "a-2", "a-2-2", "b", "c-3", "c", "only", "only", None, "d-x", "d-x-2"]) for _ in range(400))]

    def plain():
        taken, out = set(), []
        for s in slugs:
            name, k = s, 2
            while s is not None and name in taken:
                name, k = f"{s}-{k}", k + 1
            taken.add(name)
            out.append(name)
        return out

    rows = spark.createDataFrame([(k, s) for k, s in enumerate(slugs)], "k long, s string").repartition(5)
    got = {x["k"]: x["unique_slug"] for x in visitors.unique_slugs(rows, "s", "k").collect()}
    assert [got[k] for k in range(len(slugs))] == plain()
    assert [got[k] for k in range(3)] == ["a", "a-2", "a-2-2"]
    named = [v for v in got.values() if v is not None]
    assert len(set(named)) == len(named)


def test_entities_are_those_of_html(spark):
    import html

    from tidemark.functions import prose

    known = [f"a&{name};b" for name in prose.ENTITIES] + [f"x &{name} y" for name in prose.SHORT]
    known += ["&#252;", "&#xFC;&#x2013;", "&#8364", "&#128;", "&#0;", "&#xD800;", "&#x110000;", "&#99999999999;", "&amp;lt;", "&&amp;&", "no entity", "", "&#x1F600;!", "&#0000065;", "a &b; &c"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in [*known, None]], "t string").select(prose.decoded(F.col("t"))).collect()]
    assert got[:-1] == [html.unescape(t) for t in known] and got[-1] is None


def test_place_names_are_found_by_one_pattern(spark, tmp_path):
    import re

    from tidemark.operators import location

    names = ["bad homburg", "ulm", "ulmen", "haar", "grenzach-wyhlen", "a.b"]
    texts = ["in bad homburg", "ulmen", "xhaar", "bad hom", "grenzach-wyhlen", "axb", "a.b", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").rlike(location.tree_of(names)))
    assert [r[0] for r in df.collect()] == [any(n in t for n in names) for t in texts]
    assert all(re.search(location.tree_of(location.GERMAN_CITIES), n) for n in location.GERMAN_CITIES)
    (tmp_path / "names.txt").write_text("Erlangen\nfürth \n\n")
    assert location.names_of(spark, str(tmp_path / "names.txt")) == ["erlangen", "fürth"]
