"""Queries over stores: facet bits before and after changes, and the merges that keep tables current."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import facets, store
from tidemark.operators.buckets import BucketStore
from tidemark.operators.facet_index import IndexedStore
from tidemark.plans.queries import AS_OF, ASKED, COUNTS, CUT, DOMAINS, FINGER, LIVE, OVERLAP, POSTINGS, postings, query, table

col = F.col


def folder(spark: SparkSession, name: str) -> str:
    return f"{store.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def indexed(spark: SparkSession, rows: DataFrame) -> IndexedStore:
    """The postings as a store with facet bits."""
    return IndexedStore(spark, folder(spark, "facets"), rows.schema, ["JobID"], list(DOMAINS), facets.live(), buckets=8).start(rows)


def changed(rows: DataFrame) -> DataFrame:
    """A batch: some postings get another category, some of these are rejected, and some are new."""
    key = col("JobID")
    old = rows.where(key % 10 == 3).withColumns({"Category": F.lit("MACHINERY"), "Status": F.when(key % 20 == 3, "rejected").otherwise(col("Status"))})
    return old.unionByName(rows.where(key % 50 == 1).withColumn("JobID", key + 1_000_000_000_000))


CHANGED = f"""{POSTINGS}, old AS (SELECT * FROM postings), hit AS (SELECT * FROM postings WHERE {{hit}}), now AS (SELECT * FROM postings WHERE JobID % 10 <> 3
 UNION ALL SELECT * REPLACE ('MACHINERY' AS Category, CASE WHEN JobID % 20 = 3 THEN 'rejected' ELSE Status END AS Status) FROM postings WHERE JobID % 10 = 3
 UNION ALL SELECT * REPLACE (JobID + 1000000000000 AS JobID) FROM postings WHERE JobID % 50 = 1), """
IN_WINDOW = "(coalesce(PostedDate >= TIMESTAMP '1997-12-02', false) OR scrapedAt >= TIMESTAMP '1997-12-02')"
ASKED_SQL = f"{LIVE} AND Experience IN ('1-URGENT', '2-HIGH') AND {OVERLAP} AND {IN_WINDOW}"
TOTAL = "SELECT 'total' AS facet, '' AS value, count(*) AS n FROM hit"


@query("t09_facet_index", f"""{CHANGED.format(hit=ASKED_SQL)} new AS (SELECT * FROM now WHERE {ASKED_SQL})
 SELECT 'before' AS phase, * FROM ({TOTAL} UNION ALL {COUNTS}) UNION ALL SELECT 'after', * FROM ({TOTAL.replace('hit', 'new')} UNION ALL {COUNTS.replace('FROM hit', 'FROM new')})""")  # fmt: skip
def facet_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet counts from the bits, before and after a batch of changes."""
    rows = postings(spark, sf_dir)
    index = indexed(spark, rows)
    asked = ASKED.checked(DOMAINS)
    others = (facets.seen_since(asked.window, AS_OF), facets.salary_overlaps(asked.salary_min, asked.salary_max))

    def counts() -> DataFrame:
        return index.counts(index.matching(asked.facets, *others), DOMAINS)

    before = counts()
    index.merge(changed(rows), ["scrapedAt"], inserted={})
    return before.withColumn("phase", F.lit("before")).unionByName(counts().withColumn("phase", F.lit("after")))


SETS = f"{LIVE} AND Experience IN ('1-URGENT', '5-LOW') AND Workplace IN ('remote', 'onsite') AND Category IN ('BUILDING', 'MACHINERY', 'FURNITURE')"


@query("u01_intersected", f"{CHANGED.format(hit=SETS)} r AS (SELECT * FROM now WHERE {SETS}) SELECT JobID, Category, Workplace, Experience FROM r")
def intersected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings by united and intersected facet values, from the bits after a batch of changes."""
    rows = postings(spark, sf_dir)
    index = indexed(spark, rows)
    index.merge(changed(rows), ["scrapedAt"], inserted={})
    hits = index.matching({"Experience": ["1-URGENT", "5-LOW"], "Workplace": ["remote", "onsite"], "Category": ["BUILDING", "MACHINERY", "FURNITURE"]})
    return index.rows(hits).select("JobID", "Category", "Workplace", "Experience")


@query("a23_indexed_values", f"""{POSTINGS} SELECT facet, count(DISTINCT value) AS "values" FROM (SELECT unnest([{{'facet': 'Workplace', 'value': Workplace}}, {{'facet': 'Category', 'value': Category}},
 {{'facet': 'Experience', 'value': Experience}}], recursive := true) FROM postings WHERE {LIVE} AND Experience IN ('1-URGENT', '2-HIGH')) WHERE value IS NOT NULL GROUP BY 1""")  # fmt: skip
def indexed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = indexed(spark, postings(spark, sf_dir))
    return index.distinct(index.matching({"Experience": ["1-URGENT", "2-HIGH"]}), list(DOMAINS))


@query("s18_bucket_upsert", f"""SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.value, o.value) AS value,
 CASE WHEN o.user_id IS NULL THEN '2024-01-31' ELSE '2024-01-15' END AS created, CASE WHEN n.user_id IS NULL THEN '2024-01-15' ELSE '2024-01-31' END AS updated
 FROM (SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE ts < {CUT} AND event_type <> 'error' GROUP BY 1) o
 FULL JOIN (SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE ts >= {CUT} AND event_type = 'click' GROUP BY 1) n ON o.user_id = n.user_id""")  # fmt: skip
def bucket_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, cut = table(spark, sf_dir, "events").withColumn("ts", col("ts").cast("timestamp")), F.lit(datetime(2024, 1, 15))
    own = ["user_id", "event_id", "value"]
    schema = "user_id long, event_id long, value double, createdAt timestamp, updatedAt timestamp"
    users = BucketStore(spark, folder(spark, "users"), spark.createDataFrame([], schema).schema, ["user_id"]).start()
    users.upsert(events.where((col("ts") < cut) & (col("event_type") != "error")).select(*own), datetime(2024, 1, 15), "event_id")
    users.upsert(events.where((col("ts") >= cut) & (col("event_type") == "click")).select(*own), datetime(2024, 1, 31), "event_id")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return users.current().select("user_id", "value", day("createdAt").alias("created"), day("updatedAt").alias("updated"))


@query("s19_verdicts", f"""WITH v AS (SELECT {FINGER} AS fingerprint, doc_id, doc_id % 3 = 0 AS late, coalesce(toxic = 1, false) AS germanRequired,
 coalesce(quality, 0) AS confidence, CASE WHEN source LIKE '%1%' THEN source ELSE 'Unclear' END AS domain FROM documents LEFT JOIN labels USING (doc_id))
 SELECT fingerprint, CASE WHEN bool_or(NOT late) THEN 'first' ELSE 'second' END AS created, arg_max(germanRequired, (late, doc_id)) AS germanRequired,
 arg_max(confidence, (late, doc_id))::DOUBLE AS confidence, arg_max(domain, (late, doc_id)) AS domain FROM v GROUP BY 1""")  # fmt: skip
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict store after two runs: a later verdict replaces, when it was made first stays."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    found = docs.select(
        text.fingerprint(col("lang"), col("source"), col("text")).alias("fingerprint"), "doc_id", (col("toxic") == 1).alias("germanRequired"),
        col("quality").alias("confidence"), F.when(col("source").contains("1"), col("source")).otherwise("").alias("domain"), F.lit("").alias("subDomain"),
    )
    kept = store.verdict_store(spark, folder(spark, "verdicts"))
    runs = (found.where("doc_id % 3 <> 0"), found.where("doc_id % 3 = 0"))
    for day, run in zip((1, 2), runs, strict=True):
        store.save_verdicts(kept, run, datetime(2024, 1, day), "doc_id")
    made = F.when(F.dayofmonth("createdAt") == 1, "first").otherwise("second")
    return kept.current().select("fingerprint", made.alias("created"), "germanRequired", "confidence", "domain")


SUBSCRIBED = """WITH old AS (SELECT lower(c_name) AS email, c_mktsegment AS location, [c_mktsegment] AS wanted, c_custkey % 2 = 0 AS subscribed, 'old' AS made FROM customer WHERE c_custkey % 4 <> 3),
 asked AS (SELECT lower(c_name) AS email, CASE WHEN c_custkey % 3 = 0 THEN 'moved' END AS location, CASE WHEN c_custkey % 5 = 0 THEN ['a', 'b'] END AS wanted FROM customer WHERE c_custkey % 7 < 3),
 joined AS (SELECT coalesce(o.email, a.email) AS email, CASE WHEN a.email IS NULL THEN o.location ELSE coalesce(a.location, o.location) END AS location,
  coalesce(a.wanted, o.wanted, []) AS wanted, a.email IS NOT NULL OR o.subscribed AS subscribed, coalesce(made, 'new') AS made FROM old o FULL JOIN asked a ON o.email = a.email)
"""
LEFT = "email IN (SELECT lower(c_name) FROM customer WHERE c_custkey % 11 = 0)"


def members(spark: SparkSession, sf_dir: str) -> BucketStore:
    """Accounts by email, after some sign-ups and some who left."""
    c, key = table(spark, sf_dir, "customer"), col("c_custkey")
    old = c.where(key % 4 != 3).select(
        F.lower("c_name").alias("email"), col("c_mktsegment").alias("location"), F.array("c_mktsegment").alias("desiredCategories"), (key % 2 == 0).alias("isSubscribed"),
        F.lit(datetime(2024, 1, 1)).alias("createdAt"), F.lit(datetime(2024, 1, 1)).alias("updatedAt"), F.lit(None).cast("timestamp").alias("lastEmailSent"),
    )
    users = BucketStore(spark, folder(spark, "members"), old.schema, ["email"]).start(old)
    asked = c.where(key % 7 < 3).select(
        F.concat(F.lit(" "), F.upper("c_name")).alias("email"), F.when(key % 3 == 0, "moved").when(key % 3 == 1, "").alias("location"),
        F.when(key % 5 == 0, F.array(F.lit("a"), F.lit("b"))).alias("desiredCategories"), "c_custkey",
    )
    store.subscribe(users, asked, datetime(2024, 1, 2), "c_custkey")
    store.unsubscribe(users, c.where(key % 11 == 0).select(F.concat("c_name", F.lit(" ")).alias("email")), datetime(2024, 1, 3))
    return users


@query("m18_subscriptions", f"""{SUBSCRIBED} SELECT email, location, array_to_string(wanted, ',') AS wanted, subscribed AND NOT {LEFT} AS subscribed, made FROM joined""")
def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.dayofmonth("createdAt") == 1, "old").otherwise("new")
    return members(spark, sf_dir).current().select(
        "email", "location", F.array_join("desiredCategories", ",").alias("wanted"), col("isSubscribed").alias("subscribed"), made.alias("made")
    )


@query("m23_mails_stamped", f"""{SUBSCRIBED} SELECT email, CASE WHEN email IN (SELECT lower(c_name) FROM customer WHERE c_custkey % 13 = 0) THEN '2024-01-09' END AS sent,
 CASE WHEN email IN (SELECT lower(c_name) FROM customer WHERE c_custkey % 13 = 0) THEN 9 WHEN {LEFT} THEN 3 WHEN email IN (SELECT email FROM asked) THEN 2 ELSE 1 END AS "day" FROM joined""")  # fmt: skip
def mails_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = members(spark, sf_dir)
    store.mailed(users, table(spark, sf_dir, "customer").where("c_custkey % 13 = 0").select(F.lower("c_name").alias("email")), datetime(2024, 1, 9))
    return users.current().select("email", F.date_format("lastEmailSent", "yyyy-MM-dd").alias("sent"), F.dayofmonth("updatedAt").alias("day"))


URL = "'https://jobs.example/' || {}"


@query("m21_curated", f"""WITH old AS (SELECT {URL.format('o_custkey')} AS url, min(o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
 new AS (SELECT {URL.format('o_custkey')} AS url, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 5 <> 0 GROUP BY 1)
 SELECT url, k, 'old' AS site FROM old UNION ALL SELECT url, k, 'Curated' FROM new WHERE url NOT IN (SELECT url FROM old)""")  # fmt: skip
def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated postings come in where nobody has their address, and only with title, address and company."""
    orders, key = table(spark, sf_dir, "orders"), col("o_orderkey")
    own = orders.select(
        F.concat(F.lit("https://jobs.example/"), "o_custkey").alias("ApplicationURL"), key.alias("JobID"), F.lit("t").alias("JobTitle"),
        F.when(key % 5 != 0, "c").alias("Company"), F.lit("old").alias("sourceSite"), "o_orderstatus",
    )
    old = store.first_missing(own.limit(0).select("ApplicationURL"), own.where("o_orderstatus <> 'P'").drop("o_orderstatus"), ["ApplicationURL"], "JobID")
    rows = BucketStore(spark, folder(spark, "postings"), old.schema, ["ApplicationURL"]).start(old)
    store.add_curated(rows, own.where("o_orderstatus = 'P'").drop("o_orderstatus"), "JobID")
    return rows.current().select(col("ApplicationURL").alias("url"), col("JobID").alias("k"), col("sourceSite").alias("site"))


@query("f29_company_deleted", """SELECT c_custkey, c_name FROM customer WHERE lower(c_name) NOT IN ('customer#000000007', 'customer#000000099') AND NOT (c_custkey % 2 = 0 AND c_custkey % 100 = 42)""")
def company_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All postings of a company go, whatever the case of its name; nothing in the name is a pattern."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(col("c_custkey") % 100 == 42, "A.B (x)+").otherwise(col("c_name")).alias("Company"), "c_name")
    kept = BucketStore(spark, folder(spark, "companies"), rows.schema, ["c_custkey"]).start(rows)
    for name in ("CUSTOMER#000000007", "customer#000000099", "a.b (X)+", "."):
        kept.delete(store.of_company(name))
    return kept.current().select("c_custkey", "c_name")
