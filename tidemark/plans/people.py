"""Queries on review, visitors, members and skills, each with the same query for DuckDB."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import facets, members, reports, review, skills, store, visitors
from tidemark.plans.fixture import JOBS, jobs
from tidemark.plans.queries import query, table

AS_OF = datetime(2000, 1, 1)
NOW = "TIMESTAMP '2000-01-01'"
col = F.col
AUTO = "Status = 'active' AND coalesce(approvalMethod = 'ai_auto', false)"


def counted_by(rows: DataFrame, *values: F.Column) -> DataFrame:
    return rows.groupBy(*values).agg(F.count("*").alias("n"))


@query("f26_review_queue", JOBS + f"SELECT JobID FROM jobs WHERE Status = 'pending_review' OR ({AUTO} AND reviewedAt IS NULL)")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).where(review.in_queue()).select("JobID")


@query("f32_may_be_judged_again", JOBS + "SELECT JobID FROM jobs WHERE coalesce(sourceSite <> 'Curated', true) AND NOT (reviewedAt IS NOT NULL AND Status IN ('active', 'rejected'))")
def judge_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).where(review.may_be_judged_again()).select("JobID")


@query("f40_visible", JOBS + "SELECT JobID FROM jobs WHERE Status = 'active' AND NOT coalesce(GermanRequired, false)")
def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).where(review.visible()).select("JobID")


@query("f27_expired", JOBS + """SELECT JobID FROM jobs WHERE sourceSite = 'Test Site' AND ((Status = 'rejected' AND reviewedAt IS NULL AND updatedAt < TIMESTAMP '1999-12-25')
 OR (Status = 'rejected' AND reviewedAt <= TIMESTAMP '1999-12-18') OR (Status = 'pending_review' AND updatedAt < TIMESTAMP '1999-12-18') OR (Status = 'active' AND reviewedAt IS NULL AND updatedAt < TIMESTAMP '1999-12-18'))""")  # fmt: skip
def expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).where(store.expired(AS_OF, "Test Site")).select("JobID")


@query("f30_compatible", JOBS + """SELECT JobID FROM jobs WHERE CASE JobID % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE NOT coalesce(GermanRequired, false) END AND NOT coalesce(visa_sponsorship = 'not_available', false)""")
def compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("JobID") % 4
    detail = F.when(k == 0, "C1 nice to have").when(k == 1, "C1 Erforderlich").when(k == 2, "good")
    fits = review.compatible(detail, col("GermanRequired"), "basic") & ~F.coalesce(col("visa_sponsorship") == "not_available", F.lit(False))
    return jobs(spark, sf_dir).where(fits).select("JobID")


@query("o06_newest_if_many", JOBS + "SELECT JobID FROM jobs ORDER BY coalesce(PostedDate, TIMESTAMP '1970-01-01') DESC, JobID LIMIT 200")
def newest_if_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.newest_if_many(jobs(spark, sf_dir).select("JobID", "PostedDate"), 200, *facets.newest_first()).select("JobID")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(col("o_orderkey") % 9 == 0, "accept").when(col("o_orderkey") % 9 == 3, "reject").otherwise("later")
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    return rows.select(col("o_orderkey").alias("JobID"), d.alias("decision"), F.when(col("o_orderkey") % 2 == 0, "no").alias("reason"))


@query("m01_decided", JOBS + f"""SELECT CASE WHEN JobID % 3 > 0 THEN Status WHEN JobID % 9 = 0 THEN 'active' WHEN JobID % 9 = 3 THEN 'rejected' ELSE 'pending_review' END AS status, CASE WHEN JobID % 9 = 0 AND NOT ({AUTO}) THEN 'manual' ELSE approvalMethod END AS method,
 CASE WHEN JobID % 9 = 3 AND JobID % 2 = 0 THEN 'no' END AS reason, JobID % 3 = 0 OR reviewedAt IS NOT NULL AS seen, JobID % 9 = 3 AS gone, count(*) AS n FROM jobs GROUP BY ALL""")  # fmt: skip
def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    rows = jobs(spark, sf_dir).withColumns({"rejectedAt": none.cast("timestamp"), "RejectionReason": none.cast("string")})
    made = review.decided(rows, decisions(spark, sf_dir), AS_OF)
    return counted_by(made, col("Status").alias("status"), col("approvalMethod").alias("method"), col("RejectionReason").alias("reason"), col("reviewedAt").isNotNull().alias("seen"), col("rejectedAt").isNotNull().alias("gone"))


@query("m02_judged_again", JOBS + """SELECT CASE WHEN use THEN CASE WHEN JobID % 4 = 0 OR c < 0.6 THEN 'rejected' WHEN c >= 0.85 THEN 'active' ELSE 'pending_review' END ELSE Status END AS status, CASE WHEN use THEN JobID % 4 = 0 ELSE GermanRequired END AS german, count(*) AS n
 FROM (SELECT *, (JobID % 100) / 100 AS c, JobID % 2 = 0 AND coalesce(sourceSite <> 'Curated', true) AND NOT (reviewedAt IS NOT NULL AND Status IN ('active', 'rejected')) AS use FROM jobs) GROUP BY ALL""")  # fmt: skip
def judged_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir)
    verdicts = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(col("o_orderkey").alias("JobID"), (col("o_orderkey") % 4 == 0).alias("german"), ((col("o_orderkey") % 100) / 100).alias("confidence"))
    return counted_by(review.judged_again(rows, verdicts), col("Status").alias("status"), col("GermanRequired").alias("german"))


@query("m03_restored", JOBS + "SELECT CASE WHEN Status = 'rejected' AND JobID % 2 = 0 THEN 'pending_review' ELSE Status END AS status, reviewedAt IS NOT NULL AND NOT (Status = 'rejected' AND JobID % 2 = 0) AS seen, count(*) AS n FROM jobs GROUP BY ALL")
def restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = (col("Status") == "rejected") & (col("JobID") % 2 == 0)
    rows = jobs(spark, sf_dir).withColumn("RejectionReason", F.lit("x"))
    return counted_by(rows.withColumns(review.restored(chosen)), col("Status").alias("status"), col("reviewedAt").isNotNull().alias("seen"))


@query("a24_looked_at", JOBS + "SELECT count(*) AS n FROM jobs WHERE reviewedAt IS NOT NULL AND Status IN ('active', 'rejected')")
def looked_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).where(review.looked_at()).agg(F.count("*").alias("n"))


CLICKS = """clicks AS (SELECT CAST(props->>'k' AS INT) AS job, user_id, min(ts) AS t FROM events WHERE event_type = 'click' GROUP BY ALL),
 conf AS (SELECT CAST(props->>'k' AS INT) AS job, user_id, max(ts) AS c, min(ts) AS f FROM events WHERE event_type = 'purchase' GROUP BY ALL),
 m AS (SELECT coalesce(a.job, b.job) AS job, coalesce(a.user_id, b.user_id) AS user_id, coalesce(t, f) AS clickedAt, c AS confirmedAt FROM clicks a FULL JOIN conf b ON a.job = b.job AND a.user_id = b.user_id)"""


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("job", F.get_json_object("props", "$.k").cast("int"))
    of = lambda kind: events.where(col("event_type") == kind)
    return visitors.confirmed(of("click"), of("purchase"), ["job", "user_id"])


@query("m05_confirmed", f'WITH {CLICKS} SELECT job, user_id, clickedAt AS "clickedAt", confirmedAt AS "confirmedAt", confirmedAt IS NOT NULL AS "confirmedApplied" FROM m')
def confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks(spark, sf_dir)


@query("j03_applied", JOBS + f', {CLICKS} SELECT user_id, JobID, confirmedAt AS "appliedAt", Status = \'active\' AS "isActive" FROM m JOIN jobs ON job = JobID WHERE confirmedAt IS NOT NULL')
def applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir).select(col("JobID"), col("JobID").cast("int").alias("job"), "Status")
    return visitors.applied(clicks(spark, sf_dir), rows, "job").select("user_id", "JobID", "appliedAt", "isActive")


@query("u05_views", "SELECT user_id, array_to_string(list(k ORDER BY t, k), ',') AS seen, count(*) AS n FROM (SELECT user_id, CAST(props->>'k' AS INT) AS k, min(ts) AS t FROM events WHERE event_type = 'view' GROUP BY ALL) GROUP BY 1")
def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'view'").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return visitors.views(rows, "user_id", "k", "ts").select("user_id", F.array_join("seen", ",").alias("seen"), "n")


@query("f33_gate", """SELECT gate, count(*) AS n FROM (SELECT CASE WHEN v.user_id IS NULL THEN 'no visitor' WHEN e.user_id % 5 = 0 THEN 'open: linked' WHEN e.user_id % 7 = 0 THEN 'flagged' WHEN list_contains(seen, k) THEN 'open: seen' WHEN len(seen) >= 12 THEN 'limit' ELSE 'open' END AS gate
 FROM (SELECT user_id, props->>'k' AS k FROM events WHERE event_type = 'click') e LEFT JOIN (SELECT user_id, list(DISTINCT props->>'k') AS seen FROM events WHERE event_type = 'view' AND user_id % 3 > 0 GROUP BY 1) v ON e.user_id = v.user_id) GROUP BY 1""")  # fmt: skip
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    seen = visitors.views(events.where("event_type = 'view' and user_id % 3 > 0"), "user_id", "k", "ts").select(col("user_id").alias("who"), "seen")
    met = events.where("event_type = 'click'").join(seen, col("user_id") == col("who"), "left")
    user = F.when(col("user_id") % 5 == 0, col("user_id"))
    return counted_by(met, visitors.gate(col("who").isNotNull(), user, col("user_id") % 7 == 0, col("seen"), col("k"), 12).alias("gate"))


@query("x23_ip_hash", "SELECT user_id, substr(sha256(user_id || '|salt'), 1, 24) AS hash FROM (SELECT DISTINCT user_id FROM events)")
def ip_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", visitors.ip_hash(col("user_id").cast("string"), "salt").alias("hash"))


@query("t10_unexpired", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 1 HOUR")
def unexpired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visitors.unexpired(table(spark, sf_dir, "events"), "ts", datetime(2024, 1, 20)).select("event_id")


@query("j13_identified", """WITH v AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 500 END AS vid, c_custkey % 37 AS ip, CASE WHEN c_custkey % 4 > 0 AND c_custkey % 3 > 0 THEN c_custkey % 91 END AS print, c_nationkey AS t, c_custkey % 5 = 0 AS flagged, c_custkey % 7 = 0 AS linked FROM customer),
 r AS (SELECT event_id AS request, CASE WHEN event_id % 5 > 0 THEN event_id % 600 END AS vid, event_id % 41 AS ip, CASE WHEN event_id % 5 > 0 AND event_id % 2 = 0 THEN event_id % 91 END AS print FROM events),
 hits AS (SELECT request, id, t, 0 AS rule, 'two signals' AS how FROM r JOIN v ON r.vid = v.vid AND r.ip = v.ip UNION ALL SELECT request, id, t, 0, 'two signals' FROM r JOIN v ON r.vid = v.vid AND r.print = v.print UNION ALL SELECT request, id, t, 0, 'two signals' FROM r JOIN v ON r.ip = v.ip AND r.print = v.print
  UNION ALL SELECT request, id, t, 1, 'cookie' FROM r JOIN v ON r.vid = v.vid
  UNION ALL SELECT request, id, t, 2, 'claimed' FROM r JOIN v ON r.ip = v.ip WHERE v.vid IS NULL AND v.print IS NULL AND NOT flagged AND NOT linked AND (r.vid IS NOT NULL OR r.print IS NOT NULL) AND t >= 14
  UNION ALL SELECT request, id, t, 0, 'address' FROM r JOIN v ON r.ip = v.ip WHERE v.vid IS NULL AND v.print IS NULL AND r.vid IS NULL AND r.print IS NULL)
 SELECT request, id, how FROM hits QUALIFY row_number() OVER (PARTITION BY request ORDER BY rule, t DESC, id) = 1""")  # fmt: skip
def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = col("c_custkey"), col("event_id")
    minute = F.timestamp_seconds(F.lit(946_684_800) + (col("c_nationkey").cast("long") - 24) * 60)
    known = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 4 > 0, k % 500).alias("vid"), (k % 37).alias("ip"), F.when((k % 4 > 0) & (k % 3 > 0), k % 91).alias("print"),
        minute.alias("lastSeenAt"), (k % 5 == 0).alias("flagged"), F.when(k % 7 == 0, k).alias("linked"), minute.alias("createdAt"),
    )
    asked = table(spark, sf_dir, "events").select(e.alias("request"), F.when(e % 5 > 0, e % 600).alias("vid"), (e % 41).alias("ip"), F.when((e % 5 > 0) & (e % 2 == 0), e % 91).alias("print"))
    return visitors.identified(asked, known, datetime(2000, 1, 1)).select("request", "id", "how")


UNTIL = "TIMESTAMP '1999-12-01' + to_days(CAST(c_custkey % 60 AS INT))"


def until() -> F.Column:
    return F.lit(datetime(1999, 12, 1)) + F.make_dt_interval(days=(col("c_custkey") % 60).cast("int"))


@query("f34_limits", f"SELECT views, clicks, count(*) AS n FROM (SELECT CASE WHEN {UNTIL} > {NOW} THEN NULL WHEN c_custkey % 4 = 0 THEN 5 ELSE 20 END AS views, CASE WHEN {UNTIL} > {NOW} THEN NULL WHEN c_custkey % 4 = 0 THEN 5 ELSE 15 END AS clicks FROM customer) GROUP BY ALL")
def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = members.limits(F.when(col("c_custkey") % 4 > 0, col("c_custkey")), until(), AS_OF)
    return counted_by(table(spark, sf_dir, "customer").select(made.alias("m")), col("m.views").alias("views"), col("m.clicks").alias("clicks"))


@query("m07_activated", f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN {NOW} + INTERVAL 90 DAY ELSE {UNTIL} END AS until FROM customer")
def activated(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = members.activated(until(), col("c_custkey") % 2 == 0, F.lit(90), AS_OF)
    return table(spark, sf_dir, "customer").select("c_custkey", made.alias("until"))


@query("m19_redemption", f"""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN {UNTIL} > {NOW} THEN 'already_premium' WHEN c_custkey % 5 = 0 THEN 'expired' WHEN c_custkey % 3 = 0 THEN 'partial_discount' WHEN c_custkey % 2 = 0 THEN 'already_used' ELSE 'redeemed' END AS outcome FROM customer) GROUP BY 1""")
def redemption(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("c_custkey")
    made = members.redemption(until(), F.when(k % 5 == 0, "expired").otherwise("valid"), F.when(k % 3 == 0, 50).otherwise(100), k % 2 == 0, AS_OF)
    return counted_by(table(spark, sf_dir, "customer"), made.alias("outcome"))


@query("x44_code_state", f"SELECT state, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 3 > 0 THEN 'redeemed' WHEN {UNTIL} < {NOW} THEN 'expired' ELSE 'pending' END AS state FROM customer) GROUP BY 1")
def code_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted_by(table(spark, sf_dir, "customer"), members.code_state(col("c_custkey") % 3, until(), AS_OF).alias("state"))


@query("m17_subscription_edge", "SELECT edge, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 3 > 0 AND c_custkey % 2 = 0 THEN 'subscribed' WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 THEN 'unsubscribed' END AS edge FROM customer) GROUP BY 1")
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.when(col("c_custkey") % 3 == 0, True).when(col("c_custkey") % 3 == 1, False)
    return counted_by(table(spark, sf_dir, "customer"), members.subscription_edge(old, col("c_custkey") % 2 == 0).alias("edge"))


@query("m22_patched", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS s_name, s_acctbal FROM supplier")
def patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    patches = rows.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit("new").alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    return members.patched(rows, patches, "s_suppkey", ["s_name", "s_phone"])


@query("m08_merged", f"""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 'new' WHEN s_suppkey % 4 > 0 THEN s_name END AS name, CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal END AS bal, CASE WHEN s_suppkey % 4 > 0 THEN TIMESTAMP '1990-01-01' ELSE {NOW} END AS "createdAt",
 CASE WHEN s_suppkey % 3 = 0 THEN {NOW} ELSE TIMESTAMP '1990-01-01' END AS "updatedAt" FROM supplier WHERE s_suppkey % 4 > 0 OR s_suppkey % 3 = 0""")  # fmt: skip
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, then = table(spark, sf_dir, "supplier"), F.lit(datetime(1990, 1, 1))
    old = rows.where("s_suppkey % 4 > 0").select("s_suppkey", col("s_name").alias("name"), col("s_acctbal").alias("bal"), then.alias("createdAt"), then.alias("updatedAt"))
    new = rows.where("s_suppkey % 3 = 0").select("s_suppkey", F.when(col("s_suppkey") % 2 == 0, "new").alias("name"))
    return members.merged(old, new, "s_suppkey", AS_OF)


@query("m09_stamped_once", f"SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '1990-01-01' WHEN s_suppkey % 3 = 0 THEN {NOW} END AS \"publishedAt\" FROM supplier")
def stamped_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("s_suppkey")
    made = members.stamped_once(F.when(k % 2 == 0, F.lit(datetime(1990, 1, 1))), k % 3 == 0, AS_OF)
    return table(spark, sf_dir, "supplier").select("s_suppkey", made.alias("publishedAt"))


@query("m20_appended_new", "SELECT k, min(id) AS id FROM (SELECT s_suppkey % 40 AS k, s_suppkey + 100000 AS id FROM supplier WHERE s_suppkey % 40 NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 20)) GROUP BY 1 UNION ALL SELECT s_suppkey, s_suppkey FROM supplier WHERE s_suppkey < 20")
def appended_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = table(spark, sf_dir, "supplier"), col("s_suppkey")
    return members.appended_new(rows.where(k < 20).select(k.alias("k"), k.alias("id")), rows.select((k % 40).alias("k"), (k + 100000).alias("id")), "k", "id")


@query("s20_first_missing", "SELECT user_id, min(event_id) AS event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 9 = 0) GROUP BY 1")
def first_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    known = events.where("event_type = 'purchase' and event_id % 9 = 0").select("user_id").distinct()
    return store.first_missing(known, events.select("user_id", "event_id"), ["user_id"], "event_id")


@query("s16_by_id", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77 OR o_custkey = 77 ORDER BY CASE WHEN o_orderkey = 77 THEN 0 ELSE 1 END, o_orderkey LIMIT 1")
def by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.by_id(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "77", "o_orderkey", "o_custkey")


@query("m06_week_reset", """SELECT c_custkey, 0 AS views, 0 AS clicks, c_name AS name, DATE '2000-01-01' AS reset, 0 AS viewed, c_custkey % 9 = 0 AS flagged,
 CASE WHEN c_custkey % 4 = 3 THEN NULL WHEN c_custkey % 4 = 0 THEN 'cancelled' WHEN c_custkey % 5 < 2 THEN 'expired' ELSE 'active' END AS status FROM customer""")  # fmt: skip
def week_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly reset of users, visitors and subscriptions: counters go, the rest stays."""
    c, key = table(spark, sf_dir, "customer"), col("c_custkey")
    users = members.week_reset(c.select("c_custkey", col("c_name").alias("name"), (key % 7).alias("views"), (key % 3).alias("clicks")), AS_OF)
    seen = F.transform(F.sequence(F.lit(0), key % 3), lambda x: x.cast("string"))
    visitors = members.visitors_reset(c.select("c_custkey", (key % 9 == 0).alias("flagged"), F.size(seen).alias("viewCount"), seen.alias("seen")), AS_OF)
    days = F.when(key % 5 < 2, -1 - key % 30).when(key % 5 < 4, key % 30)
    ends = c.where("c_custkey % 4 <> 3").select("c_custkey", F.when(key % 4 == 0, "cancelled").otherwise("active").alias("status"), (F.lit(AS_OF) + F.make_dt_interval(days=days.cast("int"))).alias("expiresAt"))
    both = users.join(visitors, "c_custkey").join(members.subscriptions_expired(ends, AS_OF), "c_custkey", "left")
    return both.select("c_custkey", "views", "clicks", "name", F.to_date("weekResetAt").alias("reset"), (F.size("seen") + col("viewCount")).alias("viewed"), "flagged", "status")


@query("m14_dead_pages", "SELECT page_id FROM pages WHERE CASE page_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 410 WHEN 2 THEN 500 WHEN 3 THEN 200 END IN (404, 410)")
def dead_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("page_id") % 5
    status = F.when(k == 0, 404).when(k == 1, 410).when(k == 2, 500).when(k == 3, 200)
    return table(spark, sf_dir, "pages").where(members.after_probe(status)).select("page_id")


@query("m15_parse_state", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN event_type = 'click' THEN CASE WHEN ts < TIMESTAMP '2024-01-20' - INTERVAL 10 MINUTE THEN 'idle' ELSE 'processing' END WHEN event_type = 'view' THEN 'complete' ELSE 'idle' END AS state FROM events) GROUP BY 1")
def parse_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(col("event_type") == "click", "processing").when(col("event_type") == "view", "complete")
    return counted_by(table(spark, sf_dir, "events"), members.parse_state(state, col("ts"), datetime(2024, 1, 20)).alias("state"))


@query("j15_invited", f"SELECT c_custkey FROM customer WHERE {UNTIL} <= {NOW} AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0) AND c_custkey % 3 > 0")
def invited(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").withColumn("until", until())
    redeemed = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_orderkey % 2 = 0").select(col("o_custkey").alias("c_custkey"))
    return members.invited(users, redeemed, users.where("c_custkey % 3 = 0"), "c_custkey", "until", AS_OF).select("c_custkey")


@query("f38_feedback", r"SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '[ \t\n\r\x0b\x0c]+'), lambda w: w <> '')) BETWEEN 1 AND 200 AND doc_id % 3 < 2")
def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    email = F.when(col("doc_id") % 3 == 0, "a@b.de").when(col("doc_id") % 3 == 2, "not an email")
    return table(spark, sf_dir, "documents").where(members.valid_feedback(col("text"), email)).select("doc_id")


@query("j11_digest", JOBS + """SELECT c_custkey, JobID FROM customer JOIN (SELECT JobID, Category FROM jobs WHERE Status = 'active' QUALIFY row_number() OVER (PARTITION BY Category ORDER BY coalesce(PostedDate, TIMESTAMP '1970-01-01') DESC, JobID) <= 5) ON Category = c_mktsegment OR Category = 'BUILDING'""")
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select("c_custkey", F.array("c_mktsegment", F.lit("BUILDING")).alias("wanted"))
    rows = jobs(spark, sf_dir).where("Status = 'active'").select("JobID", "Category", "PostedDate")
    return reports.digest(users, rows, "c_custkey", "wanted", "Category", 5, *facets.newest_first()).select("c_custkey", "JobID")


@query("x26_canonical_skill", "SELECT DISTINCT p_name, CASE replace(p_name, ' ', '') WHEN 'x' THEN 'y' ELSE replace(p_name, ' ', '') END AS skill FROM part")
def canonical_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_name").distinct().withColumn("skill", skills.canonical_skill(col("p_name")))


PROFILE = ["red widget", "small-ring", "Bolt", "hot", "js", "gear"]
PARTS = "SELECT p_partkey AS k, p_brand AS company, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, replace(p_name, ' ', '') AS c FROM part"
HAS = "('redwidget', 'smallring', 'bolt', 'hot', 'javascript', 'gear')"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda j: F.split_part("p_name", F.lit(" "), F.lit(j))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.array(word(1), "p_name").alias("required"), F.array(word(2)).alias("preferred"), F.array(word(2), F.lit("JS"), F.lit("one two three four five")).alias("tools")
    )
    return skills.match_scores(rows, "p_partkey", PROFILE)


SCORES = f"""SELECT k AS p_partkey, ((CASE WHEN a IN {HAS} THEN 3 ELSE 0 END + CASE WHEN c IN {HAS} THEN 3 ELSE 0 END) / 6.0::DOUBLE) * 0.8 + ((CASE WHEN b IN {HAS} THEN 1 ELSE 0 END + 1) / 3.0::DOUBLE) * 0.2 AS score,
 CASE WHEN a IN {HAS} THEN 1 ELSE 0 END + CASE WHEN c IN {HAS} THEN 1 ELSE 0 END + CASE WHEN b IN {HAS} THEN 1 ELSE 0 END + 1 AS matched FROM ({PARTS})"""


@query("x27_match_scores", f"SELECT p_partkey, round(score, 9) AS score, matched FROM ({SCORES})")
def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("p_partkey", F.round("score", 9).alias("score"), "matched")


@query("x28_factors", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.6 ELSE 1.0 END::DOUBLE AS level, CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 ELSE 0.85 END::DOUBLE AS domain FROM part")
def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("p_partkey")
    level = F.when(k % 4 == 0, " Senior").when(k % 4 == 1, "lead").when(k % 4 == 2, "Entry").otherwise("odd")
    domain = F.when(k % 3 == 0, "Technical").when(k % 3 == 1, "non-technical").otherwise("legal")
    made = (skills.level_factor("Senior", level).alias("level"), skills.domain_factor("technical", domain).alias("domain"))
    return table(spark, sf_dir, "part").select("p_partkey", *made)


TIE = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_partkey::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)"
MIXED = "(xor((h % 4294967296 + 4294967296) % 4294967296, 20260101)::HUGEINT * 2654435761::HUGEINT % 4294967296::HUGEINT)::BIGINT"


@query("o07_ranked", f"""SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY band DESC, tie, score DESC, p_partkey) AS r FROM (SELECT *, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS tie
 FROM (SELECT *, xor(m, m >> 15) AS u FROM (SELECT *, {MIXED} AS m FROM (SELECT s.p_partkey, p_brand, score, floor(score * 10 + 0.5) AS band, {TIE.replace('p_partkey', 's.p_partkey')} AS h FROM ({SCORES}) s JOIN part p ON s.p_partkey = p.p_partkey)))))
 WHERE r <= 2 ORDER BY band DESC, tie, score DESC, p_partkey LIMIT 10""")  # fmt: skip
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return skills.ranked(scored(spark, sf_dir).join(brands, "p_partkey"), "p_partkey", "p_brand", 20260101).select("p_partkey")
