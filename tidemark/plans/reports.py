"""Queries of reports, orders, sets and joins, each with the same query for DuckDB."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import facets, location, ranking, reports
from tidemark.plans.fixture import JOBS, jobs
from tidemark.plans.queries import DOMAINS, query, table
from tidemark.plans.texts import company_sql

AS_OF = datetime(2000, 1, 1)
col = F.col
SEGMENTS = [*DOMAINS["Category"], "NONE"]


@query("a03_active_categories", JOBS + f"SELECT d.c AS Category, count(JobID) AS n FROM (SELECT unnest({SEGMENTS!r}) AS c) d LEFT JOIN jobs ON Category = d.c AND Status = 'active' GROUP BY 1")
def active_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.zero_filled(spark, SEGMENTS, jobs(spark, sf_dir).where("Status = 'active'"), "Category")


@query("a05_company_names", JOBS + "SELECT DISTINCT Company FROM jobs WHERE Status = 'active'")
def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir).where("Status = 'active'").select("Company").distinct()
    return rows.orderBy(F.collate("Company", "UNICODE"))


@query("a09_dashboard", JOBS + "SELECT count(*) FILTER (Status = 'active' AND GermanRequired = false) AS active, count(*) FILTER (Status = 'rejected') AS rejected, count(*) FILTER (Status = 'pending_review') AS pending FROM jobs")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counted(jobs(spark, sf_dir), active=facets.live(), rejected=col("Status") == "rejected", pending=col("Status") == "pending_review")


@query("a10_auto_published", JOBS + "SELECT count(*) FILTER (Status = 'active' AND createdAt >= TIMESTAMP '2000-01-01') AS today, count(*) FILTER (Status = 'active' AND reviewedAt IS NULL) AS waiting, count(*) FILTER (Status = 'rejected') AS pulled FROM jobs WHERE approvalMethod = 'ai_auto'")
def auto_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, live = jobs(spark, sf_dir).where("approvalMethod = 'ai_auto'"), col("Status") == "active"
    return reports.counted(rows, today=live & (col("createdAt") >= F.lit(AS_OF)), waiting=live & col("reviewedAt").isNull(), pulled=col("Status") == "rejected")


@query("a11_funnel", "SELECT count(*) AS codes, count(*) FILTER (s_suppkey % 3 > 0) AS used, count(*) FILTER (s_suppkey % 3 = 0 AND s_acctbal < 0) AS expired, count(*) FILTER (s_suppkey % 3 = 0 AND s_acctbal >= 0) AS open FROM supplier")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = col("s_suppkey") % 3 > 0
    return reports.counted(table(spark, sf_dir, "supplier"), codes=F.lit(True), used=used, expired=~used & (col("s_acctbal") < 0), open=~used & (col("s_acctbal") >= 0))


@query("a12_by_state", "SELECT count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view, count(*) AS total FROM events")
def by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counted(table(spark, sf_dir, "events"), error=col("event_type") == "error", view=col("event_type") == "view", total=F.lit(True))


LABELS = {"AUTOMOBILE": "Cars", "BUILDING": "Houses", "NONE": "Nothing"}


@query("a13_labelled", """SELECT c AS c_mktsegment, count(c_custkey) AS n, CASE c WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END AS place, CASE c WHEN 'AUTOMOBILE' THEN 'Cars' WHEN 'BUILDING' THEN 'Houses' ELSE 'Nothing' END AS label
 FROM (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'NONE']) AS c) LEFT JOIN customer ON c_mktsegment = c GROUP BY 1""")  # fmt: skip
def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.labelled(reports.zero_filled(spark, list(LABELS), table(spark, sf_dir, "customer"), "c_mktsegment"), "c_mktsegment", LABELS)


@query("a16_distribution", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_mktsegment")


@query("a18_top_and_rest", "WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, p_name LIMIT 15) SELECT * FROM t UNION ALL SELECT '(others)', coalesce(sum(n), 0)::BIGINT FROM c WHERE p_name NOT IN (SELECT p_name FROM t)")
def top_and_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_and_rest(table(spark, sf_dir, "part"), "p_name", 15)


@query("a19_freshness", "SELECT CASE WHEN h > 48 THEN 'fail' WHEN h > 30 THEN 'warn' ELSE 'ok' END AS status FROM (SELECT date_diff('microsecond', max(ts), TIMESTAMP '2024-02-01 08:00:00') / 3600e6 AS h FROM events)")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.freshness(table(spark, sf_dir, "events"), "ts", datetime(2024, 2, 1, 8))


@query("a20_rollup", "SELECT c_nationkey, CASE WHEN bool_or(c_custkey % 11 = 0 AND c_custkey % 7 = 0) THEN 'down' WHEN bool_or(c_custkey % 7 < 2) THEN 'degraded' ELSE 'operational' END AS overall FROM customer GROUP BY 1")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("c_custkey")
    checks = table(spark, sf_dir, "customer").select("c_nationkey", (k % 11 == 0).alias("critical"), F.when(k % 7 == 0, "fail").when(k % 7 == 1, "warn").otherwise("ok").alias("status"))
    return reports.rollup(checks, "c_nationkey")


@query("a25_yields", """SELECT board, count(*) FILTER (ok) AS hits, count(*) AS total, coalesce(array_to_string(list_sort(list(DISTINCT url) FILTER (ok))[1:3], ','), '') AS sample FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS board, url, contains(url, '/de') AS ok FROM pages) GROUP BY 1""")
def yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("url", F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("board"))
    return reports.yields(rows, "board", col("url").contains("/de"), "url")


@query("a28_coverage", "SELECT count(*) FILTER (n > 20) AS verified, count(*) FILTER (n BETWEEN 1 AND 20) AS few, count(*) FILTER (n = 0) AS none FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(counts, "c_custkey", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return reports.counted(rows, verified=col("n") > 20, few=col("n").between(1, 20), none=col("n") == 0)


@query("a02_open_counts", JOBS + "SELECT 'CountryCode' AS facet, upper(trim(CountryCode)) AS value, count(*) AS n FROM jobs WHERE coalesce(trim(CountryCode), '') <> '' GROUP BY 2 UNION ALL SELECT 'total', '', count(*) FROM jobs UNION ALL SELECT 'Category', c, count(JobID) FROM (SELECT unnest(" + repr(DOMAINS["Category"]) + ") AS c) LEFT JOIN jobs ON Category = c GROUP BY 2")
def open_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir)
    return facets.facet_counts(rows, {"Category": DOMAINS["Category"]}).unionByName(facets.open_counts(rows, "CountryCode"))


@query("f04_country", JOBS + "SELECT JobID FROM jobs WHERE upper(trim(CountryCode)) IN ('DE', 'FR')")
def by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).where(facets.country("CountryCode", [" de", "Fr"])).select("JobID")


@query("f05_offers", JOBS + "SELECT JobID FROM jobs WHERE visa_sponsorship = 'available' AND relocation_support = 'available' AND coalesce(SalaryInterval, '') <> ''")
def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).where(facets.offers("visa_sponsorship", "relocation_support") & facets.has_salary("SalaryInterval")).select("JobID")


@query("f10_facet_or_all", JOBS + "SELECT count(*) AS n FROM jobs WHERE Status = 'active'")
def facet_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).where("Status = 'active'").where(facets.facet_or_all("Category", ["moon"], DOMAINS["Category"])).agg(F.count("*").alias("n"))


@query("f12_allowed", JOBS + "SELECT JobID FROM jobs WHERE Status = 'active' AND GermanRequired = false AND Category = 'BUILDING'")
def allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = facets.QueryFilters({"Category": ["BUILDING"], "EmploymentType": ["temp"]}, 50_000, None)
    own, _ = facets.allowed(asked, False, ("EmploymentType", "salary"))
    return jobs(spark, sf_dir).where(facets.predicate(own, AS_OF)).select("JobID")


GERMAN = "(" + " OR ".join(f"contains(lower({{0}}), '{p}')" for p in location.GERMAN_PLACES) + " OR regexp_matches(lower({0}), '\\bde\\b'))"


@query("f23_lever_in_germany", JOBS + f"SELECT JobID FROM jobs WHERE CASE WHEN coalesce(CountryCode, '') <> '' THEN lower(trim(CountryCode)) IN ('de', 'deu') ELSE {GERMAN.format('Location')} OR Department = 'IT' OR (JobID % 2 = 0 AND Department = 'Sales') END")
def lever(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.when(col("Department") == "IT", F.array(F.lit("x"), F.lit("Bonn")))
    text = F.when(col("Department") == "Sales", "Remote in Germany only")
    work = F.when(col("JobID") % 2 == 0, "remote")
    return jobs(spark, sf_dir).where(location.lever_in_germany(col("CountryCode"), col("Location"), places, work, text)).select("JobID")


@query("f24_feeds_in_germany", JOBS + f"""SELECT JobID, coalesce(upper(CountryCode) = 'DE', false) OR ({GERMAN.format('Location').rsplit(' OR ', 1)[0]})) AS recruitee, {GERMAN.format('Location')} OR coalesce(CountryCode = 'de', false) AS ashby,
 coalesce(CountryCode = 'de', false) OR {GERMAN.format('JobTitle')} AS teamtailor, {GERMAN.format('Location')} OR JobID % 2 = 0 AS workday FROM jobs""")  # fmt: skip
def feeds_in_germany(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, code = F.lit(None), col("CountryCode")
    flat = F.array(F.struct(code.alias("country_code"), none.cast("string").alias("country"), none.cast("string").alias("city")))
    address = F.array(F.struct(F.when(code == "de", code).alias("country"), none.cast("string").alias("city")))
    return jobs(spark, sf_dir).select(
        "JobID", location.recruitee_in_germany(flat, none.cast("string"), none.cast("string"), none.cast("string"), col("Location")).alias("recruitee"),
        location.ashby_in_germany(col("Location"), F.when(code == "de", code), none.cast("array<string>")).alias("ashby"),
        location.teamtailor_in_germany(address, col("JobTitle")).alias("teamtailor"),
        location.workday_in_germany(col("Location"), F.when(col("JobID") % 2 == 0, F.array(F.lit("Germany"), F.lit("Hamburg")))).alias("workday"),
    )


@query("w06_batches", "SELECT o_custkey, (r - 1) // 10 AS batch, count(*) AS n FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY ALL")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reports.batches(table(spark, sf_dir, "orders"), col("o_custkey"), 10, col("o_orderkey"))
    return made.groupBy("o_custkey", "batch").agg(F.count("*").alias("n"))


@query("o05_by_company", JOBS + "SELECT JobID FROM jobs WHERE Status = 'active' ORDER BY Company, PostedDate DESC NULLS LAST, JobID LIMIT 50")
def by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.page(jobs(spark, sf_dir).where("Status = 'active'"), 1, 50, col("Company").asc(), F.desc_nulls_last("PostedDate"), col("JobID").asc()).select("JobID")


@query("o04_second_page", JOBS + "SELECT JobID FROM jobs WHERE Status = 'rejected' ORDER BY createdAt DESC, JobID LIMIT 25 OFFSET 25")
def second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.page(jobs(spark, sf_dir).where("Status = 'rejected'"), 2, 25, F.desc("createdAt"), col("JobID").asc()).select("JobID")


@query("o08_top_of_top", "SELECT event_id FROM (SELECT * FROM (SELECT * FROM events ORDER BY value DESC, event_id LIMIT 20) ORDER BY value * (event_id % 5 + 1) DESC, event_id LIMIT 15)")
def top_of_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id").limit(20)
    return first.orderBy((col("value") * (col("event_id") % 5 + 1)).desc(), "event_id").limit(15).select("event_id")


@query("o09_latest_verdicts", "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 500")
def latest_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.page(table(spark, sf_dir, "events").where("event_type = 'error'"), 1, 500, F.desc("ts"), col("event_id").asc()).select("event_id")


@query("u03_directory", JOBS + f"""SELECT name, n, branch, CASE WHEN key = 'customer#000000003' THEN 'known' END AS description FROM (SELECT *, {company_sql('name')} AS key FROM (SELECT Company AS name, count(*) AS n, 0 AS branch FROM jobs WHERE Status = 'active' GROUP BY 1
 UNION ALL SELECT s_name, 0, 1 FROM supplier WHERE lower(s_name) NOT IN (SELECT lower(Company) FROM jobs WHERE Status = 'active')))""")  # fmt: skip
def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    scraped = jobs(spark, sf_dir).where("Status = 'active'").groupBy(col("Company").alias("name")).agg(F.count("*").alias("n"))
    manual = table(spark, sf_dir, "supplier").select(col("s_name").alias("name"))
    profiles = spark.createDataFrame([("customer#000000003", "known")], "key string, description string")
    return reports.directory(scraped, manual, profiles, names.company_key).select("name", "n", "branch", "description")


@query("j04_profiles", JOBS + f"SELECT JobID, s_suppkey FROM (SELECT JobID, {company_sql('Company')} AS key FROM jobs) LEFT JOIN supplier ON key = replace(lower(s_name), 'supplier', 'customer')")
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").select("s_suppkey", F.replace(F.lower("s_name"), F.lit("supplier"), F.lit("customer")).alias("key"))
    return jobs(spark, sf_dir).join(known, names.company_key(col("Company")) == col("key"), "left").select("JobID", "s_suppkey")


@query("j07_new_only", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(known, col("o_orderkey") == col("l_orderkey"), "left_anti").select("o_orderkey")


@query("j08_read_again", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)")
def read_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(keys, col("o_orderkey") == col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("j09_late_columns", "SELECT d.doc_id, md5(text) AS hash FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50) t JOIN documents d ON d.doc_id = t.doc_id")
def late_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    best = docs.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50).select("doc_id")
    return docs.select("doc_id", "text").join(F.broadcast(best), "doc_id").select("doc_id", F.md5("text").alias("hash"))  # 50 rows


@query("u06_candidates", "SELECT name, sum(n)::BIGINT AS n FROM (SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT c_mktsegment, count(*) FROM customer GROUP BY 1) WHERE name NOT LIKE '%ring%' GROUP BY 1")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "part").select(col("p_name").alias("name")).unionByName(table(spark, sf_dir, "customer").select(col("c_mktsegment").alias("name")))
    dead = table(spark, sf_dir, "part").where("p_name like '%ring%'").select(col("p_name").alias("name")).distinct()
    return both.groupBy("name").agg(F.count("*").alias("n")).join(dead, "name", "left_anti").orderBy(F.desc("n"), "name")


@query("f42_missing", JOBS + "SELECT JobID FROM jobs WHERE salary_min IS NULL AND Status = 'active'")
def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).where(col("salary_min").isNull() & (col("Status") == "active")).select("JobID")


@query("s13_cached_scan", JOBS + "SELECT JobID, Company, Location FROM jobs WHERE Status = 'active'")
def cached_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).where("Status = 'active'").select("JobID", "Company", "Location")


@query("a22_per_hour", "SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 2")
def per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return rows.where("n >= 2").select("user_id", col("w.start").alias("hour"), "n")


@query("w02_best_two", JOBS + "SELECT JobID FROM jobs QUALIFY row_number() OVER (PARTITION BY Company ORDER BY PostedDate DESC NULLS LAST, JobID) <= 2")
def best_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.cap_per_group(jobs(spark, sf_dir).select("JobID", "Company", "PostedDate"), col("Company"), 2, F.desc_nulls_last("PostedDate"), col("JobID").asc()).select("JobID")
