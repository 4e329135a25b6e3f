"""Queries over what comes in: landed pages, JSON of models and callers, and the digest that goes out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import digest, facets, markup, schemas
from tidemark.plans.queries import AS_OF, LIVE, POSTINGS, postings, query, table
from tidemark.plans.stores import folder
from tidemark.sources import paged

col = F.col
HOST = "^[a-z]+://([^/?#:]+)"


@query("d01_landed_pages", f"""SELECT board, 10 * ((k - 1) // 10) AS "offset", (k - 1) % 10 AS position, page_id FROM (SELECT regexp_extract(url, '{HOST}', 1) AS board, page_id,
 row_number() OVER (PARTITION BY regexp_extract(url, '{HOST}', 1) ORDER BY page_id) AS k FROM pages)""")  # fmt: skip
def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through the paged source: landed by board, read page by page until the total is reached."""
    pages, path = table(spark, sf_dir, "pages"), folder(spark, "landed")
    paged.land(pages, F.regexp_extract("url", HOST, 1), F.to_json(F.struct("page_id", "url")), path, "page_id", 10)
    found = paged.read(spark, path, 10)
    return found.select("board", "offset", "position", F.get_json_object("job", "$.page_id").cast("long").alias("page_id"))


#: JSON of a model's reply for each document, by its id; of some it is broken or no object.
REPLIES = """CASE doc_id % 8
 WHEN 0 THEN concat('{"required_skills": ["', lang, '", {"name": "sql", "category": "Database"}, {"name": "x", "category": "?"}, 7, {"category": "Tool"}], "experience_level": "Senior", "salary_min": 90000, "salary_max": 60000, "salary_currency": "eur"}')
 WHEN 1 THEN concat('{"tools_and_platforms": ["a", 1, null, "', source, '"], "min_experience_years": ', CAST(doc_id % 20 AS STRING), ', "experience_level": "Boss", "visa_sponsorship": "available"}')
 WHEN 2 THEN '{"required_education": "  ", "german_level_detail": " B2 ", "min_experience_years": "3", "team_context": 5, "remote_policy_detail": "hybrid"}'
 WHEN 3 THEN '{"salary_min": 70, "salary_currency": "EUR", "salary_interval": "yearly", "employment_type": "Full-time"}'
 WHEN 4 THEN '{"salary_max": 40.5, "salary_currency": "CHF", "salary_interval": "hourly", "required_skills": "none", "key_responsibilities": []}'
 WHEN 5 THEN '[1, 2]' WHEN 6 THEN concat('{"broken": ', lang) ELSE '{}' END"""
DUCK_REPLIES = REPLIES.replace("AS STRING", "AS VARCHAR")


@query("p19_requirements", f"""SELECT doc_id, CASE r WHEN 0 THEN lang || '/Other,sql/Database,x/Other' WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE '' END AS skills,
 CASE r WHEN 1 THEN 'a,' || source WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE '' END AS tools, CASE r WHEN 1 THEN (doc_id % 20)::DOUBLE END AS years,
 CASE r WHEN 0 THEN 'Senior' END AS level, CASE r WHEN 3 THEN 'Full-time' END AS employment, CASE r WHEN 2 THEN ' B2 ' WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE 'not mentioned' END AS german,
 CASE r WHEN 1 THEN 'available' WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE 'not_mentioned' END AS visa, CASE r WHEN 2 THEN 'hybrid' WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE 'not_mentioned' END AS remote,
 CASE r WHEN 0 THEN 60000.0::DOUBLE END AS low, CASE r WHEN 0 THEN 90000.0::DOUBLE WHEN 4 THEN 40.5::DOUBLE END AS high, CASE r WHEN 0 THEN 'EUR' WHEN 4 THEN 'CHF' END AS currency, CASE r WHEN 0 THEN 'yearly' WHEN 4 THEN 'hourly' END AS "interval",
 CASE r WHEN 1 THEN 'experience_level: not allowed' WHEN 2 THEN 'min_experience_years: no number,team_context: no text' WHEN 4 THEN 'required_skills: no skills' WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE '' END AS errors
 FROM (SELECT *, doc_id % 8 AS r FROM documents)""")  # fmt: skip
def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model says about each document, as far as it fits the schema."""
    v = schemas.parsed(F.expr(REPLIES))
    made = table(spark, sf_dir, "documents").select("doc_id", schemas.validated(v, schemas.REQUIREMENTS).alias("x"), schemas.pay_of(v).alias("pay"))
    skills = F.array_join(F.transform("x.required_skills", lambda s: F.concat_ws("/", s["name"], s["category"])), ",")
    return made.select(
        "doc_id", skills.alias("skills"), F.array_join("x.tools_and_platforms", ",").alias("tools"), col("x.min_experience_years").alias("years"), col("x.experience_level").alias("level"),
        col("x.employment_type").alias("employment"), col("x.german_level_detail").alias("german"), col("x.visa_sponsorship").alias("visa"), col("x.remote_policy_detail").alias("remote"),
        col("pay.salary_min").alias("low"), col("pay.salary_max").alias("high"), col("pay.salary_currency").alias("currency"), col("pay.salary_interval").alias("interval"),
        F.array_join("x.errors", ",").alias("errors"),
    )


PROFILES = """CASE doc_id % 5
 WHEN 0 THEN concat('{"name": "', source, '", "experience": [{"company": "A", "title": 3, "isCurrent": true, "technologies": ["x", 2, "y"]}, 7, {"endDate": "2020"}], "level": "Lead", "experience_years": 4.5, "languages": [{"a": 1}, "b"]}')
 WHEN 1 THEN '{"seniority_level": "Junior", "level": "Mid", "total_experience_years": 7, "experience_years": 2, "open_to_remote": "yes", "visa_required": false}'
 WHEN 2 THEN '{"education": [{"degree": "MSc", "endDate": 2019}], "projects": [{"name": "p", "technologies": "no"}], "certifications": ["c", null], "domain": null, "skills": ["s"]}'
 WHEN 3 THEN 'null' ELSE '{}' END"""


@query("p18_profile", """SELECT doc_id, CASE r WHEN 0 THEN source END AS name, CASE r WHEN 0 THEN 'A||true|x+y;||false|' WHEN 3 THEN NULL ELSE '' END AS experience, CASE r WHEN 0 THEN 'Lead' WHEN 1 THEN 'Mid' END AS level,
 CASE r WHEN 0 THEN 4.5::DOUBLE WHEN 1 THEN 7.0::DOUBLE END AS years, CASE r WHEN 0 THEN 1 WHEN 3 THEN NULL ELSE 0 END AS languages, CASE r WHEN 1 THEN false END AS visa, CASE r WHEN 2 THEN 'MSc|' WHEN 3 THEN NULL ELSE '' END AS education,
 CASE r WHEN 2 THEN 'p/0' WHEN 3 THEN NULL ELSE '' END AS projects, CASE r WHEN 2 THEN 'c' WHEN 3 THEN NULL ELSE '' END AS certificates, CASE r WHEN 3 THEN NULL ELSE 'Other' END AS domain,
 CASE r WHEN 1 THEN 'seniority_level: not allowed,open_to_remote: no flag' WHEN 3 THEN NULL ELSE '' END AS errors FROM (SELECT *, doc_id % 5 AS r FROM documents)""")  # fmt: skip
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select("doc_id", schemas.validated(schemas.parsed(F.expr(PROFILES)), schemas.PROFILE).alias("x"))
    joined = lambda c, of, by: F.array_join(F.transform(c, of), by)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return made.select(
        "doc_id", col("x.name").alias("name"), joined("x.experience", lambda e: F.concat_ws("|", e["company"], e["title"], text(e["isCurrent"]), F.array_join(e["technologies"], "+")), ";").alias("experience"),
        col("x.seniority_level").alias("level"), col("x.total_experience_years").alias("years"), F.when(col("x").isNotNull(), F.size("x.languages")).alias("languages"), col("x.visa_required").alias("visa"),
        joined("x.education", lambda e: F.concat(e["degree"], F.lit("|"), text(e["endDate"])), ";").alias("education"), joined("x.projects", lambda p: F.concat(p["name"], F.lit("/"), F.size(p["technologies"]).cast("string")), ";").alias("projects"),
        F.array_join("x.certifications", ",").alias("certificates"), col("x.domain").alias("domain"), F.array_join("x.errors", ",").alias("errors"),
    )


RAW = """concat('{"JobID": ', CAST(o_orderkey AS STRING), ', "JobTitle": " a  b ", "SalaryMin": ', CASE o_orderkey % 4 WHEN 0 THEN '"61000.5"' WHEN 1 THEN '0' WHEN 2 THEN '"x"' ELSE 'null' END,
 ', "GermanRequired": ', CASE o_orderkey % 5 WHEN 0 THEN '"true"' WHEN 1 THEN '"yes"' WHEN 2 THEN '1' WHEN 3 THEN 'true' ELSE 'null' END, ', "Tags": ', CASE o_orderkey % 3 WHEN 0 THEN '["t", "u"]' ELSE '"t"' END,
 ', "PostedDate": ', CASE o_orderkey % 3 WHEN 0 THEN '"2024-02-03T04:05:06Z"' WHEN 1 THEN '86400000' ELSE '"soon"' END, '}')"""


@query("p11_model", """SELECT o_orderkey::VARCHAR AS id, 'a  b' AS title, CASE o_orderkey % 4 WHEN 0 THEN 61000.5::DOUBLE END AS pay, o_orderkey % 5 IN (0, 2, 3) AS german, CASE o_orderkey % 3 WHEN 0 THEN 't,u' ELSE '' END AS tags,
 CASE o_orderkey % 3 WHEN 0 THEN '2024-02-03 04:05:06' WHEN 1 THEN '1970-01-02 00:00:00' END AS posted, 'N/A' AS company, 'pending_review' AS status, 0::DOUBLE AS clicks FROM orders""")  # fmt: skip
def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loosely typed postings with their defaults."""
    made = table(spark, sf_dir, "orders").select(schemas.validated(schemas.parsed(F.expr(RAW)), schemas.POSTING).alias("x"))
    return made.select(
        col("x.JobID").alias("id"), col("x.JobTitle").alias("title"), col("x.SalaryMin").alias("pay"), col("x.GermanRequired").alias("german"), F.array_join("x.Tags", ",").alias("tags"),
        F.date_format("x.PostedDate", "yyyy-MM-dd HH:mm:ss").alias("posted"), col("x.Company").alias("company"), col("x.Status").alias("status"), col("x.applyClicks").alias("clicks"),
    )


WISHES = """CASE c_custkey % 4 WHEN 0 THEN concat('{"salary_min": "', CAST(c_custkey AS STRING), '", "visa_status": "", "notice_period": 3}') WHEN 1 THEN '{"salary_min": "much", "salary_max": 70000, "preferred_work_style": "remote"}'
 WHEN 2 THEN '{"available_from": false, "notice_period": 0, "x": 1}' ELSE 'no json' END"""


@query("p21_preferences", """SELECT c_custkey, CASE WHEN r = 0 AND c_custkey > 0 THEN c_custkey::DOUBLE END AS low, CASE r WHEN 1 THEN 70000.0::DOUBLE END AS high, CASE r WHEN 1 THEN 'remote' END AS style, CASE r WHEN 0 THEN '3' END AS notice,
 NULL::VARCHAR AS since, NULL::VARCHAR AS visa FROM (SELECT *, c_custkey % 4 AS r FROM customer)""")  # fmt: skip
def wishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "customer").select("c_custkey", schemas.preferences(schemas.parsed(F.expr(WISHES))).alias("x"))
    names = {"salary_min": "low", "salary_max": "high", "preferred_work_style": "style", "notice_period": "notice", "available_from": "since", "visa_status": "visa"}
    return made.select("c_custkey", *[col(f"x.{c}").alias(n) for c, n in names.items()])


RECENT = f"{LIVE} AND coalesce(PostedDate, scrapedAt) >= TIMESTAMP '1997-12-02'"


@query("m10_digest", POSTINGS + f"""SELECT c_custkey, count(*) FILTER (k <= 50) AS total, count(*) FILTER (shown) AS shown, string_agg(Category || ':' || JobID, ',' ORDER BY place, k) FILTER (shown) AS picks
 FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY k, place) <= 8 AS shown FROM (
  SELECT c_custkey, Category, JobID, place, row_number() OVER (PARTITION BY c_custkey, Category ORDER BY coalesce(PostedDate, TIMESTAMP '1970-01-01') DESC, JobID) AS k
  FROM (SELECT c_custkey, unnest(w) AS Category, generate_subscripts(w, 1) AS place FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ['BUILDING', c_mktsegment] WHEN 1 THEN [c_mktsegment, 'NONE', 'FURNITURE'] WHEN 2 THEN ['NONE'] ELSE [] END AS w0,
    list_filter(w0, lambda x, i: list_position(w0, x) = i) AS w FROM customer)) JOIN (SELECT * FROM postings WHERE {RECENT}) USING (Category))) WHERE k <= 50 GROUP BY 1""")  # fmt: skip
def weekly_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subscriber's digest."""
    key, own = col("c_custkey"), col("c_mktsegment")
    wanted = F.when(key % 4 == 0, F.array(F.lit("BUILDING"), own)).when(key % 4 == 1, F.array(own, F.lit("NONE"), F.lit("FURNITURE"))).when(key % 4 == 2, F.array(F.lit("NONE")))
    users = table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(wanted, F.array().cast("array<string>")).alias("desiredCategories"))
    rows = postings(spark, sf_dir).where(facets.live() & facets.seen_since("This Month", AS_OF, either=False))
    sent = digest.messages(users, rows.select("Category", "JobID", "PostedDate"), "Category", "JobID", *facets.newest_first())
    picks = F.array_join(F.transform("picks", lambda p: F.concat(p["category"], F.lit(":"), p["id"].cast("string"))), ",")
    return sent.select("c_custkey", "total", col("shown").cast("long").alias("shown"), picks.alias("picks"))


@query("x18_sanitized")
def sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's markup, made safe.  DuckDB has no parser either, so walks over small trees test it."""
    return markup.sanitized(table(spark, sf_dir, "pages"), "page_id", "html")


@query("m13_resanitized", """SELECT page_id, '<p>' || page_id || ' &amp; more</p>' AS html FROM pages WHERE page_id % 3 <> 0""")
def resanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored markup of three kinds: safe already, encoded, and with what must go."""
    key = col("page_id")
    text = F.concat(key.cast("string"), F.lit(" &amp;amp;amp; more"))
    old = F.when(key % 3 == 0, F.concat(F.lit("<p>"), key.cast("string"), F.lit("</p>"))).when(
        key % 3 == 1, F.concat(F.lit("&amp;lt;div class=x&amp;gt;"), text, F.lit("&amp;lt;/div&amp;gt;"))
    )
    rest = F.concat(F.lit("<div class='content-conclusion'>no<div>t</div></div><p class=a>"), text, F.lit("</p><script>no()</script>"))
    return markup.resanitized(table(spark, sf_dir, "pages").select(key, F.coalesce(old, rest).alias("old")), "page_id", "old")
