"""Queries of the posting engine on the test tables, each with the same query for DuckDB.

The tables hold no postings: ``postings`` makes some of orders, customers and nations.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import canonical, shuffle, text
from tidemark.operators import accounts, facets, location, ranking, store
from tidemark.streaming import changes

AS_OF = datetime(1998, 1, 1)
DOMAINS = {
    "Workplace": ["remote", "hybrid", "onsite"],
    "Category": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "Experience": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    key = F.col("o_orderkey")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # 25 rows at any scale
        .select(
            key.alias("JobID"), F.col("o_orderpriority").alias("JobTitle"), F.col("c_name").alias("Company"), F.col("n_name").alias("Location"),
            F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "pending_review").otherwise("rejected").alias("Status"),
            F.col("c_mktsegment").alias("Category"), F.col("o_orderpriority").alias("Experience"),
            F.when(key % 4 == 0, "remote").when(key % 4 == 1, "hybrid").when(key % 4 == 2, "onsite").alias("Workplace"),
            F.when(key % 3 != 0, F.col("o_totalprice")).alias("SalaryMin"), F.when(key % 5 != 0, F.col("o_totalprice") * 1.2).alias("SalaryMax"),
            F.when(key % 10 != 0, F.col("o_orderdate")).alias("PostedDate"), (F.col("o_orderdate") + F.expr("interval 1 day")).alias("scrapedAt"),
            (F.col("o_custkey") % 7 == 0).alias("GermanRequired"),
        )
    )


POSTINGS = """WITH postings AS (
SELECT o_orderkey AS JobID, o_orderpriority AS JobTitle, c_name AS Company, n_name AS Location,
 CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'pending_review' ELSE 'rejected' END AS Status,
 c_mktsegment AS Category, o_orderpriority AS Experience,
 CASE o_orderkey % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' END AS Workplace,
 CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS SalaryMin, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice * 1.2 END AS SalaryMax,
 CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS PostedDate, o_orderdate + INTERVAL 1 DAY AS scrapedAt, o_custkey % 7 = 0 AS GermanRequired
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) """
LIVE = "Status = 'active' AND GermanRequired = false"
OVERLAP = """(SalaryMin IS NOT NULL OR SalaryMax IS NOT NULL) AND NOT coalesce(SalaryMin < 50000 AND NOT coalesce(SalaryMax >= 50000, false), false)
 AND NOT coalesce(SalaryMax > 200000 AND NOT coalesce(SalaryMin <= 200000, false), false)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):  # noqa: ANN201
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return put


ASKED = facets.QueryFilters({"Experience": ["1-URGENT", "2-HIGH"]}, 50_000, 200_000, None, "This Month")
COUNTS = " UNION ALL ".join(
    f"SELECT '{c}' AS facet, '{v}' AS value, count(*) FILTER ({c} = '{v}') AS n FROM hit" for c, vs in DOMAINS.items() for v in vs
)


@query("a01_facet_counts", POSTINGS + f""", hit AS (SELECT * FROM postings WHERE {LIVE} AND Experience IN ('1-URGENT', '2-HIGH') AND {OVERLAP}
 AND (coalesce(PostedDate >= TIMESTAMP '1997-12-02', false) OR scrapedAt >= TIMESTAMP '1997-12-02'))
 SELECT 'total' AS facet, '' AS value, count(*) AS n FROM hit UNION ALL {COUNTS}""")  # fmt: skip
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = postings(spark, sf_dir).where(facets.predicate(ASKED.checked(DOMAINS), AS_OF))
    return facets.facet_counts(rows, DOMAINS)


@query("o02_list_page", POSTINGS + f"""SELECT JobID, Company, Category, PostedDate FROM postings WHERE {LIVE} AND {OVERLAP}
 ORDER BY coalesce(PostedDate, TIMESTAMP '1970-01-01') DESC, JobID LIMIT 30 OFFSET 30""")  # fmt: skip
def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = postings(spark, sf_dir).where(facets.predicate(facets.QueryFilters({}, 50_000, 200_000), AS_OF))
    return facets.page(rows, 2, 30, *facets.newest_first()).select("JobID", "Company", "Category", "PostedDate")


@query("f03_nothing_valid", POSTINGS + f"SELECT JobID FROM postings WHERE {LIVE} AND false")
def nothing_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = facets.QueryFilters({"Workplace": ["moon"]}).checked(DOMAINS)
    return postings(spark, sf_dir).where(facets.predicate(asked, AS_OF)).select("JobID")


@query("f07_search", POSTINGS + f"SELECT JobID, Location FROM postings WHERE {LIVE} AND (contains(lower(JobTitle), 'ion_2') OR contains(lower(Company), 'ion_2') OR contains(lower(Location), 'ion_2'))")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).where(facets.live() & facets.contains_text(" ION_2 ")).select("JobID", "Location")


@query("f09_window_fallback", POSTINGS + "SELECT count(*) AS n FROM postings WHERE coalesce(PostedDate, scrapedAt) >= TIMESTAMP '1997-12-02'")
def window_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).where(facets.seen_since("This Month", AS_OF, either=False)).agg(F.count("*").alias("n"))


@query("f25_confidence_bands", """SELECT band, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'rejected' WHEN value / 50 < 0.6 THEN 'rejected'
 WHEN value / 50 >= 0.85 THEN 'active' ELSE 'pending_review' END AS band FROM events) GROUP BY 1""")  # fmt: skip
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("value") / 50
    band = F.when(F.col("event_type") == "error", "rejected").when(score < 0.6, "rejected").when(score >= 0.85, "active").otherwise("pending_review")
    return table(spark, sf_dir, "events").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("a04_category_counts", POSTINGS + f"""SELECT d.c AS Category, count(JobID) AS n FROM (SELECT unnest({[*DOMAINS['Category'], 'NONE']!r}) AS c) d
 LEFT JOIN postings ON Category = d.c AND {LIVE} GROUP BY 1""")  # fmt: skip
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(c,) for c in [*DOMAINS["Category"], "NONE"]], "Category string")
    counts = postings(spark, sf_dir).where(facets.live()).groupBy("Category").agg(F.count("*").alias("n"))
    return names.join(counts, "Category", "left").select("Category", F.coalesce("n", F.lit(0)).alias("n"))


@query("a06_directory", POSTINGS + """SELECT Company, count(*) AS n, array_to_string(list_slice(list_sort(list_distinct(list(Location))), 1, 3), ',') AS cities
 FROM postings WHERE Status = 'active' GROUP BY 1""")  # fmt: skip
def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = F.array_join(F.slice(F.array_sort(F.collect_set("Location")), 1, 3), ",")
    return postings(spark, sf_dir).where("Status = 'active'").groupBy("Company").agg(F.count("*").alias("n"), cities.alias("cities"))


@query("a08_review_breakdown", POSTINGS + """SELECT count(*) FILTER (Status = 'pending_review') AS pending, count(*) FILTER (Status = 'active' AND PostedDate IS NULL) AS unreviewed,
 count(*) FILTER (Status = 'pending_review' OR (Status = 'active' AND PostedDate IS NULL)) AS total FROM postings""")  # fmt: skip
def review_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending, auto = F.col("Status") == "pending_review", (F.col("Status") == "active") & F.col("PostedDate").isNull()
    return postings(spark, sf_dir).agg(
        F.count_if(pending).alias("pending"), F.count_if(auto).alias("unreviewed"), F.count_if(pending | auto).alias("total")
    )


@query("a14_daily_counters", """SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view,
 count(*) FILTER (event_type = 'signup') AS signup FROM events GROUP BY 1""")  # fmt: skip
def daily_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [F.count_if(F.col("event_type") == k).alias(k) for k in ("click", "view", "signup")]
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(*kinds)


@query("a22_rate_limit", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_trailing FROM events""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.trailing_count(table(spark, sf_dir, "events"), "user_id", "ts", 3600).select("event_id", "n_trailing")


@query("j06_verdict_lookup", """SELECT CASE WHEN l.doc_id IS NULL THEN 'miss' ELSE 'hit' END AS cache, coalesce(quality, -1) AS quality, count(*) AS n
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL""")  # fmt: skip
def verdict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    hit = F.when(F.col("quality").isNull(), "miss").otherwise("hit")
    return docs.join(labels, "doc_id", "left").groupBy(hit.alias("cache"), F.coalesce("quality", F.lit(-1)).alias("quality")).agg(F.count("*").alias("n"))


FINGER = "md5(lower(lang) || '|' || lower(source) || '|' || substr(regexp_replace(lower(text), '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g'), 1, 500))"


@query("a15_first_per_fingerprint", f"SELECT fp, min(doc_id) AS doc_id FROM (SELECT doc_id, {FINGER} AS fp FROM documents) GROUP BY 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.col("lang"), F.col("source"), F.col("text")).alias("fp"))
    return ranking.first_per_key(rows, ["fp"], "doc_id")


@query("w01_category_cap", POSTINGS + f"""SELECT Category, JobID FROM postings WHERE {LIVE}
 QUALIFY row_number() OVER (PARTITION BY Category ORDER BY coalesce(PostedDate, TIMESTAMP '1970-01-01') DESC, JobID) <= 50""")  # fmt: skip
def category_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = postings(spark, sf_dir).where(facets.live())
    return ranking.cap_per_group(rows, F.col("Category"), 50, *facets.newest_first()).select("Category", "JobID")


@query("w03_round_robin", POSTINGS + f"""SELECT Category, JobID FROM (SELECT Category, JobID, row_number() OVER (PARTITION BY Category ORDER BY JobID) AS turn,
 list_position({DOMAINS['Category'][:3]!r}, Category) AS place FROM postings WHERE {LIVE} AND Category IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')) ORDER BY turn, place LIMIT 8""")  # fmt: skip
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = postings(spark, sf_dir).where(facets.live())
    return ranking.round_robin(rows, "Category", DOMAINS["Category"][:3], 8, F.col("JobID").asc()).select("Category", "JobID")


@query("w02_company_cap", POSTINGS + f"""SELECT JobID, Company FROM (SELECT JobID, Company, SalaryMin, row_number() OVER (PARTITION BY Company ORDER BY SalaryMin DESC, JobID) AS r
 FROM postings WHERE {LIVE} AND SalaryMin IS NOT NULL) WHERE r <= 2 ORDER BY SalaryMin DESC, JobID LIMIT 40""")  # fmt: skip
def company_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = postings(spark, sf_dir).where(facets.live() & F.col("SalaryMin").isNotNull())
    order = (F.col("SalaryMin").desc(), F.col("JobID").asc())
    return ranking.cap_per_group(rows, F.col("Company"), 2, *order).orderBy(*order).limit(40).select("JobID", "Company")


@query("x05_yearly_salary", """SELECT o_orderkey, CASE WHEN y BETWEEN 10000 AND 1000000 THEN y END AS y FROM (SELECT o_orderkey, CAST(floor(o_totalprice
 * CASE o_orderkey % 4 WHEN 0 THEN 12 ELSE 1 END * (CASE o_orderkey % 3 WHEN 0 THEN 0.92 WHEN 1 THEN 1.17 ELSE 1.0 END)::DOUBLE + 0.5) AS BIGINT) AS y FROM orders)""")  # fmt: skip
def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    currency = F.when(key % 3 == 0, "USD").when(key % 3 == 1, "GBP").otherwise("EUR")
    interval = F.when(key % 4 == 0, "monthly").otherwise("yearly")
    return table(spark, sf_dir, "orders").select("o_orderkey", canonical.yearly_euros(F.col("o_totalprice"), currency, interval).alias("y"))


@query("p16_preview", r"""SELECT page_id, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '...' ELSE t END AS preview FROM (SELECT page_id,
 regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS t FROM pages)""")  # fmt: skip
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.preview(F.col("html")).alias("preview"))


@query("m04_idempotent_clicks", """SELECT CAST(props->>'k' AS INT) AS k, count(DISTINCT user_id) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1""")
def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").where("event_type = 'click'").groupBy(job.alias("k")).agg(F.countDistinct("user_id").alias("clicks"))


CUT = "TIMESTAMP '2024-01-15'"


@query("s18_upsert", f"""SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.value, o.value) AS value,
 CASE WHEN o.user_id IS NULL THEN '2024-01-31' ELSE '2024-01-15' END AS created, CASE WHEN n.user_id IS NULL THEN '2024-01-15' ELSE '2024-01-31' END AS updated
 FROM (SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE ts < {CUT} AND event_type <> 'error' GROUP BY 1) o
 FULL JOIN (SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE ts >= {CUT} AND event_type = 'click' GROUP BY 1) n ON o.user_id = n.user_id""")  # fmt: skip
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, cut = table(spark, sf_dir, "events"), F.lit(datetime(2024, 1, 15))
    last = lambda rows: store.last_per_key(rows.select("user_id", "event_id", "value"), ["user_id"], "event_id").drop("event_id")
    old = last(events.where((F.col("ts") < cut) & (F.col("event_type") != "error"))).withColumns({"createdAt": cut, "updatedAt": cut})
    new = last(events.where((F.col("ts") >= cut) & (F.col("event_type") == "click")))
    both = store.upsert(old, new, ["user_id"], datetime(2024, 1, 31))
    return both.select("user_id", "value", F.date_format("createdAt", "yyyy-MM-dd").alias("created"), F.date_format("updatedAt", "yyyy-MM-dd").alias("updated"))


@query("t04_change_feed", """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
 WHERE r = 1 AND event_type <> 'error'""")  # fmt: skip
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.followed(spark, sf_dir, store.shared_dir(spark))


@query("f31_least_or_all", POSTINGS + f"SELECT count(*) AS n FROM postings WHERE {LIVE} AND (Category = 'BUILDING' OR (SELECT count(*) FROM postings WHERE {LIVE} AND Category = 'BUILDING') < 20)")
def least_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = postings(spark, sf_dir).where(facets.live())
    return ranking.at_least_or_all(rows, F.col("Category") == "BUILDING", 20).agg(F.count("*").alias("n"))


@query("j05_manual_companies", """SELECT s_name AS name FROM supplier WHERE lower(s_name) NOT IN (SELECT lower(replace(c_name, 'Customer', 'Supplier')) FROM customer WHERE c_custkey % 2 = 0)""")
def manual_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.lower(F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))).alias("k"))
    own = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    return own.join(known, F.lower("name") == F.col("k"), "left_anti")


ORDER_DAY = "2026-01-01"


def walked(day: str) -> str:
    """One step of the keyed permutation over places v, as SQL: four rounds, then the place of both halves."""
    keys = shuffle.feistel(1, day)[2]
    more = lambda x, k: f"((({x} + {keys[k][0]}) % {shuffle.PRIME}) * (({x} + {keys[k][1]}) % {shuffle.PRIME}) % {shuffle.PRIME})"
    turns = "SELECT k, n, a, b, steps, v // b AS l, v % b AS r FROM walk WHERE steps = 0 OR v >= n"
    for j in range(shuffle.ROUNDS):
        l, r = ("l", f"(r + {more('l', j)}) % b") if j % 2 else (f"(l + {more('r', j)}) % a", "r")  # noqa: E741
        turns = f"SELECT k, n, a, b, steps, {l} AS l, {r} AS r FROM ({turns})"
    return f"SELECT k, n, a, b, steps + 1, l * b + r FROM ({turns})"


@query("o01_daily_order", f"""WITH RECURSIVE size AS (SELECT n, floor(sqrt(n - 1))::BIGINT + 1 AS a FROM (SELECT count(*) AS n FROM orders)),
 walk AS (SELECT o_orderkey AS k, n, a, (n + a - 1) // a AS b, 0 AS steps, row_number() OVER (ORDER BY o_orderkey) - 1 AS v FROM orders, size UNION ALL {walked(ORDER_DAY)})
 SELECT v AS pos, k AS o_orderkey FROM walk WHERE steps > 0 AND v < n""")  # fmt: skip
def daily_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in the day's order."""
    return ranking.daily_order(table(spark, sf_dir, "orders"), "o_orderkey", ORDER_DAY, f"{store.shared_dir(spark)}/daily-{uuid.uuid4().hex}")


MARKED = " ".join(
    f"WHEN long AND ({' + '.join(f'len(regexp_extract_all(t, {chr(39)}{chr(92)}b(?:{chr(124).join(ms)}){chr(92)}b{chr(39)}))' for ms in (sorted(set(words)), sorted({m for m in words if words.count(m) > 1})) if ms)}) / n > 0.15 THEN '{lang}'"
    for lang, words in text.MARKERS.items()
)


@query("f18_marker_language", rf"""SELECT coalesce(CASE {MARKED} END, 'other') AS lang, count(*) AS n FROM (SELECT t, n, length(text) >= 100 AND n >= 20 AS long
 FROM (SELECT text, lower(substr(text, 1, 600)) AS t, len(regexp_split_to_array(lower(substr(text, 1, 600)), '\s+')) AS n FROM documents)) GROUP BY 1""")  # fmt: skip
def marker_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.coalesce(text.marker_language(F.col("text")), F.lit("other"))
    return table(spark, sf_dir, "documents").groupBy(lang.alias("lang")).agg(F.count("*").alias("n"))


@query("x10_experience", r"""SELECT p_partkey, CASE WHEN regexp_matches(t, '\b(staff|staff\+|distinguished)\b') THEN 'Staff' WHEN regexp_matches(t, '\b(lead|principal|tech lead)\b') THEN 'Lead'
 WHEN regexp_matches(t, '\b(senior|sr\.?|senior level)\b') THEN 'Senior' WHEN regexp_matches(t, '\b(junior|jr\.?|entry|associate|graduate|intern|entry level|entry-level)\b') THEN 'Entry' ELSE 'Mid' END AS level
 FROM (SELECT p_partkey, lower(CASE p_partkey % 5 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Leading ' WHEN 2 THEN 'Jr. ' WHEN 3 THEN 'Staff, ' ELSE '' END || p_name) AS t FROM part)""")  # fmt: skip
def experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    word = F.when(k == 0, "Senior ").when(k == 1, "Leading ").when(k == 2, "Jr. ").when(k == 3, "Staff, ").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", text.experience_of(F.concat(word, "p_name")).alias("level"))


GERMAN = f"regexp_matches(lower(place), '{location.any_of(location.GERMAN_PLACES)}"


@query("f21_surely_german", POSTINGS + f"""SELECT place, count(*) AS n FROM (SELECT Location || CASE JobID % 4 WHEN 0 THEN ', Köln' WHEN 1 THEN ' (Remote)' WHEN 2 THEN ', Paris' ELSE '' END AS place
 FROM postings) WHERE {GERMAN}') AND NOT regexp_matches(lower(place), '{location.any_of(location.OPEN_PLACES)}') GROUP BY 1""")  # fmt: skip
def surely_german(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("JobID") % 4
    place = F.concat("Location", F.when(k == 0, ", Köln").when(k == 1, " (Remote)").when(k == 2, ", Paris").otherwise(""))
    rows = postings(spark, sf_dir).select(place.alias("place")).where(location.surely_german(F.col("place")))
    return rows.groupBy("place").agg(F.count("*").alias("n"))


@query("f35_code_outcome", """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN s_suppkey IS NULL THEN 'not_found' WHEN TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 40 AS INT)) < TIMESTAMP '2024-01-15' THEN 'expired'
 WHEN s_acctbal >= 5000 THEN 'exhausted' ELSE 'valid' END AS outcome FROM events LEFT JOIN supplier ON user_id = s_suppkey) GROUP BY 1""")  # fmt: skip
def code_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "events").join(table(spark, sf_dir, "supplier"), F.col("user_id") == F.col("s_suppkey"), "left")
    expires = F.lit(datetime(2024, 1, 1)) + F.make_dt_interval(days=(F.col("s_suppkey") % 40).cast("int"))
    outcome = accounts.code_outcome(datetime(2024, 1, 15), F.col("s_suppkey").isNotNull(), expires, F.col("s_acctbal"), F.lit(5000))
    return met.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("f39_weekly_meter", "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id) <= 2 AS allowed FROM events WHERE event_type = 'view'")
def weekly_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "events").where("event_type = 'view'")
    return accounts.metered(uses, "user_id", "ts", 2, "event_id").select("event_id", "allowed")


@query("j16_account_resolution", """SELECT event_id, coalesce(a.c_custkey, b.c_custkey) AS user_id, CASE WHEN a.c_custkey IS NOT NULL THEN 'external_id' WHEN b.c_custkey IS NOT NULL THEN 'email' ELSE 'new' END AS "by"
 FROM events LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) a ON user_id = a.c_custkey
 LEFT JOIN (SELECT min(c_custkey) AS c_custkey, c_custkey % 1000 AS mail FROM customer WHERE c_custkey % 2 = 0 GROUP BY 2) b ON user_id % 1000 = b.mail""")  # fmt: skip
def account_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    users = table(spark, sf_dir, "customer").select(
        key.alias("user_id"), F.when(key % 3 == 0, key).alias("external_id"), F.when(key % 2 == 0, key % 1000).alias("email")
    )
    requests = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("external_id"), (F.col("user_id") % 1000).alias("email"))
    return accounts.resolved(requests, users).select("event_id", "user_id", "by")


@query("j02_saved_postings", POSTINGS + """SELECT user_id, JobID, Company, count(*) AS n FROM (SELECT user_id, event_id AS k FROM events WHERE event_type = 'click') JOIN postings ON k = JobID GROUP BY ALL""")
def saved_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'")
    users = clicks.select("user_id", F.array(F.struct(F.col("event_id").alias("JobID"), F.col("ts").alias("savedAt"))).alias("saved"))
    rows = accounts.saved_postings(users, postings(spark, sf_dir), "user_id", "saved")
    return rows.groupBy("user_id", "JobID", "Company").agg(F.count("*").alias("n"))


@query("a29_first_conversions", "SELECT CAST(first AS DATE) AS day, count(*) AS n FROM (SELECT user_id, min(ts) AS first FROM events WHERE event_type = 'signup' GROUP BY 1) GROUP BY 1")
def first_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.conversions(table(spark, sf_dir, "events").where("event_type = 'signup'"), "user_id", "ts")


@query("a02_country_counts", POSTINGS + "SELECT upper(trim(Location)) AS country, count(*) AS n FROM postings WHERE Status = 'active' GROUP BY 1")
def country_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).where("Status = 'active'").groupBy(F.upper(F.trim("Location")).alias("country")).agg(F.count("*").alias("n"))


@query("a07_average_by_kind", "SELECT event_type, round(avg(value), 4) AS mean, count(*) AS n FROM events GROUP BY 1")
def average_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.count("*").alias("n"))


@query("a21_watermark", POSTINGS + "SELECT count(*) AS n, max(scrapedAt) AS latest FROM postings WHERE Status = 'active'")
def watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).where("Status = 'active'").agg(F.count("*").alias("n"), F.max("scrapedAt").alias("latest"))


@query("a17_tally_with_null", POSTINGS + "SELECT coalesce(Workplace, 'null') AS workplace, count(*) AS n FROM postings GROUP BY 1")
def tally_with_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).groupBy(F.coalesce("Workplace", F.lit("null")).alias("workplace")).agg(F.count("*").alias("n"))


@query("j10_last_log", """SELECT o_orderkey, l.k.l_partkey AS part FROM orders JOIN (SELECT l_orderkey, max({'l_shipdate': l_shipdate, 'l_linenumber': l_linenumber, 'l_partkey': l_partkey}) AS k
 FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey""")  # fmt: skip
def last_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey")
    last = store.last_per_key(logs, ["l_orderkey"], "l_shipdate", "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("l_partkey").alias("part"))


@query("j12_uncovered", "SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


@query("j01_latest_with_account", """SELECT o_orderkey, c_name FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100)
 LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0""")  # fmt: skip
def latest_with_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)
    users = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    return latest.join(users, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query("j14_already_redeemed", "SELECT event_id FROM events e WHERE event_type = 'click' AND EXISTS (FROM events r WHERE r.event_type = 'signup' AND r.user_id = e.user_id AND r.props->>'k' = e.props->>'k')")
def already_redeemed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("code", F.get_json_object("props", "$.k"))
    redeemed = events.where("event_type = 'signup'").select("user_id", "code")
    return events.where("event_type = 'click'").join(redeemed, ["user_id", "code"], "left_semi").select("event_id")


@query("j17_new_boards", """SELECT source, count(*) AS yield, min(doc_id) AS first FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE source LIKE '%1%') GROUP BY 1""")
def new_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    found = docs.groupBy("source").agg(F.count("*").alias("yield"), F.min("doc_id").alias("first"))
    known = docs.where("source LIKE '%1%'").select("source").distinct()
    return found.join(known, "source", "left_anti").orderBy(F.desc("yield"), "source")


@query("w05_review_page", POSTINGS + """SELECT JobID, Status FROM postings WHERE Status = 'pending_review' OR (Status = 'active' AND PostedDate IS NULL)
 ORDER BY CASE Status WHEN 'pending_review' THEN 0 ELSE 1 END, scrapedAt DESC, JobID LIMIT 20 OFFSET 20""")  # fmt: skip
def review_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = F.col("Status") == "pending_review"
    rows = postings(spark, sf_dir).where(pending | ((F.col("Status") == "active") & F.col("PostedDate").isNull()))
    return facets.page(rows, 2, 20, F.when(pending, 0).otherwise(1), F.desc("scrapedAt"), F.col("JobID").asc()).select("JobID", "Status")


@query("a23_distinct_values", POSTINGS + """SELECT count(DISTINCT Workplace) AS workplaces, count(DISTINCT Category) AS categories, count(DISTINCT Experience) AS levels,
 count(DISTINCT Company) AS companies, count(*) AS n FROM postings""")  # fmt: skip
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"workplaces": "Workplace", "categories": "Category", "levels": "Experience", "companies": "Company"}
    return postings(spark, sf_dir).agg(*[F.countDistinct(c).alias(n) for n, c in named.items()], F.count("*").alias("n"))


@query("a26_unique_and_repeated", "SELECT count(*) AS names, count(*) FILTER (n > 1) AS repeated, sum(n)::BIGINT AS total FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1)")
def unique_and_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    return names.agg(F.count("*").alias("names"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum("n").alias("total"))


@query("x42_set_hash", "SELECT p_brand, md5(array_to_string(list_sort(list(DISTINCT p_type)), '|')) AS hash FROM part GROUP BY 1")
def set_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_join(F.array_sort(F.collect_set("p_type")), "|")  # a brand's types, few at any scale
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.md5(names).alias("hash"))
