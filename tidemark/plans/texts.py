"""Queries on names, categories, pay and prose of postings, each with the same query for DuckDB."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import canonical, categories, names, pay, prose, shuffle
from tidemark.operators import ingest, location, projections, ranking, store
from tidemark.plans.fixture import JOBS, jobs
from tidemark.plans.queries import query, table

AS_OF = datetime(1998, 1, 1)
col = F.col


def any_sql(text: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"


def company_sql(x: str) -> str:
    """The rule for company keys as DuckDB SQL."""
    key = f"lower(trim({x}))"
    for form in names.LEGAL_FORMS:
        key = f"regexp_replace({key}, '[,s]+{re.escape(form)}s*$', '')"
    cut = "CASE " + " ".join(f"WHEN suffix(k, '{f}') AND length(trim(left(k, length(k) - {len(f)}))) > 1 THEN trim(left(k, length(k) - {len(f)}))" for f in names.LEGAL_FORMS) + " ELSE k END"
    return f"(SELECT trim(regexp_replace(regexp_replace({cut}, '[,.\\-]+$', ''), '\\s+', ' ', 'g')) FROM (SELECT {key} AS k))"


@query("x16_company_key", JOBS + f"SELECT DISTINCT Company AS company, {company_sql('Company')} AS key FROM jobs")
def company_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).select(col("Company").alias("company")).distinct().withColumn("key", names.company_key(col("company")))


CITY = "trim(regexp_replace(trim(regexp_extract(lower(trim(Location)), '^[^,;|–—-]*')), '^remote\\s*[-–—]?\\s*', ''))"


@query("x15_entity_key", JOBS + f"SELECT key, count(*) AS n FROM (SELECT {company_sql('Company')} || '|' || lower(trim(JobTitle)) || '|' || {CITY} AS key FROM jobs) GROUP BY 1")
def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).groupBy(names.entity_key(col("JobTitle"), col("Company"), col("Location")).alias("key")).agg(F.count("*").alias("n"))


@query("w04_first_arrivals", JOBS + f"SELECT min(JobID) AS JobID FROM jobs GROUP BY {company_sql('Company')}, lower(trim(JobTitle))")
def first_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_arrivals(jobs(spark, sf_dir).select("JobID", "JobTitle", "Company"), "JobTitle", "Company", "JobID").select("JobID")


DOMAIN = """CASE WHEN regexp_matches(h, '(^|\\.)(greenhouse\\.io|lever\\.co|ashbyhq\\.com|workable\\.com|smartrecruiters\\.com|recruitee\\.com|jobs\\.personio\\.de|jobs\\.personio\\.com|teamtailor\\.com|myworkdayjobs\\.com)$') THEN NULL
 ELSE nullif(regexp_replace(h, '^(?:(?:www|careers|career|jobs|job|apply|hire|work|join|boards|recruiting)\\.)+([^.]+\\.[^.]+)', '\\1'), '') END"""
HOST = "lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


@query("x19_company_domain", JOBS + f"SELECT domain, count(*) AS n FROM (SELECT {DOMAIN} AS domain FROM (SELECT {HOST.format('u')} AS h FROM (SELECT ApplicationURL AS u FROM jobs UNION ALL SELECT url FROM pages))) GROUP BY 1")
def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = jobs(spark, sf_dir).select(col("ApplicationURL").alias("u")).unionByName(table(spark, sf_dir, "pages").select(col("url").alias("u")))
    return urls.groupBy(names.company_domain(col("u")).alias("domain")).agg(F.count("*").alias("n"))


SLUG = "left(regexp_replace(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80)"


@query("x20_slug", JOBS + f"SELECT slug, count(*) AS n FROM (SELECT {SLUG.format("Location || ' ' || JobTitle || ' Élan für Ñandú'")} AS slug FROM jobs) GROUP BY 1")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("Location", F.lit(" "), "JobTitle", F.lit(" Élan für Ñandú"))
    return jobs(spark, sf_dir).groupBy(names.slug(text).alias("slug")).agg(F.count("*").alias("n"))


@query("x21_unique_slug", f"SELECT p_partkey, CASE r WHEN 1 THEN s ELSE s || '-' || r END AS unique_slug FROM (SELECT p_partkey, s, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS r FROM (SELECT p_partkey, {SLUG.format('p_name')} AS s FROM part))")
def unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.visitors import unique_slugs as unique

    rows = table(spark, sf_dir, "part").select("p_partkey", names.slug(col("p_name")).alias("s"))
    return unique(rows, "s", "p_partkey").select("p_partkey", "unique_slug")


@query("x41_board_guesses", JOBS + """SELECT DISTINCT Company AS company, array_to_string(list_filter(CASE WHEN j = d AND j = f THEN [j] WHEN j = d THEN [j, f] WHEN d = f THEN [j, d] WHEN j = f THEN [j, d] ELSE [j, d, f] END, lambda s: length(s) >= 3), ',') AS guesses
 FROM (SELECT Company, regexp_replace(lower(trim(Company)), '[^a-z0-9]+', '', 'g') AS j, regexp_replace(regexp_replace(lower(trim(Company)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS d,
  split_part(regexp_replace(regexp_replace(lower(trim(Company)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '-', 1) AS f FROM jobs)""")  # fmt: skip
def board_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir).select(col("Company").alias("company")).distinct()
    return rows.withColumn("guesses", F.array_join(names.board_guesses(col("company")), ","))


def category_sql() -> str:
    t, s, d = (f"' ' || lower(coalesce({c}, '')) || ' '" for c in ("JobTitle", "SubDomain", "Department"))
    c = categories
    hint = any_sql("lower(coalesce(SubDomain, ''))", c.SOFTWARE_AREAS + c.DATA_AREAS)
    product = f"CASE WHEN Domain = 'Technical' THEN 'product_tech' WHEN Domain = 'Non-Technical' THEN 'product_nontech' WHEN {hint} THEN 'product_tech' ELSE 'product_nontech' END"
    rules = [(t, c.OTHER_TITLES, "'other_nontech'"), (t, c.DATA_TITLES, "'data'"), (t, c.SOFTWARE_TITLES, "'software'"), (t, c.PRODUCT_TITLES, product),
             (s, c.DATA_AREAS, "'data'"), (s, c.SOFTWARE_AREAS, "'software'"), (s, c.PRODUCT_AREAS, product), (d, c.SOFTWARE_AREAS, "'software'"), (d, c.DATA_AREAS, "'data'")]
    return "CASE " + " ".join(f"WHEN {any_sql(x, words)} THEN {value}" for x, words, value in rules) + " WHEN Domain = 'Technical' THEN 'other_tech' ELSE 'other_nontech' END"


@query("x08_category", JOBS + f"SELECT JobID, {category_sql()} AS category FROM jobs")
def category(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.lit(None).cast("array<string>")
    return jobs(spark, sf_dir).select("JobID", categories.category(col("JobTitle"), col("Department"), col("SubDomain"), col("Domain"), tags).alias("category"))


@query("x09_domain", JOBS + f"SELECT JobID, CASE WHEN {any_sql("lower(coalesce(Department, '') || ' ' || JobTitle)", categories.TECHNICAL)} THEN 'Technical' ELSE 'Non-Technical' END AS domain FROM jobs")
def domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).select("JobID", categories.domain(col("Department"), col("JobTitle")).alias("domain"))


SCALE = "CASE WHEN {0} > 0 AND {0} < CASE WHEN coalesce(SalaryInterval, '') IN ('', 'yearly') THEN 1000 WHEN SalaryInterval IN ('monthly', 'per-month-salary') THEN 100 END THEN {0} * 1000 ELSE {0} END"
NO_PAY = "coalesce(SalaryMin, 0) = 0 AND coalesce(SalaryMax, 0) = 0"


@query("x11_repaired_pay", JOBS + f"""SELECT JobID, CASE WHEN NOT ({NO_PAY}) THEN {SCALE.format('SalaryMin')} END AS min, CASE WHEN NOT ({NO_PAY}) THEN {SCALE.format('SalaryMax')} END AS max,
 CASE WHEN NOT ({NO_PAY}) THEN SalaryCurrency END AS currency FROM jobs""")  # fmt: skip
def repaired_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pay.repaired(*[col(c) for c in ("SalaryMin", "SalaryMax", "SalaryCurrency", "SalaryInterval")])
    return jobs(spark, sf_dir).select("JobID", made.alias("p")).select("JobID", "p.min", "p.max", "p.currency")


@query("x29_validated_pay", JOBS + """SELECT JobID, CASE WHEN ok THEN least(lo, hi) END AS min, CASE WHEN ok THEN CASE WHEN lo > hi THEN lo ELSE hi END END AS max, CASE WHEN ok THEN money END AS currency, CASE WHEN ok THEN kind END AS interval
 FROM (SELECT *, CASE WHEN lo > hi THEN hi ELSE lo END AS a, (lo IS NOT NULL OR hi IS NOT NULL) AND money IS NOT NULL
  AND coalesce(lo BETWEEN l AND m, true) AND coalesce(hi BETWEEN l AND m, true) AS ok
  FROM (SELECT *, CASE kind WHEN 'yearly' THEN 10000 WHEN 'monthly' THEN 800 ELSE 5 END AS l, CASE kind WHEN 'yearly' THEN 1000000 WHEN 'monthly' THEN 100000 ELSE 2000 END AS m
   FROM (SELECT JobID, salary_min AS lo, salary_max AS hi, CASE WHEN upper(SalaryCurrency) IN ('EUR', 'USD', 'GBP', 'CHF') THEN upper(SalaryCurrency) END AS money,
    CASE WHEN SalaryInterval IN ('yearly', 'monthly', 'hourly') THEN SalaryInterval ELSE 'yearly' END AS kind FROM jobs)))""".replace("least(lo, hi)", "a"))  # fmt: skip
def validated_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pay.validated(*[col(c) for c in ("salary_min", "salary_max", "SalaryCurrency", "SalaryInterval")])
    return jobs(spark, sf_dir).select("JobID", made.alias("p")).select("JobID", "p.*")


@query("x43_filled_pay", JOBS + """SELECT JobID, CASE WHEN SalaryMin IS NULL AND (salary_min IS NOT NULL OR salary_max IS NOT NULL) THEN salary_min ELSE SalaryMin END AS min,
 CASE WHEN SalaryMin IS NULL AND (salary_min IS NOT NULL OR salary_max IS NOT NULL) THEN salary_max ELSE SalaryMax END AS max FROM (SELECT JobID, "SalaryMin" AS SalaryMin, "SalaryMax" AS SalaryMax, "salary_min" AS salary_min, "salary_max" AS salary_max FROM jobs)""")  # fmt: skip
def filled_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = {"min": col("SalaryMin"), "max": col("SalaryMax"), "currency": F.lit(None), "interval": F.lit(None)}
    made = pay.filled(own, {"min": col("salary_min"), "max": col("salary_max"), "currency": F.lit(None), "interval": F.lit(None)})
    return jobs(spark, sf_dir).select("JobID", made["min"].alias("min"), made["max"].alias("max"))


@query("f36_suspect_pay", JOBS + "SELECT JobID FROM jobs WHERE (SalaryMin > 0 AND SalaryMin < 1000) OR (SalaryMax > 0 AND SalaryMax < 1000)")
def suspect_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).where(pay.suspect(col("SalaryMin"), col("SalaryMax"))).select("JobID")


@query("x31_pay_from_text", """SELECT o_orderkey, nullif(regexp_extract(c, '(\\d{2,7}(?:\\.\\d+)?)\\s*(?:-|to)\\s*(\\d{2,7}(?:\\.\\d+)?)', 1), '')::DOUBLE AS min, nullif(regexp_extract(c, '(\\d{2,7}(?:\\.\\d+)?)\\s*(?:-|to)\\s*(\\d{2,7}(?:\\.\\d+)?)', 2), '')::DOUBLE AS max,
 CASE o_orderkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' END AS currency, CASE o_orderkey % 4 WHEN 0 THEN 'per-year-salary' WHEN 1 THEN 'per-hour-wage' WHEN 2 THEN 'per-month-salary' END AS interval
 FROM (SELECT o_orderkey, replace(replace(t, '.', ''), ',', '.') AS c FROM (SELECT o_orderkey, concat('Pay: ', CAST(o_orderkey % 90 AS VARCHAR), '.000 ', CASE o_orderkey % 3 WHEN 0 THEN '€' WHEN 1 THEN 'usd' ELSE '' END, ' - 95.500,5 ',
  CASE o_orderkey % 4 WHEN 0 THEN 'hourly or annual' WHEN 1 THEN '/hour' WHEN 2 THEN 'per month' ELSE '' END) AS t FROM orders))""".replace("' - 95", "'- 95").replace("WHEN 0 THEN '€' WHEN 1 THEN 'usd'", "WHEN 0 THEN '' WHEN 1 THEN ''").replace("'Pay: '", "CASE o_orderkey % 3 WHEN 0 THEN '€ ' WHEN 1 THEN 'usd ' ELSE '' END"))  # fmt: skip
def pay_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("o_orderkey")
    text = F.concat(
        F.when(k % 3 == 0, "€ ").when(k % 3 == 1, "usd ").otherwise(""), (k % 90).cast("string"), F.lit(".000 - 95.500,5 "),
        F.when(k % 4 == 0, "hourly or annual").when(k % 4 == 1, "/hour").when(k % 4 == 2, "per month").otherwise(""),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", pay.from_text(text).alias("p")).select("o_orderkey", "p.*")


@query("x38_pay_label", """SELECT o_orderkey, CASE WHEN lo IS NULL AND hi IS NULL THEN '' ELSE CASE WHEN hi IS NULL THEN 'from ' || a WHEN lo IS NULL THEN 'up to ' || b WHEN lo = hi THEN a ELSE a || ' – ' || b END || ' / year' END AS label
 FROM (SELECT *, '€' || format('{:,}', lo) AS a, '€' || format('{:,}', hi) AS b FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CAST(round(o_totalprice) AS BIGINT) END AS lo, CASE WHEN o_orderkey % 5 > 1 THEN CAST(round(o_totalprice) AS BIGINT) + o_orderkey % 2 END AS hi FROM orders))""")
def pay_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, whole = col("o_orderkey"), F.round("o_totalprice").cast("long")
    made = pay.label(F.when(k % 3 > 0, whole), F.when(k % 5 > 1, whole + k % 2), F.lit("eur"), F.lit("per-year-salary"))
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("label"))


def found_sql(x: str, table_: dict[str, list[str]]) -> str:
    quoted = lambda vs: ", ".join(f"'{v}'" for v in vs)
    return f"CASE {' '.join(f'WHEN lower(trim({x})) IN ({quoted(vs)}) THEN {chr(39)}{k}{chr(39)}' for k, vs in table_.items())} END"


for _key, _made, _sql in (
    ("x01_workplace", lambda: canonical.workplace(col("remote_policy_detail"), col("WorkplaceType"), col("Location")),
     f"coalesce({found_sql('remote_policy_detail', canonical.WORKPLACE)}, {found_sql('WorkplaceType', canonical.WORKPLACE)}, CASE WHEN contains(lower(Location), 'remote') THEN 'remote' END)"),
    ("x02_experience", lambda: canonical.experience(F.lit(None), col("ExperienceLevel"), col("JobID") % 6 == 0), f"coalesce({found_sql('ExperienceLevel', canonical.EXPERIENCE)}, CASE WHEN JobID % 6 = 0 THEN 'entry' END)"),
    ("x03_employment", lambda: canonical.employment(F.lit(None), col("EmploymentType")), found_sql("EmploymentType", canonical.EMPLOYMENT)),
    ("x04_offers", lambda: canonical.confirmed(col("visa_sponsorship")), "CASE WHEN visa_sponsorship = 'available' THEN 'available' END"),
    ("x12_workplace_name", lambda: location.workplace_name(col("WorkplaceType")), "CASE WHEN contains(lower(WorkplaceType), 'remote') THEN 'Remote' WHEN contains(lower(WorkplaceType), 'hybrid') THEN 'Hybrid' ELSE 'Unspecified' END"),
    ("x12_employment_name", lambda: location.employment_name(col("EmploymentType")), "CASE EmploymentType WHEN 'Full-time' THEN 'FullTime' WHEN 'full_time' THEN 'FullTime' WHEN 'PartTime' THEN 'PartTime' WHEN 'Intern' THEN 'Intern' WHEN 'temp' THEN 'Temporary' WHEN 'Freelance contract' THEN 'Contract' END"),
    ("x12_country_code", lambda: location.country_code(col("CountryCode")), "CASE trim(CountryCode) WHEN '' THEN NULL WHEN 'DEU' THEN 'DEU' ELSE upper(trim(CountryCode)) END"),
    ("f22_mentions_germany", lambda: location.mentions_germany(col("Location")).cast("string"), f"({any_sql('lower(Location)', location.GERMAN_PLACES)} OR regexp_matches(lower(Location), '\\bde\\b'))::VARCHAR"),
    ("f14_banned_role", lambda: F.lower("JobTitle").rlike("|".join(ingest.BANNED_ROLES)).cast("string"), f"{any_sql('lower(JobTitle)', ingest.BANNED_ROLES)}::VARCHAR"),
    ("f15_keywords", lambda: ingest.fits_keywords(col("JobTitle"), ["Engineer", "manager"]).cast("string"), "(contains(lower(JobTitle), 'engineer') OR contains(lower(JobTitle), 'manager'))::VARCHAR"),
    ("x40_filled_workplace", lambda: location.filled_workplace(col("WorkplaceType"), col("Location"), F.concat(F.lit("we are "), "JobTitle")),
     "CASE WHEN WorkplaceType IS NOT NULL THEN WorkplaceType WHEN contains(lower(Location), 'remote') THEN 'Remote' WHEN contains(lower(Location), 'hybrid') THEN 'Hybrid' ELSE 'Unspecified' END"),
):

    def _run(spark: SparkSession, sf_dir: str, made=_made) -> DataFrame:  # noqa: ANN001
        return jobs(spark, sf_dir).groupBy(made().alias("value")).agg(F.count("*").alias("n"))

    query(_key, JOBS + f"SELECT {_sql} AS value, count(*) AS n FROM jobs GROUP BY 1")(_run)


GERMAN_CITY = any_sql("lower(x)", location.GERMAN_PLACES)


#: Places of postings: the place, further ones, whether it is in Germany, and how it is stored.
SITES = [
    ("Bremen", None, True, "Bremen, Germany"), ("Walldorf, BW", None, True, "Walldorf, Germany"), ("fürth - Hybrid", None, True, "Fürth, Germany"),
    ("Kaiserslautern", None, True, "Kaiserslautern, Germany"), ("Vienna", "Graz|erlangen, Bavaria", True, "Erlangen, Germany"), ("Deutschland", None, True, "Germany"),
    ("Remote - Germany", None, True, "Remote - Germany, Germany"), ("Remote, Germany", None, True, "Remote, Germany"), ("German speaking, Vienna", None, False, "German speaking, Vienna"),
    ("Paris, paris, France", "Lyon", False, "Paris, France"), (None, "Villingen-Schwenningen", True, "Villingen-schwenningen, Germany"), (None, None, False, "Germany"),
    ("Schwäbisch Gmünd – Onsite", None, True, "Schwäbisch Gmünd, Germany"), ("Zürich", "", False, "Zürich"),
]
said = lambda v: "NULL" if v is None else f"'{v}'"
AT = f"(VALUES {', '.join(f'({k}, {said(p)}, {str(g).upper()}, {said(s)})' for k, (p, _, g, s) in enumerate(SITES))}) AS site(k, place, german, stored)"
#: Further names that a caller passes besides the list.
MORE_PLACES = ("erlangen", "fürth", "walldorf")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a place each."""
    pick = lambda j: F.element_at(F.array(*[F.lit(s[j]) for s in SITES]), (col("c_custkey") % len(SITES) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", pick(0).alias("place"), F.split(pick(1), r"\|").alias("others"))


@query("f16_names_germany", f"SELECT c_custkey, german FROM customer JOIN {AT} ON c_custkey % {len(SITES)} = k")
def still_german(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (*location.GERMAN_CITIES, *MORE_PLACES)
    return sites(spark, sf_dir).select("c_custkey", location.still_germany(col("place"), col("others"), names).alias("german"))


@query("x13_stored_place_named", f"SELECT c_custkey, stored AS place FROM customer JOIN {AT} ON c_custkey % {len(SITES)} = k")
def stored_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (*location.GERMAN_CITIES, *MORE_PLACES)
    return sites(spark, sf_dir).select("c_custkey", location.stored_place(col("place"), col("others"), F.lit(False), names).alias("place"))


@query("x13_stored_place", JOBS + """SELECT place, count(*) AS n FROM (SELECT CASE Location WHEN 'Berlin, Germany' THEN 'Berlin, Germany' WHEN 'Remote - Germany' THEN 'Remote - Germany, Germany' WHEN 'München' THEN 'München, Germany' WHEN 'Paris, France' THEN 'Paris, France'
 WHEN 'Köln - Hybrid' THEN 'Köln, Germany' WHEN 'Rio de Janeiro' THEN 'Rio de Janeiro' WHEN '' THEN 'Germany' WHEN 'Ulm, Baden, ulm' THEN 'Ulm, Germany' WHEN 'Frankfurt am main; Bonn' THEN 'Frankfurt Am Main; Bonn, Germany' ELSE 'Remote Kiel|jena, Germany' END AS place FROM jobs) GROUP BY 1""")
def stored_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = location.stored_place(col("Location"), F.lit(None).cast("array<string>"), F.lit(False))
    return jobs(spark, sf_dir).groupBy(made.alias("place")).agg(F.count("*").alias("n"))


def undone(t: str) -> str:
    """The entities that the pages hold, as SQL; the ampersand last."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("apos", "''"), ("nbsp", "\u00A0"), ("copy", "©"), ("middot", "·")):
        t = f"replace({t}, '&{name};', '{char}')"
    return f"replace(regexp_replace({t}, '&amp([^A-Za-z0-9;]|$)', '&\\1', 'g'), '&amp;', '&')"


TAGLESS = f"regexp_replace({undone('html')}, '<[^>]+>', '', 'g')"


@query("x17_bare_text", rf"""SELECT page_id, md5(trim(regexp_replace(t, '[\s\x{{00A0}}]+', ' ', 'g'))) AS text FROM (SELECT page_id, {undone(TAGLESS)} AS t FROM pages)""")
def bare_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(prose.bare(col("html"))).alias("text"))


@query("p17_gated_preview", "SELECT doc_id, substr(text, 1, 150) || '...' AS preview FROM documents")
def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", prose.gated_preview(col("text")).alias("preview"))


@query("x34_german_context", r"""SELECT doc_id, CASE WHEN length(t) >= 100 THEN md5(trim(substr(t, greatest(p - 1000, 0)::BIGINT + 1, p + 8 + 1000 - greatest(p - 1000, 0)), E' \n\t\r\x0b\x0c')) END AS context FROM (SELECT doc_id, t, instr(t, 'german required'::VARCHAR) - 1 AS p
 FROM (SELECT doc_id, regexp_replace(text, '[^a-z \n]', 'x', 'g') || ' german required ' || regexp_replace(text, '[^a-z \n]', 'x', 'g') AS t FROM documents)) WHERE p >= 0""".replace("p + 8", "p + 15"))  # fmt: skip
def german_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.regexp_replace("text", "[^a-z \n]", "x")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(clean, F.lit(" german required "), clean).alias("t"))
    return rows.select("doc_id", F.md5(prose.german_context(col("t"))).alias("context"))


@query("x36_words", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\s\x{00A0}]+'), lambda w: w <> '')) AS n, array_to_string(regexp_split_to_array(regexp_replace(text, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g'), '[\s\x{00A0}]+')[1:7], ' ') AS head FROM documents")
def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", prose.n_words(col("text")).alias("n"), prose.first_words(col("text"), 7).alias("head"))


@query("x37_days_ago", "SELECT o_orderkey, CASE WHEN d IS NULL THEN '' WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' ELSE d || ' days ago' END AS label FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN date_diff('day', o_orderdate, TIMESTAMP '1998-01-01') END AS d FROM orders)")
def days_ago(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.when(col("o_orderkey") % 10 > 0, col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", prose.days_ago(ts, AS_OF).alias("label"))


@query("x39_tier", "SELECT tier, count(*) AS n FROM (SELECT CASE WHEN value >= 85 THEN 'strong' WHEN value >= 65 THEN 'good' ELSE 'partial' END AS tier FROM events) GROUP BY 1")
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(prose.tier(col("value")).alias("tier")).agg(F.count("*").alias("n"))


@query("x30_reply_json", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey % 9 END AS n FROM orders")
def reply_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("o_orderkey")
    body = F.format_string('{"n": %d, "s": "x"}', k % 9)
    reply = F.when(k % 4 == 0, body).when(k % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 4 == 2, F.concat(F.lit("Here: "), body, F.lit(" Done."))).otherwise("no json { here")
    return table(spark, sf_dir, "orders").select("o_orderkey", prose.reply_json(reply, "n long, s string")["n"].alias("n"))


@query("x32_by_key_part", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS value FROM orders")
def key_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("o_orderkey")
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"))
    entries = F.when(k % 3 == 0, F.array(pair("Job Salary", "a"), pair("pay", "b"))).when(k % 3 == 1, F.array(pair("x", "c"), pair("Base PAY range", "b"))).otherwise(F.array(pair("x", "c")))
    return table(spark, sf_dir, "orders").select("o_orderkey", prose.by_key_part(entries, ["salary", "pay"]).alias("value"))


@query("u04_clean_list", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'a,x' ELSE 'b,a' END AS tags FROM orders")
def clean_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(col("o_orderkey") % 3 == 0, F.array(F.lit(" a"), F.lit(""), F.lit("x "), F.lit("a"), F.lit(None))).otherwise(F.array(F.lit("b"), F.lit(" a ")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(names.clean_list(tags), ",").alias("tags"))


@query("x22_content_hash", "SELECT user_id, sha256(array_to_string(list_sort(list(event_id::VARCHAR)), chr(10))) AS hash FROM events GROUP BY 1")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(store.content_hash(F.collect_list(col("event_id").cast("string"))).alias("hash"))


@query("x24_fnv1a", """SELECT c_custkey, list_reduce(list_prepend(2166136261, list_transform(string_split(c_name || '/2026', ''), lambda c: unicode(c)::BIGINT)),
 lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS seed FROM customer""")  # fmt: skip
def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32-bit hash of each customer's name."""
    return table(spark, sf_dir, "customer").select("c_custkey", shuffle.fnv1a_of(F.concat("c_name", F.lit("/2026"))).alias("seed"))


ENGLISH = "JobTitle <> '' AND NOT contains(lower(JobTitle), 'werkstudent') AND NOT contains(lower(JobTitle), 'german-speaking')"


@query("a27_ingest_summary", JOBS + """SELECT sourceSite AS site, CASE WHEN JobTitle = '' THEN 'no_title' WHEN contains(lower(JobTitle), 'werkstudent') THEN 'banned_role' WHEN contains(lower(JobTitle), 'german-speaking') THEN 'german_title' ELSE 'accepted' END AS reason, count(*) AS n
 FROM jobs GROUP BY ALL""")  # fmt: skip
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir).withColumn("Description", F.lit("short")).withColumn("reject_reason", ingest.reject_reason())
    return ingest.summary(rows, "sourceSite").withColumnRenamed("sourceSite", "site")


@query("f25_judged", JOBS + f"""SELECT Status AS status, count(*) AS n FROM (SELECT CASE WHEN NOT ({ENGLISH}) THEN 'rejected' WHEN JobID % 9 = 0 THEN 'pending_review' WHEN JobID % 8 = 0 THEN 'rejected' WHEN (JobID % 100) / 100 < 0.6 THEN 'rejected'
 WHEN (JobID % 100) / 100 >= 0.85 THEN 'active' ELSE 'pending_review' END AS Status FROM jobs) GROUP BY 1""")  # fmt: skip
def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.text import fingerprint

    rows = jobs(spark, sf_dir).drop("Status").withColumn("Description", F.concat(F.lit("job "), col("JobID").cast("string")))
    known = rows.where("JobID % 9 <> 0")
    verdicts = known.select(fingerprint(col("JobTitle"), col("Company"), col("Description")).alias("fingerprint"), (col("JobID") % 8 == 0).alias("german"), ((col("JobID") % 100) / 100).alias("confidence"))
    return ingest.judged(rows, verdicts).groupBy(col("Status").alias("status")).agg(F.count("*").alias("n"))


TEASED = ["JobID", "Company", "filterWorkplace", "filterVisa", "filterRelocation", "companyDomain", "applyClicks"]
TEASER_SQL = f"""JobID, Company, coalesce({found_sql('remote_policy_detail', canonical.WORKPLACE)}, {found_sql('WorkplaceType', canonical.WORKPLACE)}, CASE WHEN contains(lower(Location), 'remote') THEN 'remote' END) AS "filterWorkplace",
 CASE WHEN visa_sponsorship = 'available' THEN 'available' END AS "filterVisa", CASE WHEN relocation_support = 'available' THEN 'available' END AS "filterRelocation", {DOMAIN} AS "companyDomain", 0 AS "applyClicks" """


@query("p12_teaser", JOBS + f"SELECT {TEASER_SQL} FROM (SELECT *, {HOST.format('ApplicationURL')} AS h FROM jobs)")
def teasers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.teaser(jobs(spark, sf_dir).drop("salary_min", "salary_max")).select(*TEASED)


@query("p13_detail", JOBS + f"SELECT JobID, ApplicationURL AS \"ApplicationURL\", {DOMAIN} AS \"companyDomain\", 0 AS \"applyClicks\" FROM (SELECT *, {HOST.format('ApplicationURL')} AS h FROM jobs)")
def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.detail(jobs(spark, sf_dir).drop("salary_min", "salary_max")).select("JobID", "ApplicationURL", "companyDomain", "applyClicks")


@query("p14_bait", JOBS + f"""SELECT JobID, JobTitle AS "JobTitle", {DOMAIN} AS "companyDomain" FROM (SELECT *, {HOST.format('ApplicationURL')} AS h FROM jobs WHERE Status = 'active')
 ORDER BY coalesce(PostedDate, TIMESTAMP '1970-01-01') DESC, JobID LIMIT 9""")  # fmt: skip
def baits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import facets

    rows = facets.page(jobs(spark, sf_dir).drop("salary_min", "salary_max").where("Status = 'active'"), 1, 9, *facets.newest_first())
    return projections.bait(rows).select("JobID", "JobTitle", "companyDomain")


YEAR = "CAST(floor({0} * CASE lower(SalaryInterval) WHEN 'monthly' THEN 12 WHEN 'hourly' THEN 2080 ELSE 1 END * CASE upper(SalaryCurrency) WHEN 'EUR' THEN 1.0::DOUBLE WHEN 'USD' THEN 0.92::DOUBLE WHEN 'GBP' THEN 1.17::DOUBLE END + 0.5) AS BIGINT)"
BOUND = "CASE WHEN {0} > 0 AND " + YEAR + " BETWEEN 10000 AND 1000000 THEN " + YEAR + " END"


@query("x06_resolved", JOBS + f"""SELECT JobID, CASE WHEN anything THEN lo END AS "filterSalaryMin", CASE WHEN anything THEN hi END AS "filterSalaryMax", CASE WHEN anything THEN 'ats' END AS "filterSalaryTier"
 FROM (SELECT *, coalesce(SalaryMin > 0, false) OR coalesce(SalaryMax > 0, false) AS has, (lo IS NOT NULL OR hi IS NOT NULL) AS anything FROM (SELECT *, {BOUND.format('SalaryMin')} AS lo, {BOUND.format('SalaryMax')} AS hi FROM jobs))""")  # fmt: skip
def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projections.resolved(jobs(spark, sf_dir).drop("salary_min", "salary_max"))
    return rows.select("JobID", "filterSalaryMin", "filterSalaryMax", "filterSalaryTier")
