"""More columns for the postings of the test tables, written so that Spark and DuckDB read them alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.queries import table

TITLES = [
    "Senior Data Engineer", "Product Marketing Manager", "Product Manager", "Backend Developer ", "Werkstudent Sales",
    "Staff Engineer (German-speaking)", "Account Executive", "Junior Analyst", "Head of Things", "UX Designer", "Lead Firmware", "",
]
FORMS = [" GmbH", ", Inc.", " SE", "", " AG", " B.V.", " U.K. Limited", " GmbH & Co. KG", " sarl", ",ltd.", " Visa", "  Enterprise"]
PLACES = ["Berlin, Germany", "Remote - Germany", "München", "Paris, France", "Köln - Hybrid", "Rio de Janeiro", "", "Ulm, Baden, ulm", "Frankfurt am main; Bonn", "remote Kiel|Jena"]
URLS = [
    "https://boards.greenhouse.io/x", "https://careers.acme.com/a", "https://www.jobs.example.org:8080/b?c", "http://user@work.join.foo.de/",
    "not a url", "https://apply.jobs.personio.de/x", "https://jobs.io", "https://x.lever.co", "https://www.jobs.com",
]
AREAS = ["Engineering", "Machine Learning", "Product Design", "", None]
DEPARTMENTS = ["IT", "Sales", "Data Platform", None, "Security", "Facilities"]
CODES = ["de", " DEU ", "fr", "", None]
POLICIES = ["fully_remote", "not_mentioned", None, "hybrid", "on_site"]
KINDS = ["Full-time", "Intern", "full_time", None, "Freelance contract", "PartTime", "temp"]


def pick(key: str, values: list) -> str:
    """One of the values by a number, as SQL."""
    said = lambda v: "NULL" if v is None else f"'{v}'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {said(v)}" for k, v in enumerate(values)) + " END"


K = "o_orderkey"
COLUMNS = {
    "JobID": K, "JobTitle": pick(K, TITLES), "Company": f"concat(c_name, {pick('o_custkey', FORMS)})", "Location": pick(K, PLACES),
    "ApplicationURL": pick(K, URLS), "SubDomain": pick(K, AREAS), "Department": pick(K, DEPARTMENTS), "CountryCode": pick(K, CODES),
    "remote_policy_detail": pick(K, POLICIES), "EmploymentType": pick(K, KINDS), "WorkplaceType": pick("o_custkey", ["Remote", "x", None, "Hybrid"]),
    "ExperienceLevel": pick("o_custkey", ["Senior", "mid", None, "CTO", "intern"]), "visa_sponsorship": pick(K, ["available", "not_available", None]),
    "relocation_support": pick("o_custkey", ["available", None]),
    "Domain": pick("o_custkey", ["Technical", "Non-Technical", None]),
    "Status": "CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'pending_review' ELSE 'rejected' END",
    "approvalMethod": pick("o_custkey", ["ai_auto", "manual", None]), "sourceSite": pick("o_custkey", ["Curated", "Test Site", "Other", None]),
    "reviewedAt": f"CASE WHEN {K} % 5 = 0 THEN o_orderdate + INTERVAL 3 DAY END", "createdAt": "o_orderdate", "updatedAt": "o_orderdate + INTERVAL 1 DAY",
    "GermanRequired": f"CASE WHEN {K} % 11 = 0 THEN NULL ELSE o_custkey % 7 = 0 END",
    "SalaryMin": f"CASE {K} % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN 55.0 WHEN 2 THEN 0.0 END", "SalaryMax": f"CASE {K} % 3 WHEN 0 THEN o_totalprice * 2 WHEN 1 THEN 75.0 END",
    "SalaryCurrency": pick(K, ["EUR", "usd", "XXX", None, "GBP"]), "SalaryInterval": pick("o_custkey", ["yearly", "monthly", None, "per-month-salary", "hourly"]),
    "salary_min": f"CASE {K} % 2 WHEN 0 THEN 60000.0 END", "salary_max": f"CASE {K} % 7 WHEN 0 THEN 50000.0 WHEN 1 THEN 70.0 END",
    "PostedDate": f"CASE WHEN {K} % 10 <> 0 THEN o_orderdate END", "Category": "c_mktsegment",
}
JOBS = "WITH jobs AS (SELECT " + ", ".join(f'{sql} AS "{name}"' for name, sql in COLUMNS.items()) + " FROM orders JOIN customer ON o_custkey = c_custkey) "


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(*[F.expr(sql).alias(name) for name, sql in COLUMNS.items()])
