"""Whole feeds from landed JSON that is made of the documents, each with what must come out beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.queries import query, table
from tidemark.plans.stores import folder
from tidemark.sources import whole

col = F.col
# the same characters for both engines, and none that JSON would escape
CLEAN = "regexp_replace(substr(text, 1, 300), '[^a-zA-Z]+', ' '{})"
SPARK_CLEAN, DUCK_CLEAN = CLEAN.format(""), CLEAN.format(", 'g'")

RAW = {
    "greenhouse": """concat('{"board": "acme-labs_eu", "id": ', CAST(doc_id AS STRING), ', "title": "', CASE doc_id % 3 WHEN 0 THEN 'Senior Data Engineer' WHEN 1 THEN 'Junior Analyst' ELSE 'Designer' END,
 '", "content": "&lt;p class=x&gt;', clean, CASE doc_id % 4 WHEN 0 THEN ' EUR 50.000 - 60.000 per year' ELSE '' END, '&lt;/p&gt;&lt;script&gt;x&lt;/script&gt;", "absolute_url": "https://x/', source, '", "updated_at": "2024-05-06T07:08:09Z"',
 CASE doc_id % 2 WHEN 0 THEN ', "location": {"name": "Berlin, Germany"}, "offices": [{"name": "HQ", "location": " Munich "}, {"name": "B", "location": null}, {"name": "C", "location": "Berlin, Germany"}]' ELSE '' END,
 CASE doc_id % 5 WHEN 0 THEN ', "departments": [{"name": "Data"}]' ELSE ', "metadata": [{"name": "Company Name", "value": "Acme"}, {"name": "Team", "value": "Core"}, {"name": "Employment Kind", "value": "Full-time"}, {"name": "Min Salary", "value": "40000"}, {"name": "Pay Interval", "value": "Monthly"}, {"name": "Currency", "value": null}]' END, '}')""",
    "ashby": """concat('{"board": "the_new-board", "jobUrl": "https://a/b/', CAST(doc_id AS STRING), '", "title": "Staff Associate", "descriptionHtml": "<div><p>', clean, '</p></div>", "publishedAt": "2024-05-06T07:08:09.123Z", "team": "T", "employmentType": "PartTime"',
 CASE doc_id % 3 WHEN 0 THEN ', "location": "Paris", "secondaryLocations": [{"location": "Hamburg"}, {"location": "Remote, Germany"}], "isRemote": true, "workplaceType": "OnSite"' WHEN 1 THEN ', "location": "Berlin", "workplaceType": "Hybrid", "department": "D"' ELSE ', "descriptionPlain": "plain  text"' END,
 CASE doc_id % 2 WHEN 0 THEN ', "applyUrl": "https://a/apply", "compensation": {"summaryComponents": [{"compensationType": "Equity"}], "compensationTiers": [{"components": null}, {"components": [{"compensationType": "salary", "currencyCode": "EUR", "minValue": 50000, "maxValue": 70000.5, "interval": "1 YEAR"}]}]}' ELSE ', "address": {"postalAddress": {"addressCountry": " Deutschland"}}' END, '}')""",
    "lever": """concat('{"id": "', CAST(doc_id AS STRING), '", "createdAt": 1714979289000, "description": "<b>', clean, '</b>"', CASE doc_id % 4 WHEN 0 THEN ', "text": "Lead Intern", "hostedUrl": "https://jobs.lever.co/acme/1?x=/y", "country": "de"' WHEN 1 THEN ', "hostedUrl": "", "applyUrl": "https://apply", "country": "Germany"' WHEN 2 THEN ', "hostedUrl": "no url", "country": " Austria "' ELSE '' END,
 CASE doc_id % 3 WHEN 0 THEN ', "workplaceType": "remote", "tags": ["a", " a", ""], "categories": {"location": "Berlin", "allLocations": ["Berlin", "Bonn", "Bonn"], "team": "Core", "commitment": "Permanent Full-Time"}' WHEN 1 THEN ', "workplaceType": "on-site", "categories": {"department": "R", "allLocations": ["Ulm"], "commitment": "Internship"}, "salaryRange": {"min": 10.5, "max": 20, "currency": "EUR", "interval": "per-hour-wage"}' ELSE '' END, '}')""",
}
SHOWN = [c for c in whole.COLUMNS if c not in ("PostedDate", "AllLocations", "Tags", "Description", "DescriptionHtml")]


def shown(spark: SparkSession, sf_dir: str, feed: str) -> DataFrame:
    """A feed landed and read whole; arrays joined, long texts hashed."""
    docs, path = table(spark, sf_dir, "documents"), folder(spark, feed)
    rows = docs.select("doc_id", "source", F.expr(SPARK_CLEAN).alias("clean"))
    rows.select(F.expr(RAW[feed]).alias("value")).where("value is not null").write.text(path)
    found = whole.read(spark, feed, path)
    lists = [F.array_join(c, "|").alias(c) for c in ("AllLocations", "Tags")]
    hashes = [F.md5(c).alias(c) for c in ("Description", "DescriptionHtml")]
    return found.select(*SHOWN, F.date_format("PostedDate", "yyyy-MM-dd HH:mm:ss").alias("PostedDate"), *lists, *hashes)


FROM = f"FROM (SELECT *, trim(regexp_replace(clean, ' +', ' ', 'g')) AS t FROM (SELECT doc_id, source, {DUCK_CLEAN} AS clean FROM documents WHERE text IS NOT NULL))"


@query("p02_greenhouse", f"""SELECT 'greenhouse_acme-labs_eu_' || doc_id AS "JobID", CASE doc_id % 3 WHEN 0 THEN 'Senior Data Engineer' WHEN 1 THEN 'Junior Analyst' ELSE 'Designer' END AS "JobTitle",
 CASE WHEN doc_id % 5 = 0 THEN 'Acme Labs Eu' ELSE 'Acme' END AS "Company", CASE WHEN doc_id % 2 = 0 THEN 'Berlin, Germany' ELSE 'Germany' END AS "Location", 'https://x/' || source AS "ApplicationURL", '2024-05-06 07:08:09' AS "PostedDate",
 NULL::VARCHAR AS "DirectApplyURL", 'greenhouse' AS "ATSPlatform", CASE WHEN doc_id % 4 = 0 THEN 'EUR' WHEN regexp_matches(clean, '(?i)(USD|EUR|GBP|CHF|CAD|AUD|JPY|SEK|NOK|DKK|PLN)') THEN upper(regexp_extract(clean, '(?i)(USD|EUR|GBP|CHF|CAD|AUD|JPY|SEK|NOK|DKK|PLN)', 1)) END AS c0,
 CASE WHEN doc_id % 4 = 0 THEN 50000.0::DOUBLE WHEN doc_id % 5 <> 0 THEN 40000.0::DOUBLE END AS "SalaryMin", CASE WHEN doc_id % 4 = 0 THEN 60000.0::DOUBLE END AS "SalaryMax",
 CASE WHEN doc_id % 4 = 0 THEN 'per-year-salary' WHEN doc_id % 5 <> 0 THEN 'per-month-salary' END AS "SalaryInterval", CASE WHEN doc_id % 5 = 0 THEN 'Data' ELSE 'Core' END AS "Department", CASE WHEN doc_id % 5 <> 0 THEN 'Core' END AS "Team",
 'Unspecified' AS "WorkplaceType", CASE WHEN doc_id % 5 <> 0 THEN 'FullTime' END AS "EmploymentType", false AS "IsRemote", CASE WHEN doc_id % 2 = 0 THEN 'DE' END AS "Country", CASE WHEN doc_id % 2 = 0 THEN 'Berlin, Germany|Munich' ELSE '' END AS "AllLocations",
 CASE WHEN doc_id % 2 = 0 THEN 'HQ' END AS "Office", CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Company Name:Acme|Team:Core|Employment Kind:Full-time|Min Salary:40000|Pay Interval:Monthly' END AS "Tags", doc_id % 3 = 1 AS "isEntryLevel",
 CASE doc_id % 3 WHEN 0 THEN 'Senior' WHEN 1 THEN 'Entry' ELSE 'Mid' END AS "ExperienceLevel", md5(trim(regexp_replace(clean || tail || 'x', ' +', ' ', 'g'))) AS "Description", md5(CASE WHEN trim(clean || tail) = '' THEN '' ELSE '<p>' || clean || tail || '</p>' END) AS "DescriptionHtml"
 FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN ' EUR 50.000 - 60.000 per year' ELSE '' END AS tail {FROM})""".replace(" AS c0,", ' AS "SalaryCurrency",'))  # fmt: skip
def greenhouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(spark, sf_dir, "greenhouse")


@query("p03_ashby", f"""SELECT 'ashby_the_new-board_' || doc_id AS "JobID", 'Staff Associate' AS "JobTitle", 'The New Board' AS "Company", CASE doc_id % 3 WHEN 0 THEN 'Hamburg, Remote, Germany' WHEN 1 THEN 'Berlin' ELSE 'Germany' END AS "Location",
 'https://a/b/' || doc_id AS "ApplicationURL", '2024-05-06 07:08:09' AS "PostedDate", CASE WHEN doc_id % 2 = 0 THEN 'https://a/apply' END AS "DirectApplyURL", 'ashby' AS "ATSPlatform", CASE WHEN doc_id % 2 = 0 THEN 'EUR' END AS "SalaryCurrency",
 CASE WHEN doc_id % 2 = 0 THEN 50000.0::DOUBLE END AS "SalaryMin", CASE WHEN doc_id % 2 = 0 THEN 70000.5::DOUBLE END AS "SalaryMax", CASE WHEN doc_id % 2 = 0 THEN 'per-year-salary' END AS "SalaryInterval",
 CASE WHEN doc_id % 3 = 1 THEN 'D' ELSE 'N/A' END AS "Department", 'T' AS "Team", CASE doc_id % 3 WHEN 0 THEN 'Onsite' WHEN 1 THEN 'Hybrid' ELSE 'Unspecified' END AS "WorkplaceType", 'PartTime' AS "EmploymentType", doc_id % 3 < 2 AS "IsRemote",
 CASE WHEN doc_id % 2 = 1 THEN 'DE' END AS "Country", CASE doc_id % 3 WHEN 0 THEN 'Paris|Hamburg|Remote, Germany' WHEN 1 THEN 'Berlin' ELSE '' END AS "AllLocations", CASE doc_id % 3 WHEN 0 THEN 'Paris' WHEN 1 THEN 'Berlin' END AS "Office",
 CASE doc_id % 3 WHEN 0 THEN 'T|OnSite|PartTime' WHEN 1 THEN 'D|T|Hybrid|PartTime' ELSE 'T|PartTime' END AS "Tags", true AS "isEntryLevel", 'Staff' AS "ExperienceLevel", md5(CASE WHEN doc_id % 3 = 2 THEN 'plain text' ELSE t END) AS "Description",
 md5(CASE WHEN t = '' THEN '' ELSE '<p>' || clean || '</p>' END) AS "DescriptionHtml" {FROM}""")  # fmt: skip
def ashby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(spark, sf_dir, "ashby")


@query("p04_lever", f"""SELECT 'lever_' || doc_id AS "JobID", CASE WHEN doc_id % 4 = 0 THEN 'Lead Intern' ELSE 'Untitled Position' END AS "JobTitle", CASE WHEN doc_id % 4 = 0 THEN 'Acme' ELSE 'Company via Lever' END AS "Company",
 CASE doc_id % 3 WHEN 0 THEN 'Berlin, Bonn, Remote' WHEN 1 THEN 'Ulm' ELSE 'Location not specified' END AS "Location", CASE doc_id % 4 WHEN 0 THEN 'https://jobs.lever.co/acme/1?x=/y' WHEN 1 THEN 'https://apply' WHEN 2 THEN 'no url' END AS "ApplicationURL",
 '2024-05-06 07:08:09' AS "PostedDate", CASE WHEN doc_id % 4 = 1 THEN 'https://apply' END AS "DirectApplyURL", 'lever' AS "ATSPlatform", CASE WHEN doc_id % 3 = 1 THEN 'EUR' END AS "SalaryCurrency", CASE WHEN doc_id % 3 = 1 THEN 10.5::DOUBLE END AS "SalaryMin",
 CASE WHEN doc_id % 3 = 1 THEN 20.0::DOUBLE END AS "SalaryMax", CASE WHEN doc_id % 3 = 1 THEN 'per-hour-wage' END AS "SalaryInterval", CASE WHEN doc_id % 3 = 1 THEN 'R' ELSE 'N/A' END AS "Department", CASE WHEN doc_id % 3 = 0 THEN 'Core' END AS "Team",
 CASE doc_id % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Onsite' ELSE 'Unspecified' END AS "WorkplaceType", CASE doc_id % 3 WHEN 0 THEN 'FullTime' WHEN 1 THEN 'Intern' END AS "EmploymentType", doc_id % 3 = 0 AS "IsRemote",
 CASE doc_id % 4 WHEN 0 THEN 'DE' WHEN 1 THEN 'DE' WHEN 2 THEN 'Austria' END AS "Country", CASE doc_id % 3 WHEN 0 THEN 'Berlin|Bonn' WHEN 1 THEN 'Ulm' ELSE '' END AS "AllLocations", CASE WHEN doc_id % 3 = 0 THEN 'Berlin' END AS "Office",
 CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE '' END AS "Tags", doc_id % 4 = 0 AS "isEntryLevel", CASE WHEN doc_id % 4 = 0 THEN 'Lead' ELSE 'Mid' END AS "ExperienceLevel", md5(CASE WHEN length(clean) + 7 > 100 THEN t ELSE '' END) AS "Description",
 md5(CASE WHEN t = '' THEN '' ELSE '<p><b>' || clean || '</b></p>' END) AS "DescriptionHtml" {FROM}""")  # fmt: skip
def lever(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(spark, sf_dir, "lever")
