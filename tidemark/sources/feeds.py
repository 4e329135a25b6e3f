"""Raw posting feeds, landed as JSON or XML files, as canonical postings.

Each feed is one ``select``; all have the same columns and are put together by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANONICAL = ("JobID", "JobTitle", "Company", "Location", "AllLocations", "Department", "Description", "ApplicationURL", "PostedDate", "EmploymentType", "WorkplaceType")
SCHEMAS = {
    "greenhouse": "company string, jobs array<struct<id: long, title: string, location: struct<name: string>, content: string, absolute_url: string, updated_at: string, departments: array<struct<name: string>>, offices: array<struct<name: string, location: string>>, metadata: array<struct<name: string, value: string>>>>",
    "lever": "company string, id string, text string, hostedUrl string, country string, workplaceType string, createdAt long, descriptionPlain string, categories struct<location: string, allLocations: array<string>, department: string, team: string, commitment: string>",
    "ashby": "company string, jobs array<struct<jobUrl: string, applyUrl: string, title: string, location: string, secondaryLocations: array<struct<location: string>>, descriptionPlain: string, publishedAt: string, department: string, team: string, employmentType: string, workplaceType: string, isRemote: boolean>>",
    "workable": "jobs array<struct<id: string, title: string, description: string, url: string, department: string, employmentType: string, workplace: string, locations: array<string>, location: struct<city: string, countryName: string>, created: string, company: struct<title: string>>>",
    "recruitee": "offers array<struct<id: long, title: string, company_name: string, city: string, country: string, description: string, requirements: string, careers_url: string, published_at: string, department: string, remote: boolean, hybrid: boolean, on_site: boolean, employment_type_code: string>>",
    "smartrecruiters": "company string, content array<struct<id: string, name: string, releasedDate: string, location: struct<city: string, country: string, remote: boolean, hybrid: boolean>, department: struct<label: string>, typeOfEmployment: struct<label: string>, applyUrl: string>>",
    "teamtailor": "items array<struct<id: string, title: string, url: string, content_html: string, date_published: string, _jobposting: struct<hiringOrganization: struct<name: string>, jobLocation: array<struct<address: struct<addressLocality: string, addressCountry: string>>>>>>",
    "workday": "company string, jobPostings array<struct<externalPath: string, title: string, locationsText: string, bulletFields: array<string>>>",
}
PERSONIO = "id string, name string, office string, subcompany string, department string, employmentType string, schedule string, createdAt string, jobDescriptions struct<jobDescription: array<struct<name: string, value: string>>>"


def when_read(c: Column) -> Column:
    """A timestamp from ISO text or from milliseconds."""
    text = c.cast("string")
    return F.coalesce(F.timestamp_millis(text.try_cast("long")), F.try_to_timestamp(text))


def joined(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *[F.nullif(F.trim(p), F.lit("")) for p in parts]), F.lit(""))


def flags(remote: Column, hybrid: Column, onsite: Column | None = None) -> Column:
    found = F.when(remote, "remote").when(hybrid, "hybrid")
    return found if onsite is None else found.when(onsite, "onsite")


def canonical(rows: DataFrame, site: str, **columns: Column) -> DataFrame:
    """The canonical columns; what a feed lacks is null.  Ids are text."""
    missing = F.lit(None)
    return rows.select(
        F.lit(site).alias("sourceSite"),
        *[(columns.get(c, missing).cast({"PostedDate": "timestamp", "AllLocations": "array<string>"}.get(c, "string"))).alias(c) for c in CANONICAL],
    ).where(F.col("JobID").isNotNull())


def greenhouse(raw: DataFrame) -> DataFrame:
    j = raw.select("company", F.explode("jobs").alias("j"))
    return canonical(
        j, "greenhouse", JobID=F.col("j.id"), JobTitle=F.col("j.title"), Company=F.col("company"), Location=F.col("j.location.name"),
        AllLocations=F.transform("j.offices", lambda o: F.coalesce(o["location"], o["name"])), Department=F.get("j.departments", F.lit(0))["name"],
        Description=F.col("j.content"), ApplicationURL=F.col("j.absolute_url"), PostedDate=when_read(F.col("j.updated_at")),
    )


def lever(raw: DataFrame) -> DataFrame:
    return canonical(
        raw, "lever", JobID=F.col("id"), JobTitle=F.col("text"), Company=F.col("company"), Location=F.col("categories.location"),
        AllLocations=F.array_distinct(F.array_compact(F.concat(F.array("categories.location"), F.coalesce("categories.allLocations", F.array().cast("array<string>"))))),
        Department=F.coalesce("categories.department", "categories.team"), Description=F.col("descriptionPlain"), ApplicationURL=F.col("hostedUrl"),
        PostedDate=when_read(F.col("createdAt")), EmploymentType=F.col("categories.commitment"), WorkplaceType=F.col("workplaceType"),
    )


def ashby(raw: DataFrame) -> DataFrame:
    j = raw.select("company", F.explode("jobs").alias("j"))
    return canonical(
        j, "ashby", JobID=F.regexp_extract("j.jobUrl", r"([^/?#]+)/?(?:[?#].*)?$", 1), JobTitle=F.col("j.title"), Company=F.col("company"), Location=F.col("j.location"),
        AllLocations=F.transform("j.secondaryLocations", lambda s: s["location"]), Department=F.coalesce("j.department", "j.team"), Description=F.col("j.descriptionPlain"),
        ApplicationURL=F.coalesce("j.applyUrl", "j.jobUrl"), PostedDate=when_read(F.col("j.publishedAt")), EmploymentType=F.col("j.employmentType"),
        WorkplaceType=F.coalesce("j.workplaceType", F.when(F.col("j.isRemote"), "remote")),
    )


def workable(raw: DataFrame) -> DataFrame:
    j = raw.select(F.explode("jobs").alias("j"))
    return canonical(
        j, "workable", JobID=F.col("j.id"), JobTitle=F.col("j.title"), Company=F.col("j.company.title"), Location=joined(F.col("j.location.city"), F.col("j.location.countryName")),
        AllLocations=F.col("j.locations"), Department=F.col("j.department"), Description=F.col("j.description"), ApplicationURL=F.col("j.url"),
        PostedDate=when_read(F.col("j.created")), EmploymentType=F.col("j.employmentType"), WorkplaceType=F.col("j.workplace"),
    )


def recruitee(raw: DataFrame) -> DataFrame:
    j = raw.select(F.explode("offers").alias("j"))
    return canonical(
        j, "recruitee", JobID=F.col("j.id"), JobTitle=F.col("j.title"), Company=F.col("j.company_name"), Location=joined(F.col("j.city"), F.col("j.country")),
        Department=F.col("j.department"), Description=F.concat_ws("\n", "j.description", "j.requirements"), ApplicationURL=F.col("j.careers_url"),
        PostedDate=when_read(F.regexp_replace("j.published_at", " UTC$", "")), EmploymentType=F.col("j.employment_type_code"), WorkplaceType=flags(F.col("j.remote"), F.col("j.hybrid"), F.col("j.on_site")),
    )


def smartrecruiters(raw: DataFrame) -> DataFrame:
    j = raw.select("company", F.explode("content").alias("j"))
    return canonical(
        j, "smartrecruiters", JobID=F.col("j.id"), JobTitle=F.col("j.name"), Company=F.col("company"), Location=joined(F.col("j.location.city"), F.col("j.location.country")),
        Department=F.col("j.department.label"), ApplicationURL=F.col("j.applyUrl"), PostedDate=when_read(F.col("j.releasedDate")), EmploymentType=F.col("j.typeOfEmployment.label"),
        WorkplaceType=flags(F.col("j.location.remote"), F.col("j.location.hybrid")),
    )


def teamtailor(raw: DataFrame) -> DataFrame:
    j = raw.select(F.explode("items").alias("j"))
    places = F.transform("j._jobposting.jobLocation", lambda p: joined(p["address"]["addressLocality"], p["address"]["addressCountry"]))
    return canonical(
        j, "teamtailor", JobID=F.col("j.id"), JobTitle=F.col("j.title"), Company=F.col("j._jobposting.hiringOrganization.name"), Location=F.get(places, F.lit(0)),
        AllLocations=places, Description=F.col("j.content_html"), ApplicationURL=F.col("j.url"), PostedDate=when_read(F.col("j.date_published")),
    )


def workday(raw: DataFrame) -> DataFrame:
    j = raw.select("company", F.explode("jobPostings").alias("j"))
    return canonical(
        j, "workday", JobID=F.coalesce(F.get("j.bulletFields", F.lit(0)), "j.externalPath"), JobTitle=F.col("j.title"), Company=F.col("company"),
        Location=F.col("j.locationsText"), ApplicationURL=F.col("j.externalPath"),
    )


def personio(raw: DataFrame) -> DataFrame:
    sections = F.transform("jobDescriptions.jobDescription", lambda d: F.concat_ws("\n", d["name"], d["value"]))
    return canonical(
        raw, "personio", JobID=F.col("id"), JobTitle=F.col("name"), Company=F.col("subcompany"), Location=F.col("office"), Department=F.col("department"),
        Description=F.array_join(sections, "\n\n"), PostedDate=when_read(F.col("createdAt")), EmploymentType=F.coalesce("schedule", "employmentType"),
    )


FEEDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    f.__name__: f for f in (greenhouse, lever, ashby, workable, recruitee, smartrecruiters, teamtailor, workday, personio)
}


def read(spark: SparkSession, feed: str, path: str) -> DataFrame:
    """The postings of one feed's landed files; broken records are left out by the reader."""
    if feed == "personio":
        raw = spark.read.format("xml").option("rowTag", "position").schema(PERSONIO).load(path)
    else:
        raw = spark.read.schema(SCHEMAS[feed]).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return FEEDS[feed](raw)


def read_all(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All feeds together, one row per (sourceSite, JobID)."""
    found = None
    for feed, path in paths.items():
        one = read(spark, feed, path)
        found = one if found is None else found.unionByName(one)
    return found.dropDuplicates(["sourceSite", "JobID"])
