"""Raw postings of three feeds with all canonical columns: pay, places, tags, levels, markup.

Each feed is one ``select`` over its raw rows, a row a posting; ``read`` lands JSON lines with the
feed's schema and adds the safe markup by one join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import pay, prose, text
from tidemark.functions.text import EDGE, js_trim
from tidemark.operators import location, markup
from tidemark.sources.feeds import when_read

COLUMNS = {
    "JobID": "string", "JobTitle": "string", "Company": "string", "Location": "string", "Description": "string", "DescriptionHtml": "string", "ApplicationURL": "string",
    "PostedDate": "timestamp", "DirectApplyURL": "string", "ATSPlatform": "string", "SalaryCurrency": "string", "SalaryMin": "double", "SalaryMax": "double", "SalaryInterval": "string",
    "Department": "string", "Team": "string", "WorkplaceType": "string", "EmploymentType": "string", "IsRemote": "boolean", "Country": "string", "AllLocations": "array<string>",
    "Office": "string", "Tags": "array<string>", "isEntryLevel": "boolean", "ExperienceLevel": "string",
}
SCHEMAS = {
    "greenhouse": "board string, id long, title string, content string, absolute_url string, updated_at string, location struct<name: string>, departments array<struct<name: string>>, "
    "offices array<struct<name: string, location: string>>, metadata array<struct<name: string, value: string>>",
    "ashby": "board string, jobUrl string, applyUrl string, title string, location string, secondaryLocations array<struct<location: string>>, descriptionPlain string, descriptionHtml string, "
    "publishedAt string, department string, team string, employmentType string, workplaceType string, isRemote boolean, address struct<postalAddress: struct<addressCountry: string>>, "
    "compensation struct<summaryComponents: array<struct<compensationType: string, currencyCode: string, minValue: double, maxValue: double, interval: string>>, "
    "compensationTiers: array<struct<components: array<struct<compensationType: string, currencyCode: string, minValue: double, maxValue: double, interval: string>>>>>",
    "lever": "id string, text string, hostedUrl string, applyUrl string, country string, workplaceType string, createdAt long, descriptionPlain string, description string, tags array<string>, "
    "salaryRange struct<min: double, max: double, currency: string, interval: string>, categories struct<location: string, allLocations: array<string>, department: string, team: string, commitment: string>",
}
ENTRY = r"junior|jr\.?|entry|associate|graduate|intern|entry level|entry-level"


def texts(*parts: Column) -> Column:
    """An array of texts out of texts and arrays."""
    return F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])


def once(values: Column) -> Column:
    """Trimmed texts, each once, blanks left out."""
    trimmed = F.transform(values, js_trim)
    return F.array_distinct(F.filter(trimmed, lambda v: F.coalesce(v, F.lit("")) != ""))


def or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def capital(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, 2, 10_000))


def named(board: Column) -> Column:
    """A board's name for readers: its parts with capitals."""
    return F.array_join(F.transform(F.split(board, "[-_]"), capital), " ")


def interval_of(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("year"), "per-year-salary").when(low.contains("month"), "per-month-salary").when(low.contains("hour"), "per-hour-wage")


def canonical(rows: DataFrame, html: Column, **columns: Column) -> DataFrame:
    """All columns in their types, and ``_raw``, the markup as it came; a posting without an id is left out."""
    title = columns["JobTitle"]
    columns |= {"isEntryLevel": F.lower(F.coalesce(title, F.lit(""))).rlike(f"{EDGE}(?:{ENTRY}){EDGE}"), "ExperienceLevel": text.experience_of(title)}
    found = [columns[c].cast(kind).alias(c) for c, kind in COLUMNS.items() if c != "DescriptionHtml"]
    return rows.select(*found, html.alias("_raw")).where(F.col("JobID").isNotNull())


def greenhouse(j: DataFrame) -> DataFrame:
    """Fields that a board has no column for are looked up in its metadata, the first entry whose name has one of some words."""
    meta = F.filter(F.coalesce("metadata", F.array().cast("array<struct<name: string, value: string>>")), lambda m: F.coalesce(m["name"], F.lit("")) != "")

    def said(*words: str) -> Column:
        hit = F.filter(meta, lambda m: F.lower(m["name"]).rlike("|".join(words)))
        return F.get(hit, F.lit(0))["value"]

    # as columns: each is named several times below
    j = j.withColumn("_plain", prose.bare(F.col("content"))).withColumn("_pay", pay.from_text(F.col("_plain")))
    plain, read = F.col("_plain"), F.col("_pay")
    number = lambda c: c.try_cast("double")
    places = once(texts(F.array("location.name"), F.transform("offices", lambda o: o["location"])))
    every = F.lower(F.array_join(places, " "))
    low = F.lower(said("salary interval", "interval"))
    told = F.when(low.contains("hour"), "per-hour-wage").when(low.contains("month"), "per-month-salary").when(low.contains("year"), "per-year-salary")
    return canonical(
        j, F.col("content"), JobID=F.concat(F.lit("greenhouse_"), "board", F.lit("_"), F.col("id").cast("string")), JobTitle=F.col("title"), Company=F.coalesce(said("company"), named(F.col("board"))),
        Location=F.coalesce(or_null(F.col("location.name")), F.lit("Germany")), Description=plain, ApplicationURL=F.col("absolute_url"), PostedDate=when_read(F.col("updated_at")),
        DirectApplyURL=F.lit(None), ATSPlatform=F.lit("greenhouse"), SalaryCurrency=F.coalesce(read["currency"], or_null(said("currency"))),
        SalaryMin=F.coalesce(read["min"], number(said("salary min", "min salary", "minimum salary", "comp min"))),
        SalaryMax=F.coalesce(read["max"], number(said("salary max", "max salary", "maximum salary", "comp max"))), SalaryInterval=F.coalesce(read["interval"], told),
        Department=F.coalesce(or_null(F.get("departments", F.lit(0))["name"]), or_null(said("department", "team")), F.lit("N/A")), Team=or_null(said("team")),
        WorkplaceType=F.lit("Unspecified"), EmploymentType=location.employment_name(said("employment", "contract", "time")), IsRemote=F.lit(False),
        Country=F.when(every.rlike("germany|deutschland"), "DE"), AllLocations=places, Office=or_null(F.get("offices", F.lit(0))["name"]),
        Tags=once(F.transform(F.filter(meta, lambda m: F.coalesce(m["value"], F.lit("")) != ""), lambda m: F.concat(m["name"], F.lit(":"), m["value"]))),
    )


def ashby(j: DataFrame) -> DataFrame:
    """Pay is the first component of the kind salary, of the summary before the tiers."""
    kind = "array<struct<compensationType: string, currencyCode: string, minValue: double, maxValue: double, interval: string>>"
    none = F.array().cast(kind)
    tiers = F.flatten(F.transform(F.coalesce("compensation.compensationTiers", F.array().cast(f"array<struct<components: {kind}>>")), lambda t: F.coalesce(t["components"], none)))
    salary = F.get(F.filter(F.concat(F.coalesce("compensation.summaryComponents", none), tiers), lambda c: F.lower(c["compensationType"]) == "salary"), F.lit(0))
    others = F.transform("secondaryLocations", lambda s: s["location"])
    german = F.filter(texts(F.array("location"), others), location.mentions_germany)
    workplace = location.workplace_name(F.col("workplaceType"))
    return canonical(
        j, F.col("descriptionHtml"), JobID=F.concat(F.lit("ashby_"), "board", F.lit("_"), F.element_at(F.split("jobUrl", "/"), -1)), JobTitle=F.col("title"), Company=named(F.col("board")),
        Location=F.coalesce(or_null(F.array_join(german, ", ")), F.lit("Germany")), Description=prose.bare(F.coalesce(or_null(F.col("descriptionPlain")), F.col("descriptionHtml"))),
        ApplicationURL=F.coalesce(or_null(F.col("jobUrl")), F.col("applyUrl")), PostedDate=when_read(F.col("publishedAt")), DirectApplyURL=or_null(F.col("applyUrl")), ATSPlatform=F.lit("ashby"),
        SalaryCurrency=or_null(salary["currencyCode"]), SalaryMin=salary["minValue"], SalaryMax=salary["maxValue"], SalaryInterval=interval_of(salary["interval"]),
        Department=F.coalesce(or_null(F.col("department")), F.lit("N/A")), Team=or_null(F.col("team")), WorkplaceType=workplace, EmploymentType=location.employment_name(F.col("employmentType")),
        IsRemote=F.coalesce("isRemote", workplace.isin("Remote", "Hybrid")), Country=location.country_code(F.col("address.postalAddress.addressCountry")),
        AllLocations=once(texts(F.array("location"), others)), Office=or_null(F.col("location")), Tags=once(F.array("department", "team", "workplaceType", "employmentType")),
    )


def lever(j: DataFrame) -> DataFrame:
    """The company is the first part of the posting's address; places end with how one works."""
    path = F.filter(F.split(F.regexp_replace("hostedUrl", "^[a-z]+://[^/]+/?|[?#].*$", ""), "/"), lambda p: p != "")
    first = F.when(F.col("hostedUrl").rlike("^[a-z]+://"), capital(F.get(path, F.lit(0))))
    c = F.col("categories")
    mode = F.when(~F.coalesce(F.col("workplaceType"), F.lit("")).isin("", "unspecified", "on-site"), capital(F.col("workplaceType")))
    place = or_null(c["location"])
    more = F.filter(F.array_distinct(F.coalesce(c["allLocations"], F.array().cast("array<string>"))), lambda p: ~F.coalesce(p == place, F.lit(False)))
    every = F.array_compact(texts(F.array(place), more, F.array(mode)))
    long = lambda t: F.when(F.length(t) > 100, prose.bare(t))
    workplace = location.workplace_name(F.col("workplaceType"))
    return canonical(
        j, F.col("description"), JobID=F.concat(F.lit("lever_"), "id"), JobTitle=F.coalesce(or_null(F.col("text")), F.lit("Untitled Position")), Company=F.coalesce(first, F.lit("Company via Lever")),
        Location=F.coalesce(or_null(F.array_join(every, ", ")), F.lit("Location not specified")), Description=F.coalesce(long(F.col("descriptionPlain")), long(F.col("description")), F.lit("")),
        ApplicationURL=F.coalesce(or_null(F.col("hostedUrl")), or_null(F.col("applyUrl"))), PostedDate=when_read(F.col("createdAt")), DirectApplyURL=or_null(F.col("applyUrl")), ATSPlatform=F.lit("lever"),
        SalaryCurrency=or_null(F.col("salaryRange.currency")), SalaryMin=F.col("salaryRange.min"), SalaryMax=F.col("salaryRange.max"), SalaryInterval=or_null(F.col("salaryRange.interval")),
        Department=F.coalesce(or_null(c["department"]), F.lit("N/A")), Team=or_null(c["team"]), WorkplaceType=workplace, EmploymentType=location.employment_name(c["commitment"]),
        IsRemote=workplace.isin("Remote", "Hybrid"), Country=location.country_code(F.col("country")), AllLocations=once(F.coalesce(c["allLocations"], F.array().cast("array<string>"))),
        Office=place, Tags=once(F.coalesce("tags", F.array().cast("array<string>"))),
    )


FEEDS: dict[str, Callable[[DataFrame], DataFrame]] = {f.__name__: f for f in (greenhouse, ashby, lever)}


def whole(raw: DataFrame, feed: str) -> DataFrame:
    """All columns of a feed's raw rows; of equal ids one posting is kept, the one with the least markup by order."""
    found = FEEDS[feed](raw)
    rest = [c for c in found.columns if c != "JobID"]
    one = found.groupBy("JobID").agg(F.min(F.struct("_raw", *[c for c in rest if c != "_raw"])).alias("x")).select("JobID", "x.*")
    safe = markup.sanitized(one.select("JobID", "_raw"), "JobID", "_raw").withColumnRenamed("html", "DescriptionHtml")
    return one.drop("_raw").join(safe, "JobID").select(*COLUMNS)


def read(spark: SparkSession, feed: str, path: str) -> DataFrame:
    """A feed's landed JSON lines with all columns; broken lines are left out."""
    return whole(spark.read.schema(SCHEMAS[feed]).option("mode", "DROPMALFORMED").json(path), feed)
