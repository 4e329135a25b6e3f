"""What leaves the engine: list entries, details and baits, by lists of allowed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import canonical, names

# The columns of each shape.
TEASER = [
    "JobID", "JobTitle", "Company", "Location", "Department", "Domain", "SubDomain", "Category", "WorkplaceType",
    "EmploymentType", "ExperienceLevel", "isEntryLevel", "ContractType", "Tags", "PostedDate", "scrapedAt", "applyClicks",
    "AllLocations", "Country", "IsRemote", "filterWorkplace", "filterExperience", "filterEmployment", "filterVisa",
    "filterRelocation", "companyDomain",
]
SALARY = ["filterSalaryMin", "filterSalaryMax", "filterSalaryTier", "filterSalaryCurrency", "filterSalaryInterval"]
DETAIL = [
    *TEASER, "Description", "DescriptionHtml", "ApplicationURL", "DirectApplyURL", *SALARY,
]
BAIT = ["JobID", "JobTitle", "Company", "Location", "Category", "WorkplaceType", "EmploymentType", "ExperienceLevel", "PostedDate", "scrapedAt", "companyDomain"]
#: Types of columns that a posting may lack.
LACKING = {"applyClicks": "int", "isEntryLevel": "boolean", "IsRemote": "boolean", "Tags": "array<string>", "AllLocations": "array<string>", "PostedDate": "timestamp", "scrapedAt": "timestamp"}
READ = ["remote_policy_detail", "experience_level", "employment_type", "visa_sponsorship", "relocation_support", "salary_min", "salary_max", "salary_currency", "salary_interval"]


def column(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column, or null where ``df`` lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def resolved(postings: DataFrame) -> DataFrame:
    """``postings`` with the ten ``filter*`` columns, from the feed's values and those read from the text.

    The read values are the columns of ``READ``; stored ``filter*`` columns are not trusted
    but made anew.  Missing columns count as null.
    """
    c = lambda name, kind="string": column(postings, name, kind)
    pay = canonical.salary(
        {"min": c("SalaryMin", "double"), "max": c("SalaryMax", "double"), "currency": c("SalaryCurrency"), "interval": c("SalaryInterval")},
        {"min": c("salary_min", "double"), "max": c("salary_max", "double"), "currency": c("salary_currency"), "interval": c("salary_interval")},
    )
    made = {
        "filterWorkplace": canonical.workplace(c("remote_policy_detail"), c("WorkplaceType"), c("Location")),
        "filterExperience": canonical.experience(c("experience_level"), c("ExperienceLevel"), c("isEntryLevel", "boolean")),
        "filterEmployment": canonical.employment(c("employment_type"), c("EmploymentType")),
        "filterVisa": canonical.confirmed(c("visa_sponsorship")),
        "filterRelocation": canonical.confirmed(c("relocation_support")),
        **{f"filterSalary{k.capitalize()}": pay[k] for k in ("min", "max", "currency", "interval", "tier")},
    }
    return postings.withColumns(made)


def shaped(postings: DataFrame, shape: list[str]) -> DataFrame:
    """The columns of a shape and no other; missing ones are null, clicks zero."""
    rows = resolved(postings).withColumn("companyDomain", names.company_domain(column(postings, "ApplicationURL")))
    own = [column(rows, n, LACKING.get(n, "string")) for n in shape]
    return rows.select(*[(F.coalesce(c, F.lit(0)) if n == "applyClicks" else c).alias(n) for n, c in zip(shape, own, strict=True)])


def teaser(postings: DataFrame, with_salary: bool = False) -> DataFrame:
    return shaped(postings, TEASER + SALARY if with_salary else TEASER)


def detail(postings: DataFrame) -> DataFrame:
    return shaped(postings, DETAIL)


def bait(postings: DataFrame) -> DataFrame:
    return shaped(postings, BAIT)
