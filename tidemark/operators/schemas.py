"""Schema tables for JSON of models and callers, compiled into columns over VARIANT: values, and an error for each field that does not fit.

A text is parsed once.  A field's rule says its type, where it is looked for, what may stand
there and what counts otherwise; a value of another type counts as missing, and is named in
``errors``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.pay import BOUNDS, CURRENCIES
from tidemark.functions.text import let

NUMBERS = "BIGINT|DOUBLE|FLOAT|DECIMAL.*"
#: What a value's schema must be for each kind.
KINDS = {"text": "STRING", "number": NUMBERS, "flag": "BOOLEAN", "texts": "ARRAY<.*", "skills": "ARRAY<.*", "rows": "ARRAY<.*", "objects": "ARRAY<.*"}
TYPES = {"text": "string", "number": "double", "flag": "boolean", "date": "timestamp"}


@dataclass(frozen=True)
class Field:
    """One rule.

    ``kind``: text, number, flag, texts (the texts of an array), skills (names with a category),
    rows (objects by ``fields``), objects (as JSON).  ``also`` are other names that are tried;
    ``allowed`` the values of an enumeration.  With ``filled`` a blank text counts as missing.
    With ``coerce`` other types are converted as a loosely typed language does: a number that
    is 0 or none counts as missing, the text "true" is true.
    """

    name: str
    kind: str = "text"
    default: object = None
    also: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    fields: tuple[Field, ...] = ()
    filled: bool = False
    trim: bool = False
    coerce: bool = False


def at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def is_kind(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(f"^({KINDS[kind]})$"), F.lit(False))


def elements(v: Column) -> Column:
    """The elements of an array, none of anything else."""
    none = F.array().cast("array<variant>")
    return F.coalesce(F.when(is_kind(v, "texts"), F.try_variant_get(v, "$", "array<variant>")), none)


def text_of(v: Column) -> Column:
    return F.when(is_kind(v, "text"), F.try_variant_get(v, "$", "string"))


def texts_of(v: Column) -> Column:
    return F.transform(F.filter(elements(v), lambda x: is_kind(x, "text")), lambda x: F.try_variant_get(x, "$", "string"))


def skills_of(v: Column, categories: Sequence[str]) -> Column:
    """(name, category): texts, and objects with a name; a category that is unknown is Other."""

    def one(x: Column) -> Column:
        category = text_of(at(x, "category"))
        known = F.when(category.isin(*categories), category).otherwise("Other")
        named = F.struct(text_of(at(x, "name")).alias("name"), known.alias("category"))
        return F.when(is_kind(x, "text"), F.struct(F.try_variant_get(x, "$", "string").alias("name"), F.lit("Other").alias("category"))).when(text_of(at(x, "name")).isNotNull(), named)

    return F.array_compact(F.transform(elements(v), one))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike("^OBJECT<"), F.lit(False))


def missing(v: Column) -> Column:
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def loose(v: Column, kind: str, trim: bool) -> Column:
    """A value of any type as text, number, flag or date."""
    text = F.try_variant_get(v, "$", "string")
    if kind == "text":
        return F.trim(text) if trim else text
    number = F.coalesce(F.try_variant_get(v, "$", "double"), F.when(is_kind(v, "flag"), F.try_variant_get(v, "$", "boolean").cast("double")))
    if kind == "number":
        return F.when((number != 0) & ~F.isnan(number), number)
    if kind == "date":
        return F.when(is_kind(v, "number"), F.timestamp_millis(number.cast("long"))).otherwise(F.try_to_timestamp(text))
    return F.when(is_kind(v, "text"), text == "true").when(is_kind(v, "flag"), F.try_variant_get(v, "$", "boolean")).otherwise(F.coalesce(number != 0, F.lit(True)))


def default_of(f: Field) -> Column:
    return F.lit(f.default).cast(TYPES[f.kind]) if f.kind in TYPES else F.lit(f.default)


def value(v: Column, f: Field) -> Column:
    found = at(v, f.name)
    if f.kind == "texts":
        return texts_of(found)
    if f.kind == "skills":
        return skills_of(found, f.allowed)
    if f.kind == "objects":
        return F.transform(F.filter(elements(found), is_object), lambda x: F.to_json(x))
    if f.kind == "rows":
        return F.transform(F.filter(elements(found), is_object), lambda x: F.struct(*[value(x, g).alias(g.name) for g in f.fields]))
    if f.coerce:
        return F.coalesce(let(found, lambda x: F.when(~missing(x), loose(x, f.kind, f.trim))), default_of(f))

    def strict(name: str) -> Column:
        got = let(at(v, name), lambda own: F.when(is_kind(own, f.kind), F.try_variant_get(own, "$", TYPES[f.kind])))
        if f.allowed:
            got = F.when(got.isin(*f.allowed), got)
        return F.when(F.trim(got) != "", got) if f.filled else got

    return F.coalesce(*[strict(name) for name in (f.name, *f.also)], default_of(f))


def error(v: Column, f: Field) -> Column:
    """What is wrong with a field that is there, or null."""

    def wrong(found: Column) -> Column:
        if f.coerce:
            return F.when(~missing(found) & loose(found, f.kind, f.trim).isNull(), f"{f.name}: no {f.kind}")
        other = F.when(~missing(found) & ~is_kind(found, f.kind), f"{f.name}: no {f.kind}")
        if f.allowed and f.kind == "text":
            other = F.coalesce(other, F.when(~missing(found) & ~F.coalesce(text_of(found).isin(*f.allowed), F.lit(False)), f"{f.name}: not allowed"))
        return other

    return F.lit(None).cast("string") if f.coerce and f.kind == "text" else let(at(v, f.name), wrong)


def parsed(text: Column) -> Column:
    """JSON as VARIANT; null if it is none."""
    return F.try_parse_json(text)


def validated(v: Column, fields: Sequence[Field]) -> Column:
    """A struct of the fields' values and ``errors``; null where the JSON is no object."""

    def made(own: Column) -> Column:
        errors = F.array_compact(F.array(*[error(own, f) for f in fields]))
        return F.when(is_object(own), F.struct(*[value(own, f).alias(f.name) for f in fields], errors.alias("errors")))

    return let(v, made)


def pay_of(v: Column) -> Column:
    """(salary_min, salary_max, salary_currency, salary_interval): usable amounts in order, or four nulls.

    Numbers within the interval's bounds, yearly without one, in a known currency.
    """
    return let(v, lambda own: let(said_pay(own), usable))


def said_pay(v: Column) -> Column:
    """(low, high, interval, currency) as the JSON has them."""
    number = lambda name: let(at(v, name), lambda x: F.when(is_kind(x, "number"), F.try_variant_get(x, "$", "double")))
    asked = text_of(at(v, "salary_interval"))
    interval = F.when(asked.isin(*BOUNDS), asked).otherwise("yearly")
    currency = F.upper(text_of(at(v, "salary_currency")))
    return F.struct(number("salary_min").alias("low"), number("salary_max").alias("high"), interval.alias("interval"), currency.alias("currency"))


def usable(said: Column) -> Column:
    low, high, interval, currency = (said[c] for c in ("low", "high", "interval", "currency"))
    fits = F.lit(False)
    for name, (least, most) in BOUNDS.items():
        fits |= (interval == name) & F.coalesce(low.between(least, most), F.lit(True)) & F.coalesce(high.between(least, most), F.lit(True))
    good = (low.isNotNull() | high.isNotNull()) & currency.isin(*CURRENCIES) & fits
    swapped = low > high
    parts = {
        "salary_min": F.when(swapped, high).otherwise(low), "salary_max": F.when(swapped, low).otherwise(high), "salary_currency": currency, "salary_interval": interval,
    }
    return F.struct(*[F.when(good, c).alias(n) for n, c in parts.items()])


# Enumerations.
LEVELS = ("Entry", "Mid", "Senior", "Lead", "Executive")
EMPLOYMENT = ("Full-time", "Part-time", "Contract", "Internship")
SKILLS = ("Language", "Framework", "Database", "Cloud", "DevOps", "Tool", "Domain", "Other")
OFFERED = ("available", "not_available", "not_mentioned")
REMOTE = ("fully_remote", "hybrid", "on_site", "not_mentioned")

REQUIREMENTS = (
    Field("required_skills", "skills", allowed=SKILLS), Field("preferred_skills", "skills", allowed=SKILLS), Field("tools_and_platforms", "texts"),
    Field("min_experience_years", "number"), Field("max_experience_years", "number"), Field("required_education", filled=True),
    Field("experience_level", allowed=LEVELS), Field("employment_type", allowed=EMPLOYMENT), Field("german_level_detail", default="not mentioned", filled=True),
    Field("visa_sponsorship", default="not_mentioned", allowed=OFFERED), Field("remote_policy_detail", default="not_mentioned", allowed=REMOTE),
    Field("relocation_support", default="not_mentioned", allowed=OFFERED), Field("team_context", filled=True), Field("key_responsibilities", "texts"),
)
PROFILE = (
    Field("name"), Field("email"), Field("phone"), Field("linkedin_url"), Field("summary", default=""),
    Field("experience", "rows", fields=(
        Field("company", default=""), Field("title", default=""), Field("startDate"), Field("endDate"), Field("isCurrent", "flag", default=False),
        Field("responsibilities", "texts"), Field("technologies", "texts"),
    )),
    Field("education", "rows", fields=(Field("institution", default=""), Field("degree", default=""), Field("field", default=""), Field("endDate"))),
    Field("skills", "skills", allowed=SKILLS), Field("projects", "rows", fields=(Field("name", default=""), Field("description", default=""), Field("technologies", "texts"))),
    Field("total_experience_years", "number", also=("experience_years",)), Field("seniority_level", allowed=LEVELS, also=("level",)),
    Field("domain", default="Other"), Field("sub_domain"), Field("languages", "objects"), Field("location"), Field("open_to_remote", "flag"),
    Field("open_to_relocate", "flag"), Field("visa_required", "flag"), Field("certifications", "texts"),
)
POSTING = (
    *[Field(n, coerce=True, trim=n == "JobTitle") for n in ("JobID", "sourceSite", "JobTitle", "ApplicationURL", "DirectApplyURL")],
    Field("Description", default="", coerce=True), Field("DescriptionHtml", coerce=True), Field("descriptionPreview", default="", coerce=True),
    *[Field(n, default="N/A", coerce=True) for n in ("Location", "Company", "ATSPlatform", "Department", "ContractType", "ExperienceLevel")],
    *[Field(n, "flag", default=False, coerce=True) for n in ("GermanRequired", "IsRemote", "isEntryLevel")],
    Field("Domain", default="Unclear", coerce=True), Field("SubDomain", default="Other", coerce=True), Field("Status", default="pending_review", coerce=True),
    Field("WorkplaceType", default="Unspecified", coerce=True),
    *[Field(n, "number", default=d, coerce=True) for n, d in (("ConfidenceScore", 0), ("applyClicks", 0), ("SalaryMin", None), ("SalaryMax", None))],
    *[Field(n, coerce=True) for n in ("approvalMethod", "Team", "Office", "EmploymentType", "Country", "SalaryCurrency", "SalaryInterval")],
    *[Field(n, "date", coerce=True) for n in ("autoPublishedAt", "PostedDate")], Field("AllLocations", "texts"), Field("Tags", "texts"),
)
PREFERENCES = (
    *[Field(n, "number", coerce=True) for n in ("salary_min", "salary_max")],
    *[Field(n, coerce=True) for n in ("preferred_work_style", "notice_period", "available_from", "visa_status")],
)


def preferences(v: Column) -> Column:
    """What a caller sets of the preferences: empty texts, false and 0 are no texts; amounts are numbers or nothing."""

    def own(made: Column) -> Column:
        texts = lambda c: F.when(~c.isin("", "false", "0"), c)
        return F.when(made.isNotNull(), F.struct(*[(made[f.name] if f.kind == "number" else texts(made[f.name])).alias(f.name) for f in PREFERENCES]))

    return let(validated(v, PREFERENCES), own)
