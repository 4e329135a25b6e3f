"""The ingest chain: an ordered list of reasons to reject, in one pass over the postings.

Rejections stay rows: ``reject_reason`` names the first rule that fits, so that a report
and the accepted rows come from the same scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.functions.text import EDGE, fingerprint, js_trim, marker_language
from tidemark.operators.ranking import first_per_key

# Role words of titles that are never published.
BANNED_ROLES = [
    "intern", "internship", "werkstudent", "werkstudentin", "working student", "student assistant",
    "studentische hilfskraft", "ausbildung", "trainee", "duales studium", "apprentice", "apprenticeship",
    "filialleiter", "filialleitung", "store manager", "shop manager", "verke4ufer", "sales assistant", "cashier",
    "zeitarbeit", "leiharbeit", "phd thesis", "master thesis", "bachelor thesis",
]
# Titles that ask for German.
GERMAN_TITLES = [
    r"\bgerman[\s-]*speak(?:ing|er)\b", r"\bgerman[\s-]*fluent\b", r"\bfluent[\s-]*german\b", r"\bgerman[\s-]*native\b",
    r"\bnative[\s-]*german\b", r"\bgerman[\s-]*(?:required|mandatory)\b", r"\bgerman[\s-]*(?:c[12]|b[12])\b",
    r"\b(?:c[12]|b[12])[\s-]*german\b", r"\bdeutschsprachig(?:e[rn]?)?\b", r"\bmuttersprachler(?:in)?\b",
    r"\bflie[ßs]end[\s-]*deutsch\b", r"\bdeutschkenntnisse\b",
]
# Descriptions that ask for a citizenship.
CITIZENSHIP = [
    r"\bgerman\s+(?:citizenship|nationality)\s+(?:is\s+)?(?:required|mandatory|essential|necessary|needed)\b",
    r"\b(?:require[sd]?|must\s+have|must\s+hold|must\s+possess)\s+german\s+(?:citizenship|nationality)\b",
    r"\bmust\s+be\s+a\s+german\s+citizen\b",
    r"\bgerman\s+(?:citizen|national)\s+(?:only|required)\b",
    r"\b(?:no|not)\s+dual\s+citizenship\b",
    r"\bdual\s+citizenship\s+(?:is\s+)?not\s+(?:allowed|accepted|permitted)\b",
    r"\b(?:eu|eea)\s+(?:citizenship|nationality|work\s+(?:permit|authorization))\s+(?:is\s+)?(?:required|mandatory|essential)\b",
    r"\b(?:require[sd]?|must\s+have|must\s+hold)\s+(?:eu|eea)\s+(?:citizenship|nationality)\b",
    r"\bmust\s+be\s+(?:an?\s+)?(?:eu|eea)\s+(?:citizen|national|resident)\b",
    r"\bStaatsbürgerschaft\s+erforderlich\b",
    r"\bdeutsche\s+Staats(?:bürgerschaft|angehörigkeit)\b",
    r"\bdeutsche[rn]?\s+(?:Pass|Ausweis)\s+erforderlich\b",
]
# Other languages that a description may ask for, in the order of the check.
LANGUAGES = (
    "french dutch polish turkish spanish italian portuguese czech hungarian romanian danish swedish norwegian finnish "
    "greek arabic russian ukrainian japanese chinese mandarin cantonese korean hindi hebrew"
).split()
# How it asks; LANG stands for the language.
ASKS = [
    r"\b(?:fluent|fluency|native|proficient|proficiency)\s+(?:in\s+)?LANG\b",
    r"\bLANG\s+(?:required|mandatory|essential|fluent|native|proficiency)\b",
    r"\bLANG\s+(?:c[12]|b2)\b",
    r"\b(?:c[12]|b2)\s+(?:level\s+)?(?:in\s+)?LANG\b",
    r"\bLANG\s+(?:native\s+)?speaker\b",
    r"\bnative[\s-]+(?:level\s+)?LANG\b",
]


def java_regex(pattern: str) -> str:
    """A pattern with ASCII word edges, spaces that include no-break ones, and case ignored."""
    return "(?iu)" + pattern.replace(r"\b", EDGE).replace(r"[\s-]", r"[\s\u00A0-]").replace(r"\s+", r"[\s\u00A0]+")


def first_phrase(c: Column, patterns: list[str]) -> Column:
    """The text that the first fitting pattern matches; null without any."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), java_regex(p), 0), F.lit("")) for p in patterns])


def other_language(description: Column) -> Column:
    """The first language of the list that the description asks for; null without any.

    One alternation finds rows that ask for any; only those are asked for each language.
    """
    text = F.coalesce(description, F.lit(""))
    some = "|".join(p.replace("LANG", f"(?:{'|'.join(LANGUAGES)})") for p in ASKS)
    each = F.coalesce(*[F.when(text.rlike(java_regex("|".join(ASKS).replace("LANG", lang))), F.lit(lang)) for lang in LANGUAGES])
    return F.when(text.rlike(java_regex(some)), each)


def reject_reason(known: Column | None = None) -> Column:
    """The first reason to reject a row of JobTitle and Description; null if accepted."""
    title, text = F.col("JobTitle"), F.col("Description")
    rules = [
        ("known", F.lit(False) if known is None else known),
        ("no_title", js_trim(F.coalesce(title, F.lit(""))) == ""),
        ("banned_role", F.lower(title).rlike("|".join(BANNED_ROLES))),
        ("german_title", first_phrase(title, GERMAN_TITLES).isNotNull()),
        ("not_english", marker_language(text).isNotNull()),
        ("citizenship", first_phrase(text, CITIZENSHIP).isNotNull()),
        ("other_language", other_language(text).isNotNull()),
    ]
    return F.coalesce(*[F.when(fits, F.lit(name)) for name, fits in rules])


def judged(postings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``postings`` with fingerprint, reject_reason and Status.

    ``verdicts`` (fingerprint, german, confidence) is looked up for rows that pass the
    rules: German or below 0.6 is rejected, from 0.85 on published, between and without
    verdict left for review.  Spark broadcasts the verdicts if they are small.
    """
    marked = postings.withColumn("fingerprint", fingerprint(F.col("JobTitle"), F.col("Company"), F.col("Description"))).withColumn(
        "reject_reason", reject_reason()
    )
    best = verdicts.groupBy("fingerprint").agg(F.max(F.struct("confidence", "german")).alias("v"))
    met = marked.join(best, "fingerprint", "left")
    band = (
        F.when(F.col("reject_reason").isNotNull() | F.coalesce("v.german", F.lit(False)), "rejected")
        .when(F.col("v.confidence") < 0.6, "rejected").when(F.col("v.confidence") >= 0.85, "active").otherwise("pending_review")
    )
    return met.withColumn("Status", band).drop("v")


def fits_keywords(title: Column, keywords: list[str]) -> Column:
    """Any keyword of the source in the title; without keywords every title fits."""
    return F.lower(F.coalesce(title, F.lit(""))).rlike("|".join(re.escape(k.lower()) for k in keywords)) if keywords else F.lit(True)


def first_arrivals(rows: DataFrame, title: str, company: str, *order: str) -> DataFrame:
    """The first row of each company and title, by ``order``: later ones are the same job in another city or entity."""
    keyed = rows.withColumns({"_company": names.company_key(F.col(company)), "_title": names.title_key(F.col(title))})
    return first_per_key(keyed, ["_company", "_title"], *order).drop("_company", "_title")


def summary(rows: DataFrame, site: str) -> DataFrame:
    """(site, reason, n): how many rows were accepted, and rejected for which reason."""
    return rows.groupBy(site, F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))
