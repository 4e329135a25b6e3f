"""Canonical values of postings: lookups and trust orders as column expressions.

Every resolver takes the value that was read from the description (``said``) and the one
of the feed (``given``); the description wins where it says anything known.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import js_trim

# Spellings of each canonical value.
WORKPLACE = {
    "remote": ["remote", "fully remote", "fully_remote"],
    "hybrid": ["hybrid", "partially remote", "partially_remote", "flexible"],
    "onsite": ["on-site", "on_site", "onsite", "in-office", "office"],
}
EXPERIENCE = {
    "entry": ["entry level", "entry", "entry_level", "junior", "intern", "internship", "student", "werkstudent", "praktikant"],
    "mid": ["mid", "mid level", "mid_level", "mid-level", "associate", "fachkraft", "experienced", "professional", "ic2", "ic3"],
    "senior": ["mid-senior level", "senior", "senior level", "senior_level", "ic4", "staff"],
    "lead": ["lead", "principal", "staff engineer", "teamleiter", "team lead"],
    "executive": [
        "director", "vp", "vice president", "head of", "c-level", "executive", "geschäftsführer", "managing director",
        "cto", "ceo", "cfo", "coo", "ciso",
    ],
}
EMPLOYMENT = {
    "fulltime": [
        "full-time", "fulltime", "full_time", "permanent", "regular", "festanstellung", "unbefristet", "vollzeit",
        "fulltime_fixed_term",
    ],
    "parttime": ["part-time", "parttime", "part_time", "teilzeit"],
    "contract": ["contract", "freelance", "temporary", "befristet", "fixed-term", "contractor", "zeitarbeit"],
    "internship": ["internship", "werkstudent", "working student", "praktikum", "ausbildung", "apprenticeship"],
}
EUROS = {"EUR": 1.0, "USD": 0.92, "GBP": 1.17, "CHF": 1.05}
TIMES_A_YEAR = {"yearly": 1, "monthly": 12, "hourly": 2080}
YEARLY = (10_000, 1_000_000)


def canonical(value: Column, spellings: dict[str, list[str]]) -> Column:
    """The canonical value of a spelling, case and outer space ignored; null if unknown."""
    key = F.lower(js_trim(value.cast("string")))
    found = F.lit(None).cast("string")
    for name, known in spellings.items():
        found = F.when(key.isin(known), F.lit(name)).otherwise(found)
    return found


def workplace(said: Column, given: Column, location: Column) -> Column:
    remote = F.when(F.lower(F.coalesce(location, F.lit(""))).contains("remote"), F.lit("remote"))
    return F.coalesce(canonical(said, WORKPLACE), canonical(given, WORKPLACE), remote)


def experience(said: Column, given: Column, entry: Column) -> Column:
    return F.coalesce(canonical(said, EXPERIENCE), canonical(given, EXPERIENCE), F.when(entry, F.lit("entry")))


def employment(said: Column, given: Column) -> Column:
    return F.coalesce(canonical(said, EMPLOYMENT), canonical(given, EMPLOYMENT))


def confirmed(value: Column) -> Column:
    """Only a confirmed offer counts: "available" or null."""
    return F.when(value == "available", F.lit("available"))


def yearly_euros(amount: Column, currency: Column, interval: Column) -> Column:
    """Whole euros a year; null for unknown currencies and beyond the bounds of a salary."""
    rate = F.lit(None).cast("double")
    for name, r in EUROS.items():
        rate = F.when(F.upper(currency) == name, F.lit(r)).otherwise(rate)
    times = F.lit(1)
    for name, n in TIMES_A_YEAR.items():
        times = F.when(F.lower(interval) == name, F.lit(n)).otherwise(times)
    year = F.floor(amount * times * rate + 0.5)
    return F.when((amount > 0) & year.between(*YEARLY), year)


def salary(given: dict[str, Column], said: dict[str, Column]) -> Column:
    """A struct of min, max, currency, interval, tier from two sources of
    min, max, currency and interval.  A source with either bound gives the whole pair."""
    has = lambda s: F.coalesce(s["min"] > 0, F.lit(False)) | F.coalesce(s["max"] > 0, F.lit(False))
    tier = F.when(has(given), F.lit("ats")).when(has(said), F.lit("jd"))
    pick = lambda k: F.when(has(given), given[k]).otherwise(said[k])
    low, high = (yearly_euros(pick(k), pick("currency"), pick("interval")) for k in ("min", "max"))
    some = tier.isNotNull() & (low.isNotNull() | high.isNotNull())
    parts = {"min": low, "max": high, "currency": F.lit("EUR"), "interval": F.lit("yearly"), "tier": tier}
    return F.struct(*[F.when(some, v).alias(k) for k, v in parts.items()])
