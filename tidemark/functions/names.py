"""Names: companies without legal form, keys across entities, domains, slugs."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import js_trim

# Legal forms, in the order in which they are taken off.
LEGAL_FORMS = [
    "gesellschaft mit beschränkter haftung", "gmbh & co. kg", "gmbh & co kg", "gmbh & co.", "gmbh & co", "gmbh",
    "ag & co. kgaa", "ag & co kgaa", "ag", "e.v.", "ohg", "kg",
    "incorporated", "corporation", "limited liability company",
    "inc.", "inc", "corp.", "corp", "llc", "llp", "ltd.", "ltd", "limited", "plc",
    "b.v.", "bv", "n.v.", "nv",
    "s.a.r.l.", "sarl", "s.a.r.l", "sàrl",
    "s.a.", "sa", "s.r.l.", "srl", "s.p.a.", "spa", "a.s.", "as", "oy", "oyj", "ab", "a/s", "aps", "se",
]
# Hosts of application systems, which say nothing about a company.
SYSTEM_HOSTS = [
    "greenhouse.io", "lever.co", "ashbyhq.com", "workable.com", "smartrecruiters.com", "recruitee.com",
    "jobs.personio.de", "jobs.personio.com", "teamtailor.com", "myworkdayjobs.com",
]
# Labels of career sites in front of a company's domain.
CAREER_LABELS = ["www", "careers", "career", "jobs", "job", "apply", "hire", "work", "join", "boards", "recruiting"]


def company_key(name: Column) -> Column:
    """A company's name in lower case without its legal form.

    A form behind a comma, or behind the letter s, goes first, one of each kind; then one
    form at the very end, whatever stands before it, if two characters are left.  (The
    letter s is what the rule has always meant by a space: "Visa" gives "vi".)
    """
    key = F.lower(js_trim(F.coalesce(name, F.lit(""))))
    for form in LEGAL_FORMS:
        key = F.regexp_replace(key, rf"[,s]+{re.escape(form)}s*\z", "")

    def cut(key: Column) -> Column:
        bare = [js_trim(F.left(key, F.length(key) - len(form))) for form in LEGAL_FORMS]
        return F.coalesce(*[F.when(F.endswith(key, F.lit(f)) & (F.length(b) > 1), b) for f, b in zip(LEGAL_FORMS, bare, strict=True)], key)

    # bound by a lambda, or the optimizer would copy the chain into every branch
    last = F.get(F.transform(F.array(key), cut), F.lit(0))
    return js_trim(F.regexp_replace(F.regexp_replace(last, r"[,.\-]+\z", ""), r"[\s\u00A0]+", " "))


def city_of(place: Column) -> Column:
    """What stands before the first comma, semicolon, bar or dash, without "remote" in front."""
    first = js_trim(F.get(F.split(F.lower(js_trim(F.coalesce(place, F.lit("")))), r"[,;|–—\-]"), F.lit(0)))
    return js_trim(F.regexp_replace(first, r"^remote[\s\u00A0]*[-–—]?[\s\u00A0]*", ""))


def title_key(title: Column) -> Column:
    return js_trim(F.lower(F.coalesce(title, F.lit(""))))


def entity_key(title: Column, company: Column, place: Column) -> Column:
    """company|title|city: equal for the same posting by several entities of a company."""
    return F.concat_ws("|", company_key(company), title_key(title), city_of(place))


def company_domain(url: Column) -> Column:
    """The company's domain of an application URL; null for hosts of application systems."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    system = rf"(?:^|\.)(?:{'|'.join(re.escape(h) for h in SYSTEM_HOSTS)})$"
    own = F.regexp_replace(host, rf"^(?:(?:{'|'.join(CAREER_LABELS)})\.)+(?=[^.]+\.[^.]+)", "")
    return F.when(~host.rlike(system), F.nullif(own, F.lit("")))


def accents() -> tuple[str, str]:
    """Letters below U+0250 that are a letter with accents, and those letters."""
    plain = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x250)}
    some = {c: d[0] for c, d in plain.items() if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])}
    return "".join(some), "".join(some.values())


def slug(text: Column, length: int = 80) -> Column:
    """Lower case, accents off, anything else but letters and digits a dash."""
    bare = F.lower(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"[̀-ͯ]", ""), *accents()))
    return F.left(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(length))


def board_guesses(company: Column, least: int = 3) -> Column:
    """Names under which a company's board may be found: joined, dashed, first word."""
    low = js_trim(F.lower(F.coalesce(company, F.lit(""))))
    joined, dashed = F.regexp_replace(low, "[^a-z0-9]+", ""), F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    first = F.get(F.split(dashed, "-"), F.lit(0))
    return F.filter(F.array_distinct(F.array(joined, dashed, first)), lambda s: F.length(s) >= least)


def clean_list(values: Column) -> Column:
    """Trimmed, non-empty strings of an array, each once, in the order of first sight."""
    return F.array_distinct(F.filter(F.transform(values, js_trim), lambda v: v.isNotNull() & (v != "")))


def clean_skills(skills: Column, categories: list[str], fallback: str = "Other") -> Column:
    """Skills (name, category) with a name, trimmed; a category that is not listed becomes the fallback."""
    named = F.filter(skills, lambda s: js_trim(F.coalesce(s["name"], F.lit(""))) != "")
    return F.transform(named, lambda s: F.struct(js_trim(s["name"]).alias("name"), F.when(s["category"].isin(categories), s["category"]).otherwise(fallback).alias("category")))
