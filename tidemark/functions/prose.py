"""Texts of postings: tags off, snippets for a reader, replies of models, labels."""

from __future__ import annotations

from datetime import datetime
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import EDGE, js_trim, let

#: Named entities: the names of HTML 4 and the apostrophe, with the characters of HTML 5.
ENTITIES = {name: html5[f"{name};"] for name in (*name2codepoint, "apos")}
#: Of these the names that need no semicolon.
SHORT = sorted(name for name in ENTITIES if name in html5)
#: What numbers from 128 to 159 stand for: the characters of Windows' code page, where it has one.
WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}
# What begins the boilerplate at the end of a text.
TAILS = [
    r"\n\s*(?:we are (?:proud to be )?an equal opportunity employer)", r"\n\s*(?:equal employment opportunity)",
    r"\n\s*(?:AEDT|automated employment decision tool)", r"\n\s*(?:pursuant to the (?:san francisco|los angeles|new york))",
]
# Phrases that ask for German.
GERMAN_PHRASES = [
    r"\b(?:fluent|fluency|proficien(?:t|cy)|native)[\s\-]+(?:in\s+)?german",
    r"\bgerman[\s\-]+(?:fluent|native|required|mandatory|essential|speaker|proficiency)",
    r"\bgerman\s*\((?:fluent|native|required|mandatory|C[12]|B[12])\)",
    r"\bcommunication(?:\s+skills?)?\s+(?:in\s+)?(?:both\s+)?(?:english\s+and\s+)?german",
    r"\bgerman\s+(?:and|&|\+)\s+english", r"\benglish\s+(?:and|&|\+)\s+german",
    r"\bgerman\s*[\(\-]?\s*(?:A[12]|B[12]|C[12])[\+\)]?", r"\b(?:A[12]|B[12]|C[12])[\+\-]?\s*(?:level\s+)?(?:in\s+)?german",
    r"\bDeutschkenntnisse", r"\bVerhandlungssichere?s?\s*Deutsch", r"\bflie[ßs]end(?:e[srnm]?)?\s*Deutsch",
    r"\bMuttersprachler(?:in)?\b", r"\bDu\s+sprichst\b", r"\bDu\s+verf[üu]gst\b", r"\bgute[rns]?\s+Deutsch",
    r"\bSprachkenntnisse",
]


def character(number: Column) -> Column:
    """The character of a code point; what is none becomes the replacement character."""
    none = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    windows = F.create_map(*[F.lit(x) for pair in WINDOWS.items() for x in pair])
    safe = F.when(none, 0xFFFD).otherwise(number).cast("long")
    return F.when(number.between(128, 159), F.try_element_at(windows, number.cast("int"))).otherwise(F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32"))


def decoded(text: Column) -> Column:
    """Entities as characters: numbers, the names of HTML 4, and those names that need no semicolon without one."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    short = F.array(*[F.lit(n) for n in SHORT])

    def code(digits: Column, base: int) -> Column:
        """A number of more than nine digits is no character."""
        bare = F.ltrim(digits, F.lit("0"))
        return F.when(F.length(bare) > 9, 0x7FFFFFFF).when(bare == "", 0).otherwise(F.conv(bare, base, 10).cast("long"))

    def part(p: Column) -> Column:
        """What stands behind an ampersand."""
        number, hexed, name = F.regexp_extract(p, "^#([0-9]+)", 1), F.regexp_extract(p, "^#[xX]([0-9a-fA-F]+)", 1), F.regexp_extract(p, "^[A-Za-z][A-Za-z0-9]*", 0)
        rest = lambda n: F.regexp_replace(F.substring(p, n + 1, F.length(p)), "^;", "")
        ended = F.substring(p, F.length(name) + 1, F.lit(1)) == ";"
        known = F.when(ended | F.array_contains(short, name), F.try_element_at(names, name))
        return (
            F.when(number != "", F.concat(character(code(number, 10)), rest(F.length(number) + 1)))
            .when(hexed != "", F.concat(character(code(hexed, 16)), rest(F.length(hexed) + 2)))
            .when(known.isNotNull(), F.concat(known, rest(F.length(name)))).otherwise(F.concat(F.lit("&"), p))
        )

    parts = F.split(text, "&")
    whole = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), part), ""))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def bare(html: Column) -> Column:
    """Tags out without a trace, entities decoded before and after, white space collapsed."""
    text = decoded(F.regexp_replace(decoded(F.coalesce(html, F.lit(""))), "<[^>]+>", ""))
    return js_trim(F.regexp_replace(text, "[\\s\u00A0]+", " "))


def gated_preview(text: Column, length: int = 150) -> Column:
    """The first characters with dots behind, always."""
    return F.concat(F.left(F.coalesce(text, F.lit("")), F.lit(length)), F.lit("..."))


def found_at(text: Column, pattern: str) -> Column:
    """(place from 0, length) of the first match; null without one."""
    java = "(?iu)" + pattern.replace(r"\b", EDGE)
    found = lambda place: F.when(place > 0, F.struct((place - 1).alias("at"), F.length(F.regexp_extract(text, java, 0)).alias("n")))
    return let(F.regexp_instr(text, F.lit(java)), found)


def without_tail(text: Column) -> Column:
    """Tracking tags out; boilerplate cut where it begins in the last 30 % of the text."""

    def cut(clean: Column) -> Column:
        late = F.coalesce(*[let(found_at(clean, p)["at"], lambda at: F.when(at > F.length(clean) * 0.7, at)) for p in TAILS])
        return F.coalesce(js_trim(F.left(clean, late)), clean)

    whole = let(F.regexp_replace(F.coalesce(text, F.lit("")), "#LI-[A-Za-z0-9]+", ""), cut)
    return js_trim(F.regexp_replace(whole, "[\\s\u00A0]{3,}", "\n\n"))


def german_context(text: Column, around: int = 1000) -> Column:
    """The text around the first phrase, by the order of phrases, that asks for German; null below 100 characters."""

    def part(hit: Column) -> Column:
        start = F.greatest(hit["at"] - around, F.lit(0))
        return js_trim(F.substring(text, start + 1, hit["at"] + hit["n"] + around - start))

    def some(low: Column) -> Column:
        """Whether any phrase is possible: each has one of these parts."""
        return F.greatest(*[F.contains(low, F.lit(w)) for w in ("german", "deut", "mutter", "prich", "verf", "prach")])

    possible = (F.length(text) >= 100) & let(F.lower(text), some)
    return F.when(possible, let(F.coalesce(*[found_at(text, p) for p in GERMAN_PHRASES]), part))


# Headings of what a posting asks for, and of what follows it.
ASKED_HEADINGS = [
    "requirements", "what you['']ll bring", "what we['']re looking for", "your profile", "qualifications", "what you bring", "your expertise", "who you are",
    "must[- ]?have", "minimum requirements", "required skills", "key requirements", "what we expect", "your skills", "skills and experience", "about you",
    "what you need", "desired qualifications", "preferred qualifications", "you have", "humble expectations", "technical qualifications", "core competencies",
    "essential skills", "your background", "key qualifications", "what you['']ll need", "experience and skills", "our requirements",
]
ASKED_HEADINGS_DE = [
    "anforderungen", "was du mitbringst", "dein profil", "qualifikationen", "was wir erwarten", "deine skills", "voraussetzungen", "das bringst du mit",
    "was sie mitbringen", "ihr profil", "das solltest du mitbringen", "deine qualifikationen", "das zeichnet dich aus", "das erwarten wir", "dein hintergrund",
]
OTHER_HEADINGS = [
    "benefits", "what we offer", "how we['']ll take care", "our commitment", "about us", "about the", "the team", "your responsibilities", "what you['']ll do",
    "our offer", "was wir bieten", "unser angebot", "location", "salary", "compensation", "perks", "why join", "why us", "apply", "how to apply",
    "nice to have", "bonus points", "unsere benefits", "was wir dir bieten",
]


def heading(words: list[str], start: str) -> str:
    """A line that is one of the headings, with a colon or dash at most."""
    return rf"{start}[\s\u00A0]*(?:{'|'.join(words)})[\s\u00A0]*[:\-]?[\s\u00A0]*\n"


def asked_section(text: Column, least: int = 100, most: int = 3000) -> Column:
    """What stands under the first heading of requirements, English before German, up to another heading; null below ``least`` characters."""

    def section(rest: Column) -> Column:
        end = F.coalesce(found_at(rest, heading(OTHER_HEADINGS, r"\n"))["at"], F.lit(most))
        return let(js_trim(F.left(rest, end)), lambda s: F.when(F.length(s) >= least, s))

    def under(words: list[str]) -> Column:
        rest = let(found_at(text, heading(words, r"(?:^|\n)")), lambda hit: F.substring(text, hit["at"] + hit["n"] + 1, F.length(text)))
        return let(rest, section)

    return F.coalesce(under(ASKED_HEADINGS), under(ASKED_HEADINGS_DE))


def snippet(text: Column, room: int = 4000, most: int = 5500) -> Column:
    """What a reader with little room gets of a plain text: German context, or all, or the requirements between both ends, or both ends."""

    def framed(clean: Column) -> Column:
        parts = (F.lit("\n\n--- REQUIREMENTS SECTION ---\n"), asked_section(clean), F.lit("\n--- END REQUIREMENTS ---\n\n"))
        return F.left(F.concat(F.left(clean, F.lit(1000)), *parts, F.right(clean, F.lit(1000))), F.lit(most))

    def taken(clean: Column) -> Column:
        ends = F.concat(F.left(clean, F.lit(1500)), F.lit("\n...\n"), F.right(clean, F.lit(2500)))
        return F.coalesce(german_context(clean), F.when(F.length(clean) <= room, clean), framed(clean), ends)

    return let(without_tail(text), taken)


def reply_json(reply: Column, schema: str, array: bool = False) -> Column:
    """A model's reply as JSON: fences off, else the part between the outer brackets; null if neither parses."""
    clean = js_trim(F.regexp_replace(F.regexp_replace(js_trim(reply), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    part = F.regexp_extract(clean, r"\[[\s\S]*\]" if array else r"\{[\s\S]*\}", 0)
    whole = lambda c: F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema))
    return F.coalesce(whole(clean), whole(part))


def one_of(value: Column, allowed: list[str], fallback: str | None = None) -> Column:
    return F.when(value.isin(allowed), value).otherwise(F.lit(fallback))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\s\u00A0]+"), lambda w: w != ""))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(js_trim(F.coalesce(text, F.lit(""))), "[\\s\u00A0]+"), 1, n), " ")


def days_ago(ts: Column, as_of: datetime) -> Column:
    """today, yesterday or "N days ago"; empty without a date."""
    days = F.floor((F.unix_micros(F.lit(as_of)) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000)
    return F.when(ts.isNull(), "").when(days <= 0, "today").when(days == 1, "yesterday").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))


def employment_label(raw: Column) -> Column:
    """ "FullTime" and "full_time" give "Full time"."""
    clean = js_trim(F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), "[_-]", " "), "([a-z])([A-Z])", "$1 $2"))
    return F.concat(F.upper(F.left(clean, F.lit(1))), F.lower(F.substring(clean, 2, 1_000_000)))


def escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def tier(score: Column) -> Column:
    return F.when(score >= 85, "strong").when(score >= 65, "good").otherwise("partial")


def by_key_part(entries: Column, parts: list[str]) -> Column:
    """The value of the first (name, value) whose name holds any of the parts."""
    fits = lambda e: F.lower(e["name"]).rlike("|".join(parts))
    return F.get(F.filter(entries, fits), F.lit(0))["value"]
