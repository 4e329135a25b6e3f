"""Scalar text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a language, in the order in which languages are tried; a
# word that stands twice counts twice.
MARKERS = {
    "french": (
        "nous vous sont avec pour dans votre notre être avoir cette aussi mais chez depuis toutes leurs comme après "
        "entre fait très peut plus tout elle aux ces ses une des les sur par qui que est ont"
    ).split(),
    "spanish": (
        "para como está tiene puede todos esta desde cuando entre donde hacia según sobre nuestro nuestra también "
        "porque empresa trabajo"
    ).split(),
    "dutch": "voor zijn worden naar hebben onze deze maar ook niet bij jouw jij wij ons".split(),
    "italian": "sono della questo anche essere questo nella delle nostro nostra lavoro ogni".split(),
    "polish": "jest oraz jako przez będzie które więcej nasz pracy może tylko jeśli bardzo".split(),
}
#: An edge of a word of ASCII letters, digits and underscores.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def js_trim(c: Column) -> Column:
    """Trims white space and no-break spaces on both sides."""
    return F.regexp_replace(c, r"^[\s\u00A0]+|[\s\u00A0]+$", "")


def fingerprint(title: Column, company: Column, description: Column) -> Column:
    """md5 of title, company and the first 500 characters of the description."""
    part = lambda c: js_trim(F.lower(F.coalesce(c, F.lit(""))))
    return F.md5(F.concat_ws("|", part(title), part(company), F.left(part(description), F.lit(500))))


def preview(html: Column, length: int = 200) -> Column:
    """Tags removed, white space collapsed, cut with dots."""
    bare = js_trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " "), r"\s+", " "))
    return F.when(F.length(bare) > length, F.concat(F.substring(bare, 1, length), F.lit("..."))).otherwise(bare)


def marker_language(text: Column, density: float = 0.15, head: int = 600) -> Column:
    """The first language whose markers are more than ``density`` of the words of the
    text's head; null for short texts (100 characters, 20 words) and for others."""
    whole = F.coalesce(text, F.lit(""))
    own = F.lower(F.substring(whole, 1, head))
    words = F.size(F.split(own, r"\s+"))
    long = (F.length(whole) >= 100) & (words >= 20)

    def hits(markers: list[str]) -> Column:
        twice = sorted({m for m in markers if markers.count(m) > 1})
        counts = [F.regexp_count(own, F.lit(f"{EDGE}(?:{'|'.join(ms)}){EDGE}")) for ms in (sorted(set(markers)), twice) if ms]
        return sum(counts[1:], counts[0])

    return F.coalesce(*[F.when(long & (hits(ms) / words > density), F.lit(lang)) for lang, ms in MARKERS.items()])


def experience_of(title: Column) -> Column:
    """Level named by a title, the first rule that fits; Mid without any."""
    # Words of each level, in the order in which levels are tried
    levels = {
        "Staff": r"staff|staff\+|distinguished",
        "Lead": r"lead|principal|tech lead",
        "Senior": r"senior|sr\.?|senior level",
        "Entry": r"junior|jr\.?|entry|associate|graduate|intern|entry level|entry-level",
    }
    found, t = F.lit("Mid"), F.lower(F.coalesce(title, F.lit("")))
    for level, words in reversed(levels.items()):
        found = F.when(t.rlike(f"{EDGE}(?:{words}){EDGE}"), F.lit(level)).otherwise(found)
    return found


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))
