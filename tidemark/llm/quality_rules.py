"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` is data: each row names a measure, a bound and the side that fails.  ``apply``
compiles the measures and the table into one projection of built-in functions: no user
function, no shuffle, no join, so the plan is a scan with projections whatever the size.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_BREAK, text_or_empty, words_of

WINDOW = 5
SYMBOLS = r"[^#*$%&|<>]"
#: Frequent function words of the supported languages.
STOP_WORDS = (
    "a and are as at be by for from he in is it of on or that the this to was were with "
    "der die das und ein eine ist nicht mit auf den von zu im sich des für als auch es "
    "le la les et un une de des du est que qui en dans pour pas sur au par avec il elle "
    "el los las y del se una por con su al lo como más pero sus"
).split()


class Rule(NamedTuple):
    """A document fails when ``measure`` is below ``low`` or above ``high``."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("too_short", "n_words", low=10),
    Rule("repeated_windows", "repeat_ratio", high=0.2),
    Rule("too_long", "n_words", high=1_000_000),
    Rule("short_words", "mean_word_chars", low=1.5),
    Rule("long_words", "mean_word_chars", high=25),
    Rule("symbols", "symbol_ratio", high=0.3),
    Rule("duplicate_lines", "dup_line_ratio", high=0.3),
    Rule("no_stop_words", "stop_word_ratio", low=0.005),
    Rule("shouting", "upper_ratio", high=0.7),
)
#: The rules that a document must pass before the others are asked.
BASE = ("too_short", "repeated_windows")


def windows(words: str, window: int = WINDOW) -> tuple[Column, Column]:
    """Hashes of the words of an array column, and of its windows of word hashes.

    Both become array columns of their own, ``__hashes`` and ``__windows``, so that each is
    built once: equal windows are then found by sorting (hash, start).
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    starts = F.sequence(F.lit(0), F.size(words) - window)
    return hashes, F.transform(starts, lambda i: F.xxhash64(*[F.get("__hashes", i + k) for k in range(window)]))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``__m`` of counts and ratios of each whole text.

    Words are runs of anything but ASCII white space; a null text has none.  Ratios of
    empty texts are zero.  Other columns pass through, whatever their names.
    """
    text = text_or_empty(text_col)
    n = F.size("__words")
    lines = F.filter(F.split("__text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    hashes, shingles = windows("__words")
    sorted_windows = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    last = F.size("__sorted") - 1
    twins = F.filter(
        F.transform(
            "__sorted",
            lambda x, k: F.when(
                ((k > 0) & (F.get("__sorted", k - 1)["h"] == x["h"]))
                | ((k < last) & (F.get("__sorted", k + 1)["h"] == x["h"])),
                x["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    covered = F.aggregate(
        F.array_sort("__twins"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at")),
        lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), i - a["at"])).cast("long").alias("n"), i.alias("at")
        ),
        lambda a: a["n"],
    )
    none = F.array().cast("array<int>")
    pairs = F.array().cast("array<struct<h:bigint,i:int>>")
    lower = F.transform("__words", lambda w: F.regexp_replace(F.lower(w), r"[.,;:!?]+$", ""))
    base = (
        docs.withColumn("__text", text)
        .withColumn("__words", words_of(F.col("__text")))
        .withColumn("__lines", lines)
        .withColumn("__hashes", hashes)
        .withColumn("__windows", F.when(n >= WINDOW, shingles).otherwise(F.array().cast("array<bigint>")))
        .withColumn(
            "__sorted",
            F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), sorted_windows).otherwise(pairs),
        )
        .withColumn("__twins", F.when(F.size("__sorted") > 0, twins).otherwise(none))
    )
    chars = F.length(F.regexp_replace("__text", WORD_BREAK, ""))
    counts = {
        "n_words": n.cast("long"),
        "word_chars": chars.cast("long"),
        "n_symbols": F.length(F.regexp_replace("__text", SYMBOLS, "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_repeat_words": covered,
        "n_stop_words": F.size(F.filter(lower, lambda w: w.isin(STOP_WORDS))).cast("long"),
        "n_upper": F.length(F.regexp_replace("__text", r"[^\p{Lu}]", "")).cast("long"),
    }
    counted = base.withColumn("__c", F.struct(*[v.alias(k) for k, v in counts.items()]))
    c = {k: F.col(f"__c.{k}") for k in counts}

    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(c[a], c[b]), F.lit(0.0))

    ratios = {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "upper_ratio": ratio("n_upper", "word_chars"),
    }
    made = counted.withColumn("__m", F.struct("__c.*", *[v.alias(k) for k, v in ratios.items()]))
    return made.drop("__text", "__words", "__lines", "__hashes", "__windows", "__sorted", "__twins", "__c")


def compiled(rules: tuple[Rule, ...], measure: str = "__m") -> Column:
    """The names of the rules that a row fails, in the table's order."""
    checks = []
    for rule in rules:
        m, fails = F.col(f"{measure}.{rule.measure}"), F.lit(False)
        if rule.low is not None:
            fails = fails | (m < rule.low)
        if rule.high is not None:
            fails = fails | (m > rule.high)
        checks.append(F.when(fails, F.lit(rule.name)))
    return F.array_compact(F.array(*checks))


def apply(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with its measures ``__m`` and the ``failed`` rules; one projection.

    Null and empty texts have no words and so fail ``too_short``.  Rows are judged one by
    one: ties and repeated rows do not matter; an empty table gives an empty result.
    """
    return measures(docs, text_col).withColumn("failed", compiled(rules))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, kept, failed): the verdict on every row of ``docs``.

    ``base_failed`` is exact in whole numbers: fewer than 10 words, or more than a fifth of
    the words in repeated windows.  ``kept`` also needs every other rule.
    """
    m = lambda k: F.col(f"__m.{k}")
    base = (m("n_words") < 10) | (100 * m("n_repeat_words") > 20 * m("n_words"))
    others = tuple(r for r in RULES if r.name not in BASE)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return (
        apply(docs.select(id_col, text_col), text_col, others)
        .withColumn("base_failed", base)
        .select(id_col, *[m(k).alias(k) for k in names], "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed")
    )
