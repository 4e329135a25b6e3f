"""Pay: repair, validation, reading from text, and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plausible amounts for each interval.
BOUNDS = {"yearly": (10_000, 1_000_000), "monthly": (800, 100_000), "hourly": (5, 2_000)}
CURRENCIES = ["EUR", "USD", "GBP", "CHF"]
SYMBOLS = {"EUR": "€", "USD": "$", "GBP": "£", "CHF": "CHF "}
# Names of intervals in feeds.
YEAR, MONTH = ["", "per-year-salary", "yearly", "year"], ["per-month-salary", "monthly"]


def repaired(low: Column, high: Column, currency: Column, interval: Column) -> Column:
    """A struct of min, max, currency, interval: amounts in thousands are scaled up.

    Below 1000 a year, or 100 a month, an amount is in thousands.  Without any amount all
    four are null.
    """
    kind = F.lower(F.coalesce(interval, F.lit("")))
    bar = F.when(kind.isin(YEAR), 1000).when(kind.isin(MONTH), 100)
    scaled = lambda x: F.when((x > 0) & (x < bar), x * 1000).otherwise(x)
    none = (F.coalesce(low, F.lit(0)) == 0) & (F.coalesce(high, F.lit(0)) == 0)
    parts = {"min": scaled(low), "max": scaled(high), "currency": currency, "interval": interval}
    return F.struct(*[F.when(~none, v).alias(k) for k, v in parts.items()])


def validated(low: Column, high: Column, currency: Column, interval: Column) -> Column:
    """A struct of min, max, currency, interval of a read salary; all null unless it is usable.

    An unknown interval is yearly; an unknown currency, or an amount out of ``BOUNDS``, makes
    the whole unusable; bounds in the wrong order are swapped.
    """
    kind = F.when(interval.isin(list(BOUNDS)), interval).otherwise("yearly")
    money = F.when(F.upper(currency).isin(CURRENCIES), F.upper(currency))
    fits = F.lit(True)
    for name, (least, most) in BOUNDS.items():
        own = [x.isNull() | x.between(least, most) for x in (low, high)]
        fits = fits & ((kind != name) | (own[0] & own[1]))
    fine = (low.isNotNull() | high.isNotNull()) & money.isNotNull() & fits
    swap = F.coalesce(low > high, F.lit(False))
    parts = {"min": F.when(swap, high).otherwise(low), "max": F.when(swap, low).otherwise(high), "currency": money, "interval": kind}
    return F.struct(*[F.when(fine, v).alias(k) for k, v in parts.items()])


def filled(own: dict[str, Column], read: dict[str, Column]) -> dict[str, Column]:
    """The columns min, max, currency and interval of ``own``, from ``read`` where ``own`` has no minimum."""
    take = own["min"].isNull() & (read["min"].isNotNull() | read["max"].isNotNull())
    return {k: F.when(take, read[k]).otherwise(own[k]) for k in ("min", "max", "currency", "interval")}


def from_text(text: Column) -> Column:
    """A struct of min, max, currency, interval read from plain text; dots group digits, commas are decimal."""
    clean = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    low = F.lower(clean)
    found = lambda pattern, group: F.nullif(F.regexp_extract(clean, pattern, group), F.lit(""))
    span = r"(?i)(\d{2,7}(?:\.\d+)?)\s*(?:-|–|—|to)\s*(\d{2,7}(?:\.\d+)?)"
    symbol = found("[€$£]", 0)
    currency = F.coalesce(
        F.upper(found("(?i)(USD|EUR|GBP|CHF|CAD|AUD|JPY|SEK|NOK|DKK|PLN)", 1)),
        F.when(symbol == "€", "EUR").when(symbol == "$", "USD").when(symbol == "£", "GBP"),
    )
    # the last rule that fits counts
    interval = (
        F.when(low.rlike("per year|/year|annual|yearly"), "per-year-salary")
        .when(low.rlike("per month|/month|monthly"), "per-month-salary")
        .when(low.rlike("per hour|/hour|hourly"), "per-hour-wage")
    )
    parts = {"min": found(span, 1).try_cast("double"), "max": found(span, 2).try_cast("double"), "currency": currency, "interval": interval}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def label(low: Column, high: Column, currency: Column, interval: Column) -> Column:
    """ "€60,000 – €80,000 / year", "from ..", "up to .."; empty without amounts.  Whole amounts."""
    symbol = F.coalesce(
        *[F.when(F.upper(currency) == c, F.lit(s)) for c, s in SYMBOLS.items()],
        F.when(F.coalesce(currency, F.lit("")) == "", F.lit("")),
        F.concat(currency, F.lit(" ")),
    )
    money = lambda x: F.concat(symbol, F.format_number(x, 0))
    amount = (
        F.when(low.isNull() & high.isNull(), F.lit("")).when(high.isNull(), F.concat(F.lit("from "), money(low)))
        .when(low.isNull(), F.concat(F.lit("up to "), money(high))).when(low == high, money(low))
        .otherwise(F.concat(money(low), F.lit(" – "), money(high)))
    )
    kind = F.lower(F.coalesce(interval, F.lit("")))
    per = F.when(kind.contains("year") | (kind == "annual"), " / year")
    for word in ("month", "hour", "day"):
        per = per.when(kind.contains(word), f" / {word}")
    return F.when(amount == "", amount).otherwise(F.concat(amount, F.coalesce(per, F.lit(""))))


def suspect(low: Column, high: Column) -> Column:
    """Amounts above zero and below 1000, which are in thousands."""
    small = lambda x: F.coalesce((x > 0) & (x < 1000), F.lit(False))
    return small(low) | small(high)
