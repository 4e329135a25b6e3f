"""Faceted queries: a filter description becomes one column predicate; counts are one pass."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days that each window label reaches back.
DATE_WINDOWS = {"Today": 1, "This Week": 7, "This Month": 30}


@dataclass
class QueryFilters:
    """What a caller asks for.  Facets map a column to wanted values; ``None`` is not asked."""

    facets: dict[str, list[str]] = field(default_factory=dict)
    salary_min: float | None = None
    salary_max: float | None = None
    search: str | None = None
    window: str | None = None

    def checked(self, domains: dict[str, list[str]]) -> QueryFilters:
        """Facet values outside ``domains`` dropped; an inverted or odd salary range dropped."""
        facets = {c: [v for v in vs if v in domains.get(c, vs)] for c, vs in self.facets.items() if vs}
        lo, hi = (x if x is not None and 0 <= x <= 1_000_000 else None for x in (self.salary_min, self.salary_max))
        if lo is not None and hi is not None and lo > hi:
            lo = hi = None
        return QueryFilters(facets, lo, hi, (self.search or "").strip() or None, self.window)


def live(german: str = "GermanRequired", status: str = "Status") -> Column:
    """Active postings that do not require German; an unknown requirement is not enough."""
    return (F.col(status) == "active") & (F.col(german) == F.lit(False))


def facet(column: str, values: list[str]) -> Column:
    """Any of the values; asked for but with none left, nothing."""
    return F.col(column).isin(values) if values else F.lit(False)


def country(column: str, values: list[str]) -> Column:
    """Any of the countries, whatever the case and outer spaces."""
    return facet_of(F.upper(F.trim(F.col(column))), [v.strip().upper() for v in values])


def facet_of(value: Column, values: list[str]) -> Column:
    return value.isin(values) if values else F.lit(False)


def facet_or_all(column: str, values: list[str], known: list[str]) -> Column:
    """The known ones of the values; with none left, everything."""
    own = [v for v in values if v in known]
    return F.col(column).isin(own) if own else F.lit(True)


def offers(*columns: str) -> Column:
    """All of the offers are available."""
    found = F.lit(True)
    for c in columns:
        found &= F.coalesce(F.col(c) == "available", F.lit(False))
    return found


def has_salary(tier: str) -> Column:
    return F.coalesce(F.col(tier), F.lit("")) != ""


def allowed(filters: QueryFilters, premium: bool, reserved: tuple[str, ...]) -> tuple[QueryFilters, list[str]]:
    """What of the filters a caller may use, and the names of those left out; premium callers may use all."""
    if premium:
        return filters, []
    gone = [c for c in filters.facets if c in reserved]
    salary = "salary" in reserved and (filters.salary_min is not None or filters.salary_max is not None)
    kept = {c: v for c, v in filters.facets.items() if c not in gone}
    own = (None, None) if salary else (filters.salary_min, filters.salary_max)
    return QueryFilters(kept, *own, filters.search, filters.window), gone + ["salary"] * salary


def open_counts(rows: DataFrame, column: str) -> DataFrame:
    """(facet, value, n) of a facet without a fixed list, upper case and trimmed."""
    value = F.upper(F.trim(F.col(column)))
    return rows.where(F.coalesce(value, F.lit("")) != "").groupBy(value.alias("value")).agg(F.count("*").alias("n")).select(F.lit(column).alias("facet"), "value", "n")


def salary_overlaps(lo: float | None, hi: float | None, low: str = "SalaryMin", high: str = "SalaryMax") -> Column:
    """The posted range meets [lo, hi]; one open end is fine, two are not."""
    a, b = F.col(low), F.col(high)
    fits = a.isNotNull() | b.isNotNull()
    false = F.lit(False)
    if lo is not None:
        fits &= ~F.coalesce((a < lo) & ~F.coalesce(b >= lo, false), false)
    if hi is not None:
        fits &= ~F.coalesce((b > hi) & ~F.coalesce(a <= hi, false), false)
    return fits


def contains_text(query: str, columns: tuple[str, ...] = ("JobTitle", "Company", "Location")) -> Column:
    """Case-insensitive literal substring in any of the columns."""
    wanted = query.strip().lower()
    found = F.lit(False)
    for c in columns:
        found |= F.lower(F.coalesce(F.col(c), F.lit(""))).contains(wanted)
    return found


def seen_since(label: str | None, as_of: datetime, either: bool = True) -> Column:
    """Posted in the window; ``either`` also takes a recent scrape, else only without a date."""
    if label not in DATE_WINDOWS:
        return F.lit(True)
    cut = F.lit(as_of - timedelta(days=DATE_WINDOWS[label]))
    posted, scraped = F.col("PostedDate"), F.col("scrapedAt")
    if either:
        return F.coalesce(posted >= cut, F.lit(False)) | F.coalesce(scraped >= cut, F.lit(False))
    return F.coalesce(posted, scraped) >= cut


def predicate(filters: QueryFilters, as_of: datetime, universe: Column | None = None) -> Column:
    """All of a filter description as one column, cheap tests first."""
    found = live() if universe is None else universe
    for column, values in filters.facets.items():
        found &= facet(column, values)
    found &= seen_since(filters.window, as_of)
    if filters.salary_min is not None or filters.salary_max is not None:
        found &= salary_overlaps(filters.salary_min, filters.salary_max)
    if filters.search:
        found &= contains_text(filters.search)
    return found


def facet_counts(rows: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """(facet, value, n): every value of every domain, zeros too, and the total; one scan."""
    counts = [F.count(F.when(F.col(c) == v, 1)).alias(f"{c}|{v}") for c, vs in domains.items() for v in vs]
    one = rows.agg(F.count("*").alias("total|"), *counts)
    names = one.columns
    long = F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"`{n}`").alias("n")) for n in names])
    return one.select(F.explode(long).alias("x")).select(
        F.split_part("x.k", F.lit("|"), F.lit(1)).alias("facet"), F.split_part("x.k", F.lit("|"), F.lit(2)).alias("value"), "x.n"
    )


def page(rows: DataFrame, number: int = 1, size: int = 30, *order: Column) -> DataFrame:
    """One page in a total order; Spark keeps only the top rows of each task."""
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def newest_first() -> tuple[Column, Column]:
    epoch = F.timestamp_seconds(F.lit(0))
    return F.coalesce("PostedDate", epoch).desc(), F.col("JobID").asc()
