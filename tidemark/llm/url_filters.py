"""URL filters: a temporal join of dated list entries with captures, by DataFrame functions.

Method: dated entries (pattern, action, listed_at) become validity intervals: each holds
until the next entry of its pattern.  A capture asks for its host and for every parent
domain of it, and an as-of join finds the entries active at its fetch time; the longest
pattern decides.

Scale: intervals are dealt to time buckets, so the join has the keys (pattern, bucket)
instead of one key per pattern: a hot host is spread over its buckets, AQE splits what is
still skewed, and a capture only meets the entries of its own bucket, never a pattern's
whole history.  No user functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_S = 30 * 86400
#: Host of a URL, without user and port.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), HOST, 1)), F.lit(""))


def patterns_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    starts = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    return F.transform(starts, lambda k: F.array_join(F.slice(parts, k, n), "."))


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, listed_at, until): what each entry's pattern says, and how long.

    ``until`` is null for the last entry.  Entries without pattern or date are ignored; of
    several entries with the same pattern and date the largest action counts, so that
    repeated rows do no harm.
    """
    clean = (
        entries.where(F.col("pattern").isNotNull() & F.col("listed_at").isNotNull())
        .groupBy(F.lower("pattern").alias("pattern"), "listed_at")
        .agg(F.max("action").alias("action"))
    )
    by = Window.partitionBy("pattern").orderBy("listed_at")
    return clean.withColumn("until", F.lead("listed_at").over(by))


def evaluate(
    captures: DataFrame,
    entries: DataFrame,
    url_col: str = "url",
    ts_col: str = "fetched_at",
    keep: tuple[str, ...] = ("page_id",),
    bucket_s: int = BUCKET_S,
) -> DataFrame:
    """(keep, url, time, host, verdict, pattern, listed_at), one row for each capture.

    ``verdict`` is the action of the active entry with the longest pattern, "none" without
    one; an action "remove" takes an entry off the list.  An entry is active from its date
    on, and no longer at the date of the next one.  Captures without URL, host or time get
    "none".  Repeated captures give repeated rows; empty tables are fine.
    """
    rows = captures.select(
        *keep, F.col(url_col).alias("url"), F.col(ts_col).cast("timestamp").alias("fetched_at"), host_of(F.col(url_col)).alias("host")
    )
    bucket = lambda ts: F.floor(seconds(ts) / bucket_s)
    asked = (
        rows.where(F.col("host").isNotNull() & F.col("fetched_at").isNotNull())
        .select("host", "fetched_at")
        .distinct()
        .select("host", "fetched_at", F.explode(patterns_of(F.col("host"))).alias("p"), bucket(F.col("fetched_at")).alias("b"))
    )
    span = rows.agg(F.min("fetched_at").alias("lo"), F.max("fetched_at").alias("hi")).first()
    lo, hi = (F.lit(span[k]).cast("timestamp") for k in ("lo", "hi"))
    valid = (
        intervals(entries)
        .where((F.col("listed_at") <= hi) & (F.col("until").isNull() | (F.col("until") > lo)))
        .withColumn(
            "b",
            F.explode(
                F.sequence(
                    bucket(F.greatest(F.col("listed_at"), lo)), bucket(F.least(F.coalesce("until", hi), hi))
                )
            ),
        )
        .withColumnsRenamed({"pattern": "__p", "b": "__b"})
    )
    best = (
        asked.join(valid, (F.col("p") == F.col("__p")) & (F.col("b") == F.col("__b")))
        .where((F.col("listed_at") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until"))))
        .where(F.col("action") != "remove")
        .groupBy(F.col("host").alias("__h"), F.col("fetched_at").alias("__t"))
        .agg(F.max(F.struct(F.length("p").alias("n"), F.col("p").alias("pattern"), "listed_at", "action")).alias("hit"))
    )
    return rows.join(best, (F.col("host") == F.col("__h")) & (F.col("fetched_at") == F.col("__t")), "left").select(
        *keep,
        "url",
        "fetched_at",
        "host",
        F.coalesce("hit.action", F.lit("none")).alias("verdict"),
        F.col("hit.pattern").alias("pattern"),
        F.col("hit.listed_at").alias("listed_at"),
    )


def listed(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts of ``pages``, for tables that come without a list.

    Derived from the md5 of a host or of its parent domain: three dated entries for half of
    the hosts (block, allow, remove), one for a quarter of the domains.
    """
    host = host_of(F.col("url"))
    hosts = pages.select(host.alias("pattern")).where("pattern is not null").distinct()
    part = lambda k: F.conv(F.substring(F.md5("pattern"), k, 4), 16, 10).cast("int")
    start = F.lit("2024-01-01").cast("date")
    day = lambda n: F.date_add(start, n).cast("timestamp")
    a, b, c = part(1) % 300, part(5) % 60 + 1, part(9) % 60 + 1
    steps = F.array(
        F.struct(F.lit("block").alias("action"), day(a).alias("listed_at")),
        F.struct(F.lit("allow").alias("action"), day(a + b).alias("listed_at")),
        F.struct(F.lit("remove").alias("action"), day(a + b + c).alias("listed_at")),
    )
    own = hosts.where(part(13) % 2 == 0).select("pattern", F.inline(steps))
    parents = hosts.select(F.explode(F.slice(patterns_of(F.col("pattern")), 2, 99)).alias("pattern")).distinct()
    return own.unionByName(
        parents.where(part(13) % 4 == 0).select("pattern", F.lit("block").alias("action"), day(a).alias("listed_at"))
    )


def captured(pages: DataFrame) -> DataFrame:
    """``pages`` with a fetch time spread over 2024 by the id, as the table has none."""
    minutes = F.coalesce(F.col("page_id") * 7919 % 525_600, F.lit(0))
    return pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1_704_067_200) + minutes * 60))
