"""Visitors, clicks and saved postings: gates, counters and who is who."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import placed
from tidemark.operators.store import shared_dir


def ip_hash(ip: Column, salt: str) -> Column:
    """24 hex digits of a salted SHA-256; null without an address."""
    return F.when(F.coalesce(ip, F.lit("")) != "", F.left(F.sha2(F.concat(ip, F.lit("|" + salt)), 256), F.lit(24)))


def gate(known: Column, user: Column, flagged: Column, seen: Column, job: Column, limit: int) -> Column:
    """Whether a view is barred, and by which rule: the first that fits decides."""
    seen = F.coalesce(seen, F.array().cast("array<string>"))
    return (
        F.when(~F.coalesce(known, F.lit(False)), "no visitor").when(user.isNotNull(), "open: linked")
        .when(F.coalesce(flagged, F.lit(False)), "flagged").when(F.array_contains(seen, job), "open: seen")
        .when(F.size(seen) >= limit, "limit").otherwise("open")
    )


def with_view(seen: Column, job: Column) -> Column:
    """A set of views with one more, in order of first sight."""
    seen = F.coalesce(seen, F.array().cast("array<string>"))
    return F.when(F.array_contains(seen, job), seen).otherwise(F.array_append(seen, job))


def without(values: Column, value: Column) -> Column:
    return F.filter(values, lambda v: v != value)


def views(events: DataFrame, who: str, what: str, ts: str) -> DataFrame:
    """(who, seen, n): each visitor's viewed items, each once, by first view."""
    first = events.groupBy(who, what).agg(F.min(ts).alias("_t"))
    seen = F.array_sort(F.collect_list(F.struct("_t", F.col(what).alias("v"))))
    return first.groupBy(who).agg(F.transform(seen, lambda s: s["v"]).alias("seen"), F.count("*").alias("n"))


def confirmed(clicks: DataFrame, confirmations: DataFrame, key: list[str]) -> DataFrame:
    """One row a key: clickedAt is the first click, or the confirmation where there was none; confirmedAt the last one."""
    c = clicks.groupBy(*key).agg(F.min("ts").alias("clickedAt"))
    d = confirmations.groupBy(*key).agg(F.max("ts").alias("confirmedAt"), F.min("ts").alias("_first"))
    both = c.join(d, key, "full_outer")
    return both.select(*key, F.coalesce("clickedAt", "_first").alias("clickedAt"), "confirmedAt", F.col("confirmedAt").isNotNull().alias("confirmedApplied"))


def applied(clicks: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """Confirmed clicks with their postings, with ``appliedAt`` and ``isActive``; lost postings drop out."""
    own = clicks.where("confirmedApplied").withColumn("appliedAt", F.coalesce("confirmedAt", "clickedAt"))
    return own.join(postings, key).withColumn("isActive", F.coalesce(F.col("Status") == "active", F.lit(False)))


def identified(requests: DataFrame, visitors: DataFrame, as_of: datetime, fresh_minutes: int = 10) -> DataFrame:
    """(request, id, how) for requests (request, vid, ip, print): the visitor that a request comes from.

    Two of three equal signals first (seen last, then smallest id), then an equal cookie,
    then a fresh visitor without cookie and print at the same address that is neither
    flagged nor linked.  A request with an address only is the visitor there that has
    neither cookie nor print.  Pairs of signals and single cookies are equi-joins: no
    signal alone, which crowds may share, is joined but the cookie.
    """
    v = visitors.select("id", "lastSeenAt", *[F.col(c).alias(f"v_{c}") for c in ("vid", "ip", "print")], "flagged", "linked", "createdAt")
    # of the visitors that share signals only the one seen last can be meant: crowds are cut down before the join
    last = F.max(F.struct("lastSeenAt", (-F.col("id")).alias("_i"))).alias("b")

    def joined(signals: tuple[str, ...], rule: int, how: str) -> DataFrame:
        best = v.dropna(subset=[f"v_{s}" for s in signals]).groupBy(*[f"v_{s}" for s in signals]).agg(last)
        hit = requests.join(best, [F.col(s) == F.col(f"v_{s}") for s in signals])
        return hit.select("request", (-F.col("b._i")).alias("id"), F.col("b.lastSeenAt").alias("lastSeenAt"), F.lit(rule).alias("rule"), F.lit(how).alias("how"))

    found = [joined(pair, 0, "two signals") for pair in (("vid", "ip"), ("vid", "print"), ("ip", "print"))] + [joined(("vid",), 1, "cookie")]
    # of the anonymous visitors at an address only the one seen last can be meant
    blank = v.where("v_vid is null and v_print is null and v_ip is not null")
    fresh = F.col("createdAt") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(fresh_minutes))
    claim = blank.where(~F.coalesce("flagged", F.lit(False)) & F.col("linked").isNull() & fresh).groupBy("v_ip").agg(last)
    alone = blank.groupBy("v_ip").agg(last)
    some = F.col("vid").isNotNull() | F.col("print").isNotNull()
    for rows, side, rule, how in ((requests.where(some), claim, 2, "claimed"), (requests.where(~some), alone, 0, "address")):
        hit = rows.join(side, F.col("ip") == F.col("v_ip"))
        found.append(hit.select("request", (-F.col("b._i")).alias("id"), F.col("b.lastSeenAt").alias("lastSeenAt"), F.lit(rule).alias("rule"), F.lit(how).alias("how")))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    best = hits.groupBy("request").agg(F.min(F.struct("rule", (-F.unix_micros("lastSeenAt")).alias("t"), "id", "how")).alias("b"))
    return best.select("request", "b.id", "b.how")


def unexpired(rows: DataFrame, ts: str, as_of: datetime, seconds: int = 3600) -> DataFrame:
    """Rows younger than a time to live."""
    return rows.where(F.col(ts) > F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds)))


def numbered(slugs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, unique_slug): the first free name of each, in order; a family stands together."""
    family, taken, next_of = None, set(), {}
    for batch in slugs:
        rows, found = [], []
        for own, row, slug in zip(*[batch.column(c).to_pylist() for c in ("_family", "_row", "_slug")], strict=True):
            if own != family:
                family, taken, next_of = own, set(), {}
            name, k = slug, next_of.get(slug, 2)
            while name in taken:
                name, k = f"{slug}-{k}", k + 1
            next_of[slug] = k  # what came before stays taken
            taken.add(name)
            rows.append(row)
            found.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.string())], ["_row", "unique_slug"])


def unique_slugs(rows: DataFrame, slug: str, *order: str) -> DataFrame:
    """``rows`` with ``unique_slug``: in order, each takes its slug, or slug-2, slug-3 and so on, whichever is free first.

    Slugs can only meet those that differ in numbers at the end.  A slug that none of these has
    is counted: its rows follow each other in a range sort, so a slug of very many rows is no
    one task's work.  The others go, a family at a time, through a stream that holds the names
    which the family has taken.  ``order`` is total.  A null slug stays null.
    """
    path = f"{shared_dir(rows.sparkSession)}/slugs-{uuid.uuid4().hex}"
    held = placed(rows, path, slug, *order).withColumnRenamed("place", "_row")
    first = held.groupBy(F.col(slug).alias("_s")).agg(F.min("_row").alias("_first")).withColumn("_family", F.regexp_replace("_s", r"(-[0-9]+)+$", ""))
    sizes = first.where("_s is not null").groupBy("_family").agg(F.count("*").alias("_n"))
    own = held.join(first.join(sizes, "_family", "left"), F.col(slug).eqNullSafe(F.col("_s")))
    # the rows of slugs that share a family, in the caller's order
    names = [f"_o{k}" for k in range(len(order))]
    some = own.where("_n > 1").select("_family", "_row", F.col(slug).alias("_slug"), *[F.col(c).alias(n) for c, n in zip(order, names, strict=True)])
    folded = some.repartition("_family").sortWithinPartitions("_family", *names).mapInArrow(numbered, "_row long, unique_slug string")
    k = F.col("_row") - F.col("_first") + 1
    alone = own.where("_n is null or _n = 1").withColumn("unique_slug", F.when(k == 1, F.col(slug)).otherwise(F.concat(slug, F.lit("-"), k.cast("string"))))
    return alone.select(*rows.columns, "unique_slug").unionByName(held.join(folded, "_row").select(*rows.columns, "unique_slug"))
