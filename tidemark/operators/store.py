"""Stores on Parquet: upserts, retention, change application, without a MERGE statement."""

from __future__ import annotations

import tempfile
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables between jobs: ``spark.checkpoint.dir``; a temporary one on a local master only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return shared.rstrip("/") if shared else tempfile.mkdtemp(prefix="tidemark-")


def upsert(old: DataFrame, new: DataFrame, key: list[str], as_of: datetime, *order: str) -> DataFrame:
    """``old`` with the rows of ``new`` put in: createdAt is kept, updatedAt is set.

    One full outer join on the key.  Of repeated new keys the row with the largest values of
    ``order`` wins, without it the one with the largest values of all columns.
    """
    now = F.lit(as_of).cast("timestamp")
    fresh = last_per_key(new, key, *(order or [c for c in new.columns if c not in key])).withColumn("_new", F.lit(True))
    o, n = old.alias("o"), fresh.alias("n")
    both = o.join(n, key, "full_outer")
    hit = F.col("_new").isNotNull()
    data = [c for c in old.columns if c not in (*key, "createdAt", "updatedAt")]
    return both.select(
        *key,
        *[F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in data],
        F.coalesce("o.createdAt", now).alias("createdAt"),
        F.when(hit, now).otherwise(F.col("o.updatedAt")).alias("updatedAt"),
    )


def last_per_key(changes: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last change of each key, combined before the shuffle."""
    rest = [c for c in changes.columns if c not in key]
    best = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_b")
    return changes.groupBy(*key).agg(best).select(*key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def apply_changes(table: DataFrame, changes: DataFrame, key: list[str], deleted: Column, *order: str) -> DataFrame:
    """``table`` after the last change of each key: deletes take rows out, others replace."""
    last = last_per_key(changes, key, *order)
    kept = table.join(last.select(*key), key, "left_anti")
    return kept.unionByName(last.where(~deleted).select(*table.columns))


def expired(as_of: datetime, site: str, curated: str = "Curated") -> Column:
    """True for postings that retention deletes: 7 days for rejected ones that nobody
    reviewed, 14 for reviewed rejections, for pending ones and for active ones that nobody
    reviewed; curated rows and reviewed active rows stay."""
    days = lambda n: F.lit(as_of - timedelta(days=n))
    status, reviewed, updated = F.col("Status"), F.col("reviewedAt"), F.col("updatedAt")
    rules = (
        ((status == "rejected") & reviewed.isNull() & (updated < days(7)))
        | ((status == "rejected") & (reviewed <= days(14)))
        | ((status == "pending_review") & (updated < days(14)))
        | ((status == "active") & reviewed.isNull() & (updated < days(14)))
    )
    return (F.col("sourceSite") == site) & (F.col("sourceSite") != curated) & F.coalesce(rules, F.lit(False))


def changed_boards(rows: DataFrame, state: DataFrame, board: str, row_key: str) -> DataFrame:
    """Boards whose content hash differs from the stored one.

    The hash is the sum of the keys' hashes and their number, so no board's keys are
    collected into one row.
    """
    now = rows.groupBy(board).agg(
        F.sum(F.xxhash64(row_key).cast("decimal(38,0)")).cast("string").alias("hash"), F.count("*").alias("n")
    )
    return now.join(state.select(board, "hash", "n"), [board, "hash", "n"], "left_anti")


def first_missing(target: DataFrame, rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The first row of each key of ``rows`` that ``target`` lacks: what a merge that keeps existing rows appends."""
    rest = [c for c in rows.columns if c not in key]
    best = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_b")
    first = rows.groupBy(*key).agg(best).join(target.select(*key), key, "left_anti")
    return first.select(*key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def by_id(rows: DataFrame, wanted: str, *ids: str) -> DataFrame:
    """The one row with the wanted id, by the first of the id columns that has it."""
    hit = F.lit(False)
    place = F.lit(len(ids))
    for k, c in reversed(list(enumerate(ids))):
        fits = F.coalesce(F.col(c).cast("string") == wanted, F.lit(False))
        hit, place = hit | fits, F.when(fits, k).otherwise(place)
    return rows.where(hit).orderBy(place, *ids).limit(1)


def content_hash(keys: Column) -> Column:
    """SHA-256 of the sorted strings of an array, one a line: the same whatever their order."""
    return F.sha2(F.array_join(F.array_sort(keys), "\n"), 256)


def listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(value): the lines of text files that fit a pattern, in lower case, each once."""
    line = F.lower(F.trim("value"))
    return spark.read.text(path).select(line.alias("value")).where(F.col("value").rlike(pattern)).distinct()


def appended(rows: DataFrame, path: str) -> None:
    """Appends the rows of a run's log."""
    rows.write.mode("append").parquet(path)


def outdated(ts: str, as_of: datetime, days: int = 90) -> Column:
    return F.col(ts) < F.lit(as_of - timedelta(days=days))


def of_company(name: str, company: str = "Company") -> Column:
    """The company's postings, whatever the case; the name is no pattern."""
    return F.lower(F.col(company)) == name.lower()


def articles(rows: DataFrame, slug: str | None = None, category: str | None = None) -> DataFrame:
    """Published articles: one by its slug, whatever the case; those of a category; or all."""
    found = rows.where(F.col("status") == "published")
    if slug is not None:
        return found.where(F.col("slug") == slug.lower())
    return found if category is None else found.where(F.col("category") == category)


def to_probe(candidates: DataFrame, seen: DataFrame, key: list[str], retry_empty: bool = False) -> DataFrame:
    """Candidates that are worth a probe: not seen before, or seen empty where empty ones are tried again."""
    known = seen.where(F.col("status") != "empty") if retry_empty else seen.where(F.col("status").isNotNull())
    return candidates.join(known.select(*key).distinct(), key, "left_anti")


#: What is kept of a verdict.
VERDICT = "fingerprint string, germanRequired boolean, confidence double, domain string, subDomain string, createdAt timestamp, updatedAt timestamp"


def verdict_store(spark: SparkSession, path: str, buckets: int = 16):  # noqa: ANN201
    """The store of verdicts by fingerprint."""
    from tidemark.operators.buckets import BucketStore

    return BucketStore(spark, path, spark.createDataFrame([], VERDICT).schema, ["fingerprint"], buckets).start()


def save_verdicts(kept, verdicts: DataFrame, as_of: datetime, *order: str) -> list[int]:  # noqa: ANN001
    """Upserts verdicts by fingerprint: createdAt is set once; what is missing counts as false, 0, Unclear and Other; rows without a fingerprint are left out."""
    text = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other)).alias(c)
    rows = verdicts.where(F.coalesce("fingerprint", F.lit("")) != "").select(
        "fingerprint", F.coalesce("germanRequired", F.lit(False)).alias("germanRequired"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"),
        text("domain", "Unclear"), text("subDomain", "Other"), *order,
    )
    return kept.upsert(rows, as_of, *order)


def mail_key(column: str = "email") -> Column:
    return F.lower(F.trim(F.col(column)))


def subscribe(users, asked: DataFrame, as_of: datetime, *order: str) -> list[int]:  # noqa: ANN001
    """Accounts by email that want the digest: a known one keeps what the request leaves empty, another is added."""
    now, old, new = F.lit(as_of).cast("timestamp"), lambda c: F.col(f"o.{c}"), lambda c: F.col(f"n.{c}")
    nobody = F.array().cast("array<string>")
    matched = {
        "location": F.coalesce(F.nullif(new("location"), F.lit("")), old("location")),
        "desiredCategories": F.coalesce(new("desiredCategories"), old("desiredCategories"), nobody),
        "isSubscribed": F.lit(True), "updatedAt": now, "createdAt": old("createdAt"),
    }
    inserted = {
        "location": F.nullif(new("location"), F.lit("")), "desiredCategories": F.coalesce(new("desiredCategories"), nobody), "isSubscribed": F.lit(True),
        "createdAt": now, "updatedAt": now,
    }
    return users.merge(asked.withColumn("email", mail_key()), list(order), matched, inserted)


def unsubscribe(users, emails: DataFrame, as_of: datetime) -> list[int]:  # noqa: ANN001
    return users.update(emails.select(mail_key().alias("email")), {"isSubscribed": F.lit(False), "updatedAt": F.lit(as_of).cast("timestamp")})


def mailed(users, emails: DataFrame, as_of: datetime) -> list[int]:  # noqa: ANN001
    """Stamps the accounts that have just had a mail."""
    now = F.lit(as_of).cast("timestamp")
    return users.update(emails.select("email"), {"lastEmailSent": now, "updatedAt": now})


def add_curated(postings, rows: DataFrame, *order: str, site: str = "Curated") -> list[int]:  # noqa: ANN001
    """Adds postings by hand, keyed by ApplicationURL: none whose address is known, none without title, address and company."""
    whole = F.lit(True)
    for c in ("JobTitle", "ApplicationURL", "Company"):
        whole &= F.coalesce(F.col(c), F.lit("")) != ""
    return postings.insert_missing(rows.where(whole).withColumn("sourceSite", F.lit(site)), *order)
