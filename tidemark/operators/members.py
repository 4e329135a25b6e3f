"""Members: premium time, limits, codes, preferences and resets."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weekly limits of views and clicks.
LIMITS = {"anonymous": (5, 5), "free": (20, 15)}


def premium(until: Column, as_of: datetime) -> Column:
    return F.coalesce(until > F.lit(as_of), F.lit(False))


def limits(user: Column, until: Column, as_of: datetime) -> Column:
    """(views, clicks) of a week; null means no limit."""
    pick = lambda j: F.when(premium(until, as_of), F.lit(None).cast("int")).when(user.isNull(), LIMITS["anonymous"][j]).otherwise(LIMITS["free"][j])
    return F.struct(pick(0).alias("views"), pick(1).alias("clicks"))


def activated(until: Column, chosen: Column, days: Column, as_of: datetime) -> Column:
    """Premium time of the ``chosen``: so many days from now; what was left is not added."""
    return F.when(chosen, F.lit(as_of).cast("timestamp") + F.make_dt_interval(days=F.coalesce(days, F.lit(0)).cast("int"))).otherwise(until)


def redemption(until: Column, outcome: Column, discount: Column, used_before: Column, as_of: datetime) -> Column:
    """What becomes of a code that is entered: the first guard that fits."""
    return (
        F.when(premium(until, as_of), "already_premium").when(outcome != "valid", outcome)
        .when(discount < 100, "partial_discount").when(used_before, "already_used").otherwise("redeemed")
    )


def code_state(used: Column, expires: Column, as_of: datetime) -> Column:
    return F.when(used > 0, "redeemed").when(expires < F.lit(as_of), "expired").otherwise("pending")


def subscription_edge(old: Column, new: Column) -> Column:
    """subscribed or unsubscribed where a flag changes, else null; a null old flag is off, a null new one no change."""
    was = F.coalesce(old, F.lit(False))
    return F.when(~was & new, "subscribed").when(was & ~new, "unsubscribed")


def patched(rows: DataFrame, patches: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """``rows`` with the values of ``patches`` that are set, in the ``allowed`` columns only."""
    own = [c for c in allowed if c in patches.columns]
    met = rows.join(patches.select(key, *[F.col(c).alias(f"_p_{c}") for c in own]), key, "left")
    return met.withColumns({c: F.coalesce(f"_p_{c}", c) for c in own}).drop(*[f"_p_{c}" for c in own])


def merged(old: DataFrame, new: DataFrame, key: str, as_of: datetime) -> DataFrame:
    """A partial upsert: values of ``new`` that are set win, createdAt stays, updatedAt is set where ``new`` has the key."""
    now = F.lit(as_of).cast("timestamp")
    data = [c for c in old.columns if c not in (key, "createdAt", "updatedAt")]
    fresh = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in data if c in new.columns], F.lit(True).alias("_hit"))
    both = old.join(fresh, key, "full_outer")
    hit = F.col("_hit").isNotNull()
    values = [F.coalesce(f"_n_{c}", c).alias(c) if c in new.columns else F.col(c) for c in data]
    return both.select(key, *values, F.coalesce("createdAt", now).alias("createdAt"), F.when(hit, now).otherwise(F.col("updatedAt")).alias("updatedAt"))


def stamped_once(ts: Column, chosen: Column, as_of: datetime) -> Column:
    return F.coalesce(ts, F.when(chosen, F.lit(as_of).cast("timestamp")))


def appended_new(old: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """``old`` and the first row of each key of ``new`` that ``old`` lacks."""
    rest = [c for c in old.columns if c != key]
    first = new.groupBy(key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_b"))
    some = first.join(old.select(key), key, "left_anti").select(key, *[F.col(f"_b.{c}").alias(c) for c in rest])
    return old.select(key, *rest).unionByName(some)


def week_reset(users: DataFrame, as_of: datetime) -> DataFrame:
    """``users`` with their weekly counters at zero; all else stays."""
    now = F.lit(as_of).cast("timestamp")
    return users.withColumns({"views": F.lit(0), "clicks": F.lit(0), "weekResetAt": now, "updatedAt": now})


def visitors_reset(visitors: DataFrame, as_of: datetime) -> DataFrame:
    """``visitors`` with no views, and seen now; all else stays."""
    return visitors.withColumns({"viewCount": F.lit(0), "seen": F.array().cast("array<string>"), "lastSeenAt": F.lit(as_of).cast("timestamp")})


def subscriptions_expired(subscriptions: DataFrame, as_of: datetime) -> DataFrame:
    """Active ones whose term has ended are expired; without an end, or in another state, they stay."""
    over = (F.col("status") == "active") & (F.col("expiresAt") < F.lit(as_of))
    return subscriptions.withColumn("status", F.when(over, "expired").otherwise(F.col("status")))


def parse_state(state: Column, since: Column, as_of: datetime, stuck_minutes: int = 10) -> Column:
    """idle, processing, complete or failed: what has been processed for too long is idle again."""
    old = since < F.lit(as_of - timedelta(minutes=stuck_minutes))
    return F.when((state == "processing") & F.coalesce(old, F.lit(True)), "idle").otherwise(F.coalesce(state, F.lit("idle")))


def after_probe(status: Column) -> Column:
    """Whether a posting's page is gone for good; any other answer keeps it."""
    return F.coalesce(status.isin(404, 410), F.lit(False))


def invited(users: DataFrame, redeemed: DataFrame, invited_before: DataFrame, key: str, until: str, as_of: datetime) -> DataFrame:
    """``users`` without premium who neither redeemed a code nor were invited before."""
    out = users.where(~premium(F.col(until), as_of))
    for known in (redeemed, invited_before):
        out = out.join(known.select(key), key, "left_anti")
    return out


def valid_feedback(message: Column, email: Column, most_words: int = 200) -> Column:
    """Neither empty nor too long, with no email or a plausible one."""
    words = F.size(F.filter(F.split(F.coalesce(message, F.lit("")), r"\s+"), lambda w: w != ""))
    plausible = F.coalesce(email, F.lit("")).rlike(r"^$|^[^\s@]+@[^\s@]+\.[^\s@]+$")
    return words.between(1, most_words) & plausible


def backfilled(users: DataFrame, by_domain: dict[str, list[str]], legacy: tuple[str, ...], as_of: datetime) -> DataFrame:
    """``users`` whose wanted categories come from an old field where they have none; the old fields go.

    A user in none of the domains, or with categories, keeps what is there, an empty list at least;
    updatedAt is set where categories were filled in.
    """
    none = F.coalesce(F.size("desiredCategories") <= 0, F.lit(True))
    found = F.lit(None).cast("array<string>")
    for domain, categories in by_domain.items():
        found = F.when(F.col("domain") == domain, F.array(*[F.lit(c) for c in categories])).otherwise(found)
    filled = none & found.isNotNull()
    made = users.withColumns({
        "desiredCategories": F.when(filled, found).otherwise(F.coalesce("desiredCategories", F.array().cast("array<string>"))),
        "updatedAt": F.when(filled, F.lit(as_of).cast("timestamp")).otherwise(F.col("updatedAt")),
    })
    return made.drop(*legacy)
