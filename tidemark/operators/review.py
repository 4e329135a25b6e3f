"""Review of postings: the queue, decisions, second looks, and who may still see what."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def auto_published() -> Column:
    return F.coalesce((F.col("Status") == "active") & (F.col("approvalMethod") == "ai_auto"), F.lit(False))


def in_queue() -> Column:
    """Pending, or published by the machine and not looked at."""
    return (F.col("Status") == "pending_review") | (auto_published() & F.col("reviewedAt").isNull())


def looked_at() -> Column:
    """Accepted or rejected by a person."""
    return F.col("reviewedAt").isNotNull() & F.col("Status").isin("active", "rejected")


def may_be_judged_again(curated: str = "Curated") -> Column:
    """Rows for another look by the machine; a null site is eligible."""
    return F.col("Status").isin("pending_review", "active", "rejected") & F.coalesce(F.col("sourceSite") != curated, F.lit(True)) & ~looked_at()


def visible() -> Column:
    """What may be saved, opened or applied for: live, and not known to require German."""
    return (F.col("Status") == "active") & ~F.coalesce(F.col("GermanRequired"), F.lit(False))


def decided(postings: DataFrame, decisions: DataFrame, as_of: datetime) -> DataFrame:
    """``postings`` after ``decisions`` (JobID, decision, reason), one a posting.

    An accepted posting becomes active, by hand unless the machine had published it; a
    rejected one gets time and reason; any other decision puts it back into the queue.
    """
    met = postings.join(decisions.withColumnsRenamed({"decision": "_d", "reason": "_r"}).withColumn("_hit", F.lit(True)), "JobID", "left")
    hit, accept, reject = F.col("_hit").isNotNull(), F.col("_d") == "accept", F.col("_d") == "reject"
    now = F.lit(as_of).cast("timestamp")
    return met.withColumns({
        "Status": F.when(hit & accept, "active").when(hit & reject, "rejected").when(hit, "pending_review").otherwise(F.col("Status")),
        "reviewedAt": F.when(hit, now).otherwise(F.col("reviewedAt")),
        "approvalMethod": F.when(hit & accept & ~auto_published(), "manual").otherwise(F.col("approvalMethod")),
        "rejectedAt": F.when(hit & reject, now).otherwise(F.col("rejectedAt")),
        "RejectionReason": F.when(hit & reject & (F.coalesce("_r", F.lit("")) != ""), F.col("_r")).otherwise(F.col("RejectionReason")),
    }).drop("_d", "_r", "_hit")


def restored(chosen: Column) -> dict[str, Column]:
    """Columns that put the ``chosen`` rows back into the queue."""
    return {
        "Status": F.when(chosen, "pending_review").otherwise(F.col("Status")),
        "RejectionReason": F.when(~chosen, F.col("RejectionReason")),
        "reviewedAt": F.when(~chosen, F.col("reviewedAt")),
    }


def judged_again(postings: DataFrame, verdicts: DataFrame, least: float = 0.6, sure: float = 0.85) -> DataFrame:
    """``postings`` after new ``verdicts`` (JobID, german, confidence): rows that a person decided stay."""
    met = postings.join(verdicts, "JobID", "left")
    use = F.col("confidence").isNotNull() & may_be_judged_again()
    status = F.when(F.col("german") | (F.col("confidence") < least), "rejected").when(F.col("confidence") >= sure, "active").otherwise("pending_review")
    return met.withColumns({
        "GermanRequired": F.when(use, F.col("german")).otherwise(F.col("GermanRequired")), "Status": F.when(use, status).otherwise(F.col("Status")),
    }).drop("german", "confidence")


def compatible(detail: Column, required: Column, level: str = "none") -> Column:
    """Whether a candidate's German is enough: the detail's words first, then the flag."""
    if level in ("fluent", "native"):
        return F.lit(True)
    low = F.lower(F.coalesce(detail, F.lit("")))
    return (
        F.when(low.rlike("nice to have|preferred|von vorteil|not mentioned"), F.lit(True))
        .when(low.rlike("required|mandatory|erforderlich|c1|c2"), F.lit(False))
        .otherwise(~F.coalesce(required, F.lit(False)))
    )


def newest_if_many(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first ``most`` rows by ``order``; fewer rows stay as they are."""
    return rows.orderBy(*order).limit(most)
