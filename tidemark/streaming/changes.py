"""A table kept current from a change feed: files of change records, applied in micro-batches."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.buckets import BucketStore
from tidemark.operators.store import apply_changes, last_per_key

# Root fields whose change matters to a query.
SIGNIFICANT = [
    "Status", "JobTitle", "Company", "Country", "WorkplaceType", "EmploymentType", "ExperienceLevel", "Category", "Domain",
    "SubDomain", "Description", "DescriptionHtml", "ApplicationURL", "DirectApplyURL", "PostedDate", "SalaryMin",
    "SalaryMax", "SalaryCurrency", "SalaryInterval", "filterWorkplace", "filterExperience", "filterEmployment",
    "filterSalaryTier", "filterSalaryMin", "filterSalaryMax",
]


def kind(operation: Column) -> Column:
    """What a change does: upsert, delete, reconcile (the whole table is in question) or nothing."""
    return (
        F.when(operation.isin("insert", "replace", "update"), "upsert").when(operation == "delete", "delete")
        .when(operation.isin("drop", "dropDatabase", "rename"), "reconcile")
    )


def matters(operation: Column, touched: Column, fields: list[str] | None = None) -> Column:
    """False for updates that touch no significant root field; other changes, and updates without a list, matter."""
    roots = F.transform(touched, lambda f: F.split_part(f, F.lit("."), F.lit(1)))
    some = F.arrays_overlap(roots, F.array(*[F.lit(f) for f in fields or SIGNIFICANT]))
    return F.when(F.coalesce(operation, F.lit("")) != "update", F.lit(True)).otherwise(F.coalesce(some, F.lit(True)))


class CurrentTable(BucketStore):
    """A ``BucketStore`` kept current by micro-batches: each rewrites the buckets that it touches, once.

    The number of a batch is in the record that commits it, so a batch that is repeated after
    a failure is skipped, or written anew if it was not committed.  A batch with a change that
    puts the whole table in question replaces it by the snapshot.  Every ``tidy`` versions the
    log is summed up and folders that no state needs are removed.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType, key: list[str], deleted: Column, order: str, buckets: int = 16,
        reconcile: Column | None = None, snapshot: Callable[[], DataFrame] | None = None, tidy: int = 64,
    ) -> None:
        super().__init__(spark, path, schema, key, buckets)
        self.deleted, self.order, self.reconcile, self.snapshot, self.tidy = deleted, order, reconcile, snapshot, tidy

    def apply(self, batch: DataFrame, number: int) -> None:
        if self.has_batch(number):
            return
        if self.snapshot and self.reconcile is not None and not batch.where(self.reconcile).isEmpty():
            self.replace(self.snapshot(), number)
        else:
            self.rewrite(batch, lambda old: apply_changes(old, batch, self.key, self.deleted, self.order), number)
        if self.tidy and self.version() % self.tidy == 0:
            self.vacuum(keep=2)

    def follow(self, changes: DataFrame, available_now: bool = True):  # noqa: ANN201
        """Starts the stream; the checkpoint, which keeps the place in the feed, lies beside the table."""
        writer = changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.path}/_state")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="300 milliseconds")).start()


def kept_up(start: Callable[[], object], refresh: Callable[[], None], tries: int = 5, first_wait: float = 1.0, most_wait: float = 60.0) -> None:
    """Runs a stream to its end; after an error, refreshes from a snapshot, waits longer each time and starts anew."""
    wait = first_wait
    for k in range(tries):
        try:
            start().awaitTermination()  # type: ignore[attr-defined]
            return
        except StreamingQueryException:
            if k == tries - 1:
                raise
            refresh()
            time.sleep(wait)
            wait = min(2 * wait, most_wait)


def changed_mark(table: DataFrame, ts: str, seen: tuple | None) -> tuple | None:
    """(rows, latest time) of a table where it differs from the one seen before, else null: what a poll looks at."""
    row = table.agg(F.count("*").alias("n"), F.max(ts).alias("t")).first()
    return None if seen == (row["n"], row["t"]) else (row["n"], row["t"])


def fed(events: DataFrame, path: str, parts: int = 4) -> None:
    """The events as a feed: files in the order of event ids, with what each operation is.  Errors are deletes; one file has a drop."""
    last = events.agg(F.max("event_id").alias("m")).first()["m"]
    operation = F.when(F.col("event_type") == "error", "delete").when(F.col("event_id") % 2 == 0, "update").otherwise("insert")
    feed = events.select("user_id", "event_id", "event_type", "value", operation.alias("op"))
    for k in range(parts):
        own = feed.where(F.floor(F.col("event_id") * parts / F.lit((last or 0) + 1)) == k)
        if k == parts // 2:
            own = own.unionByName(events.sparkSession.range(1).select(F.lit("drop").alias("op")), allowMissingColumns=True)
        own.coalesce(1).write.mode("append").parquet(path)  # a file a trigger; a feed is written by many small runs


def followed(spark: SparkSession, sf_dir: str, shared: str) -> DataFrame:
    """The last event of each user, kept by a stream over a feed of several files with updates, deletes and a drop."""
    events, path = spark.read.parquet(f"{sf_dir}/events.parquet"), f"{shared}/feed-{uuid.uuid4().hex}"
    fed(events, path)
    schema = spark.read.parquet(path).schema
    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    own = StructType([f for f in schema if f.name != "op"])

    def snapshot() -> DataFrame:
        """What the source has now."""
        return last_per_key(events.select(*own.names), ["user_id"], "event_id").where("event_type <> 'error'")

    table = CurrentTable(
        spark, f"{shared}/current-{uuid.uuid4().hex}", own, ["user_id"], kind(F.col("op")) == "delete", "event_id",
        reconcile=kind(F.col("op")) == "reconcile", snapshot=snapshot, tidy=2,
    )
    table.start()
    table.follow(changes).awaitTermination()
    return table.current()
