"""A Parquet table in hashed key buckets: merges rewrite the buckets that they touch, and nothing else.

Layout: ``v=N/bucket=B`` has the rows of a bucket as version N left them, ``_log/N.json`` commits
version N and is written last, in one rename.  A record says which buckets the version wrote,
and the number of the batch, if it came from a stream; a record with ``all`` names the version
of every bucket, so older records are not needed any more.  A version without its record is
written anew by the next writer; a version whose record exists is never touched, so a second
writer that took the same number fails and can start again.

Readers take the last version of each bucket, and of the buckets of wanted keys only where keys
are given.  ``vacuum`` removes records and folders that no last version needs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.store import last_per_key


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class BucketStore:
    """Rows of ``schema`` by ``key``; a null is a key like any other.

    ``buckets`` is fixed when the store is made: about rows / buckets rows are rewritten for each
    touched bucket, so choose it by bytes (some 100 MB each).  A bucket is written in ``parts``
    files, by a hash of the key, so a large bucket is not one task's work.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], buckets: int = 16, parts: int = 1) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets, self.parts = spark, path.rstrip("/"), schema, list(key), buckets, parts
        self.files = self.place(path).getFileSystem(spark._jsc.hadoopConfiguration())

    # folders and the log

    def place(self, path: str):  # noqa: ANN201
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.files.exists(self.place(path))

    def names(self, path: str) -> list[str]:
        return [f.getPath().getName() for f in self.files.listStatus(self.place(path))] if self.exists(path) else []

    def log(self) -> list[dict]:
        """The records, oldest first: one a version, few after ``vacuum``."""
        if not any(n.endswith(".json") for n in self.names(f"{self.path}/_log")):
            return []
        rows = self.spark.read.option("pathGlobFilter", "*.json").text(f"{self.path}/_log").collect()
        return sorted((json.loads(r[0]) for r in rows), key=lambda r: r["v"])

    def latest(self, before: int | None = None) -> dict[int, int]:
        """The last committed version of each bucket, below ``before``."""
        found: dict[int, int] = {}
        for record in self.log():
            if before is None or record["v"] < before:
                found |= {int(b): v for b, v in record["all"].items()} if "all" in record else dict.fromkeys(record["buckets"], record["v"])
        return found

    def version(self) -> int:
        """The last committed version, or -1."""
        return max([r["v"] for r in self.log()], default=-1)

    def has_batch(self, batch: int) -> bool:
        """Whether a batch has been committed; batches come in order."""
        return any(r["batch"] is not None and r["batch"] >= batch for r in self.log())

    def commit(self, version: int, batch: int | None = None, **what: object) -> None:
        last, done = f"{self.path}/_log/{version}.json", [r["batch"] for r in self.log() if r["batch"] is not None]
        record = {"v": version, "batch": max([*done, *([] if batch is None else [batch])], default=None), **what}
        draft = self.place(f"{self.path}/_log/.{version}-{uuid.uuid4().hex}")
        out = self.files.create(draft)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        if self.exists(last) or not self.files.rename(draft, self.place(last)):
            self.files.delete(draft, False)
            raise Conflict(last)

    # rows

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of keys: at most ``buckets`` numbers."""
        return sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def folders(self, latest: dict[int, int], of: str = "") -> list[str]:
        held = {v: set(self.names(f"{self.path}/{of}v={v}")) for v in set(latest.values())}
        return [f"{self.path}/{of}v={v}/bucket={b}" for b, v in sorted(latest.items()) if f"bucket={b}" in held[v]]

    def read(self, latest: dict[int, int]) -> DataFrame:
        paths = self.folders(latest)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def current(self, keys: DataFrame | None = None) -> DataFrame:
        """The rows; with ``keys``, those of their buckets that have one of the keys."""
        latest = self.latest()
        if keys is None:
            return self.read(latest)
        own = self.touched(keys)
        return self.matched(self.read({b: v for b, v in latest.items() if b in own}), keys.select(*self.key).distinct(), "left_semi")

    def matched(self, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """A join by key in which nulls are equal; the left key's columns, or the right's where the left has no row."""
        names = {c: f"_key_{c}" for c in self.key}
        fits = F.lit(True)
        for c, other in names.items():
            fits &= left[c].eqNullSafe(F.col(other))
        met = left.join(right.withColumnsRenamed(names), fits, how)
        if how in ("left_semi", "left_anti"):
            return met
        if how == "full_outer":
            met = met.withColumns({c: F.when(F.col("_old").isNotNull(), left[c]).otherwise(F.col(other)) for c, other in names.items()})
        return met.drop(*names.values())

    def write(self, rows: DataFrame, touched: list[int], version: int, batch: int | None = None) -> None:
        """The new state of the ``touched`` buckets, then the record that commits it."""
        held = rows.select(*self.schema.names).withColumn("bucket", self.bucket())
        dealt = held.repartition("bucket", F.pmod(F.xxhash64(F.lit(7), *self.key), F.lit(self.parts)))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={version}")
        self.commit(version, batch, buckets=touched)

    def start(self, rows: DataFrame | None = None) -> BucketStore:
        """Version 0, if nothing has been committed yet."""
        if self.version() < 0:
            self.write(self.spark.createDataFrame([], self.schema) if rows is None else rows, list(range(self.buckets)), 0)
        return self

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], batch: int | None = None) -> list[int]:
        """Replaces the buckets of ``keys`` by what ``change`` makes of their rows; these buckets."""
        if batch is not None and self.has_batch(batch):
            return []
        version, own = self.version() + 1, self.touched(keys)
        if not own and batch is None:
            return []
        latest = self.latest()
        self.write(change(self.read({b: latest[b] for b in own if b in latest})), own, version, batch)
        return own

    def replace(self, rows: DataFrame, batch: int | None = None) -> None:
        """All rows anew."""
        if batch is None or not self.has_batch(batch):
            self.write(rows, list(range(self.buckets)), self.version() + 1, batch)

    def merge(
        self, source: DataFrame, order: list[str], matched: dict[str, Column] | None = None, inserted: dict[str, Column] | None = None,
        deleted: Column | None = None, batch: int | None = None,
    ) -> list[int]:
        """What MERGE INTO does with ``source``, of whose rows the last of each key by ``order`` counts.

        ``matched`` sets columns of stored rows, ``inserted`` those of new ones; without it none
        are added.  Expressions name stored columns as ``o.c`` and the source's as ``n.c``; a
        column not named is taken from the source if it has it, else kept.  Rows for which
        ``deleted``, over ``n.c``, is true are taken out.
        """
        fresh = last_per_key(source, self.key, *order).withColumn("_hit", F.lit(True))
        gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
        data = [c for c in self.schema.names if c not in self.key]

        def value(c: str, given: dict[str, Column], fallback: Column) -> Column:
            return given[c] if c in given else F.col(f"n.{c}") if c in fresh.columns else fallback

        def change(old: DataFrame) -> DataFrame:
            named = lambda rows, side: rows.select(*self.key, F.struct(*[c for c in rows.columns if c not in self.key]).alias(side))
            both = self.matched(named(old, "o").withColumn("_old", F.lit(True)), named(fresh, "n"), "left" if inserted is None else "full_outer")
            hit, there = F.col("n._hit").isNotNull(), F.col("_old").isNotNull()
            columns = [
                F.when(hit & there, value(c, matched or {}, F.col(f"o.{c}"))).when(there, F.col(f"o.{c}"))
                .otherwise(value(c, inserted or {}, F.lit(None))).cast(self.schema[c].dataType).alias(c)
                for c in data
            ]
            return both.where(~(hit & gone)).select(*self.key, *columns)

        return self.rewrite(fresh, change, batch)

    def upsert(self, source: DataFrame, as_of: datetime, *order: str, batch: int | None = None) -> list[int]:
        """The source's values win; createdAt is set once, updatedAt each time."""
        now = F.lit(as_of).cast("timestamp")
        return self.merge(source, list(order), {"createdAt": F.col("o.createdAt"), "updatedAt": now}, {"createdAt": now, "updatedAt": now}, batch=batch)

    def insert_missing(self, source: DataFrame, *order: str) -> list[int]:
        """Adds the first row of each key that the store lacks; only buckets with a new key are written."""
        rest = [c for c in source.columns if c not in self.key]
        best = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_b")
        one = source.groupBy(*self.key).agg(best).select(*self.key, *[F.col(f"_b.{c}").alias(c) for c in rest])
        new = self.matched(one, self.current(source).select(*self.key), "left_anti")
        return self.rewrite(new, lambda old: old.unionByName(self.matched(one, old.select(*self.key), "left_anti"), allowMissingColumns=True))

    def update(self, keys: DataFrame, values: dict[str, Column]) -> list[int]:
        """Sets columns of the rows with one of the keys; ``values`` are over the stored columns."""
        own = keys.select(*self.key).distinct().withColumn("_hit", F.lit(True))

        def change(old: DataFrame) -> DataFrame:
            hit = F.col("_hit").isNotNull()
            return self.matched(old, own, "left").withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}).drop("_hit")

        return self.rewrite(own, change)

    def delete(self, fits: Column) -> list[int]:
        """Takes rows out; only buckets that have one are written."""
        return self.rewrite(self.current().where(fits).select(*self.key), lambda old: old.where(~F.coalesce(fits, F.lit(False))))

    # what nobody needs

    def compact(self) -> None:
        """Sums the log up in one record; rows stay where they are."""
        self.commit(self.version() + 1, all={str(b): v for b, v in self.latest().items()})

    def vacuum(self, keep: int = 1) -> list[int]:
        """Removes the records before the last sum, and the buckets' folders that none of the last ``keep`` states needs; the versions that are gone.

        A reader that still holds an older state fails on its next file, so keep as many as
        the longest job may need.
        """
        if not any("all" in r for r in self.log()[-1:]):
            self.compact()
        last = self.version()
        needed = {(b, v) for k in range(max(keep, 1)) for b, v in self.latest(last + 1 - k).items()}
        oldest = last - max(keep, 1)
        sums = [r["v"] for r in self.log() if "all" in r and r["v"] <= oldest + 1]
        gone = []
        for name in self.names(f"{self.path}/_log"):
            number = name.removesuffix(".json")
            if number.isdigit() and sums and int(number) < max(sums):
                self.files.delete(self.place(f"{self.path}/_log/{name}"), False)
        for version in sorted(int(n[2:]) for n in self.names(self.path) if n.startswith("v=")):
            if version > last:
                continue  # a writer may be at it
            for of in self.kinds():
                for name in self.names(f"{self.path}/{of}v={version}"):
                    if name.startswith("bucket=") and (int(name[7:]), version) not in needed:
                        self.files.delete(self.place(f"{self.path}/{of}v={version}/{name}"), True)
            if not any(v == version for _, v in needed):
                for of in self.kinds():
                    self.files.delete(self.place(f"{self.path}/{of}v={version}"), True)
                gone.append(version)
        return gone

    def kinds(self) -> Iterable[str]:
        """Prefixes of the folders that hold a version."""
        return ("",)
