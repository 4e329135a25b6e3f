"""A facet index: for each value of a facet the rows that have it, as bits, kept current by the store's merges.

A row's place is its number in its bucket, by key, so a bucket's bits are made of its rows
alone: an upsert or delete that rewrites a bucket writes the bits of this bucket anew, and no
others.  Bits are those of Spark's bitmap functions, 32,768 to a block; a bucket with more rows
has more blocks.  Values of one facet are united, facets are intersected, block by block, so no
row is read for a count by facets; a predicate that is no facet (a range, a text) becomes bits
by one scan of its own columns.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tidemark.operators.buckets import BucketStore

#: A facet's value where the row has none.
NULL = "_null"
#: The facet of the rows that may be seen at all, and its value.
LIVE = ("_live", "yes")
BITS = "facet string, value string, block long, bits binary"
BLOCK = ["bucket", "block"]


def block_of(place: Column) -> Column:
    return F.bitmap_bucket_number(place + 1)


def bits_of(place: Column) -> Column:
    """Blocks as bits: an aggregate that is combined before the shuffle."""
    return F.bitmap_construct_agg(F.bitmap_bit_position(place + 1))


class IndexedStore(BucketStore):
    """A ``BucketStore`` with bits for ``facets``, columns of few values, and for the ``live`` rows.

    Empty facet values count as null.  A facet of very many values is better served by its
    column: each value has a block of 4 KB, though mostly zeros, for each bucket that has it.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType, key: list[str], facets: list[str], live: Column | None = None,
        buckets: int = 16, parts: int = 1,
    ) -> None:
        super().__init__(spark, path, schema, key, buckets, parts)
        self.facets, self.live = facets, F.lit(True) if live is None else live
        self.placed = StructType([*schema.fields]).add("_place", LongType())

    def kinds(self) -> Iterable[str]:
        return ("", "_bits/")

    def with_places(self, latest: dict[int, int]) -> DataFrame:
        """Rows with their bucket and place."""
        paths = self.folders(latest)
        rows = self.spark.read.schema(self.placed).parquet(*paths) if paths else self.spark.createDataFrame([], self.placed)
        return rows.withColumn("bucket", self.bucket())

    def write(self, rows: DataFrame, touched: list[int], version: int, batch: int | None = None) -> None:
        held = rows.select(*self.schema.names).withColumn("bucket", self.bucket())
        # a bucket is bounded by the store's design, so its rows may be numbered in one task
        place = F.row_number().over(Window.partitionBy("bucket").orderBy(*self.key)) - 1
        held.withColumn("_place", place.cast("long")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={version}")
        # of the rows as written: their places are fixed now
        written = self.with_places({b: version for b in touched})
        pairs = [F.struct(F.lit(c).alias("facet"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(NULL)).alias("value")) for c in self.facets]
        pairs.append(F.when(self.live, F.struct(F.lit(LIVE[0]).alias("facet"), F.lit(LIVE[1]).alias("value"))))
        each = written.select("bucket", "_place", F.explode(F.array_compact(F.array(*pairs))).alias("x"))
        bits = each.groupBy("bucket", "x.facet", "x.value", block_of(F.col("_place")).alias("block")).agg(bits_of(F.col("_place")).alias("bits"))
        bits.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/_bits/v={version}")
        self.commit(version, batch, buckets=touched)

    def index(self, facets: list[str] | None = None) -> DataFrame:
        """(bucket, facet, value, block, bits) of the current versions; the facets reach the scan."""
        paths = self.folders(self.latest(), "_bits/")
        if not paths:
            return self.spark.createDataFrame([], f"bucket int, {BITS}")
        # the paths may belong to several versions; the bucket is in the path
        rows = self.spark.read.schema(BITS).parquet(*paths)
        bucket = F.regexp_extract(F.col("_metadata.file_path"), r"/bucket=(\d+)/", 1).cast("int").alias("bucket")
        rows = rows if facets is None else rows.where(F.col("facet").isin(facets))
        return rows.select(bucket, "facet", "value", "block", "bits")

    def scanned(self, fits: Column) -> DataFrame:
        """(bucket, block, bits) of the rows that fit a predicate, by a scan of its columns."""
        hit = self.with_places(self.latest()).where(fits)
        return hit.groupBy("bucket", block_of(F.col("_place")).alias("block")).agg(bits_of(F.col("_place")).alias("bits"))

    def matching(self, asked: dict[str, list[str]], *others: Column) -> DataFrame:
        """(bucket, block, bits) of the live rows with any of the values of each asked facet, and that fit the ``others``.

        A facet asked for with no value is met by no row.
        """
        wanted = {LIVE[0]: [LIVE[1]], **asked}
        fits = F.lit(False)
        for facet, values in wanted.items():
            fits |= (F.col("facet") == facet) & (F.col("value").isin(values) if values else F.lit(False))
        united = self.index(list(wanted)).where(fits).groupBy(*BLOCK, "facet").agg(F.bitmap_or_agg("bits").alias("bits"))
        for k, other in enumerate(others):
            united = united.unionByName(self.scanned(other).withColumn("facet", F.lit(f"_other{k}")))
        met = united.groupBy(*BLOCK).agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
        # a block that lacks a facet has none of its bits
        return met.where(F.col("n") == len(wanted) + len(others)).drop("n")

    def counts(self, hits: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
        """(facet, value, n): for every value of every domain the number of ``hits`` that have it, zeros too, and the total."""
        known = self.spark.createDataFrame([("total", "")] + [(c, v) for c, vs in domains.items() for v in vs], "facet string, value string")
        own = self.index(list(domains)).join(hits.withColumnRenamed("bits", "hit"), BLOCK)
        both = own.select(*BLOCK, "facet", "value", F.explode(F.array("bits", "hit")).alias("b"))
        each = both.groupBy(*BLOCK, "facet", "value").agg(F.bitmap_count(F.bitmap_and_agg("b")).alias("n")).select("facet", "value", "n")
        total = hits.select(F.lit("total").alias("facet"), F.lit("").alias("value"), F.bitmap_count("bits").alias("n"))
        summed = each.unionByName(total).groupBy("facet", "value").agg(F.sum("n").alias("n"))
        return known.join(summed, ["facet", "value"], "left").select("facet", "value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    def distinct(self, hits: DataFrame, facets: list[str]) -> DataFrame:
        """(facet, values): how many values, null not counted, the hits have in each facet."""
        counted = self.index(facets).where(F.col("value") != NULL).join(hits.withColumnRenamed("bits", "hit"), BLOCK)
        both = counted.select(*BLOCK, "facet", "value", F.explode(F.array("bits", "hit")).alias("b"))
        met = both.groupBy(*BLOCK, "facet", "value").agg(F.bitmap_count(F.bitmap_and_agg("b")).alias("n")).where("n > 0")
        return met.groupBy("facet").agg(F.countDistinct("value").alias("values"))

    def rows(self, hits: DataFrame) -> DataFrame:
        """The rows whose bit is set."""
        own = self.with_places(self.latest()).withColumn("block", block_of(F.col("_place")))
        at = F.bitmap_bit_position(F.col("_place") + 1)
        byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        there = F.expr("shiftright(_byte, _bit)").bitwiseAND(F.lit(1)) == 1
        return own.join(hits, BLOCK).withColumns({"_byte": byte, "_bit": (at % 8).cast("int")}).where(there).select(*self.schema.names)
