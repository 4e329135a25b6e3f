"""Shared pieces of the training-data operators: tables, written tables, components.

Conventions used by every operator of this subpackage:

* A null text is an empty text.  Operators never fail on one.
* Rows that share both the id and the text are one document: each such row gets the
  same result.  Rows that share an id but differ in text are told apart by a 128-bit
  hash of the text.
* Columns that an operator adds internally start with ``__`` and are dropped again;
  extra input columns pass through untouched wherever rows pass through.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast a side by hint only when its measured row count is at most this.
BROADCAST_ROWS = 100_000

#: ASCII white space of the word rule: words are runs of anything else.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder is used on a local master only; on a cluster
    that would be invisible to the other machines, so it is an error there.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes ``df`` to a new folder of the shared one and reads it back; the folder's path too."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage."""
    return stored(df, label)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``stored`` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Hints a broadcast when ``rows``, the measured size of ``df``, is small enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text: array of runs of anything but ASCII white space."""
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Columns ``__id``, ``__h1`` and ``__h2`` that tell documents apart (never null)."""
    text = text_or_empty(text_col)
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("__id"),
        F.xxhash64(text).alias("__h1"),
        F.xxhash64(F.lit(7), text).alias("__h2"),
    ]


KEY = ["__id", "__h1", "__h2"]


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b): rows (node, root).

    ``root`` is the smallest node of the component; nodes without an edge are absent.
    Alternates large-star and small-star rounds, each a hash aggregate of one minimum
    per node and a join that AQE may split at a hot node; no group is ever collected.
    Every round is written to the shared folder, so a lost executor costs one round; the
    round before is deleted then.
    """
    now, path = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        label,
    )
    mark = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        last = path
        now, path = stored(small, label)
        removed(now.sparkSession, last)
        seen = now.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
        ).first()
        if mark == (seen["n"], seen["s"]):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (seen["n"], seen["s"])
