"""Connected groups of rows that share keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.store import shared_dir


def kept(rows: DataFrame, label: str) -> DataFrame:
    """Writes rows to a new folder of the shared one and reads them back: the lineage ends there."""
    path = f"{shared_dir(rows.sparkSession)}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def star(rows: DataFrame, node: str, key: list[Column]) -> DataFrame:
    """(a, b): each node with the least node of its key, so a key of n rows gives n edges; null keys give none."""
    named = {f"_k{j}": c for j, c in enumerate(key)}
    own = rows.select(node, *[c.alias(n) for n, c in named.items()]).dropna(subset=list(named))
    least = own.groupBy(*named).agg(F.min(node).alias("b"))
    return own.join(least, list(named)).where(F.col(node) != F.col("b")).select(F.col(node).alias("a"), "b")


def connected(nodes: DataFrame, edges: DataFrame, label: str = "groups") -> DataFrame:
    """(node, group): ``group`` is the least node that edges (a, b) lead to.

    Each round every node takes the least group among its neighbours' and its own, then the group of
    that group, so paths shorten by half; a round is one combined minimum and two joins, and is
    written.  The rounds end when no group changes.
    """
    both = edges.union(edges.select("b", "a")).distinct()
    both = kept(both, f"{label}-edges")
    now = kept(nodes.select(F.col(nodes.columns[0]).alias("node"), F.col(nodes.columns[0]).alias("group")), label)
    while True:
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("group").alias("near"))
        hooked = now.join(near, "node", "left").select("node", "group", F.least("group", F.coalesce("near", "group")).alias("to"))
        # a group whose root was hooked somewhere goes along
        roots = hooked.groupBy("group").agg(F.min("to").alias("root"))
        moved = hooked.join(roots, "group").select("node", F.least("to", "root").alias("group"), F.col("group").alias("was"))
        jump = now.select(F.col("node").alias("group"), F.col("group").alias("far"))
        new = kept(moved.join(jump, "group", "left").select("node", F.least("group", F.coalesce("far", "group")).alias("group"), "was"), label)
        if new.where(F.col("group") != F.col("was")).isEmpty():
            return new.select("node", "group")
        now = new.drop("was")
