"""The weekly digest of every subscriber: picked once for each list of wanted categories, not for each user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import cap_per_group

#: Postings in a mail, and postings of a category that are counted for it.
SHOWN, COUNTED = 8, 50


def subject(shown: Column) -> Column:
    return F.concat(F.lit("Your weekly job digest — "), shown.cast("string"), F.when(shown == 1, " new role in Germany").otherwise(" new roles in Germany"))


def picked(wanted: DataFrame, postings: DataFrame, category: str, id_col: str, *order: Column) -> DataFrame:
    """(wanted, total, picks) for lists of categories: the newest of each category in turn, ``SHOWN`` in all.

    ``picks`` are (category, id), by category in the list's order.  Lists for which there is
    no posting are left out.
    """
    top = cap_per_group(postings, F.col(category), COUNTED, *order)
    by = Window.partitionBy(category)
    ranked = top.select(
        F.col(category).alias("category"), F.col(id_col).alias("id"), F.row_number().over(by.orderBy(*order)).alias("turn"), F.count("*").over(by).alias("n")
    ).where(F.col("turn") <= SHOWN)
    named = wanted.select("wanted", F.posexplode("wanted").alias("place", "category"))
    met = named.join(ranked, "category")
    in_turn = F.row_number().over(Window.partitionBy("wanted").orderBy("turn", "place"))
    first = met.withColumn("k", in_turn)
    # a list has at most SHOWN rows a category, and SHOWN picks
    picks = F.array_sort(F.collect_list(F.when(F.col("k") <= SHOWN, F.struct("place", "turn", "category", "id"))))
    made = first.groupBy("wanted").agg(F.sum(F.when(F.col("turn") == 1, F.col("n"))).alias("total"), picks.alias("p"))
    return made.select("wanted", "total", F.transform("p", lambda x: F.struct(x["category"], x["id"])).alias("picks"))


def messages(users: DataFrame, postings: DataFrame, category: str, id_col: str, *order: Column) -> DataFrame:
    """``users`` with (total, shown, subject, picks), a row for each who gets a mail.

    ``users`` have ``desiredCategories``; an equal category counts once.  Users without
    categories, and those whose categories have no posting, get none.
    """
    own = users.withColumn("wanted", F.array_distinct("desiredCategories")).where(F.size("wanted") > 0)
    found = picked(own.select("wanted").distinct(), postings, category, id_col, *order)
    shown = F.size("picks")
    return own.join(found, "wanted").drop("wanted").withColumns({"shown": shown, "subject": subject(shown)})
