"""HTML of postings made safe, in columns: tags as a stream of tokens, nesting by running sums.

A page becomes its tokens, tags and what stands between them.  For each element name a running
sum of opening and closing tags gives a level; an opening tag and the next closing one of its
page, name and level belong together.  Elements that go with all they hold are intervals of
tokens then, and a running sum of their starts and ends says what is inside one.  Windows are
over one page's tokens; pages are dealt out by their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.prose import decoded
from tidemark.functions.text import let

# Tags that stay, without attributes; elements that go with their content; blocks.
KEPT = ["p", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "strong", "em", "b", "i", "br"]
GONE = [
    "script", "style", "svg", "img", "picture", "video", "audio", "iframe", "noscript", "figure", "figcaption", "form", "input", "button", "select", "textarea",
]
BLOCKS = ["p", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6"]
#: Classes of sections that are no part of a posting.
GONE_CLASSES = ["content-intro", "content-conclusion"]
#: Elements without content.
VOID = ["br", "img", "input", "hr", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track"]
#: Elements whose content is no markup.
RAW = ["script", "style", "textarea", "iframe", "noscript"]

TOKEN = r"<[a-zA-Z/][^>]*>|[^<]+|<"
NAME = r"^</?([a-zA-Z][a-zA-Z0-9]*)"


def bared(html: Column) -> Column:
    """Comments, declarations and raw elements out; markup that is written as entities decoded once."""
    text = F.coalesce(html, F.lit(""))
    text = let(text, lambda t: F.when(t.rlike(r"(?i)&lt;\s*/?[a-z]"), decoded(t)).otherwise(t))
    text = F.regexp_replace(text, r"(?s)<!--.*?(?:-->|$)|<[!?][^>]*>", "")
    raw = "|".join(RAW)
    return F.regexp_replace(text, rf"(?is)<({raw})\b[^>]*>.*?(?:</\1\s*>|$)", "")


def tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, token, name, step): step is 1 for an opening tag, -1 for a closing one, 0 for a text or an element without content."""
    each = pages.select(key, F.posexplode(F.regexp_extract_all(bared(F.col(html)), F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    name = F.lower(F.regexp_extract("token", NAME, 1))
    named = each.withColumn("name", name)
    alone = (F.col("name") == "") | F.col("name").isin(VOID) | F.endswith(F.col("token"), F.lit("/>"))
    return named.withColumn("step", F.when(alone, 0).when(F.startswith(F.col("token"), F.lit("</")), -1).otherwise(1))


def outside(rows: DataFrame, key: str) -> DataFrame:
    """The tokens that lie in no element which goes with its content."""
    of_name = Window.partitionBy(key, "name").orderBy("pos")
    depth = F.sum("step").over(of_name)
    # a closing tag without an opening one does not lower the level
    ground = F.least(F.lit(0), F.min("_depth").over(of_name.rowsBetween(Window.unboundedPreceding, 0)))
    levelled = rows.withColumn("_depth", depth).withColumn("_level", F.col("_depth") - ground - F.when(F.col("step") == 1, 1).otherwise(0))
    classed = (F.col("name") == "div") & F.regexp_extract("token", r"(?i)\bclass\s*=\s*[\"']?([^\"'>]*)", 1).rlike(rf"(?:^|\s)(?:{'|'.join(GONE_CLASSES)})(?:\s|$)")
    starts = (F.col("step") == 1) & (F.col("name").isin(GONE) | classed)
    matched = Window.partitionBy(key, "name", "_level", F.col("step") != 0).orderBy("pos")
    ends = (F.col("step") == -1) & F.coalesce(F.lag("_starts").over(matched), F.lit(False))
    marked = levelled.withColumn("_starts", starts).withColumn("_ends", ends)
    inside = F.sum(F.when(F.col("_starts"), 1).when(F.col("_ends"), -1).otherwise(0)).over(Window.partitionBy(key).orderBy("pos"))
    lone = (F.col("step") == 0) & F.col("name").isin(GONE)
    return marked.withColumn("_inside", inside).where((F.col("_inside") == 0) & ~F.col("_ends") & ~lone).select(rows.columns)


def sanitized(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, html): the markup of ``KEPT`` tags without attributes, other tags unwrapped, what is dangerous or no part of it gone.

    Text and inline markup between blocks is wrapped in a paragraph; empty paragraphs and long
    runs of line breaks go.  ``key`` names a page; a page without html, or of which nothing is
    left, has an empty text.  Closing tags that nothing has opened go, elements that nobody closes
    reach to the end.
    """
    rows = outside(tokens(pages, key, html), key)
    tag = F.when(F.col("step") == -1, F.concat(F.lit("</"), "name", F.lit(">"))).otherwise(F.concat(F.lit("<"), "name", F.lit(">")))
    kept = rows.where((F.col("name") == "") | F.col("name").isin(KEPT))
    by = Window.partitionBy(key).orderBy("pos")
    summed = kept.withColumn("_sum", F.sum("step").over(by))
    ground = F.least(F.lit(0), F.min("_sum").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    deep = summed.withColumn("_deep", F.col("_sum") - ground)
    top = deep.withColumn("_top", F.coalesce(F.lag("_deep").over(by), F.lit(0)) == 0)
    # what no tag has opened is not closed
    top = top.where(~(F.col("_top") & (F.col("step") == -1)))
    # at the top begins a node, a block or not; nodes between blocks have the number of blocks before them
    begun = F.when(F.col("_top"), F.col("name").isin(BLOCKS))
    numbered = top.select(
        key, "pos", F.when(F.col("name") == "", F.col("token")).otherwise(tag).alias("out"), "name",
        F.sum(F.when(begun, 1).otherwise(0)).over(by).alias("part"), (~F.last(begun, ignorenulls=True).over(by)).alias("free"),
    )
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]), "")
    seen = F.max((F.col("name") == "") & (F.trim(F.regexp_replace("out", "[\\s ]|&nbsp;", "")) != ""))
    parts = numbered.groupBy(key, "part", "free").agg(F.min("pos").alias("pos"), said.alias("out"), seen.alias("seen"))
    wrapped = F.when(~F.col("free"), F.col("out")).when(F.col("seen"), F.concat(F.lit("<p>"), "out", F.lit("</p>"))).otherwise(F.lit(""))
    pages_of = parts.select(key, "pos", wrapped.alias("out")).groupBy(key).agg(said.alias("html"))
    clean = F.regexp_replace("html", r"(?i)(<br\s*/?>\s*){3,}", "<br>")
    clean = F.trim(F.regexp_replace(clean, r"(?i)<p>\s*(?:<br\s*/?>|\s|&nbsp;)*\s*</p>", ""), F.lit(" \n\t\r"))
    return pages.select(key).distinct().join(pages_of, key, "left").select(key, F.coalesce(clean, F.lit("")).alias("html"))


def resanitized(postings: DataFrame, key: str, html: str) -> DataFrame:
    """(key, html) of postings whose markup changes when it is decoded twice and made safe again."""
    twice = postings.where(F.coalesce(html, F.lit("")) != "").select(key, F.col(html).alias("_old"), decoded(decoded(F.col(html))).alias("_html"))
    made = sanitized(twice, key, "_html")
    return made.join(twice.select(key, "_old"), key).where(F.col("html") != F.col("_old")).select(key, "html")
