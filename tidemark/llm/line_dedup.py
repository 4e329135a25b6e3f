"""Line dedup: winnowing over hashes of line pieces, in DataFrame functions only.

Method: a text is cut into pieces, at line ends and behind sentence ends, so that a
passage that starts in the middle of a line still has whole pieces.  Pieces without words
are left out, the others hashed.  A window is a shortest run of pieces with ``MIN_WORDS``
words, seen from its first piece or from its last one.  Each window has one fingerprint,
its minimum in an order that puts long pieces first: a piece of ``MIN_WORDS`` words is a
fingerprint by itself; where all pieces of a window are short, and say little alone, the
fingerprint is their hash together.  Two equal runs of ``MIN_WORDS`` words have an equal
window, so they share a fingerprint wherever they stand.  Fingerprints that occur more
than once are joined with their positions and extended both ways to the windows around
them.  Windows are compared whole; those that occurred earlier (smaller id, then text
hash, then position) are put together to runs of any length, which are deleted.

So a piece is deleted if, and only if, it lies in a run of ``MIN_WORDS`` words or more that
is equal, piece by piece, to a run that starts earlier in any text; blank pieces go with
the one before them.  A piece's words are counted as its inner spaces plus one.

Scale: pieces are hashed once and written.  Fingerprints are shuffled once, as three
numbers each, and windows only where a fingerprint occurs again.  Values that are found
often in a sample (one in ``SAMPLE``) are hot: no more than ``HOT`` of them, they are
broadcast, and their rows are not shuffled by value; a hot value that the sample misses is
handled like any other, so the sample has no say in the result.  Rows are compared with
first occurrences only, never with each other.  Nothing is collected beyond the
fingerprints and the runs of one document.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import row_key, text_or_empty, written

MIN_WORDS = 10
#: What separates pieces: white space behind a sentence end, or a line end.
BREAK = r"([.!?;:][^\x20\x09-\x0D\p{L}\p{N}]{0,3})([ \t\x0b\x0c\r]+)|(\n)"
#: White space that makes a text's words stand apart otherwise than by one space.
WIDE = ("  ", "\t", "\r", "\x0b", "\x0c")
#: Marks cuts for a moment; where a text holds it, its md5 is added to tell them apart.
CUT = "\ue000"
#: A word, as in ``common.WORD_BREAK``.
WORD = r"[^\x20\x09-\x0D]+"
#: One row in so many is looked at to find hot values.
SAMPLE = 16
#: Bound of the number of hot values, and the rows of the sample that make a value hot at least.
HOT, OFTEN = 10_000, 8
LOW = 2**32 - 1


def cut_mark(text: Column) -> Column:
    """What marks cuts in a text for a moment, and does not occur in it."""
    return F.when(F.contains(text, F.lit(CUT)), F.concat(F.lit(CUT), F.md5(text))).otherwise(F.lit(CUT))


def pieces(text: Column, mark: Column, separators: bool = True) -> Column:
    """The pieces of a text with its ``cut_mark``; with separators they are the text again when joined."""
    kept = F.lit("$1$2$3" if separators else "$1")
    return F.split(F.regexp_replace(text, F.lit(BREAK), F.concat(kept, mark)), mark)


def narrow(text: Column) -> Column:
    """The text with one space between words of a line; it has the same ``pieces``, but for white space."""
    some = F.lit(False)
    for c in WIDE:
        some |= F.contains(text, F.lit(c))
    return F.when(some, F.regexp_replace(text, "[ \t\x0b\x0c\r]+", " ")).otherwise(text)


def hashed(texts: DataFrame) -> DataFrame:
    """The columns of ``texts``, but (i, h, w) for ``text``: arrays of the positions, hashes and words of ``pieces`` with a word.

    Text and mark are columns, each made once: within the function of an array they would be
    made anew wherever they are named.
    """

    def one(bare: Column, i: Column) -> Column:
        spaces = F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(" "), F.lit("")))
        return F.when(bare != "", F.struct(i.alias("i"), F.xxhash64(bare).alias("h"), (spaces + 1).alias("w")))

    marked = texts.withColumn("text", narrow(F.col("text"))).withColumn("mark", cut_mark(F.col("text")))
    bare = F.transform(pieces(F.col("text"), F.col("mark"), separators=False), lambda p: F.trim(p))
    made = marked.withColumn("x", F.array_compact(F.transform(bare, one)))
    return made.select("*", *[F.col(f"x.{c}").alias(c) for c in "ihw"]).drop("text", "mark", "x")


def sums(start: Column, way: int, min_words: int) -> list[Column]:
    """Words of the first, the first two, ... pieces from ``start`` on, one way; ``min_words`` or more beyond the text's end."""
    steps = (F.coalesce(F.get("w", start + way * j), F.lit(min_words)) for j in range(min_words - 1))
    return list(accumulate(steps))


def below(words: list[Column], min_words: int) -> Column:
    """How many of the sums are less than ``min_words``."""
    return sum(((s < min_words).cast("int") for s in words), F.lit(0))


def length(k: Column, behind: list[Column], min_words: int) -> Column:
    """Pieces of the shortest window that starts at piece k, by the ``sums`` behind it; it may end beyond the text."""
    own = F.get("w", k)
    return below([own, *[own + s for s in behind[:-1]]], min_words) + 1


def together(k: Column, n: Column) -> Column:
    """One hash of the n pieces from k on."""
    return F.xxhash64(F.slice("h", k + 1, n))


def packed(k: Column) -> Column:
    """The text's hash and a position in one number."""
    return F.shiftleft(F.col("t").cast("long"), 32).bitwiseOR(k.cast("long"))


def prints(cut: DataFrame, min_words: int) -> DataFrame:
    """(id, p, v): the fingerprints of all texts.

    ``p`` packs the text's hash with twice the place of a long piece, or twice the place of
    the first of some short pieces plus one.
    """

    k, n = F.col("k"), F.col("n")
    each = cut.select("id", "t", "h", "w", F.posexplode("w").alias("k", "__w"))
    ahead = each.withColumn("n", length(k, sums(k + 1, 1, min_words), min_words))
    # only the last piece of a shortest window can be long
    row = (
        F.when(n == 1, F.array(F.struct(packed(2 * k).alias("p"), F.get("h", k).alias("v"))))
        .when(F.get("w", k + n - 1) < min_words, F.array(F.struct(packed(2 * k + 1).alias("p"), together(k, n).alias("v"))))
    )
    # a filter would be pushed below and have the lengths computed twice
    return ahead.select("id", F.inline(row).alias("p", "v"))


def often(drawn: DataFrame) -> DataFrame:
    """(hot): the values ``v`` that are frequent in a sample; at most ``HOT``."""
    counted = written(drawn.groupBy("v").agg(F.count("*").alias("n")).where("n > 1"), "line-often")
    least = max(OFTEN, (counted.agg(F.sum("n")).first()[0] or 0) // HOT)
    return counted.where(F.col("n") >= least).select(F.col("v").alias("hot"))


def again(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(id, t, at): the fingerprints of each text that occur more than once."""
    marked = rows.join(F.broadcast(hot), F.col("v") == F.col("hot"), "left")
    # hot values are spread: they need no count
    spread = F.when(F.col("hot").isNotNull(), F.xxhash64("id", "p"))
    found = marked.withColumn("n", F.count("*").over(Window.partitionBy("v", spread))).where("n > 1 or hot is not null")
    text, f = F.shiftright("p", 32).cast("int"), F.col("p").bitwiseAND(F.lit(LOW)).cast("int")
    return found.groupBy("id", text.alias("t")).agg(F.array_sort(F.collect_set(f)).alias("at"))


def windows(met: DataFrame, min_words: int) -> DataFrame:
    """(id, p, v, e): the windows with a fingerprint of ``at``, by positions in the text.

    A fingerprint is a window by itself.  A long piece is also the end of the windows that
    start in the short pieces before it, and any fingerprint is the start of those that end
    in the short pieces behind it, as far as they stay shortest windows.
    """
    f, k, n, d = F.col("f"), F.col("k"), F.col("n"), F.col("d")
    each = met.select("id", "t", "i", "h", "w", F.explode("at").alias("f"))
    each = each.withColumns({"k": F.shiftright(f, 1), "alone": f.bitwiseAND(F.lit(1)) == 0})
    behind = sums(k + 1, 1, min_words)
    each = each.withColumns({
        "n": length(k, behind, min_words),
        "before": below(sums(k - 1, -1, min_words), min_words),
        "behind": below(behind, min_words),
    })
    first = F.when(F.col("alone"), -F.col("before")).otherwise(0)
    found = each.select("id", "t", "i", "h", "k", "n", F.explode(F.sequence(first, F.greatest(F.col("behind") + 1 - n, F.lit(0)))).alias("d"))
    # -d pieces before a long one, or d pieces behind a fingerprint
    found = found.select("id", "t", "i", "h", F.when(d < 0, k + d).otherwise(k).alias("k"), (n + F.abs(d)).alias("n"))
    # with the blank pieces up to the next one
    end = F.coalesce(F.get("i", k + n) - 1, F.get("i", k + n - 1))
    return found.select("id", packed(F.get("i", k)).alias("p"), together(k, n).alias("v"), end.alias("e"))


def later(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(id, p, e): the ``rows`` whose value occurred earlier."""
    same, me = F.col("v") == F.col("hot"), F.struct("id", "p")
    # at most HOT rows, each from a combining aggregate
    first = rows.join(F.broadcast(hot), same, "left_semi").groupBy(F.col("v").alias("hot")).agg(F.min(me).alias("first"))
    rare = rows.join(F.broadcast(hot), same, "left_anti").withColumn("first", F.min(me).over(Window.partitionBy("v")))
    both = rare.unionByName(rows.join(F.broadcast(first), same).drop("hot"))
    return both.where(F.col("first") < me).select("id", "p", "e")


def runs(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, text's hash, runs): for each document the sorted (s, e) of pieces that occurred before."""
    key, first, _ = row_key(id_col, text_col)
    text_hash = F.shiftright(F.shiftleft(first, 32), 32).cast("int")
    texts = docs.select(key.alias("id"), text_hash.alias("t"), text_or_empty(text_col).alias("text"))
    cut = written(hashed(texts), "line-pieces")
    one_in = lambda *key: F.pmod(F.xxhash64(*key), F.lit(SAMPLE)) == 0
    seen = again(prints(cut, min_words), often(prints(cut.where(one_in("id", "t")), min_words))).withColumnsRenamed({"id": "ci", "t": "ct"})
    met = cut.join(seen, (F.col("id") == F.col("ci")) & (F.col("t") == F.col("ct"))).drop("ci", "ct")
    rows = written(windows(met, min_words), "line-windows")
    text, s = F.shiftright("p", 32).cast("int"), F.col("p").bitwiseAND(F.lit(LOW)).cast("int")
    by = later(rows, often(rows.where(one_in("id", "p")))).groupBy(F.col("id").alias("__ri"), text.alias("__rt"))
    own = by.agg(F.array_sort(F.collect_set(F.struct(s.alias("s"), "e"))).alias("__own"))
    # sorted by start, windows are sorted by end too: a run ends where the next window leaves a gap
    starts = F.filter("__own", lambda w, k: F.coalesce(w["s"] > F.get("__own", k - 1)["e"] + 1, F.lit(True)))
    ends = F.filter("__own", lambda w, k: F.coalesce(F.get("__own", k + 1)["s"] > w["e"] + 1, F.lit(True)))
    merged = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z: F.struct(z["a"]["s"].alias("s"), z["b"]["e"].alias("e")))
    return own.select("__ri", "__rt", merged.alias("__runs"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeats of runs cut out of the text column, plus ``__cut``.

    ``__cut`` has the number of runs and words cut.  Of equal runs the one with the smallest
    id, then text hash, then position stays, also where a text repeats itself.  Rows that
    share id and text are one document and get the same result.  Null and empty texts are
    returned as they are; null ids come first; an empty table gives an empty result.  All
    other columns pass through.
    """
    key, first, _ = row_key(id_col, text_col)
    keyed = docs.withColumns({"__di": key, "__dt": F.shiftright(F.shiftleft(first, 32), 32).cast("int")})
    joined = keyed.join(
        runs(docs, id_col, text_col, min_words), (F.col("__di") == F.col("__ri")) & (F.col("__dt") == F.col("__rt")), "left"
    )
    # for each piece whether it goes, up to the last run's end
    flags = F.flatten(
        F.transform(
            "__runs",
            lambda r, k: F.concat(
                F.array_repeat(F.lit(False), r["s"] - F.coalesce(F.get("__runs", k - 1)["e"], F.lit(-1)) - 1),
                F.array_repeat(F.lit(True), r["e"] - r["s"] + 1),
            ),
        )
    )
    # zipped, not looked up from the lambda, where the optimizer might build the array anew
    text = text_or_empty(text_col)
    parts = F.arrays_zip(pieces(text, cut_mark(text)).alias("p"), flags.alias("cut"))
    gone = lambda x: F.coalesce(x["cut"], F.lit(False))
    rest = F.array_join(F.transform(F.filter("__parts", lambda x: ~gone(x)), lambda x: x["p"]), "")
    words = F.regexp_count(F.array_join(F.transform(F.filter("__parts", gone), lambda x: x["p"]), ""), F.lit(WORD))
    return (
        joined.withColumn("__parts", F.when(F.col("__runs").isNotNull(), parts))
        .withColumn(text_col, F.when(F.col("__parts").isNotNull(), rest).otherwise(F.col(text_col)))
        .withColumn(
            "__cut",
            F.struct(
                F.coalesce(F.size("__runs"), F.lit(0)).cast("long").alias("runs"),
                F.when(F.col("__parts").isNotNull(), words).otherwise(0).cast("long").alias("words"),
            ),
        )
        .drop("__di", "__dt", "__ri", "__rt", "__runs", "__parts")
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """``docs`` with repeats cut out; documents of which no word is left go."""
    cut = dedup(docs, id_col, text_col, **how)
    left = (F.col("__cut.words") == 0) | F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    # a filter would be pushed below and have the whole projection computed twice
    rows = cut.withColumn("__left", F.explode(F.when(left, F.array(F.lit(1)))))
    return rows.drop("__cut", "__left")
