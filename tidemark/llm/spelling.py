"""Spelling variant grouping: words at one inserted, deleted or replaced letter from each other.

Method: pairless wildcard groups.  For each letter of a word, the word with a wildcard in its
place, (position, prefix, suffix), is the key of a replacement group; the word without the
letter is the key of a deletion group, which the vocabulary joins under its own words.  A group
keeps its size and its two first words by occurrences: the first word's best neighbour is the
second, every other word's is the first.  A word's neighbours are counted as sizes of its groups
less itself, so no pair is ever made.

* Two words of a replacement group differ in exactly its letter, and share no other group.
* A deletion group's words are longer by one letter than the vocabulary word in it, if there is
  one; only that word and the others are near.  Equal letters side by side give the same key
  when they are deleted, so one of them is.

Keys are 127-bit polynomial hashes of the letters (a wildcard is a letter of its own), made from
the hashes of prefix and suffix, so a word of any length costs as much as it is long; with 10^12
keys the chance of one clash is below 10^-12.

Scale: words are counted in tasks before they are shuffled.  A group has at most one word for
each letter and place, whatever the table's size, so no group grows with the data; the words of
all documents are never in one place.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import removed, stored, written
from tidemark.llm.divergence import ROWS, emitted

#: Words have at least so many letters and occurrences.
MIN_LETTERS, MIN_COUNT = 6, 5
#: A form occurs at least so many times as often as its variant.
TIMES = 5
#: A letter of a run is deleted where this divides the run's checksum.
DROP = 199
#: Words that a task holds before it emits what it has counted.
HELD = 250_000
#: Key hashes: a Mersenne prime, the base, and the wildcard, which no letter equals.
PRIME, BASE, WILD = 2**127 - 1, 0x2F1E8B5A9C4D7E3361A7C9D5E2B40F97, 999

#: Latin-1 bytes of letters stay, A to Z in lower case; all others separate runs.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def spelled(run: bytes, head: int) -> bytes:
    """A lower-case run as it counts in the document whose ``<doc_id>:`` has the checksum ``head``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
    if h % DROP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counted(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) for the documents of a task."""
    schema = [("word", pa.string()), ("n", pa.int64())]
    held: dict[bytes, int] = {}
    for batch in texts:
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
            head = zlib.crc32(f"{doc}:".encode())
            # a letter beyond Latin-1 becomes a question mark, which separates as it does
            for run, n in Counter(text.encode("latin-1", "replace").translate(LETTERS).split()).items():
                # a shorter run gives no word
                if len(run) >= MIN_LETTERS and len(word := spelled(run, head)) >= MIN_LETTERS:
                    held[word] = held.get(word, 0) + n
            if len(held) > HELD:
                yield from emitted([(w.decode("latin-1"), n) for w, n in held.items()], schema)
                held = {}
    yield from emitted([(w.decode("latin-1"), n) for w, n in held.items()], schema)


def vocabulary(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n): the words that occur often enough."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    some = docs.select(doc.alias("doc"), text.alias("text")).mapInArrow(counted, "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def keys(letters: list[int]) -> tuple[int, list[int], list[int]]:
    """The hashes of a word, of the word with a wildcard for each letter, and without each letter (equal ones once)."""
    after, power = [0] * (len(letters) + 1), 1
    powers = [1]
    for k in range(len(letters) - 1, -1, -1):
        after[k] = (letters[k] * power + after[k + 1]) % PRIME
        power = power * BASE % PRIME
        powers.append(power)
    before, wild, gone = 0, [], []
    for k, c in enumerate(letters):
        rest = powers[len(letters) - 1 - k]
        wild.append(((before * BASE + WILD) * rest + after[k + 1]) % PRIME)
        if k + 1 == len(letters) or letters[k + 1] != c:
            gone.append((before * rest + after[k + 1]) % PRIME)
        before = (before * BASE + c) % PRIME
    return before, wild, gone


def grouped(words: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, kind, word, n): each word in its groups; kind 0 under its own key, 1 without a letter, 2 with a wildcard."""
    schema = [("key", pa.binary()), ("kind", pa.int32()), ("word", pa.string()), ("n", pa.int64())]
    out: list[tuple] = []
    for batch in words:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            own, wild, gone = keys([ord(c) for c in word])
            for kind, found in ((0, [own]), (1, gone), (2, wild)):
                out += [(h.to_bytes(16), kind, word, n) for h in found]
            if len(out) >= ROWS:
                yield from emitted(out, schema)
                out = []
    yield from emitted(out, schema)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best): each word with the number of near words and the best one (-n, word)."""
    members = words.mapInArrow(grouped, "key binary, kind int, word string, n long")
    # the vocabulary's word, if any, is the first of a deletion group
    group = Window.partitionBy("key")
    order = group.orderBy(F.col("kind") != 0, F.desc("n"), "word")
    me = F.struct((-F.col("n")).alias("less"), "word")
    ranked = members.select(
        "word", "n", "kind", F.count("*").over(group).alias("size"), F.row_number().over(order).alias("place"),
        F.first(F.col("kind")).over(order).alias("head"), F.first(me).over(order).alias("first"), F.lead(me).over(order).alias("next"),
    )
    lost = (F.col("kind") == 1) & (F.col("head") != 0)
    near = F.when(lost, 0).when(F.col("kind") == 1, 1).otherwise(F.col("size") - 1)
    best = F.when(~lost, F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("first")))
    return ranked.groupBy("word", "n").agg(F.sum(near).alias("n_near"), F.min(best).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last.

    Each round doubles the steps.  A form occurs ``TIMES`` times as often as its word, so there is
    no circle, and 10^18 occurrences need no more than five rounds.
    """
    now, path = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        far = now.join(on, "root", "left")
        if far.where("further is not null").isEmpty():
            return now
        last = path
        now, path = stored(far.select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        removed(now.sparkSession, last)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) for the words of all texts.

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]``, A to Z in lower case, less a letter in some
    documents (``DROP``), with ``MIN_LETTERS`` letters and ``MIN_COUNT`` occurrences at least.
    ``form`` is the near word with the most occurrences, of equal ones the first by code points,
    if it has ``TIMES`` as many as the word; ``root`` is where forms end.

    Null and empty texts have no words; a null id counts as an empty one.  Every row counts, also
    a repeated one.  Texts and words may be of any length.  An empty table gives no rows.  Columns
    not named are not read, so their names cannot clash.
    """
    words = written(vocabulary(docs, id_col, text_col), "spelling-words")
    enough = -F.col("best.less") >= TIMES * F.col("n")
    found = written(
        neighbours(words).select(
            "word", "n", "n_near", F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
        ),
        "spelling-near",
    )
    last = roots(found.where("form is not null"))
    return found.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
