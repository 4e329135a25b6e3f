"""Benchmark decontamination by template windows.

Method: words become template tokens: numbers, units behind a number and names (capital
letters inside a sentence) are replaced by typed placeholders.  Windows of ``WINDOW``
tokens of documents and benchmark items are hash-joined; then the slot values behind the
placeholders are checked: the same value in the item must be the same in the document and
the other way round, within a window and over all windows of one occurrence of an item:
those with the same offset, or with near offsets, or all of the document.  A document is
contaminated by an item when consistent windows make up ``COVER`` of the item's windows.
Windows with few literal tokens, which say little as templates, are compared verbatim:
they count with the others against all windows of the item.

Scale: documents give only windows whose hash the benchmark has, as long as the benchmark
has at most ``FILTER_WINDOWS`` windows (measured; 8 bytes each are sent to the tasks);
beyond, all windows take part in the join.  The join is by hash and may be split by AQE;
hits are aggregated per document and item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import KEY, maybe_broadcast, row_key, text_or_empty, written

WINDOW = 8
#: Windows need this many tokens that are no placeholders to be compared as templates, and
#: this many tokens of any kind to be compared verbatim.
LITERALS = 4
#: Share of an item's windows that a document must have.
COVER = 0.5
FILTER_WINDOWS = 2_000_000
#: Units that become placeholders behind a number.
UNITS = frozenset(
    "mm cm m km g kg mg t l ml s ms min h hr hrs kmh mph kph hz khz mhz ghz w kw mw v kv a ma j kj cal kcal "
    "inch inches ft feet foot yard yards mile miles lb lbs pound pounds oz ounce ounces gallon gallons "
    "meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms "
    "liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents percent degree degrees".split()
)
NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*(%|[a-zµ]{1,3})?$", re.I)
EDGES = "\"'`´‘’“”«»()[]{}<>.,;:!?¡¿…*_~|#&%$"
ENDS = ".!?:"
LINE = "\x00"
LITERAL, NUM, UNIT, NAME = range(4)
PRIME = np.uint64(0x9E3779B97F4A7C15)
CACHE = 400_000


class Words:
    """What is known of each distinct word: hash, kind and whether it ends a sentence."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((4096, 4), np.uint64)

    def about(self, word: str) -> tuple[int, int, int, int]:
        """Hash, kind, whether it ends a sentence, flags (1: unit, 2: no word) of a word."""
        plain = word.isalpha()
        core = word if plain else word.strip(EDGES)
        low = core.lower()
        kind = NAME if core[:1].isupper() else LITERAL
        ends = 0
        if not plain:
            kind = NUM if NUMBER.match(core) else kind
            ends = int(word == LINE or word.rstrip("\"'”’»)")[-1:] in ENDS or not core)
        return xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")), kind, ends, (low in UNITS) + 2 * (not core)

    def look_up(self, words: list[str]) -> np.ndarray:
        """A row of ``about`` for each word."""
        if len(self.ids) > CACHE:
            self.ids.clear()
        new = list(set(words).difference(self.ids))
        if new:
            n = len(self.ids)
            self.ids.update(zip(new, range(n, n + len(new)), strict=True))
            while n + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n : n + len(new)] = np.array([self.about(w) for w in new], np.uint64)
        return self.table[np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))]


def template(text: str, known: Words) -> tuple[np.ndarray, np.ndarray]:
    """(kinds, value hashes) of the template tokens of a text."""
    words = text.replace("\n", f" {LINE} ").split()
    found = known.look_up(words)
    kind, flags = found[:, 1].astype(np.int8), found[:, 3]
    ends = found[:, 2].astype(bool)
    starts = np.concatenate(([True], ends[:-1]))[: len(words)]
    kind[(kind == NAME) & starts] = LITERAL
    token = (flags & np.uint64(2)) == 0
    kind, value, unit = kind[token], found[token, 0], (flags[token] & np.uint64(1)) == 1
    kind[1:][unit[1:] & (kind[:-1] == NUM)] = UNIT
    return kind, value


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes."""
    h = a * PRIME + b
    h ^= h >> np.uint64(32)
    h *= PRIME
    return h ^ (h >> np.uint64(29))


def mixed(token: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` tokens from each position on, from those of 1, 2, 4 .. tokens."""
    n = len(token) - size + 1
    h, part, done, width = np.full(n, size, np.uint64), token, 0, 1
    while True:
        if size & width:
            h = joined(h, part[done : done + n])
            done += width
        if done == size:
            return h
        part, width = joined(part[:-width], part[width:]), 2 * width


def windows(kind: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start positions, hashes, compared verbatim) of all windows."""
    n = len(kind) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    token = np.where(kind == LITERAL, value, kind.astype(np.uint64) + np.uint64(11))
    literal = np.concatenate(([0], np.cumsum(kind == LITERAL)))
    rich = literal[size:] - literal[:-size] >= LITERALS
    at, few = np.flatnonzero(rich), np.flatnonzero(~rich) if size >= LITERALS else np.zeros(0, np.int64)
    h = np.full(len(few), size + 1000, np.uint64)
    for k in range(size):
        h = joined(h, value[few + k])
    h = np.concatenate((mixed(token, size)[at], h))
    return np.concatenate((at, few)), h, np.arange(len(h)) >= len(at)


def slots(kind: np.ndarray, value: np.ndarray, at: int, size: int) -> list[int]:
    """Value hashes behind the placeholders of a window, in order."""
    part = slice(at, at + size)
    return value[part][kind[part] != LITERAL].astype(np.int64).tolist()


def upper(text: str) -> bool:
    """Whether the first word of a text has a capital letter in front."""
    return next((c for w in text.split() if (c := w.strip(EDGES))), "")[:1].isupper()


def item_windows(bench: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(w, item, pos, size, total, whole, verbatim, islots): the windows of all items.

    ``total`` counts an item's template windows, ``whole`` all of them.  Items below
    ``WINDOW`` tokens are one window; those below ``LITERALS`` tokens have none.  An item
    may stand inside a sentence of a document, so the window at its start is also given with
    a capitalised first word read as a name.  Null items and texts are ignored, repeated rows
    count once.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words()
        for batch in batches:
            rows = []
            for item, text in zip(batch["item"], batch["text"], strict=True):
                kind, value = template(text, known)
                size = min(WINDOW, len(kind))
                at, h, plain = windows(kind, value, size) if size else ([], [], [])
                found = list(zip(at, np.asarray(h, np.uint64).view(np.int64), plain, [kind] * len(at), strict=True))
                if size and kind[0] == LITERAL and upper(text):
                    inside = np.concatenate(([np.int8(NAME)], kind[1:]))
                    p, x, v = windows(inside[:size], value[:size], size)
                    found += zip(p, x.view(np.int64), v, [inside] * len(p), strict=True)
                total, whole = len(at) - int(np.sum(plain)), len(at)
                rows += [(x, item, int(p), size, total, whole, bool(v), [] if v else slots(k, value, p, size)) for p, x, v, k in found]
            yield pd.DataFrame(rows, columns=["w", "item", "pos", "size", "total", "whole", "verbatim", "islots"])

    named = bench.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    return named.dropna().distinct().mapInPandas(
        cut, "w long, item long, pos int, size int, total int, whole int, verbatim boolean, islots array<long>"
    )


def document_windows(docs: DataFrame, sizes: list[int], only: np.ndarray | None, id_col: str, text_col: str) -> DataFrame:
    """(id, h1, h2, w, dpos, dslots): windows of documents, of hashes in ``only`` if given."""
    bits = None
    if only is not None:
        bits = np.zeros(1 << 22, bool)
        bits[(only & np.uint64(len(bits) - 1)).astype(np.int64)] = True

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words()
        for batch in batches:
            rows = []
            for i, h1, h2, text in batch.itertuples(index=False, name=None):
                kind, value = template(text, known)
                for size in sizes:
                    at, h, plain = windows(kind, value, size)
                    if bits is not None:
                        maybe = bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)]
                        at, h, plain = at[maybe], h[maybe], plain[maybe]
                        there = only[np.minimum(np.searchsorted(only, h), len(only) - 1)] == h
                        at, h, plain = at[there], h[there], plain[there]
                    rows += [(i, h1, h2, x, p, [] if v else slots(kind, value, p, size)) for p, x, v in zip(at.tolist(), h.view(np.int64).tolist(), plain.tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["__id", "__h1", "__h2", "w", "dpos", "dslots"])

    named = docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("__t"))
    return named.mapInPandas(cut, "__id long, __h1 long, __h2 long, w long, dpos int, dslots array<long>")


def shape(name: str):  # noqa: ANN201
    """Each slot value of an array replaced by the place where it stood first."""
    return F.transform(name, lambda v: F.array_position(name, v))


def hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h1, h2, item, cover): consistent items of each document, above ``COVER``."""
    items = written(item_windows(bench), "bench-windows")
    n = items.count()
    key = ["__id", "__h1", "__h2"]
    if not n:
        return docs.select(*row_key(id_col, text_col), F.lit(0).cast("long").alias("item"), F.lit(0.0).alias("cover")).where("false")
    sizes = [r[0] for r in items.select("size").distinct().collect()]  # at most WINDOW of them
    only = None
    if n <= FILTER_WINDOWS:
        only = np.unique(items.select("w").toPandas()["w"].to_numpy(np.int64).view(np.uint64))
    found = document_windows(docs, sizes, only, id_col, text_col).distinct()
    met = (
        found.join(maybe_broadcast(items, n), "w")
        .where((F.size("dslots") == F.size("islots")))
        .where((F.size("dslots") == 0) | (shape("dslots") == shape("islots")))
    )
    met = written(met, "bench-hits")
    # an item is there if the windows of any one occurrence agree
    met = met.select(*key, "item", "total", "whole", "verbatim", "pos", "islots", "dslots", (F.col("dpos") - F.col("pos")).alias("offset"))
    before = F.lag("offset").over(Window.partitionBy(*key, "item").orderBy("offset"))
    by = Window.partitionBy(*key, "item").orderBy("offset").rangeBetween(Window.unboundedPreceding, 0)
    near = met.withColumn("far", (F.col("offset") - before > WINDOW).cast("int")).withColumn("near", F.coalesce(F.sum("far").over(by), F.lit(0)))
    places = F.array(*[
        F.struct(F.lit(how).alias("how"), n.cast("long").alias("n"))
        for how, n in (("all", F.lit(0)), ("near", F.col("near")), ("at", F.col("offset")))
    ])
    met = written(near.withColumn("place", F.explode(places)).drop("far", "near", "offset"), "bench-places")
    key = [*key, "place"]
    pairs = met.where(F.size("dslots") > 0).select(*key, "item", F.explode(F.arrays_zip("islots", "dslots")).alias("z"))
    # one value on the one side goes with one on the other, over all windows of the item
    odd = [
        pairs.groupBy(*key, "item", f"z.{a}").agg(F.min(f"z.{b}").alias("lo"), F.max(f"z.{b}").alias("hi")).where("lo <> hi").select(*key, "item")
        for a, b in (("islots", "dslots"), ("dslots", "islots"))
    ]
    consistent = met.join(odd[0].union(odd[1]).distinct(), [*key, "item"], "left_anti")
    return (
        consistent.select(*key, "item", "total", "whole", "verbatim", "pos")
        .distinct()
        .groupBy(*key, "item")
        .agg(
            F.greatest(
                F.try_divide(F.countDistinct(F.when(~F.col("verbatim"), F.col("pos"))), F.max("total")),
                F.try_divide(F.countDistinct("pos"), F.max("whole")),
            ).alias("cover")
        )
        .where(F.col("cover") >= COVER)
        .groupBy(*KEY, "item")
        .agg(F.max("cover").alias("cover"))
    )


def found_items(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, contaminated, items, cover): every row of ``docs`` with the items found in it.

    ``items`` has ids in order, ``cover`` the largest share of an item's windows.  Empty
    and null texts are clean; rows that share id and text get the same result.
    """
    by = (
        hits(docs, bench, id_col, text_col)
        .groupBy("__id", "__h1", "__h2")
        .agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("cover").alias("cover"))
    )
    keyed = docs.select(F.col(id_col), *row_key(id_col, text_col))
    return keyed.join(by, ["__id", "__h1", "__h2"], "left").select(
        id_col,
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("cover", F.lit(0.0)).alias("cover"),
    )


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item was found, columns unchanged."""
    names = {"__id": "__ki", "__h1": "__k1", "__h2": "__k2"}
    bad = written(hits(docs, bench, id_col, text_col).select(*names).distinct().withColumnsRenamed(names), "bench-docs")
    keys = dict(zip(names, row_key(id_col, text_col), strict=True))
    return docs.join(maybe_broadcast(bad, bad.count()), [keys[k] == F.col(v) for k, v in names.items()], "left_anti")
