"""Source divergence audit: how the words of each source differ from those of its language.

Method: sort-based streaming.  A task counts the terms of its documents before anything is
shuffled; what it emits is sorted already within a term: a row has the task's runs of a
(lang, term), one a source with its documents and occurrences, in the order of sources.  Rows are
dealt out by (lang, term) and sorted by (lang, term, document), a hash of the first two in front
so that most comparisons are of two numbers.  A run-length scan adds up document frequency and
occurrences of each (lang, term, source) and keeps the terms that are in ``MIN_DOCS`` documents of
their language.  The kept runs are dealt out once more, behind a header of each language with the
totals of its sources, and sorted; a second scan holds some terms at a time and emits partial sums
for pairs of sources, and its best terms of each source.

All arithmetic is exact: 64-bit integers, and Python's where totals pass ``WIDE``.

A term that a source lacks has one share p0 there, so a pair's value is f(p0, p0) for each kept
term, plus corrections for terms that one of the two has: the work follows the occurring
(term, source) pairs times the sources of a language, which is what the result has for each
source.

Scale: a task's flush has one row a term, so even a term of every document is a small share of
what is shuffled.  A scan holds the sources of one language, one term's sums, and at most
``CELLS`` cells of a block and of open sums; sums beyond that are emitted early and added up by
Spark.  Nothing goes through the driver but the number of kept terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: A term is kept in a language with so many documents that have it.
MIN_DOCS = 10
#: Terms listed for a source.
TOP = 10
#: Shares are in billionths, with two added to each count.
SCALE, ADDED = 10**9, 2
#: Pairs of term and source that a task holds before it emits what it has counted.
HELD = 600_000
#: Kept terms of one stream of the second scan, and its cells.
STREAM_TERMS, CELLS = 5_000, 2_000_000
#: Counts from which a count times ``SCALE`` no longer fits 64 bits.
WIDE = 9 * 10**9
#: Rows of an emitted Arrow batch.
ROWS = 10_000

#: Bytes of terms stay, A to Z in lower case; all others separate terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

RUN = "lang string, term binary, doc long, sources array<string>, docs array<long>, n array<long>"
KEPT = "lang string, term binary, sources array<string>, n array<long>"
FOUND = "lang string, source string, part string, item binary, value long"


def emitted(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most ``ROWS``."""
    for at in range(0, len(rows), ROWS):
        columns = zip(*rows[at : at + ROWS], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for (_, kind), v in zip(schema, columns, strict=True)], [name for name, _ in schema])


def lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Consecutive ``values`` as lists of the given sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def in_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def runs_of(lang: str, doc: int | None, held: dict[str, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    """What a task has counted of a language: a row a term with its sources in order."""
    index: dict[bytes, int] = {}
    names, places, codes, docs, n = sorted(held), [], [], [], []
    for code, source in enumerate(names):
        count, seen = held[source]
        places.append(np.array([index.setdefault(t, len(index)) for t in count], np.int64))
        codes.append(np.full(len(count), code))
        docs.append(np.fromiter(map(seen.__getitem__, count), np.int64, len(count)))
        n.append(np.fromiter(count.values(), np.int64, len(count)))
    place = np.concatenate(places)
    order, sizes = np.argsort(place, kind="stable"), np.bincount(place, minlength=len(index))
    columns = {
        "lang": pa.array([lang] * len(index), pa.string()), "term": pa.array(list(index), pa.binary()), "doc": pa.array([doc] * len(index), pa.int64()),
        "sources": lists(sizes, pa.array(names, pa.string()).take(pa.array(np.concatenate(codes)[order]))),
        "docs": lists(sizes, pa.array(np.concatenate(docs)[order])), "n": lists(sizes, pa.array(np.concatenate(n)[order])),
    }
    yield from in_slices(pa.RecordBatch.from_pydict(columns))


def partial_runs(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, doc, sources, docs, n) for the documents of a task: its own runs, with their first document."""
    held: dict[str, tuple[int | None, dict[str, tuple[Counter, Counter]]]] = {}
    size = 0
    for batch in texts:
        for doc, text, lang, source in zip(*[batch.column(c).to_pylist() for c in ("doc", "text", "lang", "source")], strict=True):
            words = text.translate(LETTERS).split()
            _, sources = held.setdefault(lang, (doc, {}))
            n, docs = sources.setdefault(source, (Counter(), Counter()))
            before = len(n)
            n.update(words)
            docs.update(set(words))
            size += len(n) - before
            if size > HELD:
                for k, (first, own) in held.items():
                    yield from runs_of(k, first, own)
                held, size = {}, 0
    for k, (first, own) in held.items():
        yield from runs_of(k, first, own)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, sorted, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], *[np.add.reduceat(v[order], starts) for v in values]


def kept_runs(rows: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """(lang, term, sources, n) of the terms with enough documents; equal (lang, term) stand together.

    The term that a batch ends with is open: its sums wait for the next batch.
    """
    key, own = None, {}  # the open term; documents and occurrences of its sources

    def closed() -> Iterator[pa.RecordBatch]:
        if key and sum(d for d, _ in own.values()) >= min_docs:
            names = sorted(own)
            schema = [("lang", pa.string()), ("term", pa.binary()), ("sources", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))]
            yield from emitted([(*key, names, [own[s][1] for s in names])], schema)

    for batch in rows:
        if not batch.num_rows:
            continue
        lang, term = batch.column("lang"), batch.column("term")
        new = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1]))
        run = np.concatenate([[0], np.cumsum(np.asarray(new))]).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        sources = batch.column("sources").flatten().dictionary_encode()
        order = np.argsort(np.array(sources.dictionary.to_pylist(), object))  # codes in the order of sources
        names, width = sources.dictionary.take(pa.array(order)), len(order)
        code = np.empty(width, np.int64)
        code[order] = np.arange(width)
        cell = np.repeat(run, np.asarray(pc.list_value_length(batch.column("sources"))))
        docs, n = (np.asarray(batch.column(c).flatten()) for c in ("docs", "n"))
        cells, docs, n = summed(cell * width + code[np.asarray(sources.indices)], docs, n)
        of, code = cells // width, cells % width
        ends = np.searchsorted(of, np.arange(len(first) + 1))

        def taken(k: int) -> Iterator[tuple[str, int, int]]:
            part = slice(ends[k], ends[k + 1])
            return zip(names.take(pa.array(code[part])).to_pylist(), docs[part].tolist(), n[part].tolist(), strict=True)

        for k in sorted({0, len(first) - 1}):
            now = (lang[int(first[k])].as_py(), term[int(first[k])].as_py())
            if now != key:
                yield from closed()
                key, own = now, {}
            for source, d, c in taken(k):
                old = own.get(source, (0, 0))
                own[source] = (old[0] + d, old[1] + c)
        inner = np.arange(1, len(first) - 1)
        if len(inner):
            seen = np.add.reduceat(docs, ends[:-1])[inner]
            inner = inner[seen >= min_docs]
            sizes = (ends[1:] - ends[:-1])[inner]
            at = np.repeat(ends[inner] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(inner) else inner
            place = pa.array(first[inner])
            columns = {"lang": lang.take(place), "term": term.take(place), "sources": lists(sizes, names.take(pa.array(code[at]))), "n": lists(sizes, pa.array(n[at]))}
            yield pa.RecordBatch.from_pydict(columns)
    yield from closed()


def share(counts: list[int] | np.ndarray, total: int | list[int], vocabulary: int) -> np.ndarray:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * vocabulary)), as 64-bit integers."""
    wide = max([*np.ravel(total).tolist(), 0]) > WIDE
    c, n = np.asarray(counts, object if wide else np.int64), np.asarray(total, object if wide else np.int64)
    return (1 + SCALE * (c + ADDED) // (n + ADDED * vocabulary)).astype(np.int64)


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square fits."""
    d = p - q
    return d * d // (p + q)


class Language:
    """The sums of one language in one stream: sources with their totals, a block of terms, open pair sums."""

    def __init__(self, lang: str, salt: int, salts: int, top: int) -> None:
        self.lang, self.salt, self.salts, self.top = lang, salt, salts, top
        self.sources: list[str] = []
        self.totals: list[int] = []
        self.v = 0
        self.terms: list[bytes] = []
        self.owners: list[list[str]] = []
        self.counts: list[list[int]] = []
        self.size = 0
        self.sums: dict[int, np.ndarray] = {}  # to (a, b): where b lacks the term, and to (b, a): all
        self.ready = False

    def header(self, source: str, total: int, v: int) -> None:
        self.sources.append(source)
        self.totals.append(total)
        self.v = v

    def begin(self) -> list[tuple]:
        """Shares of absent terms, and this stream's part of the pairs' sums over all kept terms as absent ones."""
        self.ready = True
        s = len(self.sources)
        self.place = {x: k for k, x in enumerate(self.sources)}
        self.names = [x.encode() for x in self.sources]
        self.p0 = share([0] * s, self.totals, self.v) if self.v else np.ones(s, np.int64)
        self.q_total = sum(self.totals)
        self.block = max(1, CELLS // (4 * s))
        rows: list[tuple] = []
        for a in range(self.salt, s, self.salts):
            f0 = (self.v * difference(self.p0, self.p0[a])).tolist()
            rows += [(self.lang, self.sources[a], "pair", self.names[b], f0[b]) for b in range(s) if b != a]
        return rows

    def term(self, term: bytes, sources: list[str], n: list[int]) -> list[tuple]:
        rows = self.counted() if len(self.terms) >= self.block else []
        self.terms.append(term)
        self.owners.append(sources)
        self.counts.append(n)
        return rows

    def best(self, s: np.ndarray, t: np.ndarray, value: np.ndarray) -> list[tuple]:
        """Of the block's terms the ``top`` of each source; no other can be among the source's first."""
        rows: list[tuple] = []
        order = np.argsort(s, kind="stable")
        cuts = np.flatnonzero(np.diff(s[order], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = order[a:b]
            if len(own) > self.top:
                least = np.partition(value[own], len(own) - self.top)[len(own) - self.top]
                own = own[value[own] >= least]
            ranked = sorted(zip((-value[own]).tolist(), [self.terms[k] for k in t[own].tolist()], strict=True))
            rows += [(self.lang, self.sources[int(s[own[0]])], "term", term, -v) for v, term in ranked[: self.top]]
        return rows

    def counted(self) -> list[tuple]:
        """Takes the block into the open sums; the best of the terms that sources use more than the language."""
        if not self.terms:
            return []
        t = np.repeat(np.arange(len(self.terms)), [len(x) for x in self.owners])
        s = np.array([self.place[x] for own in self.owners for x in own], np.int64)
        n = np.array([x for own in self.counts for x in own], np.int64)
        all_n = np.zeros(len(self.terms), np.int64)
        np.add.at(all_n, t, n)
        own = share(n, np.asarray(self.totals, np.int64)[s].tolist(), self.v)
        q = share(all_n, self.q_total, self.v)[t]
        more = own > q
        rows = self.best(s[more], t[more], difference(own, q)[more]) if more.any() else []
        p = np.tile(self.p0, (len(self.terms), 1))
        there = np.zeros(p.shape, bool)
        p[t, s], there[t, s] = own, True
        width = len(self.sources)
        for a in np.unique(s).tolist():
            at = np.flatnonzero(there[:, a])
            more_f = difference(p[at], p[at, a][:, None]) - difference(self.p0, self.p0[a])
            if a not in self.sums:
                self.sums[a] = np.zeros((2, width), np.int64)
            self.sums[a][0] += np.where(there[at], 0, more_f).sum(0)
            self.sums[a][1] += more_f.sum(0)
            if len(self.sums) * 2 * width > CELLS:
                rows += self.closed()
        self.terms, self.owners, self.counts = [], [], []
        return rows

    def closed(self) -> list[tuple]:
        """Partial sums of pairs, in both directions."""
        rows: list[tuple] = []
        for a, (lacking, every) in self.sums.items():
            for b, (x, y) in enumerate(zip(lacking.tolist(), every.tolist(), strict=True)):
                if a != b and x:
                    rows.append((self.lang, self.sources[a], "pair", self.names[b], x))
                if a != b and y:
                    rows.append((self.lang, self.sources[b], "pair", self.names[a], y))
        self.sums = {}
        return rows

    def ended(self) -> list[tuple]:
        return ([] if self.ready else self.begin()) + self.counted() + self.closed()


def compared(rows: Iterator[pa.RecordBatch], salts: int, top: int) -> Iterator[pa.RecordBatch]:
    """Partial pairs and terms; sorted by (lang, salt, term, source), with null terms, the headers, first."""
    schema = [("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())]
    now: Language | None = None
    out: list[tuple] = []
    for batch in rows:
        names = ("lang", "salt", "term", "sources", "n", "v")
        for lang, salt, term, sources, n, v in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            if now is None or (now.lang, now.salt) != (lang, salt):
                if now:
                    out += now.ended()
                now = Language(lang, salt, salts, top)
            if term is None:
                now.header(sources[0], n[0], v)
                continue
            if not now.ready:
                out += now.begin()
            out += now.term(term, sources, n)
            if len(out) >= ROWS:
                yield from emitted(out, schema)
                out = []
    if now:
        out += now.ended()
    yield from emitted(out, schema)


def audit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    min_docs: int = MIN_DOCS, top: int = TOP,
) -> DataFrame:
    """(lang, source, part, item, value, rank): what sets the sources of each language apart.

    Part ``pair``: every other source of the language with the sum of differences over all
    kept terms.  Part ``term``: the ``top`` kept terms that the source uses more than its
    language.  Ranks go from 1 by value descending, then item ascending by bytes.

    Null texts, languages and sources are read as empty ones; every row is a document, so
    repeated rows count again.  A group without terms, or a language without kept terms, has its
    pairs (value 0 in the latter); a language of one source has no pairs; an empty table gives no
    rows.  Texts are read whole, whatever their length.  Columns not named are not read, so their
    names cannot clash.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lang, source = empty(lang_col).alias("lang"), empty(source_col).alias("source")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), empty(text_col).cast("binary").alias("text"), lang, source)
    runs = texts.mapInArrow(partial_runs, RUN).withColumn("hash", F.xxhash64("lang", "term"))
    sorted_runs = runs.repartition("lang", "term").sortWithinPartitions("hash", "lang", "term", "doc").drop("hash")
    kept = written(sorted_runs.mapInArrow(lambda rows: kept_runs(rows, min_docs), KEPT), "divergence-kept")

    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    streams = max(1, -(-(sizes.agg(F.sum("v")).first()[0] or 0) // STREAM_TERMS))
    cells = kept.select("lang", F.explode(F.arrays_zip("sources", "n")).alias("x"))
    totals = cells.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.n").alias("n"))
    groups = docs.select(lang, source).distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    every = F.explode(F.sequence(F.lit(0), F.lit(streams - 1))).alias("salt")
    zero = lambda c: F.coalesce(c, F.lit(0))
    headers = groups.select("lang", every, F.lit(None).cast("binary").alias("term"), F.array("source").alias("sources"), F.array(zero("n")).alias("n"), zero("v").alias("v"))
    terms = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(streams)).cast("int").alias("salt"), "term", "sources", "n", F.lit(0).cast("long").alias("v"))
    stream = headers.unionByName(terms).repartition("lang", "salt").sortWithinPartitions("lang", "salt", "term", "sources")
    found = written(stream.mapInArrow(lambda rows: compared(rows, streams, top), FOUND), "divergence-found")

    group = ("lang", "source", "part")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item")).alias("rank")
    pairs = found.where("part = 'pair'").groupBy(*group, "item").agg(F.sum("value").alias("value")).select("*", rank)
    best = found.where("part = 'term'").select("*", rank).where(F.col("rank") <= top)
    return pairs.unionByName(best).withColumn("item", F.col("item").cast("string"))
