"""SimHash near-duplicates, linked through a vantage-point tree of fingerprints.

Method: each text gets a 64-bit SimHash of its word shingles.  Distinct fingerprints are
partitioned by a shallow vantage-point tree whose leaves are shards: a fingerprint lives
in one shard, and also visits every later shard that its search ball may overlap by the
triangle inequality.  Inside a shard a second vantage-point tree prunes branches the same
way, and leaves compare exactly, so no pair within the radius is lost whatever the tree
looks like.  A shard returns only a spanning star of what it linked.

``one_of_each`` runs the same two trees over longer fingerprints with their sizes, in a
metric of both (``metric``), and checks the pairs by the shingles afterwards.

Scale: the tree's shape comes from a bounded sample (``SAMPLE`` fingerprints); shards are
added once a shard would own more than ``SHARD_ROWS`` fingerprints.  Owners and visitors of
a shard are counted first, and dealt to blocks and chunks of at most about ``GROUP_ROWS``
each: a group of tasks' rows has one block and one chunk, whatever the skew.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import KEY, components, row_key, text_or_empty, words_of, written

#: Fingerprints that shape the sharding tree (a bound, not a filter: all are sharded).
SAMPLE = 4096
#: Depth of the sharding tree where the input is not tiny, and rows per shard beyond it.
DEPTH = 6
SHARD_ROWS = 1_000_000
LEAF = 192
BLOCK = 4096
#: Rows of a shard's owners, and of its visitors, that meet in one group at most, about.
GROUP_ROWS = 1_000_000


def simhash(text: str, shingle: int = 4) -> int:
    """The fingerprint of one text: a bit is 1 if set in over half the shingle hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(b" ".join(words), 42)
    parts = zip(*(words[k:] for k in range(shingle)), strict=False)
    h = np.array([hashed(b" ".join(p), 42) for p in parts], dtype="<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text as a signed long.

    A null or empty text has fingerprint zero; null ids and repeated rows pass through.
    """

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias(id_col), fp(text_or_empty(text_col)).alias("fp"))


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def grow(points: np.ndarray, depth: int, seed: int = 0, apart: Callable = distances, also: tuple = ()) -> tuple | None:
    """A tree of (vantage, radius, inside, outside) over ``points``; None is a leaf.

    Of some points, and those of ``also``, the one whose distances vary most is the vantage.
    """
    if depth == 0 or len(points) < 2:
        return None
    draw = np.random.default_rng(seed + depth)
    tries = [*also, *draw.choice(points, min(8, len(points)), replace=False)]
    best = max(tries, key=lambda v: float(np.std(apart(points, v))))
    d = apart(points, best)
    radius = float(np.median(d))
    inside = d <= radius
    if inside.all():
        return None
    return (
        best,
        radius,
        grow(points[inside], depth - 1, 2 * seed + 1, apart, also),
        grow(points[~inside], depth - 1, 2 * seed + 2, apart, also),
    )


def routes(tree: tuple | None, points: np.ndarray, reach: float, apart: Callable = distances) -> Iterator[tuple[np.ndarray, int]]:
    """(indices of points, shard) for each shard that balls of radius ``reach`` touch."""
    stack, shard = [(tree, np.arange(len(points)))], 0
    while stack:
        node, own = stack.pop()
        if node is None:
            yield own, shard
            shard += 1
            continue
        vantage, radius, inside, outside = node
        d = apart(points[own], vantage).astype(float)
        stack.append((outside, own[d > radius - reach]))
        stack.append((inside, own[d <= radius + reach]))


class Links:
    """Components of the linked points of one shard, kept as smallest-index labels."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def link_shard(points: np.ndarray, home: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (point, smallest linked point) between the home points and those that ask."""
    order = np.argsort(points, kind="stable")
    points, home, asks = points[order], home[order], asks[order]
    links = Links(len(points))
    stack = [(np.flatnonzero(home), np.flatnonzero(asks), 0)]
    while stack:
        own, ask, level = stack.pop()
        if not len(own) or not len(ask):
            continue
        if len(own) > LEAF and level < 48:
            vantage = points[own[(level * 7919 + len(own) // 2) % len(own)]]
            d = distances(points[own], vantage)
            cut = int(np.median(d))
            inside = d <= cut
            if not inside.all():
                q = distances(points[ask], vantage).astype(np.int64)
                stack.append((own[inside], ask[q <= cut + radius], level + 1))
                stack.append((own[~inside], ask[q > cut - radius], level + 1))
                continue
        for j in range(0, len(own), LEAF):
            part = points[own[j : j + LEAF]]
            for k in range(0, len(ask), BLOCK):
                near = np.bitwise_count(points[ask[k : k + BLOCK], None] ^ part) <= radius
                x, y = np.nonzero(near)
                links.add(ask[x + k], own[y + j])
    child = np.flatnonzero(links.label != np.arange(len(points)))
    return points[child], points[links.label[child]]


def grouped(dealt: DataFrame, key: str, rows: int) -> DataFrame:
    """``dealt`` (shard, home, ..) with ``block``, ``chunk`` and ``asks``: groups of bounded size.

    The home rows of a shard are dealt to blocks by a hash of ``key``, all its rows to
    chunks; each block meets each chunk once.  ``asks`` is false for the home rows of
    another chunk.
    """
    sizes = dealt.groupBy("shard").agg(F.count_if("home").alias("own"), F.count("*").alias("all")).collect()  # a row a shard
    many = {r["shard"]: (-(-r["own"] // rows) or 1, -(-r["all"] // rows)) for r in sizes if r["all"] > rows}
    if not many:
        return dealt.withColumns({"block": F.lit(0), "chunk": F.lit(0), "asks": F.lit(True)})
    of = lambda j: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for s, n in many.items() for x in (s, n[j])]), F.col("shard")), F.lit(1))
    cell = F.xxhash64(F.lit(11), key)
    block, chunk = F.pmod(cell, of(0)).cast("int"), F.pmod(cell, of(1)).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    as_home = dealt.where("home").withColumns({"block": block, "own": chunk}).withColumn("chunk", F.explode(every(of(1))))
    as_home = as_home.withColumn("asks", F.col("chunk") == F.col("own")).drop("own")
    # a home row also asks the other blocks of its shard
    visits = dealt.withColumns({"chunk": chunk, "own": F.when(F.col("home"), block)}).withColumn("block", F.explode(every(of(0))))
    visits = visits.where("own is null or own <> block").withColumns({"home": F.lit(False), "asks": F.lit(True)}).drop("own")
    return as_home.unionByName(visits)


def link(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Components (node, root) of the distinct fingerprints ``prints`` (fp) within ``radius``.

    ``root`` is the smallest fingerprint, as a signed long, of the component; prints
    without a neighbour are absent.
    """
    n = prints.count()
    sample = prints.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    deep = 0 if n <= SAMPLE // 2 else max(DEPTH, math.ceil(math.log2(n / SHARD_ROWS)))
    tree = grow(sample, deep)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = batch["fp"].to_numpy(np.int64).view(np.uint64)
            at = np.zeros(len(points), np.int64)
            for own, shard in routes(tree, points, 0):
                at[own] = shard
            for own, shard in routes(tree, points, radius):
                # a pair in two shards meets once: only the earlier one's point visits
                own = own[at[own] <= shard]
                yield pd.DataFrame(
                    {"shard": np.int32(shard), "fp": points[own].view(np.int64), "home": at[own] == shard}
                )

    def join(group: pd.DataFrame) -> pd.DataFrame:
        points = group["fp"].to_numpy(np.int64).view(np.uint64)
        a, b = link_shard(points, group["home"].to_numpy(bool), group["asks"].to_numpy(bool), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = prints.select("fp").mapInPandas(deal, "shard int, fp long, home boolean")
    edges = grouped(dealt, "fp", GROUP_ROWS).groupBy("shard", "block", "chunk").applyInPandas(join, "a long, b long")
    return components(edges, "simhash")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """(id, fingerprint, component_id): one row per row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` is the smallest id
    reachable over links of at most ``radius`` differing bits, the row's own included.
    Null or empty texts have fingerprint zero and link like any other.  A null id is
    never a component id unless all ids of the component are null.  Repeated rows give
    repeated results; an empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "prints")
    least = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "least")
    roots = written(link(least.select("fp"), radius), "roots")
    named = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


#: Bits of the long fingerprints that estimate similarity, in words of 64; the first
#: ``SIFT_WORDS`` words sift pairs before the whole is compared.
WORDS, SIFT_WORDS = 8, 2
#: Odd multipliers that derive one 64-bit hash per word from a shingle's hash.
MIX = (np.uint64(0x9E3779B97F4A7C15) * (2 * np.arange(1, 17, dtype=np.uint64) + np.uint64(1))).astype(np.uint64)


def long_simhash(text: str, shingle: int = 5) -> tuple[bytes, int]:
    """A SimHash of ``64 * WORDS`` bits of the distinct word shingles, and their number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8 * WORDS), 0
    if len(words) <= shingle:
        parts: list | set = [words]
    else:
        parts = set(zip(*(words[k:] for k in range(shingle)), strict=False))
    h = np.array([xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts], dtype=np.uint64)
    ones = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        for k in range(WORDS):
            x = (part ^ (part >> np.uint64(31))) * MIX[k]
            x ^= x >> np.uint64(29)
            ones[k] += np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes(), len(h)


def bits_at(similarity: float, bits: int, slack: float = 0.0) -> int:
    """Differing bits expected at a Jaccard similarity, plus ``slack`` standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def metric(similarity: float) -> Callable:
    """Distances of points (rows of ``WORDS`` words of a long fingerprint and a size) to a vantage point.

    The larger of two distances: differing bits, in units of three standard deviations
    beyond ``similarity``, and the ratio of the sizes, in units of the largest one that the
    similarity allows.  Both are metrics, and so is the larger one: a ball of radius 1 has
    all texts that may be similar, and the triangle inequality prunes by both.
    """
    near = max(bits_at(similarity, 64 * WORDS, 3.0), 0.5)
    widest = max(-math.log(similarity), 1e-9)

    def place(sizes: np.ndarray) -> np.ndarray:
        # the empty text is far from all others
        return np.where(sizes > 0, np.log(np.maximum(sizes, 1)), -40.0) / widest

    def apart(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
        far = np.bitwise_count(points[:, :WORDS] ^ vantage[:WORDS]).sum(1, dtype=np.int64) / near
        return np.maximum(far, np.abs(place(points[:, WORDS]) - place(vantage[WORDS])))

    return apart


#: The empty text as a point: its distances order all others by size.
EMPTY = np.zeros(WORDS + 1, np.uint64)
#: The radius of a search ball of ``metric``, with room for rounding.
REACH = 1 + 1e-9
#: A branch is split while it owns more points than these and its split spares a tenth of the pairs.
BRANCH = 8 * LEAF
SPARED = 0.9


def branches(points: np.ndarray, own: np.ndarray, ask: np.ndarray, apart: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The leaves (own, ask) of a vantage-point tree over the points ``own``, asked by the points ``ask``.

    A point that asks goes down each branch that its ball may overlap.  Of some vantage
    points and radii those are taken that spare most pairs; where none spares enough, the
    branch is a leaf.
    """
    stack = [(own, ask, 0)]
    while stack:
        own, ask, level = stack.pop()
        if not len(own) or not len(ask):
            continue
        best, cost = None, SPARED * len(own) * len(ask)
        if len(own) > BRANCH and level < 48:
            # points of the branch in turn, and the empty text; looked at by an even part of the rows
            some, other = own[:: -(-len(own) // 1024)], ask[:: -(-len(ask) // 1024)]
            for vantage in [EMPTY, *points[own[np.linspace(0, len(own) - 1, 4).astype(int) - level % 2]]]:
                d, q = apart(points[some], vantage), apart(points[other], vantage)
                for radius in np.unique(np.quantile(d, (0.25, 0.5, 0.75), method="lower")):
                    inside = (d <= radius).mean()
                    pairs = inside * (q <= radius + REACH).mean() + (1 - inside) * (q > radius - REACH).mean()
                    if inside < 1 and pairs * len(own) * len(ask) < cost:
                        best, cost = (vantage, radius), pairs * len(own) * len(ask)
        if best is None:
            yield own, ask
            continue
        vantage, radius = best
        inside, q = apart(points[own], vantage) <= radius, apart(points[ask], vantage)
        stack.append((own[inside], ask[q <= radius + REACH], level + 1))
        stack.append((own[~inside], ask[q > radius - REACH], level + 1))


def hook(links: Links, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links the pairs, and gives those that joined two groups: never more than there are points."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        la, lb = links.label[a], links.label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            return tuple(np.concatenate([k[j] for k in kept]) if kept else np.zeros(0, np.int64) for j in (0, 1))
        # the first pair of each larger group hooks it to a smaller one
        _, first = np.unique(np.maximum(la, lb), return_index=True)
        kept.append((a[first], b[first]))
        links.add(a[first], b[first])


def link_similar(prints: np.ndarray, sizes: np.ndarray, home: np.ndarray, asks: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index, index) of a group that may be similar: a forest, likely pairs first.

    Pairs meet in the leaves of a vantage-point tree (``branches``), and there in order of
    size, which is the distance to the empty text: only its ring around a block can hold
    neighbours.  Pairs that their fingerprints make sure are hooked at once; those within three standard
    deviations of ``similarity`` later, by distance, where their groups are still apart.
    """
    order = np.argsort(sizes, kind="stable")
    prints, sizes, home, asks = prints[order], sizes[order], home[order], asks[order]
    sure, near = (bits_at(similarity, 64 * WORDS, x) for x in (-3.0, 3.0))
    sift = bits_at(similarity, 64 * SIFT_WORDS, 3.0)
    links = Links(len(sizes))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    maybe: list[np.ndarray] = []
    held = 0

    def closest(rows: list[np.ndarray]) -> np.ndarray:
        """Of pairs (distance, a, b) between two groups the closest one, by distance."""
        all_rows = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
        la, lb = links.label[all_rows[:, 1]], links.label[all_rows[:, 2]]
        all_rows, la, lb = all_rows[la != lb], la[la != lb], lb[la != lb]
        best = np.lexsort((all_rows[:, 0], np.maximum(la, lb), np.minimum(la, lb)))
        all_rows, la, lb = all_rows[best], np.minimum(la, lb)[best], np.maximum(la, lb)[best]
        new = np.append(True, (la[1:] != la[:-1]) | (lb[1:] != lb[:-1]))[: len(la)]
        return all_rows[new][np.argsort(all_rows[new][:, 0], kind="stable")]

    def compare(own: np.ndarray, ask_all: np.ndarray) -> None:
        nonlocal maybe, held
        ask_sizes = sizes[ask_all]
        for j in range(0, len(own), LEAF):
            block = own[j : j + LEAF]
            lo = np.searchsorted(ask_sizes, math.floor(sizes[block[0]] * similarity), "left")
            hi = np.searchsorted(ask_sizes, math.ceil(sizes[block[-1]] / similarity), "right")
            part = [np.ascontiguousarray(prints[block, k]) for k in range(SIFT_WORDS)]
            for k in range(lo, hi, BLOCK):
                ask = ask_all[k : min(hi, k + BLOCK)]
                d = np.bitwise_count(prints[ask, 0][:, None] ^ part[0])
                for w in range(1, SIFT_WORDS):
                    d = d + np.bitwise_count(prints[ask, w][:, None] ^ part[w])
                x, y = np.nonzero(d <= sift)
                a, b = ask[x], block[y]
                while len(a):
                    apart = links.label[a] != links.label[b]
                    a, b = a[apart], b[apart]
                    # in slices: what the first ones link needs no comparison later
                    x, y, a, b = a[:20_000], b[:20_000], a[20_000:], b[20_000:]
                    ratio = np.minimum(sizes[x], sizes[y]) >= similarity * np.maximum(sizes[x], sizes[y])
                    x, y = x[ratio], y[ratio]
                    far = np.bitwise_count(prints[x] ^ prints[y]).sum(1, dtype=np.int64)
                    found.append(hook(links, x[far <= sure], y[far <= sure]))
                    some = (far > sure) & (far <= near)
                    maybe.append(np.column_stack((far[some], x[some], y[some])))
                    held += int(some.sum())
                    if held > 1_000_000:
                        maybe = [closest(maybe)]
                        held = -len(maybe[0])

    points = np.column_stack((prints, sizes.astype(np.uint64)))
    for leaf in branches(points, np.flatnonzero(home), np.flatnonzero(asks), metric(similarity)):
        compare(*leaf)
    for k in range(sure + 1, near + 1):
        rest = closest(maybe) if k == sure + 1 else rest
        at = rest[rest[:, 0] == k]
        found.append(hook(links, at[:, 1], at[:, 2]))
    a, b = (np.concatenate([f[j] for f in found]).astype(np.int64) for j in (0, 1)) if found else (np.zeros(0, np.int64),) * 2
    return order[a], order[b]


#: Points that a shard of long prints owns, at most about; more shards cost more visits.
OWN = 150_000
LEAST_DEPTH = 5


def shingles(text: str, shingle: int) -> tuple[Column, Column]:
    """The words ``__w`` of a text column, and from them its distinct hashed shingles.

    Fewer words than a shingle are one shingle, no words are none.
    """
    words = words_of(F.lower(text))
    at = F.sequence(F.lit(0), F.size("__w") - shingle)
    many = F.transform(at, lambda k: F.xxhash64(*[F.get("__w", k + j) for j in range(shingle)]))
    return words, F.when(F.size("__w") > shingle, F.array_distinct(many)).when(F.size("__w") > 0, F.array(F.xxhash64("__w"))).otherwise(F.array().cast("array<long>"))


def verified(edges: DataFrame, docs: DataFrame, key: list, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The ``edges`` (a, b) of keys whose texts have the Jaccard similarity, by their shingles."""
    names = [f"{side}.{c}" for side in ("a", "b") for c in KEY]
    edges = edges.select(*[F.col(n).alias(n.replace(".", "")) for n in names])
    asked = edges.select(*[F.col(f"a{c}").alias(f"q{c}") for c in KEY]).union(edges.select(*[f"b{c}" for c in KEY])).distinct()
    words, sets = shingles("__t", shingle)
    own = docs.select(*key, text_or_empty(text_col).alias("__t")).join(asked, [F.col(c) == F.col(f"q{c}") for c in KEY], "left_semi")
    # rows that share a key share the text
    own = written(own.dropDuplicates(KEY).withColumn("__w", words).select(*KEY, sets.alias("s")), "shingles")
    for side in ("a", "b"):
        mine = own.select(*[F.col(c).alias(f"m{c}") for c in KEY], F.col("s").alias(f"s{side}"))
        edges = edges.join(mine, [F.col(f"{side}{c}") == F.col(f"m{c}") for c in KEY]).drop(*[f"m{c}" for c in KEY])
    both = F.size(F.array_intersect("sa", "sb"))
    kept = edges.where(both >= similarity * (F.size("sa") + F.size("sb") - both))
    return kept.select(*[F.col(f"{side}{c}") for side in ("a", "b") for c in KEY])


def similar_groups(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, h1, h2, group): the group of each document, by shingle similarity.

    A vantage-point tree over the long fingerprints and sizes (``metric``) deals the points
    to shards, as in ``link``; its shape comes from ``SAMPLE`` points.  A point also visits
    the later shards that its ball may overlap.  Inside a shard a second tree prunes
    (``branches``).  Texts with equal prints and sizes are one point.  Fingerprints of a
    similarity of 0.8 differ in 15 bits of 100, and random ones in 50, so among unlike texts
    the distance to the empty text, their size, prunes, and among families of texts the
    other vantage points do: unlike texts of one size are all compared, in numpy, in groups
    of at most about ``OWN`` points.  Each group gives a forest of pairs that may be similar, no
    more than it has points; they are verified by the shingles themselves, so that every
    link is one of two texts with the similarity.
    """
    key = row_key(id_col, text_col)

    @F.pandas_udf("fp binary, n long")
    def fp(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([long_simhash(t, shingle) for t in texts], columns=["fp", "n"])

    made = docs.select(*key, text_or_empty(text_col).alias("t")).withColumn("x", fp("t"))
    prints = written(made.select(*KEY, "x.fp", "x.n").distinct(), "long-prints")
    points = written(
        prints.groupBy("fp", "n").agg(F.min(F.struct(*KEY)).alias("k")).select("fp", "n", "k", F.xxhash64("fp", "n").alias("p")), "points"
    )
    deep = max(LEAST_DEPTH, math.ceil(math.log2(max(points.count(), 1) / OWN)))
    apart = metric(similarity)

    def rows_of(batch: pd.DataFrame) -> np.ndarray:
        fps = np.frombuffer(b"".join(batch["fp"]), "<u8").reshape(-1, WORDS)
        return np.column_stack((fps, batch["n"].to_numpy().astype(np.uint64)))

    tree = grow(rows_of(points.orderBy("p", "fp").limit(SAMPLE).toPandas()), deep, 0, apart, (EMPTY,))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = rows_of(batch)
            at = np.zeros(len(rows), np.int32)
            for own, shard in routes(tree, rows, 0, apart):
                at[own] = shard
            for own, shard in routes(tree, rows, REACH, apart):
                # a pair in two shards meets once: only the earlier one's point visits
                own = own[at[own] <= shard]
                yield batch.iloc[own].assign(shard=np.int32(shard), home=at[own] == shard)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        fps = rows_of(group)[:, :WORDS]
        a, b = link_similar(fps, group["n"].to_numpy(), group["home"].to_numpy(bool), group["asks"].to_numpy(bool), similarity)
        p = group["p"].to_numpy()
        return pd.DataFrame({"a": p[a], "b": p[b]})

    dealt = points.select("fp", "n", "p").mapInPandas(deal, "fp binary, n long, p long, shard int, home boolean")
    pairs = written(grouped(dealt, "p", OWN).groupBy("shard", "block", "chunk").applyInPandas(join, "a long, b long"), "similar-pairs")
    named = points.select(F.col("p").alias("x"), "k")
    for side in ("a", "b"):
        pairs = pairs.join(named.withColumnRenamed("k", f"k{side}"), F.col(side) == F.col("x")).drop("x")
    sure = verified(pairs.select(F.col("ka").alias("a"), F.col("kb").alias("b")), docs, key, text_col, shingle, similarity)
    ends = [F.struct(*[F.col(f"{side}{c}").alias(c) for c in KEY]) for side in ("a", "b")]
    back = points.select(F.col("k").alias("x"), "p")
    linked = sure.select(ends[0].alias("ka"), ends[1].alias("kb"))
    for side in ("a", "b"):
        linked = linked.join(back.withColumnRenamed("p", side), F.col(f"k{side}") == F.col("x")).drop("x")
    roots = components(linked.select("a", "b"), "similar")
    return (
        prints.withColumn("p", F.xxhash64("fp", "n"))
        .join(roots.withColumnRenamed("node", "p"), "p", "left")
        .select(*KEY, F.coalesce("root", "p").alias("group"))
    )


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``docs`` without near-duplicates: of each group the document with the smallest id stays.

    Ties go to the smallest text hash; of repeated rows one stays.  Null and empty texts
    are one group.  Null ids count as the smallest.  Columns are unchanged.
    """
    groups = written(similar_groups(docs, id_col, text_col, shingle, similarity), "groups")
    kept = groups.groupBy("group").agg(F.min(F.struct(*KEY)).alias("k")).select(*[F.col(f"k.{c}").alias(f"__k{c}") for c in KEY])
    keyed = docs.withColumns(dict(zip(KEY, row_key(id_col, text_col), strict=True)))
    rest = keyed.join(kept, [F.col(c) == F.col(f"__k{c}") for c in KEY], "left_semi")
    return rest.dropDuplicates(KEY).drop(*KEY)
