"""Visitors found or made, request by request: each request sees the visitors that earlier ones made.

What a request finds depends on what came before, so requests are folded in their order, but only
with those that can matter to each other:

* A request with a cookie or a print finds a visitor by an equal cookie, or by an equal address and
  print together.  So requests are grouped by cookies and by (address, print), not by addresses or
  prints, which crowds share.  A visitor may get its address and its print from different requests;
  if that pair is also another group's, the two are joined and folded again, until none is.  Groups
  of one (cookie, address, print) need no fold: the first request makes the visitor, the others
  find it.
* A request that finds none takes over the anonymous visitor of its address, or makes one.  Either
  way there is a visitor with its signals then, so this choice changes nothing above.  It is made
  by a second fold, of the new ones and the anonymous requests of an address, whose state is one
  anonymous visitor and the times of the last new ones, ``LIMIT`` of them.

Folds run over sorted streams in tasks, and hold the visitors of one group or the state of one
address, never its requests.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.groups import connected, kept, star

#: New visitors of an address in an hour before further ones are flagged.
LIMIT = 20
HOUR, FRESH = 3_600_000_000, 600_000_000
#: Prints of the modern kind are that long; shorter ones give way to them.
MODERN = 32

SIGNALS = ["vid", "ip", "print"]
FOUND = "request long, visitor long, vid string, ip string, print string, group long"


@dataclass(slots=True)
class Visitor:
    id: int
    vid: str | None
    ip: str | None
    print: str | None
    seen: int  # number of the request in the fold, the later the greater


class Group:
    """The visitors of one group by what finds them."""

    def __init__(self) -> None:
        self.by_vid: dict[str, list[Visitor]] = {}
        self.by_pair: dict[tuple[str, str], list[Visitor]] = {}
        self.n = 0

    def indexed(self, v: Visitor, vid: str | None, pair: tuple[str | None, str | None]) -> None:
        """Puts a visitor under a cookie and a pair that are new to it."""
        if vid:
            self.by_vid.setdefault(vid, []).append(v)
        if pair[0] and pair[1]:
            self.by_pair.setdefault(pair, []).append(v)

    def resolve(self, request: int, vid: str | None, ip: str | None, print: str | None) -> Visitor:  # noqa: A002
        self.n += 1
        of_vid = self.by_vid.get(vid, []) if vid else []
        pair = (ip, print)
        fits = [v for v in of_vid if (ip and v.ip == ip) or (print and v.print == print)]
        fits += [v for v in (self.by_pair.get(pair, []) if ip and print else []) if (v.ip, v.print) == pair]
        found = max(fits or of_vid, key=lambda v: v.seen, default=None)
        if not found:
            found = Visitor(request, vid, ip, print, self.n)
            self.indexed(found, vid, pair)
            return found
        found.seen = self.n
        had_vid, had = found.vid, (found.ip, found.print)
        found.vid = had_vid or vid
        found.ip = found.ip or ip
        if print and (not found.print or (len(found.print) < MODERN <= len(print))):
            found.print = print
        now = (found.ip, found.print)
        self.indexed(found, None if had_vid else vid, (None, None) if now == had else now)
        return found


def folded(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The visitor of each request as it is after it; sorted by (group, ts, request)."""
    group, state = None, Group()
    for batch in rows:
        out = []
        names = ("group", "request", *SIGNALS)
        for g, request, vid, ip, print_ in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            if g != group:
                group, state = g, Group()
            v = state.resolve(request, vid, ip, print_)
            out.append((request, v.id, v.vid, v.ip, v.print, g))
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["request", "visitor", "vid", "ip", "print", "group"])


def by_signals(requests: DataFrame) -> DataFrame:
    """(request, visitor, vid, ip, print, group) of requests with a cookie or a print; a visitor is named by the request that made it."""
    own = requests.where("vid is not null or print is not null")
    triples = kept(own.groupBy(*SIGNALS).agg(F.min("request").alias("node")), "triples")
    edges = star(triples, "node", [F.col("vid")]).union(star(triples, "node", [F.col("ip"), F.col("print")]))
    groups = connected(triples.select("node"), edges, "visitor-groups")
    done: DataFrame | None = None
    while True:
        placed = triples.join(groups, "node")
        several = placed.groupBy("group").agg(F.count("*").alias("n"))
        at = own.join(placed, [own[c].eqNullSafe(placed[c]) for c in SIGNALS]).select(own["*"], placed["group"])
        at = at.join(several, "group")
        fold = at.where("n > 1").select("group", "ts", "request", *SIGNALS).repartition("group").sortWithinPartitions("group", "ts", "request")
        first = own.groupBy(*SIGNALS).agg(F.min(F.struct("ts", "request"))["request"].alias("visitor"))
        alone = at.where("n = 1").drop("n").join(first.withColumnsRenamed({c: f"f_{c}" for c in SIGNALS}), [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in SIGNALS])
        # a print without address or cookie is found by nobody, not even by itself
        own_id = F.when(F.col("vid").isNull() & F.col("ip").isNull(), F.col("request")).otherwise(F.col("visitor")).alias("visitor")
        found = fold.mapInArrow(folded, FOUND).unionByName(alone.select("request", own_id, *SIGNALS, "group"))
        done = kept(found, "visitors")
        # a pair that visitors of two groups have, or a visitor of one and a request of another
        pairs = done.select("ip", "print", "group").union(placed.select("ip", "print", "group")).dropna(subset=["ip", "print"]).distinct()
        more = star(pairs.withColumnRenamed("group", "node"), "node", [F.col("ip"), F.col("print")]).distinct()
        if more.isEmpty():
            return done
        joined = connected(groups.select(F.col("group").alias("node")).distinct(), more, "visitor-groups")
        groups = kept(groups.join(joined.select(F.col("node").alias("group"), F.col("group").alias("to")), "group").select("node", F.col("to").alias("group")), "visitor-groups")


def at_address(rows: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Who takes over an anonymous visitor, who makes one, and who is flagged; sorted by (ip, ts, request)."""
    ip, times, blank = None, deque(), None  # times of the last visitors made here; the anonymous visitor: id, time, flagged
    for batch in rows:
        out = []
        for at, t, request, new in zip(*[batch.column(c).to_pylist() for c in ("ip", "t", "request", "new")], strict=True):
            if at != ip:
                ip, times, blank = at, deque(), None
            while times and times[0] < t - HOUR:
                times.popleft()
            flagged = len(times) >= limit
            if new and blank and not blank[2] and blank[1] >= t - FRESH:
                out.append((request, blank[0], "claimed", False))
                blank = None
                continue
            if not new and blank:
                out.append((request, blank[0], "found", blank[2]))
                continue
            if not new:
                blank = (request, t, flagged)
            if new or not flagged:
                times.append(t)
                if len(times) > limit:
                    times.popleft()
            out.append((request, request, "created", flagged))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["request", "visitor", "how", "flagged"])


def resolved(requests: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(request, visitor, how, flagged) for requests (request, ts, vid, ip, print): which visitor each is from, in the order of time, then request.

    ``visitor`` is the request that made the visitor; ``how`` says found, created or claimed (an
    anonymous visitor's first request with signals, ten minutes after it at most).  ``flagged``
    is what the visitor is marked as when it is made: one of ``limit`` or more new ones of its
    address in the last hour.  Empty signals count as null.  A request with no signal at all is
    a visitor by itself.  Request numbers are distinct; an empty table gives no rows.
    """
    clean = requests.select("request", F.col("ts").cast("timestamp").alias("ts"), *[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in SIGNALS])
    clean = kept(clean, "requests")
    found = by_signals(clean).select("request", "visitor")
    new = found.where("request = visitor").select("request", F.lit(True).alias("new"))
    blank = clean.where("vid is null and print is null").select("request", F.lit(False).alias("new"))
    at = new.union(blank).join(clean.select("request", F.unix_micros("ts").alias("t"), "ip"), "request")
    stream = at.where("ip is not null").repartition("ip").sortWithinPartitions("ip", "t", "request")
    made = stream.mapInArrow(lambda rows: at_address(rows, limit), "request long, visitor long, how string, flagged boolean")
    nowhere = at.where("ip is null").select("request", F.col("request").alias("visitor"), F.lit("created").alias("how"), F.lit(False).alias("flagged"))
    made = kept(made.unionByName(nowhere), "visitors-made")
    later = found.where("request <> visitor").join(made.select(F.col("request").alias("visitor"), F.col("visitor").alias("who"), "flagged"), "visitor")
    return made.unionByName(later.select("request", F.col("who").alias("visitor"), F.lit("found").alias("how"), "flagged"))
