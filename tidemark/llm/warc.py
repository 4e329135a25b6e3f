"""WARC archives: written from pages, read back, and merged into capture histories.

Method: pages become WARC/1.1 records, equal payloads become revisits of the first one.
Reading parses each archive into an index run, sorted locally by (URL key, time, record).
Runs are merged by an external k-way merge: range partitions of the whole index receive
their slice of every run, and a loser tree merges the slices, so the history is in global
order across partitions.

Scale: payloads are compressed before they are shuffled, once, with the marks of revisits;
a mark is found by narrow rows (id and digest), and joined by both, so that a payload that
a third of all pages share is spread too.  Each record is a gzip member of its own, each
archive of about ``ARCHIVE_MB`` a row of Spark's own text writer, so any store and a lost
or repeated task are Spark's business.  Archives are parsed once: the index is written,
and its slices are dealt from there.  The merge's range key includes time and record, so
that a URL with a third of all captures is spread over partitions.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import work_dir, written

#: Payloads below this size are never revisits.
REVISIT_BYTES = 100
#: An archive is closed at this size, of compressed records.
ARCHIVE_MB = 24
#: Index entries of one merge partition.
MERGE_ROWS = 50_000
#: Ends a record.
RECORD_END = "\r\n\r\n"
#: Uncompressed bytes of a gzip member at most: its size ends in a zero byte, see ``write``.
MEMBER = 1 << 24
GZIP, LEVEL = 31, 6
FIELDS = {
    "page_id": "X-Page-Id", "url": "WARC-Target-URI", "ts": "WARC-Date", "digest": "WARC-Payload-Digest",
    "bytes": "X-Payload-Bytes", "refers_to": "X-Refers-To-Page-Id", "type": "WARC-Type", "length": "Content-Length",
}
INDEX = (
    "urlkey string, ts string, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, payload_ok boolean, archive string, start long"
)


def packed(text: Column) -> Column:
    """The UTF-8 bytes of a text, compressed for the way through a shuffle."""

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: zlib.compress(t.encode("utf-8", "surrogatepass"), 1))

    return pack(text)


def revisits(rows: DataFrame) -> DataFrame:
    """(i, d, first): pages (id, digest, bytes) whose payload the page ``first`` has too."""
    large = rows.where(F.col("bytes") >= REVISIT_BYTES)
    first = large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    return (
        large.select("id", "digest")
        .join(first.select(F.col("digest").alias("d"), "first"), F.col("digest") == F.col("d"))
        .where(F.coalesce(F.col("id") != F.col("first"), F.lit(True)))
        .select(F.col("id").alias("i"), "d", "first")
        .distinct()
    )


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> DataFrame:
    """(head, body): the header of each page's WARC record, and its payload compressed.

    A null payload is empty and a null URL is left out.  The capture time is the column
    ``time_col``; without one it is derived from the id, and a null time is left out.
    Equal payloads of ``REVISIT_BYTES`` or more are revisits of the page with the smallest
    id, which stays a response; rows that repeat that id are responses too, and so is all
    where no id is set.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    stamp = F.col(time_col).cast("timestamp") if time_col else F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    key = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
        F.octet_length(payload).alias("bytes"),
        F.col(url_col).cast("string").alias("url"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        payload.alias("payload"),
    )
    rows = key.withColumn("body", packed(F.col("payload"))).drop("payload")
    marked = rows.join(revisits(key.select("id", "digest", "bytes")), F.col("digest").eqNullSafe(F.col("d")) & F.col("id").eqNullSafe(F.col("i")), "left")
    revisit = F.col("first").isNotNull()

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{FIELDS[name]}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")

    clean = F.regexp_replace("url", r"[\r\n]", "%0A")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("type", F.when(revisit, "revisit").otherwise("response")),
        F.lit("WARC-Record-ID: <urn:sha256:"),
        F.sha2(F.concat_ws("|", "id", "url", "ts", "digest"), 256),
        F.lit(">\r\n"),
        field("url", clean),
        field("ts", F.col("ts")),
        field("digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        field("bytes", F.col("bytes")),
        field("page_id", F.col("id")),
        field("refers_to", F.col("first")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        field("length", F.when(revisit, 0).otherwise(F.col("bytes"))),
        F.lit("\r\n"),
    )
    return marked.select(head.alias("head"), F.when(~revisit, F.col("body")).alias("body"))


def members(record: bytes) -> bytes:
    """A record as gzip: one member, or several where it is larger than ``MEMBER`` allows."""
    out = []
    for at in range(0, len(record), MEMBER - 1):
        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
        out.append(pack.compress(record[at : at + MEMBER - 1]) + pack.flush())
    return b"".join(out)


def write(pages: DataFrame, path: str, **columns: str) -> None:
    """Writes ``pages`` as WARC archives, one gzip member a record, into the new folder ``path``.

    A member ends in the record's size, whose last byte is zero below 16 MB: Spark's text
    writer, which wants something between rows, writes that byte.
    """

    def archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, size = [], 0
        for batch in batches:
            for head, body in zip(batch["head"], batch["body"], strict=True):
                own.append(members(head.encode() + (zlib.decompress(body) if body is not None else b"") + RECORD_END.encode()))
                size += len(own[-1])
                if size >= ARCHIVE_MB << 20:
                    yield pd.DataFrame({"archive": [b"".join(own)[:-1]]})
                    own, size = [], 0
        if own:
            yield pd.DataFrame({"archive": [b"".join(own)[:-1]]})

    rows = records(pages, **columns).mapInPandas(archives, "archive binary")
    # the cast keeps bytes as they are
    rows.select(F.col("archive").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def unpacked(content: bytes) -> Iterator[tuple[bytes, int]]:
    """(content, start) of each gzip member."""
    view, at = memoryview(content), 0
    while at < len(view):
        start, out, unpack = at, [], zlib.decompressobj(GZIP)
        while not unpack.eof:
            if at >= len(view):
                raise ValueError(f"archive ends inside the member at {start}")
            out.append(unpack.decompress(view[at : at + 65536]))
            at = min(at + 65536, len(view))
        at -= len(unpack.unused_data)
        yield b"".join(out), start


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, block, start) of each record of an archive; a record may take several members."""
    rest, begun = b"", 0
    for part, start in unpacked(content):
        begun = begun if rest else start
        rest += part
        end = rest.find(b"\r\n\r\n")
        if not rest.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {begun}")
        if end < 0:
            continue
        head = dict(line.split(": ", 1) for line in rest[:end].decode("utf-8").split("\r\n")[1:])
        length = int(head["Content-Length"])
        if len(rest) < end + 4 + length + len(RECORD_END):
            continue
        yield head, rest[end + 4 : end + 4 + length], begun
        rest = b""
    if rest:
        raise ValueError(f"archive ends inside the record at {begun}")


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, then the rest, lower case, scheme dropped."""
    rest = url.split("://", 1)[-1].lower()
    host, slash, path = rest.partition("/")
    return ",".join(reversed(host.split(":")[0].split("."))) + ")" + slash + path


def order(row: tuple) -> tuple:
    """URL key, time, page id (nulls first) and place: the same in every run."""
    return row[0], row[1] or "", row[2] is not None, row[2] or 0, row[9], row[10]


def index(spark: SparkSession, path: str) -> DataFrame:
    """The index runs of all archives in ``path``, each sorted locally.

    ``payload_ok`` says whether a response's bytes have the digest and size it declares.
    """

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for head, block, start in parse(content):
                    get = lambda k: head.get(FIELDS[k])  # noqa: B023, E731
                    digest, size = get("digest").removeprefix("sha256:"), int(get("bytes"))
                    ok = get("type") == "revisit" or (hashlib.sha256(block).hexdigest(), len(block)) == (digest, size)
                    page, refers = ((v := get(k)) and int(v) for k in ("page_id", "refers_to"))
                    url = get("url")
                    rows.append((url_key(url or ""), get("ts"), page, url, get("type"), refers, size, digest, ok, name, start))
                rows.sort(key=order)
                yield frame(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInPandas(runs, INDEX)


def frame(rows: list[tuple]) -> pd.DataFrame:
    found = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
    return found.astype({"page_id": "Int64", "refers_to": "Int64"})


def loser_tree(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merges sorted runs: a tree of losers, one comparison per level for each row.

    ``tree[k]`` holds the run that lost at node k; the winner goes up and is replayed along
    its own path only.
    """
    k = len(runs)
    if k < 2:
        yield from (runs[0] if runs else [])
        return
    at = [0] * k
    head: list[tuple | None] = [order(r[0]) if r else None for r in runs]

    def before(a: int, b: int) -> bool:
        """An ended run loses against every other."""
        if head[a] is None or head[b] is None:
            return head[a] is not None
        return head[a] < head[b] if head[a] != head[b] else a < b

    tree = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], tree[node] = (a, b) if before(a, b) else (b, a)
    winner = winners[1]
    while head[winner] is not None:
        yield runs[winner][at[winner]]
        at[winner] += 1
        head[winner] = order(runs[winner][at[winner]]) if at[winner] < len(runs[winner]) else None
        node = (winner + k) // 2
        while node:
            if before(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2


def merged(runs: DataFrame) -> DataFrame:
    """The runs of ``index`` as one history in global order of (URL key, time, page).

    Range partitions follow each other; within one, the slices of all runs are merged.  The
    runs are written first, as Spark reads them twice, for the ranges and for the slices.
    """
    runs = written(runs, "warc-index")
    rows = runs.count()
    parts = max(1, -(-rows // MERGE_ROWS))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
                slices.setdefault(row[9], []).append(row)
        for part in slices.values():
            part.sort(key=order)  # sorted already, but for the order in which a shuffle delivers blocks
        out: list[tuple] = []
        for row in loser_tree([slices[k] for k in sorted(slices)]):
            out.append(row)
            if len(out) == 10_000:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    return runs.repartitionByRange(parts, "urlkey", "ts", "page_id", "archive", "start").mapInPandas(merge, INDEX)


def captures(pages: DataFrame, **columns: str) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder, reads them back and merges the index.

    An empty table gives an empty history; extra columns are not archived, whatever their
    names.  Repeated rows are records of their own.
    """
    path = f"{work_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, path, **columns)
    return merged(index(pages.sparkSession, path))
