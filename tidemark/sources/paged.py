"""Landed pages of boards as a data source: a partition for each board, which reads its pages until the rule says stop.

A board's folder ``board=<name>`` has lines of JSON, a page each: offset, total and the jobs.
Filters on ``board`` are taken over, so boards that nobody asks for are not opened.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tidemark.operators.ranking import placed

SCHEMA = "board string, offset long, position long, job string"


def goes_on(found: int, offset: int, limit: int, total: int | None = None, until_empty: bool = False) -> bool:
    """Whether another page follows: never after an empty one; by the total where a board tells it; else after a full page."""
    if not found:
        return False
    if total is not None:
        return offset + found < total
    return until_empty or found >= limit


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Board(InputPartition):
    name: str
    path: str


class PagesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.limit = options["path"], int(options.get("limit", 20))
        self.rule = options.get("rule", "total")
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("board",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = own if self.wanted is None else self.wanted & own
            else:
                yield f

    def partitions(self) -> list[Board]:
        """The boards: names of folders, however many pages they have."""
        files, path = opened(self.path)
        found = files.get_file_info(fs.FileSelector(path))
        boards = [Board(unquote(f.base_name.removeprefix("board=")), f.path) for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("board=")]
        return sorted((b for b in boards if self.wanted is None or b.name in self.wanted), key=lambda b: b.name) or [Board("", "")]

    def read(self, partition: Board) -> Iterator[tuple]:
        """One page at a time."""
        if not partition.path:
            return
        files, _ = opened(self.path)
        names = sorted(f.path for f in files.get_file_info(fs.FileSelector(partition.path)) if f.base_name.startswith("part-"))
        total = None
        for name in names:
            with io.TextIOWrapper(files.open_input_stream(name), "utf-8") as lines:
                for line in lines:
                    page = json.loads(line)
                    offset, jobs = page["offset"], page.get("jobs") or []
                    total = page.get("total") if offset == 0 and self.rule == "total" else total
                    for k, job in enumerate(jobs):
                        yield partition.name, offset, k, job if isinstance(job, str) else json.dumps(job, ensure_ascii=False)
                    if not goes_on(len(jobs), offset, self.limit, total, self.rule == "until_empty"):
                        return


class LandedPages(DataSource):
    """``spark.read.format("landed_pages")`` with the options path, limit and rule (total, full or until_empty)."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:  # noqa: ANN001
        return PagesReader(self.options)


def land(rows: DataFrame, board: Column, job: Column, path: str, order: str, limit: int = 20) -> None:
    """Writes pages of ``limit`` jobs for each board, as a crawl would leave them.

    Places come from a range sort, so a board of very many jobs is dealt out; a page has its own
    jobs only.
    """
    jobs = rows.select(board.alias("board"), order, job.alias("job")).where("board is not null")
    found = placed(jobs, f"{path}-places", "board", order)
    first = found.groupBy("board").agg(F.min("place").alias("first"), F.count("*").alias("total"))
    numbered = found.join(first, "board").withColumn("k", F.col("place") - F.col("first"))
    page = numbered.groupBy("board", "total", F.expr(f"k div {limit}").alias("page")).agg(F.sort_array(F.collect_list(F.struct("k", "job"))).alias("jobs"))
    line = F.to_json(F.struct((F.col("page") * limit).alias("offset"), "total", F.transform("jobs", lambda j: j["job"]).alias("jobs")))
    lines = page.select("board", "page", line.alias("value")).repartition("board").sortWithinPartitions("board", "page")
    lines.select("board", "value").write.partitionBy("board").text(path)


def read(spark: SparkSession, path: str, limit: int = 20, rule: str = "total") -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedPages)
    return spark.read.format("landed_pages").option("path", path).option("limit", limit).option("rule", rule).load()
