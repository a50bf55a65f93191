"""Paged sources as a Python data source: an adapter gives pages, Spark reads them in parallel, each as a partition.

An adapter is a class with ``page(number, size) -> {"page", "page_size", "total", "rows"}``, made on the worker from the
options of the read; pages are numbered from 1, rows are (id, body). The driver asks for page 1 to learn the total and
plans one partition for each page, from ``first`` on (a capture that ended early is resumed there). A task checks its
page: its number and size must be those asked for, and it may not hold more rows than its size. That some page brings no
id that earlier ones haven't is found over all pages and is an error, as is a page without rows before the last.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scratch import saved

SCHEMA = "page int, pos int, id string, body string, total long"


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


def checked_page(got: dict, number: int, size: int) -> dict:
    if got["page"] != number or got["page_size"] != size or len(got["rows"]) > size:
        raise ValueError(f"page {number} has other numbers than were asked for")
    return got


class _Reader(DataSourceReader):
    def __init__(self, adapter: type, options: dict):
        self._adapter, self._options = adapter, dict(options)
        self._size, self._first, self._most = int(options.get("page_size", 100)), int(options.get("first", 1)), int(options.get("most_pages", 100))
        if not 1 <= self._size <= 100:
            raise ValueError("a page has 1 to 100 rows")

    def partitions(self) -> list[Page]:
        total = checked_page(self._adapter(self._options).page(1, self._size), 1, self._size)["total"]
        if total is None:
            raise ValueError("the first page doesn't say how many rows there are")
        pages = -(-total // self._size)
        if pages > self._most:
            raise ValueError(f"{pages} pages, of {self._most} at most")
        return [Page(n) for n in range(self._first, pages + 1)] or [Page(0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if not partition.number:
            return
        got = checked_page(self._adapter(self._options).page(partition.number, self._size), partition.number, self._size)
        if not got["rows"]:
            raise ValueError(f"page {partition.number} has no rows")
        for pos, (id_, body) in enumerate(got["rows"]):
            yield partition.number, pos, str(id_), body, got["total"]


def paged(spark: SparkSession, adapter: type, **options) -> DataFrame:
    """(page, pos, id, body, total) of all pages of an adapter."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"paged_{adapter.__name__.lower()}"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(adapter, self.options)

    spark.dataSource.register(Source)
    return spark.read.format(Source.name()).options(**{k: str(v) for k, v in options.items()}).load()


def captured(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, page, pos, body): each id once, at its first place; ``known`` (id) are those of an earlier part of the capture.

    The pages are fetched once and written. A page that brings no new id is an error.
    """
    pages = saved(pages)
    new = pages if known is None else pages.join(known.select("id").distinct(), "id", "left_anti")
    first = new.groupBy("id").agg(F.min(F.struct("page", "pos", "body")).alias("x")).select("id", "x.page", "x.pos", "x.body")
    per = pages.select("page").distinct().join(first.groupBy("page").agg(F.count("*").alias("fresh")), "page", "left")  # a row for each page
    stale = per.where("fresh is null").agg(F.min("page").alias("page")).first().page
    if stale is not None:
        raise ValueError(f"page {stale} brings no new id")
    return first


def coverage(pages: DataFrame) -> DataFrame:
    """One row: sampled (distinct ids), expected (the largest total that a page reports), dropped."""
    got = pages.agg(F.countDistinct("id").alias("sampled"), F.coalesce(F.max("total"), F.lit(0)).alias("expected"))
    return got.withColumn("dropped", F.greatest(F.col("expected") - F.col("sampled"), F.lit(0)))
