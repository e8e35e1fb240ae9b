"""Pages as a source: a Python data source whose partitions fetch their share of the addresses.

``spark.read.format("web_pages")`` with the options

* ``urls``: the addresses, one in a line, as of a text box (for tables of addresses see ``fetched_pages``);
* ``fetch``: ``module:function``; from an address it gives a dict of ``status``, ``html``, ``error``, ``render_status`` and
  ``render_error``, any of them missing. What it raises becomes the ``error`` of the page, so no page fails the others;
* ``slices``: how many partitions share the addresses (8).

The rows are what ``extract.attempted`` takes. There is no network here: functions that fetch are the user's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from importlib import import_module

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftwell.functions import extract

SCHEMA = "page_id long, url string, html string, status int, error string, render_status int, render_error string"
FIELDS = ("html", "status", "error", "render_status", "render_error")


def function(name: str) -> Callable[[str], dict]:
    module, _, attribute = name.partition(":")
    return getattr(import_module(module), attribute)


def fetched(fetch: Callable[[str], dict], url: str) -> tuple:
    """The fields of one page; an exception is its error."""
    try:
        got = fetch(url)
    except Exception as error:  # whatever a page does must not stop the others
        got = {"error": str(error) or type(error).__name__}
    return tuple(got.get(f) for f in FIELDS)


class Share(InputPartition):
    def __init__(self, rows: list[tuple[int, str]]):
        super().__init__(len(rows))
        self.rows = rows


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch = options["fetch"]
        self.slices = int(options.get("slices", "8"))
        self.urls = [u for u in options["urls"].split("\n") if u.strip()]

    def partitions(self) -> list[InputPartition]:
        rows = list(enumerate(u.strip() for u in self.urls))
        return [Share(rows[i :: self.slices]) for i in range(min(self.slices, len(rows)))] or [Share([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch = function(self.fetch)
        for number, url in partition.rows:
            yield number, url, *fetched(fetch, url)


class WebPages(DataSource):
    """A box of addresses, one in a line (option ``urls``)."""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebPages)


def fetched_pages(requests: DataFrame, fetch: Callable[[str], dict], url: str = "url", ident: str = "page_id") -> DataFrame:
    """The same for a table of addresses of any size, where Spark holds it: its tasks fetch what they read."""

    def run(batches):
        for b in batches:
            got = [fetched(fetch, u) for u in b["url"]]
            yield b.assign(**{f: [g[i] for g in got] for i, f in enumerate(FIELDS)})[["page_id", "url", *FIELDS]]

    rows = requests.select(F.col(ident).cast("long").alias("page_id"), F.col(url).alias("url"))
    return rows.mapInPandas(run, SCHEMA)


def rendering(render: Callable[[str], dict]) -> Callable[[DataFrame], DataFrame]:
    """A renderer for ``extract.attempted``: tasks call ``render`` for the addresses of those of their rows that are wanted, and no others.

    ``render`` gives a dict of ``html``, ``render_status`` and ``render_error``, any of them missing; what it raises is the error of the page.
    All columns of the rows pass through as they are, so pages are fetched and parsed once.
    """
    added = [T.StructField(c, T.IntegerType() if c == "render_status" else T.StringType()) for c in extract.BY_RENDERER]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [seen(render, url) if wanted else (None, None, None) for url, wanted in zip(b["url"].to_pylist(), b[extract.WANTED].to_pylist())]
            new = [pa.array([g[i] for g in got], pa.int32() if f.name == "render_status" else pa.string()) for i, f in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *extract.BY_RENDERER])

    def apply(rows: DataFrame) -> DataFrame:
        rows = rows.drop(*extract.BY_RENDERER)
        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))

    return apply


def seen(render: Callable[[str], dict], url: str) -> tuple:
    """What rendering a page gave; an exception is its error."""
    try:
        got = render(url)
    except Exception as error:  # whatever a page does must not stop the others
        got = {"render_error": str(error) or type(error).__name__}
    return got.get("html"), got.get("render_status"), got.get("render_error")


def rendered_from(renders: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A renderer that looks wanted pages up in ``renders(page_id, rendered_html, render_status, render_error)``, as another job left them."""

    def apply(rows: DataFrame) -> DataFrame:
        found = renders.select(F.col("page_id").alias("_page"), *extract.BY_RENDERER)
        rows = rows.drop(*extract.BY_RENDERER)
        return rows.join(found, F.col(extract.WANTED) & (F.col("page_id") == F.col("_page")), "left").drop("_page")

    return apply
