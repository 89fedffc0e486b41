"""A paged source: numbered pages of JSON records, read in parallel or as a stream with page offsets.

`fetch` names a function `module:name` of (url, page) that returns the page's records as JSON texts, or raises
Retry. Network access belongs to that function; the default reads `<url>/<page>.jsonl` files.
"""

from __future__ import annotations

import importlib
import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


class Retry(Exception):
    """The page is not to be had now, for instance because of a rate limit."""


def read_page(url: str, page: int) -> list[str]:
    path = f"{url}/{page}.jsonl"
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return [line for line in f.read().split("\n") if line]


def _fetch(options: dict, page: int) -> list[str]:
    module, _, name = options.get("fetch", "larkspur.sources.paged:read_page").partition(":")
    get, tries = getattr(importlib.import_module(module), name), int(options.get("tries", "5"))
    for k in range(tries):
        try:
            return get(options["url"], page)
        except Retry:
            if k == tries - 1:
                raise
            time.sleep(float(options.get("wait", "1")) * 2**k)
    return []


class Page(InputPartition):
    def __init__(self, page: int):
        self.page = page


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Page(p) for p in range(int(self.options.get("from", "0")), int(self.options["to"]))]

    def read(self, partition: Page) -> Iterator[tuple]:
        for k, record in enumerate(_fetch(self.options, partition.page)):
            yield (partition.page, k, record)


class _StreamReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": int(self.options.get("from", "0"))}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        records = _fetch(self.options, start["page"])
        rows = [(start["page"], k, r) for k, r in enumerate(records)]
        return iter(rows), {"page": start["page"] + bool(records)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        for page in range(start["page"], end["page"]):
            for k, r in enumerate(_fetch(self.options, page)):
                yield (page, k, r)


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged").option("url", ...).option("to", n)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, position int, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _StreamReader(dict(self.options))
