"""Connectors to a remote citation service, as Python data sources with a pluggable transport.

``spark.dataSource.register(RecordSource)``, then ``spark.read.format("citation_records").options(ids="1,2",
transport="package.module:function").load()``. A transport is a function from a URL to the text behind it; the
default uses ``urllib``. Requests are spaced by ``spacing`` seconds over all partitions (each of n partitions waits n times as
long) and tried ``tries`` times; a request that fails gives a row with ``error`` and doesn't stop the others. ``fetch_records`` and ``search_all`` take
their ids and queries from the partitions of a DataFrame instead of an option.
"""

from __future__ import annotations

import importlib
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The service's address.
SERVICE = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/"


def over_http(url: str) -> str:
    """The default transport: strict UTF-8."""
    with urllib.request.urlopen(url) as r:  # noqa: S310
        return r.read().decode("utf-8")


def transport_of(name: str | None) -> Callable[[str], str]:
    """The function that ``module:function`` names."""
    if not name:
        return over_http
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def record_url(id_: str) -> str:
    return f"{SERVICE}efetch.fcgi?db=pubmed&id={id_}&rettype=xml&retmode=xml"


def search_url(query: str, most: int) -> str:
    return f"{SERVICE}esearch.fcgi?db=pubmed&term={urllib.parse.quote(query)}&retmax={most}&retmode=xml"


def _each(items: Iterable[str], read: Callable, fetch: Callable[[str], str], spacing: float, tries: int, blanks: int) -> Iterator[tuple]:
    """``read`` of each item, spaced; after ``tries`` failures the item with ``blanks`` nulls and the error."""
    last = -spacing
    for item in items:
        for attempt in range(1, tries + 1):
            time.sleep(max(0.0, last + spacing - time.monotonic()))
            last = time.monotonic()
            try:
                yield read(fetch, item)
                break
            except Exception as e:  # noqa: BLE001
                if attempt == tries:
                    yield (item, *[None] * blanks, f"{type(e).__name__}: {e}")


def _record(fetch: Callable[[str], str], id_: str) -> tuple:
    return id_, fetch(record_url(id_)), None


def _hits(most: int) -> Callable:
    def read(fetch: Callable[[str], str], query: str) -> tuple:
        text = fetch(search_url(query, most))
        hits, listed = re.search(r"<Count>(\d+)</Count>", text), re.search(r"(?s)<IdList>(.*?)</IdList>", text)
        return query, int(hits.group(1)) if hits else 0, re.findall(r"<Id>([^<]*)</Id>", listed.group(1)) if listed else [], None

    return read


def _request(items: DataFrame, read: Callable, schema: str, blanks: int, transport: str | None, spacing: float, tries: int, partitions: int) -> DataFrame:
    """``read`` of the first column of ``items`` in ``partitions`` tasks, which together keep the spacing. Nothing passes the driver."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch, first = transport_of(transport), True
        for b in batches:
            if not first:
                time.sleep(spacing * partitions)
            first = False
            yield pd.DataFrame(_each(b.iloc[:, 0], read, fetch, spacing * partitions, tries, blanks), columns=names)

    return items.repartition(partitions).mapInPandas(run, schema)


def fetch_records(ids: DataFrame, transport: str | None = None, spacing: float = 0.4, tries: int = 2, partitions: int = 1) -> DataFrame:
    """id, xml, error of each id."""
    return _request(ids.select("id"), _record, "id string, xml string, error string", 1, transport, spacing, tries, partitions)


def search_all(queries: DataFrame, most: int = 20, transport: str | None = None, spacing: float = 0.4, tries: int = 1, partitions: int = 1) -> DataFrame:
    """query, hits, ids, error of each query, at most ``most`` ids."""
    return _request(queries.select("query"), _hits(most), "query string, hits long, ids array<string>, error string", 2, transport, spacing, tries, partitions)


class _Slice(InputPartition):
    def __init__(self, items: list[str]) -> None:
        self.items = items


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], items: list[str], read: Callable[[Callable[[str], str], str], tuple]) -> None:
        self.items, self.read_one = items, read
        self.transport = options.get("transport")
        self.parts = int(options.get("partitions", "1"))
        self.spacing, self.tries = float(options.get("spacing", "0.4")) * max(1, min(self.parts, len(items))), int(options.get("tries", "2"))

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.parts, len(self.items)))
        return [_Slice(self.items[i::n]) for i in range(n)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        yield from _each(partition.items, self.read_one, transport_of(self.transport), self.spacing, self.tries, self.blanks)

    blanks = 1


class RecordSource(DataSource):
    """id, xml, error of each id in the option ``ids`` (separated by commas)."""

    @classmethod
    def name(cls) -> str:
        return "citation_records"

    def schema(self) -> str:
        return "id string, xml string, error string"

    def reader(self, schema) -> DataSourceReader:
        ids = [x.strip() for x in self.options.get("ids", "").split(",") if x.strip()]
        return _Reader(self.options, ids, _record)


class SearchSource(DataSource):
    """query, hits, ids, error of each query in the option ``queries`` (one to a line), at most ``most`` ids."""

    @classmethod
    def name(cls) -> str:
        return "citation_search"

    def schema(self) -> str:
        return "query string, hits long, ids array<string>, error string"

    def reader(self, schema) -> DataSourceReader:
        queries = [x for x in self.options.get("queries", "").split("\n") if x.strip()]
        r = _Reader(self.options, queries, _hits(int(self.options.get("most", "20"))))
        r.blanks = 2
        return r
