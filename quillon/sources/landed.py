"""Landed sitemaps and paged listings as Spark data sources that plan their own partitions."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillon.sources.framed import _store
from quillon.sources.shared import qualified

#: Pages of a listing that one partition reads.
PAGES = 20


@dataclass
class Sitemap(InputPartition):
    file: str


def _is_file(store: pfs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type == pfs.FileType.File


def _entries(store: pfs.FileSystem, path: str, tag: str) -> Iterator[dict[str, str]]:
    """Child texts (loc, lastmod, ...) of each `tag` element, read as a stream; namespaces don't count."""
    local = lambda e: e.tag.rpartition("}")[2]
    with store.open_input_stream(path, compression="detect") as f:
        for _, e in ET.iterparse(f):
            if local(e) == tag:
                yield {local(c): (c.text or "").strip() for c in e}
                e.clear()


class SitemapReader(DataSourceReader):
    """One partition a sitemap: the entry file is read for planning if it is an index, and so are indexes in it, each
    once; those that weren't landed are left out."""

    def __init__(self, options: dict):
        self.path, self.root = options["path"], options.get("root", "")
        self.old, self.new = options.get("from", ""), options.get("to", "")

    def mapped(self, url: str) -> str:
        return url.replace(self.old, self.new) if self.old else url

    def landed(self, url: str) -> str:
        """File of a sitemap's address: the path of the address below the root."""
        return f"{self.root.rstrip('/')}/{url.partition('://')[2].partition('/')[2]}"

    def partitions(self) -> list[Sitemap]:
        found, seen, todo = [], set(), [self.path]
        while todo:
            uri = todo.pop(0)
            store, path = _store(uri)
            if uri in seen or not _is_file(store, path):
                continue
            seen.add(uri)
            inner = [self.landed(self.mapped(x["loc"])) for x in _entries(store, path, "sitemap") if x.get("loc")]
            if inner:
                todo += inner
            else:
                found.append(Sitemap(uri))
        return found

    def read(self, partition: Sitemap | None) -> Iterator[tuple]:
        if partition is None:  # what Spark reads if there are no partitions
            return
        store, path = _store(partition.file)
        for x in _entries(store, path, "url"):
            if x.get("loc"):
                yield partition.file, self.mapped(x["loc"]), x.get("lastmod")


class SitemapFiles(DataSource):
    """Data source `sitemap`: options path, root, from and to (a part of addresses that is replaced)."""

    @classmethod
    def name(cls) -> str:
        return "sitemap"

    def schema(self) -> str:
        return "sitemap string, loc string, lastmod string"

    def reader(self, schema) -> SitemapReader:
        return SitemapReader(dict(self.options))


@dataclass
class Pages(InputPartition):
    area: str
    first: int
    last: int


class _Listing:
    """Pages of a listing at <path>/area=<area>/page=<n>.json, or in the only JSON file of a folder page=<n>."""

    def __init__(self, options: dict):
        self.path, self.records, self.total = options["path"], options.get("records", "collection"), options.get("total", "metadata.totalPages")
        self.step = int(options.get("pages", PAGES))

    def areas(self) -> list[str]:
        store, root = _store(self.path)
        return sorted(x.base_name.partition("=")[2] for x in store.get_file_info(pfs.FileSelector(root)) if x.base_name.startswith("area="))

    def file(self, area: str, page: int) -> str | None:
        store, root = _store(self.path)
        name = f"{root.rstrip('/')}/area={area}/page={page}"
        if _is_file(store, f"{name}.json"):
            return f"{name}.json"
        inside = store.get_file_info(pfs.FileSelector(name, allow_not_found=True))
        return next((x.path for x in inside if x.type == pfs.FileType.File and not x.base_name.startswith(("_", "."))), None)

    def page(self, area: str, page: int) -> dict:
        """A page's object; one that wasn't landed or isn't an object is empty."""
        file = self.file(area, page)
        if file is None:
            return {}
        with _store(self.path)[0].open_input_stream(file) as f:
            try:
                value = json.loads(f.read())
            except ValueError:
                return {}
        return value if isinstance(value, dict) else {}

    def total_pages(self, area: str) -> int:
        """What the first page says; 1 if it says nothing."""
        value = self.page(area, 1)
        for name in self.total.split("."):
            value = value.get(name) if isinstance(value, dict) else None
        return int(value or 1)

    def split(self, area: str, first: int, last: int) -> list[Pages]:
        return [Pages(area, i, min(i + self.step - 1, last)) for i in range(first, last + 1, self.step)]

    def rows(self, p: Pages) -> Iterator[tuple]:
        for n in range(p.first, p.last + 1):
            records = self.page(p.area, n).get(self.records)
            for i, record in enumerate(records if isinstance(records, list) else []):
                yield p.area, n, i, json.dumps(record, ensure_ascii=False)


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.listing = _Listing(options)

    def partitions(self) -> list[Pages]:
        return [p for area in self.listing.areas() for p in self.listing.split(area, 1, self.listing.total_pages(area))]

    def read(self, partition: Pages | None) -> Iterator[tuple]:
        return self.listing.rows(partition) if partition else iter(())


class ListingStream(DataSourceStreamReader):
    """Offsets are the pages landed of each area, from the first on without a gap."""

    def __init__(self, options: dict):
        self.listing, self.seen = _Listing(options), {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for area in self.listing.areas():
            n, total = self.seen.get(area, 0), self.listing.total_pages(area)
            while n < total and self.listing.file(area, n + 1) is not None:
                n += 1
            self.seen[area] = n
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return [p for area, last in sorted(end.items()) for p in self.listing.split(area, start.get(area, 0) + 1, last)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.listing.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PagedListing(DataSource):
    """Data source `listing`, batch and stream: options path, records, total and pages (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "area string, page int, position int, record string"

    def reader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options))

    def streamReader(self, schema) -> ListingStream:
        return ListingStream(dict(self.options))


def read_sitemaps(spark: SparkSession, path: str, root: str, old: str = "", new: str = "") -> DataFrame:
    """(sitemap, loc, lastmod) of a landed sitemap, or of all sitemaps that an index and the indexes in it name."""
    spark.dataSource.register(SitemapFiles)
    return spark.read.format("sitemap").options(path=qualified(spark, path), root=qualified(spark, root), **{"from": old, "to": new}).load()


def read_listing(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """(area, page, position, record as JSON) of all areas of a landed paged listing, several pages a partition; as a
    stream, pages are read once, in order, as they land."""
    spark.dataSource.register(PagedListing)
    return (spark.readStream if stream else spark.read).format("listing").options(path=qualified(spark, path), **options).load()
