"""Recorded pages of paged services as a data source, in batch and as a stream.

A service's answers are recorded as JSON files, ``<root>/<group>/<page>.json``:
an object with ``at``, the Unix time it was fetched, and ``rows``, a list of
objects.  A group, such as a company, is one partition.  Filters on ``grp`` reach
the source, so the pages of other groups are not opened; pages older than
``ttl`` seconds are expired, and are read only as a fallback, for groups without
a fresh page and if ``stale`` allows it.  A stream gives each page once, in the order
of its number.

Nothing here opens a network connection; whoever fetches writes pages.
The root is a path that all executors can read.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "grp string, page int, fetched bigint, stale boolean, body string"


class Pages(InputPartition):
    """The pages of one group, and whether they stand in for fresh ones."""

    def __init__(self, group: str, pages: list[int], stale: bool):
        super().__init__((group, tuple(pages), stale))
        self.group, self.pages, self.stale = group, pages, stale


def _path(root: str, group: str, page: int) -> str:
    return os.path.join(root, group, f"{page}.json")


def _numbers(root: str, group: str) -> list[int]:
    names = (os.path.basename(p)[:-5] for p in glob.glob(os.path.join(glob.escape(root), glob.escape(group), "*.json")))
    return sorted(int(n) for n in names if n.isdigit())


def _load(root: str, group: str, page: int) -> dict:
    with open(_path(root, group, page), encoding="utf-8") as f:
        return json.load(f)


def _rows(root: str, part: Pages) -> Iterator[tuple]:
    for page in part.pages:
        held = _load(root, part.group, page)
        for row in held["rows"]:
            yield part.group, page, int(held["at"]), part.stale, json.dumps(row, ensure_ascii=False, sort_keys=True)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.ttl, self.now = options["path"], int(options.get("ttl", 0)), int(options.get("now", 0))
        self.allow_stale = options.get("stale", "true").lower() == "true"
        self.groups: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if f.__class__ in (EqualTo, In) and f.attribute == ("grp",):
                self.groups = wanted if self.groups is None else self.groups & wanted
            else:
                yield f

    def partitions(self) -> list[Pages]:
        """A partition for each group with pages; only names are listed where pages do not expire."""
        every = sorted(d.name for d in os.scandir(self.root) if d.is_dir())
        out = []
        for group in (g for g in every if self.groups is None or g in self.groups):
            pages = _numbers(self.root, group)
            fresh = [p for p in pages if self.now - int(_load(self.root, group, p)["at"]) < self.ttl] if self.ttl else pages
            chosen = fresh or (pages if self.allow_stale else [])
            if chosen:
                out.append(Pages(group, chosen, not fresh))
        return out or [Pages("", [], False)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _rows(self.root, partition)


class PagedStream(DataSourceStreamReader):
    """Offsets are the number of the last page of each group."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {d.name: numbers[-1] for d in os.scandir(self.root) if d.is_dir() and (numbers := _numbers(self.root, d.name))}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        new = {g: [p for p in _numbers(self.root, g) if start.get(g, -1) < p <= last] for g, last in sorted(end.items())}
        return [Pages(g, pages, False) for g, pages in new.items() if pages]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _rows(self.root, partition)

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    """``spark.dataSource.register(PagedSource)``, then ``spark.read.format("paged")`` with ``path``, and ``ttl``, ``now`` and ``stale`` as options."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options)

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(self.options)


def register(spark) -> None:
    """Make the source known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
