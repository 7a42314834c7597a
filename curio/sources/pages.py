"""Landed pages of paged sources as a data source, for batches and streams.

A crawl fetches page after page, and each page tells which one comes next: by how many records to skip, by an
offset, by a URL or by a token.  What it fetched is landed by :func:`land` as rows (source, epoch, cursor, next,
restart, first, value), sorted by cursor; an *epoch* is one crawl from its first page on.  The source follows the
cursors from page to page:

* a page that is not landed yet is where the next read, or the next batch of a stream, goes on;
* after the last page, and after one that says that its token is bad, the crawl begins anew with the next epoch.

``spark.read.format("pages")`` gives the pages of the whole chain, ``spark.readStream.format("pages")`` those that have
come since, with its place as the offset in the stream's checkpoint, so a failed batch is read again as it was
and nothing is lost or repeated.  Both plan ``pagesPerPartition`` pages a task.  Only the cursors, as it
were the listing of the source, are read where partitions are planned; tasks read the values, from the files and row
groups that hold their pages.

Options: ``path``; ``source`` (all that are landed, for none); ``pagesPerPartition`` (64).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from curio.sources import raw

SCHEMA = "source string, epoch int, cursor string, value string"
_VALUES = pa.schema([("source", pa.string()), ("epoch", pa.int32()), ("cursor", pa.string()), ("value", pa.string())])
#: Records of a page that is numbered by the records before it.
LIMIT = 100

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ---- landing


def _counted(items: str, total: str | None, limit: int) -> tuple[Column, Column]:
    """(next, restart) of pages numbered by records: none after an empty page or at the total."""
    after = F.col("cursor").cast("long") + limit
    empty = F.coalesce(F.json_array_length(F.get_json_object("value", items)), F.lit(0)) == 0
    ended = F.coalesce(after >= F.get_json_object("value", total).cast("long"), F.lit(False)) if total else F.lit(False)
    return F.when(~(empty | ended), after.cast("string")), F.lit(False)


def following(mode: str, limit: int = LIMIT) -> tuple[Column, Column, Column]:
    """(first, next, restart) of the landed pages (cursor, value) of one kind of source."""
    if mode == "skip":
        return F.col("cursor") == "0", *_counted("$.data", "$.info.total", limit)
    if mode == "offset":
        return F.col("cursor") == "0", *_counted("$.data.nodeQuery.entities", None, limit)
    if mode == "url":
        return F.col("cursor") == "", F.nullif(raw.next_url(F.col("value")), F.lit("")), F.lit(False)
    if mode == "token":
        token, bad = raw.token_of(F.col("value"))
        return F.col("cursor") == "", token, bad
    raise ValueError(f"unknown mode {mode!r}; there are skip, offset, url and token")


def land(pages: DataFrame, path: str, mode: str, limit: int = LIMIT) -> None:
    """Append pages (source, epoch, cursor, value); the first page of a crawl has cursor 0 or, for URLs and tokens, the empty text."""
    first, after, restart = following(mode, limit)
    rows = pages.select("source", F.col("epoch").cast("int").alias("epoch"), "cursor", after.alias("next"), restart.alias("restart"), first.alias("first"), "value")
    key = ["source", "epoch", "cursor"]
    rows.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("append").parquet(path)


# ---- the chain


class Place(NamedTuple):
    """Where a crawl goes on: at a page, or at the first page of an epoch (``cursor`` is None)."""

    epoch: int = 0
    cursor: str | None = None


class Landed(NamedTuple):
    next: str | None
    restart: bool
    file: str


def _dataset(path: str) -> ds.Dataset | None:
    """The landed files; the address of a file system that Arrow knows, or a local path."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if system.get_file_info(inner).type == fs.FileType.NotFound:
        return None
    return ds.dataset(inner, filesystem=system, format="parquet")


class Index:
    """The cursors of the landed pages of each source, without their values."""

    def __init__(self, path: str, source: str | None):
        self.pages: dict[str, dict[Place, Landed]] = {}
        self.firsts: dict[tuple[str, int], str] = {}
        data = _dataset(path)
        if data is None or not data.files:
            return
        wanted = None if source is None else ds.field("source") == source
        for part in sorted(data.get_fragments(), key=lambda f: f.path):
            for batch in part.to_batches(columns=["source", "epoch", "cursor", "next", "restart", "first"], filter=wanted):
                for s, e, c, n, r, f in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                    self.pages.setdefault(s, {}).setdefault(Place(e, c), Landed(n, r, part.path))  # a page landed twice counts once
                    if f:
                        self.firsts[s, e] = c

    def follow(self, source: str, at: Place, until: Place | None = None) -> tuple[list[tuple[str, int, str, str]], Place]:
        """Pages (source, epoch, cursor, file) from a place to another, or as far as pages are landed, and the place reached."""
        found, seen, pages = [], set(), self.pages.get(source, {})
        while at != until:
            here = Place(at.epoch, self.firsts.get((source, at.epoch))) if at.cursor is None else at
            page = pages.get(here) if here.cursor is not None else None
            if page is None:
                break
            if here in seen:
                raise ValueError(f"the pages of {source} lead back to {here.cursor!r}")
            seen.add(here)
            if not page.restart:
                found.append((source, here.epoch, here.cursor, page.file))
            at = Place(here.epoch + 1) if page.restart or page.next is None else Place(here.epoch, page.next)
        return found, at


def _offset(places: dict[str, Place]) -> dict:
    return {s: {"epoch": p.epoch, "cursor": p.cursor or "", "begun": p.cursor is not None} for s, p in sorted(places.items())}


def _places(offset: dict) -> dict[str, Place]:
    return {s: Place(o["epoch"], o["cursor"] if o["begun"] else None) for s, o in offset.items()}


# ---- the data source


@dataclass
class Pages(InputPartition):
    files: dict[str, list[tuple[str, int, str]]]  #: pages by the file that holds them


def _planned(pages: list[tuple[str, int, str, str]], size: int) -> list[Pages]:
    out = []
    for k in range(0, len(pages), size):
        files: dict[str, list] = {}
        for s, e, c, file in pages[k : k + size]:
            files.setdefault(file, []).append((s, e, c))
        out.append(Pages(files))
    return out


def _read(path: str, partition: Pages) -> Iterator[pa.RecordBatch]:
    system, _ = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    for file, pages in partition.files.items():
        wanted: dict[tuple[str, int], set[str]] = {}
        for s, e, c in pages:
            wanted.setdefault((s, e), set()).add(c)
        data = ds.dataset(file, filesystem=system, format="parquet")
        for (s, e), cursors in wanted.items():
            left = set(cursors)
            these = (ds.field("source") == s) & (ds.field("epoch") == e) & ds.field("cursor").isin(sorted(cursors))
            for batch in data.to_batches(columns=_VALUES.names, filter=these, batch_size=64):
                keep = []
                for c in batch.column("cursor").to_pylist():
                    keep.append(c in left)
                    left.discard(c)
                if any(keep):
                    yield batch.filter(pa.array(keep)).cast(_VALUES)


class _Batch(DataSourceReader):
    def __init__(self, path: str, source: str | None, size: int):
        self.path, self.source, self.size = path, source, size

    def partitions(self) -> list[Pages]:
        index = Index(self.path, self.source)
        return _planned([p for s in sorted(index.pages) for p in index.follow(s, Place())[0]], self.size)

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition) if partition is not None else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, source: str | None, size: int):
        self.path, self.source, self.size = path, source, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        index = Index(self.path, self.source)
        return _offset({s: index.follow(s, Place())[1] for s in index.pages})

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        index, begun = Index(self.path, self.source), _places(start)
        pages = []
        for s, to in _places(end).items():
            found, reached = index.follow(s, begun.get(s, Place()), to)
            if reached != to:
                raise ValueError(f"pages of {s} are gone: {reached} in place of {to}")
            pages += found
        return _planned(pages, self.size)

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, str | None, int]:
        if not self.options.get("path"):
            raise ValueError("the option path names the folder of the landed pages")
        return self.options["path"], self.options.get("source"), int(self.options.get("pagesPerPartition", 64))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._options())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(*self._options())


def register(spark: SparkSession) -> None:
    """Make the format ``pages`` known to the session."""
    spark.dataSource.register(PagedSource)


def resume_at(path: str, source: str) -> Place:
    """The page that a crawl fetches next: the first one that is not landed."""
    return Index(path, source).follow(source, Place())[1]


def crawled(spark: SparkSession, path: str, source: str, rows, checkpoint: str, store: str) -> int:
    """Bring the pages landed since the last call into the raw ``store``; returns the batches written.

    ``rows`` takes pages to raw rows (:func:`raw.from_pages` and the like).  A batch is a folder of its own number,
    so one that runs again after a failure replaces itself.
    """
    register(spark)
    done = []

    def write(batch: DataFrame, number: int) -> None:
        rows(batch).write.mode("overwrite").parquet(f"{store}/batch={number}")
        done.append(number)

    before = -1
    while before < len(done):  # a run that takes up a failed batch ends with it; what came since is for the next
        before = len(done)
        pages = spark.readStream.format("pages").option("path", path).option("source", source).load()
        pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(done)
