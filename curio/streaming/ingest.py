"""Incremental ingest: landed shards to the raw store, once each, in bounded micro-batches.

A shard is a file of newline-delimited JSON, plain or gzipped.  One that cannot be read whole fails for itself: the other
shards of its batch are stored, its outcome says why, and the next call tries it again.
"""

from __future__ import annotations

import gzip
import json
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curio import schemas
from curio.sources import raw

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of the store: those of records have a key; one row for each shard and try, without, tells its outcome.
STORED = "source string, key string, value string, shard string, error string, lines long, batch int, retry int"


def _text(name: str, content: bytes | None) -> str:
    """The shard as text; an error if it is not whole or holds a line that is no JSON."""
    data = gzip.decompress(content or b"") if name.endswith(".gz") else content or b""
    text = data.decode("utf-8")
    for line in text.split("\n"):
        if line.strip():
            json.loads(line)
    return text


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, error, text): one of the two last is null."""
    for batch in batches:
        for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                text, error = _text(shard, content.as_py()), None
            except (OSError, EOFError, ValueError, zlib.error) as e:
                text, error = None, f"{type(e).__name__}: {e}"[:500]
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard]), "error": pa.array([error], pa.string()), "text": pa.array([text], pa.large_string()).cast(pa.string())})


def opened(shards: DataFrame) -> DataFrame:
    """(shard, error, text) of shards (path, content): each is read whole, or has an error."""
    return shards.select("path", "content").mapInArrow(_opened, "shard string, error string, text string")


def _rows(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.schema(STORED).option("basePath", store).parquet(store)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def outcomes(spark: SparkSession, store: str) -> DataFrame:
    """(shard, stored, error, lines, batch, retry): what became of each shard at its last try."""
    tries = _rows(spark, store)
    if tries is None:
        return spark.createDataFrame([], "shard string, stored boolean, error string, lines long, batch int, retry int")
    told = tries.where("key is null").select("shard", F.col("error").isNull().alias("stored"), "error", "lines", "batch", "retry")
    return raw.last_wins(told, ["shard"], ["batch", "retry"])


def _store(spark: SparkSession, paths: list[str], source: str, store: str, batch: int, retry: int) -> None:
    """Write the shards' rows and outcomes, from one reading; what runs again takes its own place."""
    read = opened(spark.read.format("binaryFile").load(paths))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\r?\n"), lambda x: F.trim(x) != "")
    record = lambda value: F.struct(value.alias("value"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("long").alias("lines"))
    told = F.struct(F.lit(None).cast("string").alias("value"), "error", F.size(lines).cast("long").alias("lines"))
    each = read.select("shard", F.explode(F.concat(F.transform(lines, record), F.array(told))).alias("r")).select("shard", "r.*")
    rows = each.select(F.lit(source).alias("source"), raw.ndjson_key(F.col("value")).alias("key"), "value", "shard", "error", "lines")
    rows.where("key is not null or lines is not null").write.mode("overwrite").parquet(f"{store}/batch={batch}/retry={retry}")


def retry_failed(spark: SparkSession, store: str, source: str = "smithsonian") -> int:
    """Try the shards again that failed at their last try; returns how many were tried.  Their rows stand with those of their first batch."""
    failed = outcomes(spark, store).where(~F.col("stored"))
    tried = 0
    for r in failed.groupBy("batch").agg(F.max("retry").alias("retry"), F.collect_list("shard").alias("shards")).orderBy("batch").collect():
        _store(spark, r["shards"], source, store, r["batch"], r["retry"] + 1)
        tried += len(r["shards"])
    return tried


def ingest(spark: SparkSession, landed: str, store: str, checkpoint: str, source: str = "smithsonian", files_per_batch: int = 100) -> int:
    """Bring the shards below ``landed`` that no earlier call has stored into ``store``; returns the batches written.

    Failed shards are tried again first.  The checkpoint logs which files the stream has seen; only their names go through
    the driver, ``files_per_batch`` at a time.  A batch is written into a folder of its own number, so one that runs again
    after a failure replaces itself; equal keys are settled when read, the latest batch winning.
    """
    retry_failed(spark, store, source)
    done = []

    def write(batch: DataFrame, number: int) -> None:
        if paths := [r["path"] for r in batch.collect()]:
            _store(spark, paths, source, store, number, 0)
            done.append(number)

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).load(landed)
    files.select("path").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(done)


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The raw store that batches were written to: the last value of each key."""
    rows = _rows(spark, store)
    return spark.createDataFrame([], schemas.RAW) if rows is None else raw.last_wins(rows.where("key is not null").select("source", "key", "value", "batch", "retry"), ["source", "key"], ["batch", "retry", "value"]).select("source", "key", "value")


def per_minute(events: DataFrame, column: str = "ts") -> DataFrame:
    """Counts on the grid of whole minutes on which the shown item changes."""
    return events.groupBy(F.window(column, "1 minute").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), "n")
