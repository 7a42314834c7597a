"""Stored tables: bucketed by key, so that joins shuffle the batch alone, and versioned together, so that readers see whole states.

Spark buckets tables of its catalogue only.  Here a table is a folder of bucketed files; a session that reads
or writes it names it in its catalogue as an external table, whose files stay when the name goes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curio import schemas
from curio.sources import raw

#: Columns that tables are bucketed by: those by which batches are matched with them.
KEYS = {"images": "source_url", "image_artists": "image_id", "image_dates": "image_id", "image_translations": "image_id", "image_artist_names": "image_artist_id"}


def _missing(spark: SparkSession, read: Callable[[], DataFrame]) -> DataFrame | None:
    """What is read, or None where there is no such folder yet."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _named(spark: SparkSession, folder: str, schema: T.StructType, key: str, buckets: int, partitioned: str | None = None) -> str:
    """The session's name of the table in ``folder``, which is new or holds files bucketed the same way."""
    name = f"curio_{hashlib.md5(f'{folder} {schema.simpleString()}'.encode()).hexdigest()}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        dealt = f"PARTITIONED BY (`{partitioned}`) " if partitioned else ""
        quoted = folder.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {dealt}CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{quoted}'")
        if partitioned:
            spark.createDataFrame([], schema).write.mode("append").parquet(folder)  # a folder without rows, if there is none yet
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return name


def write_bucketed(df: DataFrame, folder: str, key: str, buckets: int, placed: bool = False) -> None:
    """A new folder of ``df`` in buckets by ``key``.

    ``placed`` says that rows of a bucket stand in one partition already, as after a join with a table of as many
    buckets: they are written as they are, and not shuffled.
    """
    dealt = df if placed else df.repartition(buckets, key)
    name = f"curio_{uuid.uuid4().hex}"
    dealt.write.format("parquet").bucketBy(buckets, key).option("path", folder).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


def read_bucketed(spark: SparkSession, folder: str, schema: T.StructType, key: str, buckets: int) -> DataFrame:
    """The table in ``folder``; joins and groups by ``key`` need no shuffle of it, and one key is looked up in one bucket."""
    return spark.table(_named(spark, folder, schema, key, buckets))


class Snapshot:
    """All tables as of one version: what is read through it stays as it was, whatever is committed meanwhile."""

    def __init__(self, spark: SparkSession, path: str, version: int, tables: dict[str, tuple[str, int]]):
        self.spark, self.path, self.version, self.tables = spark, path, version, tables

    def read(self, table: str) -> DataFrame:
        if table not in self.tables:
            return schemas.empty(self.spark, table)
        folder, buckets = self.tables[table]
        at, schema = f"{self.path}/{table}/{folder}", schemas.TABLES[table]
        return read_bucketed(self.spark, at, schema, KEYS[table], buckets) if buckets else self.spark.read.schema(schema).parquet(at)


class ConstraintError(ValueError):
    """A version that breaks constraints."""


class Staged(NamedTuple):
    """A written table that no version names yet."""

    folder: str
    buckets: int
    rows: DataFrame


class Store:
    """Tables in a folder, committed together.

    A job reads one :class:`Snapshot` and writes the tables that it makes of it into folders of their own; then one
    pointer names the folders of all tables, those that it left as they were among them.  So a reader sees the new
    images with their new artists or the old ones with the old, and a job that dies leaves the current version as it
    was.  A pointer is a new folder named by its version: of two jobs that began with one version the second fails.
    ``buckets`` is the number of buckets of tables written anew; 0 writes plain files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 0):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def snapshot(self) -> Snapshot:
        schema = "version int, table string, folder string, buckets int"
        pointers = _missing(self.spark, lambda: self.spark.read.schema(schema).option("recursiveFileLookup", True).json(f"{self.path}/current"))
        last = None if pointers is None else pointers.agg(F.max("version")).first()[0]
        if last is None:
            return Snapshot(self.spark, self.path, 0, {})
        rows = pointers.where(F.col("version") == last).collect()  # a row a table
        return Snapshot(self.spark, self.path, last, {r["table"]: (r["folder"], r["buckets"]) for r in rows})

    def version(self) -> int:
        return self.snapshot().version

    def read(self, table: str) -> DataFrame:
        return self.snapshot().read(table)

    def stage(self, table: str, df: DataFrame, before: Snapshot, placed: bool = False) -> Staged:
        """Write ``df`` as the next version of a table, which counts once it is committed; further columns stay readable until then.

        ``placed`` says that each partition holds rows of one of the table's buckets, as the upserts leave them.
        """
        bucketed = before.tables.get(table, ("", 0))[1] if placed else 0
        buckets = bucketed or (self.buckets if table in KEYS else 0)
        folder = f"v{before.version + 1}-{uuid.uuid4().hex}"
        at = f"{self.path}/{table}/{folder}"
        if not buckets:
            df.write.parquet(at)
            return Staged(folder, 0, self.spark.read.schema(df.schema).parquet(at))
        write_bucketed(df, at, KEYS[table], buckets, placed=bool(bucketed))
        return Staged(folder, buckets, read_bucketed(self.spark, at, df.schema, KEYS[table], buckets))

    def faults(self, tables: dict[str, Staged], before: Snapshot) -> DataFrame:
        """(table, rule, n): what the staged tables break of the constraints, parents being staged ones or those of ``before``."""
        new = Snapshot(self.spark, self.path, before.version, before.tables | {t: (s.folder, s.buckets) for t, s in tables.items()})
        asked = set(tables) | {schemas.PARENTS[t][1] for t in tables if t in schemas.PARENTS} | {t for t, (_, parent) in schemas.PARENTS.items() if parent in tables}
        return schemas.faults({t: new.read(t) for t in sorted(asked & new.tables.keys())})

    def commit(self, tables: dict[str, DataFrame | Staged], after: Snapshot | None = None, checked: bool = False) -> Snapshot:
        """The version after ``after`` (the current one for none), in which ``tables`` are new and the others as before.

        With ``checked`` a version that breaks a constraint is refused: the tables were written, but nothing names them.
        """
        before = after or self.snapshot()
        staged = {t: self.stage(t, new.select(*(f.name for f in schemas.TABLES[t])), before) if isinstance(new, DataFrame) else new for t, new in tables.items()}
        if checked and (broken := self.faults(staged, before).collect()):  # a row for each rule at most
            raise ConstraintError("; ".join(f"{r['table']}: {r['rule']} ({r['n']})" for r in sorted(broken)))
        named = before.tables | {t: (s.folder, s.buckets) for t, s in staged.items()}
        version = before.version + 1
        pointer = self.spark.createDataFrame([(version, t, f, b) for t, (f, b) in sorted(named.items())], "version int, table string, folder string, buckets int")
        pointer.coalesce(1).write.mode("errorifexists").json(f"{self.path}/current/v{version}")
        return Snapshot(self.spark, self.path, version, named)

    def write(self, table: str, df: DataFrame, after: Snapshot | None = None) -> int:
        """Commit one table; returns the version."""
        return self.commit({table: df}, after).version


class RawStore:
    """The raw layer in a folder: partitioned by source, bucketed by key; a put appends, the latest put of a key counts.

    A key is looked up in one bucket of one source, and a put shuffles and writes its batch alone.
    """

    SCHEMA = T.StructType([*(f for f in schemas.RAW if f.name != "source"), T.StructField("put", T.IntegerType()), schemas.RAW["source"]])

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _table(self) -> str:
        return _named(self.spark, self.path, self.SCHEMA, "key", self.buckets, "source")

    def rows(self) -> DataFrame:
        """All puts of all keys."""
        return self.spark.table(self._table())

    def put(self, batch: DataFrame, order: list[str] | None = None) -> int:
        """Append the batch (source, key, value, and columns to order equal keys by); returns its number."""
        number = (self.rows().agg(F.max("put")).first()[0] or 0) + 1
        new = raw.last_wins(batch, ["source", "key"], order or ["value"]).select("key", "value", F.lit(number).alias("put"), "source")
        writer = new.repartition(self.buckets, "key").write.format("parquet").mode("append").partitionBy("source").bucketBy(self.buckets, "key").option("path", self.path)
        writer.saveAsTable(self._table())
        return number

    def get(self, source: str, key: str) -> DataFrame:
        """The row of a key: one bucket is read."""
        found = self.rows().where((F.col("source") == source) & (F.col("key") == key))
        return raw.last_wins(found.select("source", "key", "value", "put"), ["source", "key"], ["put"]).select("source", "key", "value")

    def scan(self, source: str | None = None) -> DataFrame:
        """Each key with its last value; rows of a key stand in one bucket, so nothing is shuffled."""
        rows = self.rows() if source is None else self.rows().where(F.col("source") == source)
        return raw.last_wins(rows.select("source", "key", "value", "put"), ["source", "key"], ["put"]).select("source", "key", "value")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Rows of ``wanted`` (source, key) that are still to fetch: ``wanted`` is shuffled, the store is not."""
        # keys are grouped with all their sources first, so that both sides are matched by the key alone
        known = self.rows().groupBy("key").agg(F.collect_set("source").alias("_sources"))
        return wanted.join(known, "key", "left").where(~F.coalesce(F.array_contains("_sources", F.col("source")), F.lit(False))).select(*wanted.columns)
