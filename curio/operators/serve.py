"""Serving queries: by collection, by style, pages, and a pick that stays for a minute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.functions.text import contains_like


def minute_bucket(at: Column, i: int = 0) -> Column:
    """Minutes since the epoch, less ``i``."""
    return (F.floor(F.unix_timestamp(at.cast("timestamp")) / 60) - i).cast("long")


def by_collection(images: DataFrame, table: DataFrame, collection_id: int) -> DataFrame:
    wanted = table.where(F.col("collection_id") == collection_id).select(F.col("image_id").alias("id"))
    return images.join(wanted, "id", "left_semi")


def by_style(images: DataFrame, style: str) -> DataFrame:
    return images.where(contains_like(F.col("style"), style))


def ranked(df: DataFrame, order: str = "id") -> DataFrame:
    """``df`` with ``n``, the place from 0 by ``order``: see :func:`curio.operators.load.allocate_ids`."""
    from curio.operators.load import allocate_ids

    return allocate_ids(df, [order], -1, "n")


#: Rows in a folder of the kept ranks.
RANGE_ROWS = 100_000
_RANK, _RANGE = "_rank", "_range"


def place_of(bucket: int, count: int) -> int:
    """The place from 0 that a minute shows, of ``count``: a step of the minimal standard generator spreads minutes evenly."""
    return bucket * 48_271 % 2_147_483_647 % count


def write_ranks(df: DataFrame, path: str, order: str = "id") -> None:
    """Keep the rows of ``df`` by their rank, a folder for each RANGE_ROWS, for as many picks as are asked for until the rows change."""
    from curio.operators.load import allocate_ids

    kept = allocate_ids(df, [order], -1, _RANK).withColumn(_RANGE, F.floor(F.col(_RANK) / RANGE_ROWS))
    kept.write.partitionBy(_RANGE).parquet(f"{path}/rows")
    df.limit(0).write.parquet(f"{path}/columns")
    df.agg(F.count("*").alias("n")).write.parquet(f"{path}/count")


def pick(spark: SparkSession, path: str, bucket: int) -> DataFrame:
    """The row that a minute shows, of those kept by :func:`write_ranks`: the same all through it; none of no rows.

    Its place tells the one folder that is read, and the statistics of the file skip the rest of it.
    """
    count = spark.read.schema("n long").parquet(f"{path}/count").first()["n"]
    columns = spark.read.parquet(f"{path}/columns")
    if not count:
        return columns
    n = place_of(bucket, count)
    rows = spark.read.schema(columns.schema.add(_RANK, "long").add(_RANGE, "long")).parquet(f"{path}/rows")
    return rows.where((F.col(_RANGE) == n // RANGE_ROWS) & (F.col(_RANK) == n)).drop(_RANK, _RANGE)


def page_after(df: DataFrame, last: int, n: int = 5000, key: str = "id") -> DataFrame:
    """The next ``n`` rows after a key."""
    return df.where(F.col(key) > last).orderBy(key).limit(n)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
