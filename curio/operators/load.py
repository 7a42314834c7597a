"""Incremental load: change-detecting upserts that keep surrogate ids, and versioned tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curio import schemas, tables
from curio.functions import dates
from curio.functions.text import iso_now
from curio.operators.store import Snapshot, Store


def allocate_ids(new: DataFrame, order: list[str], base: int = 0, into: str = "id") -> DataFrame:
    """``new`` with ids base + 1, base + 2, ... by ``order``; rows that tie are numbered in any order.

    Rows are range-partitioned, sorted and numbered within their partition, and written once: sizes and ids
    come from the same table, however often Spark would deal the rows anew.  Only the partitions' sizes, one
    row each, are summed up in one place.
    """
    part, seq = tables.unused(new.columns, "_part", "_seq")
    ordered = new.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = tables.cut(ordered.withColumns({part: F.spark_partition_id(), seq: F.monotonically_increasing_id()}), "ordered")
    sizes = ordered.groupBy(F.col(part).alias("_p")).agg(F.count("*").alias("_n"), F.min(seq).alias("_lo"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n") - F.col("_lo")).alias("_before"))
    numbered = ordered.select(F.struct("*").alias("r")).join(F.broadcast(before), F.col(f"r.{part}") == F.col("_p"))
    return numbered.select(*(F.col("r")[c].alias(c) for c in new.columns), (F.lit(base) + F.col("_before") + F.col("r")[seq] + 1).cast("long").alias(into))


def changed(old: str, new: str, columns: tuple[str, ...]) -> Column:
    """Whether any column differs, nulls being equal to each other."""
    return ~reduce(lambda a, b: a & b, (F.col(f"{old}.`{c}`").eqNullSafe(F.col(f"{new}.`{c}`")) for c in columns))


def dedupe_records(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One record a key: the last by ``order``, with ``_first``, the place of the first."""
    place = F.struct(*order)
    rows = F.struct(*(F.col(f"`{c}`") for c in records.columns))
    best = records.groupBy(key).agg(F.max_by(rows, place).alias("_r"), F.min(place).alias("_first"))
    return best.select(*(F.col("_r")[c].alias(c) for c in records.columns), "_first")


def upsert(table: DataFrame, records: DataFrame, key: str, columns: tuple[str, ...], now: Column, order: list[str]) -> DataFrame:
    """The whole table after the upsert, with ``result``: inserted, updated, unchanged, or null for rows not in ``records``.

    Every join is by ``key``: of a table that is bucketed by it, nothing is shuffled, only the records are.  ``table`` has id, first_seen_at, updated_at and ``columns`` (``key`` among them); ``records`` has
    ``columns`` and ``order``.  Of records with one key the last counts; new ids follow the first ones' order.
    """
    last = dedupe_records(records, key, order)
    base = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    fresh = last.join(table.select(key), key, "left_anti")
    ids = allocate_ids(fresh.select(key, "_first"), ["_first", key], base).select(key, F.col("id").alias("_id"))
    n = last.join(ids, key, "left").alias("n")
    o = table.alias("o")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    is_new, is_old = F.col("o.id").isNull(), F.col(f"n.{key}").isNull()
    differs = changed("o", "n", columns)
    result = F.when(is_old, F.lit(None)).when(is_new, "inserted").when(differs, "updated").otherwise("unchanged")
    take = [F.when(is_old, F.col(f"o.`{c}`")).otherwise(F.col(f"n.`{c}`")).alias(c) for c in columns]
    return both.select(
        F.coalesce("o.id", "n._id").alias("id"),
        *take,
        F.coalesce(F.col("o.first_seen_at"), now).alias("first_seen_at"),
        F.when(result.isin("inserted", "updated"), now).otherwise(F.col("o.updated_at")).alias("updated_at"),
        result.alias("result"),
    )


def upsert_images(images: DataFrame, records: DataFrame, now: Column | None = None) -> DataFrame:
    """:func:`upsert` of common records by ``source_url``; ``now`` is the time of the run for none."""
    order = [c for c in ("source_order", "key", "item") if c in records.columns]
    return upsert(images, records, "source_url", schemas.IMAGE_COLUMNS, iso_now() if now is None else now, order or ["source_url"])


def child_rows(records: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(touched images (image_id), rows (image_id, position, artist columns)) of records whose images are loaded."""
    order = [c for c in ("source_order", "key", "item") if c in records.columns]
    last = dedupe_records(records, "source_url", order or ["source_url"])
    known = last.join(images.select("source_url", F.col("id").alias("image_id")), "source_url")
    rows = known.select("image_id", F.posexplode("artists").alias("position", "a")).select("image_id", "position", "a.*")
    return known.select("image_id"), rows


def sync_children(table: DataFrame, touched: DataFrame, rows: DataFrame, columns: tuple[str, ...], parent: str = "image_id", buckets: int = 0) -> DataFrame:
    """The child table after the lists of the touched parents were replaced, with ``result``.

    Rows are matched by (parent, position): kept ids, changed columns updated, new positions inserted,
    surplus positions of touched parents deleted (they are gone from the output).  Parents that were
    not touched pass through with a null result; other columns of the table are left as they are.

    A parent's new list is one row, as it was in its record, so every join and group is by the parent alone: of a
    table that is bucketed by it nothing is shuffled, only the new lists are.  ``buckets`` places inserted rows likewise.
    """
    base = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    key = [parent, "position"]
    rest = [c for c in table.columns if c not in ("id", *key, *columns)]
    one = F.struct("position", *(F.col(f"`{c}`") for c in columns)).alias("_new")
    given = rows.select(parent, one, F.lit(False).alias("_touched"))
    marks = touched.select(parent, F.lit(None).cast(given.schema["_new"].dataType).alias("_new"), F.lit(True).alias("_touched"))
    lists = tables.cut(given.unionByName(marks).groupBy(parent).agg(F.collect_list("_new").alias("_list"), F.max("_touched").alias("_touched")), "child-lists")
    at = lambda c: F.get(F.filter("_list", lambda x: x["position"] == F.col("o.position")), F.lit(0))[c]
    o = table.alias("o").join(lists, parent, "left")
    met = F.coalesce(F.exists("_list", lambda x: x["position"] == F.col("o.position")), F.lit(False))
    kept = o.where(met | ~F.coalesce("_touched", F.lit(False))).withColumn("_met", met)
    same = reduce(lambda a, b: a & b, (F.col(f"o.`{c}`").eqNullSafe(at(c)) for c in columns))
    result = F.when(F.col("_met"), F.when(same, "unchanged").otherwise("updated"))
    pick = lambda c: F.when(F.col("_met"), at(c)).otherwise(F.col(f"o.`{c}`")).alias(c)
    old = kept.select(F.col("o.id").alias("id"), *(F.col(f"o.`{c}`").alias(c) for c in key), *(pick(c) for c in columns), *(F.col(f"o.`{c}`") for c in rest), result.alias("result"))
    have = table.groupBy(parent).agg(F.collect_set("position").alias("_have"))
    new = lists.join(have, parent, "left").select(parent, F.explode(F.filter("_list", lambda x: ~F.coalesce(F.array_contains("_have", x["position"]), F.lit(False)))).alias("_n"))
    fresh = allocate_ids(new.select(parent, "_n.*"), key, base)
    fresh = fresh.repartition(buckets, parent) if buckets else fresh
    blank = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema}
    return old.unionByName(fresh.select("id", *key, *(F.col(f"`{c}`") for c in columns), *(blank[c] for c in rest), F.lit("inserted").alias("result")))


def sync_artists(table: DataFrame, touched: DataFrame, rows: DataFrame, buckets: int = 0) -> DataFrame:
    return sync_children(table, touched, rows, schemas.ARTIST_COLUMNS, buckets=buckets)


def image_dates(images: DataFrame, version: str = dates.RULE_VERSION) -> DataFrame:
    """The derived dates of all images: a map without a shuffle."""
    return dates.resolve(images).select(F.col("id").alias("image_id"), "date_start", "date_end", "date_precision", F.lit(version).alias("rule_version"))


def upsert_dates(table: DataFrame, images: DataFrame, sources: list[str] | None = None, version: str = dates.RULE_VERSION) -> DataFrame:
    """The date table after the named sources (all for none) were derived anew; dates of other images stay."""
    wanted = images if not sources else images.where(F.col("source").isin(*sources))
    new = image_dates(wanted, version)
    return table.join(new.select("image_id"), "image_id", "left_anti").select(*new.columns).unionByName(new)


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def load_stats(loaded: DataFrame) -> DataFrame:
    """One row: how many records were inserted, updated, left unchanged, and all of them."""
    one = lambda r: F.count(F.when(F.col("result") == r, 1)).alias(r)
    return loaded.agg(one("inserted"), one("updated"), one("unchanged"), F.count("result").alias("total"))


def load_records(store: Store, records: DataFrame, now: Column | None = None, checked: bool = False) -> tuple[Snapshot, DataFrame]:
    """One transaction: images and the lists of their artists become current together, or neither does.

    Returns the new version and its :func:`load_stats`.  Of bucketed tables neither the joins nor the writes shuffle more
    than the records and what is new.
    """
    before = store.snapshot()
    images = store.stage("images", upsert_images(before.read("images"), records, now), before, placed=True)
    touched, rows = child_rows(records, images.rows)
    parts = before.tables.get("image_artists", ("", 0))[1]
    artists = store.stage("image_artists", sync_artists(before.read("image_artists"), touched, rows, parts), before, placed=True)
    return store.commit({"images": images, "image_artists": artists}, before, checked), load_stats(images.rows)
