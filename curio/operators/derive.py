"""Derived layers: translations of titles and names, staleness, names to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.sources import raw


def seed_names(artists: DataFrame, lang: str, now: Column) -> DataFrame:
    """Names in the original language that the source itself gives, as rows of image_artist_names."""
    kept = artists.where(F.col("name_original_language").isNotNull())
    return kept.select(
        F.col("id").alias("image_artist_id"), F.lit(lang).alias("lang"), F.col("name_original_language").alias("name"), F.lit(None).cast("string").alias("confidence"), F.lit("source").alias("method"),
        F.col("name_raw").alias("name_original"), now.alias("translated_at"),
    )


def _put(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with the rows of ``new`` in place of those with their keys; of new rows with one key the last by ``order``, then by their columns."""
    rest = [c for c in table.columns if c not in key]
    new = raw.last_wins(new, key, [c for c in ("order", *rest) if c in new.columns])
    return table.join(new.select(*key), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def _order(csv: DataFrame) -> list[str]:
    return ["order"] if "order" in csv.columns else []


def put_seed(names: DataFrame, artists: DataFrame, lang: str, now: Column) -> DataFrame:
    """image_artist_names after seeding."""
    return _put(names, seed_names(artists, lang, now), ["image_artist_id", "lang"])


def read_translations(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Rows (``key``, ``value``, confidence, method, order) of CSV files with a header, ``key`` being source_url or name_raw.

    Keys are taken as they stand, blanks included, since they are matched exactly; rows without a key or a value go.
    ``order`` is the file's name and the place in it, so the last row of a key wins.
    """
    rows = spark.read.csv(path, header=True, schema=f"`{key}` string, `{value}` string, confidence string, method string", multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="", enforceSchema=False)
    placed = rows.withColumn("order", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row")))
    return placed.where((F.coalesce(key, F.lit("")) != "") & (F.coalesce(value, F.lit("")) != ""))


def apply_titles(translations: DataFrame, images: DataFrame, csv: DataFrame, lang: str, now: Column) -> DataFrame:
    """image_translations after rows (source_url, text, confidence, method, perhaps order) were applied to the images that they name."""
    met = csv.where(F.col("text").isNotNull()).join(images.select("id", "source_url", "title"), "source_url")
    new = met.select(F.col("id").alias("image_id"), F.lit("title").alias("field"), F.lit(lang).alias("lang"), "text", "confidence", "method", F.col("title").alias("source_text"), now.alias("translated_at"), *_order(csv))
    return _put(translations, new, ["image_id", "field", "lang"])


def apply_names(names: DataFrame, artists: DataFrame, csv: DataFrame, lang: str, now: Column) -> DataFrame:
    """image_artist_names after rows (name_raw, name, confidence, method, perhaps order) were fanned out to all entries of that name.

    What the source itself gave (method ``source``) is never replaced.
    """
    met = csv.where(F.col("name").isNotNull()).join(artists.select("id", "name_raw"), "name_raw")
    new = met.select(F.col("id").alias("image_artist_id"), F.lit(lang).alias("lang"), "name", "confidence", "method", F.col("name_raw").alias("name_original"), now.alias("translated_at"), *_order(csv))
    protected = names.where(F.col("method") == "source").select("image_artist_id", "lang")
    return _put(names, new.join(protected, ["image_artist_id", "lang"], "left_anti"), ["image_artist_id", "lang"])


def stale_titles(translations: DataFrame, images: DataFrame) -> DataFrame:
    """Translations whose original has changed since."""
    now = images.select(F.col("id").alias("image_id"), F.col("title").alias("current"))
    return translations.where(F.col("field") == "title").join(now, "image_id").where(~F.col("source_text").eqNullSafe(F.col("current")))


def stale_names(names: DataFrame, artists: DataFrame) -> DataFrame:
    """Names whose raw name has changed since, or whose entry has moved."""
    now = artists.select(F.col("id").alias("image_artist_id"), F.col("name_raw").alias("current"))
    return names.join(now, "image_artist_id").where(~F.col("name_original").eqNullSafe(F.col("current")))


def display_names(artists: DataFrame, names: DataFrame, lang: str, preferred: DataFrame | None = None) -> DataFrame:
    """(id, display_name): the preferred (id, name) if any, else the translated, else the raw name."""
    translated = names.where(F.col("lang") == lang).select(F.col("image_artist_id").alias("id"), F.col("name").alias("_t"))
    out = artists.select("id", "name_raw").join(translated, "id", "left")
    first = []
    if preferred is not None:
        out = out.join(preferred.select("id", F.col("name").alias("_p")), "id", "left")
        first = [F.col("_p")]
    return out.select("id", F.coalesce(*first, "_t", "name_raw").alias("display_name"))


def bucket_roles(artists: DataFrame, mapping: DataFrame) -> DataFrame:
    """``artists`` with role_bucket from a table (role_raw, role_bucket); roles that it lacks keep null."""
    table = mapping.select("role_raw", F.col("role_bucket").alias("_b"))
    return artists.join(table, "role_raw", "left").withColumn("role_bucket", F.col("_b")).select(*artists.columns)
