"""Tables of the catalogue and their constraints."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCES = ("aic", "met", "parismusees", "rijksmuseum", "smithsonian", "cleveland")
#: Names of the sources for people.
LABELS = {"aic": "AIC", "met": "MET", "parismusees": "Paris Musées", "rijksmuseum": "Rijksmuseum", "smithsonian": "Smithsonian", "cleveland": "Cleveland Museum of Art"}
PRECISIONS = ("exact", "circa", "before", "after", "range", "century", "decade", "unknown")
METHODS = ("llm", "manual", "source")

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType()}


def _struct(fields: str) -> T.StructType:
    """A struct of plain fields; needs no session, as Spark's own reading of such text does."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))])


ARTIST = _struct("name_raw string, role_raw string, qualifier_raw string, birth_year int, death_year int, source_artist_id string, authority_urls string, name_original_language string")
RECORD = _struct(
    "source string, source_id string, source_url string, image_url string, title string, artist string, date string, "
    "date_raw_start int, date_raw_end int, date_raw_precision string, category string, style string, medium string, "
    "origin string, dimensions string, credit string, description string"
).add("artists", T.ArrayType(ARTIST))
IMAGE_COLUMNS = tuple(f.name for f in RECORD if f.name != "artists")
ARTIST_COLUMNS = tuple(f.name for f in ARTIST)

RAW = _struct("source string, key string, value string")
IMAGES = T.StructType([T.StructField("id", T.LongType()), *(f for f in RECORD if f.name != "artists"), T.StructField("first_seen_at", T.StringType()), T.StructField("updated_at", T.StringType())])
IMAGE_ARTISTS = T.StructType([*_struct("id long, image_id long, position int"), *ARTIST, T.StructField("role_bucket", T.StringType())])
IMAGE_DATES = _struct("image_id long, date_start int, date_end int, date_precision string, rule_version string")
IMAGE_TRANSLATIONS = _struct("image_id long, field string, lang string, text string, confidence string, method string, source_text string, translated_at string")
IMAGE_ARTIST_NAMES = _struct("image_artist_id long, lang string, name string, confidence string, method string, name_original string, translated_at string")
COLLECTIONS = _struct("id long, title string, author string, description string, index_image_id string, tag string")
COLLECTION_IMAGES = _struct("id long, collection_id long, image_id long")

TABLES = {
    "images": IMAGES, "image_artists": IMAGE_ARTISTS, "image_dates": IMAGE_DATES, "image_translations": IMAGE_TRANSLATIONS,
    "image_artist_names": IMAGE_ARTIST_NAMES, "collections": COLLECTIONS, "collection_images": COLLECTION_IMAGES,
}
KEYS = {
    "images": [("id",), ("source_url",)], "image_artists": [("id",), ("image_id", "position")], "image_dates": [("image_id",)], "image_translations": [("image_id", "field", "lang")],
    "image_artist_names": [("image_artist_id", "lang")], "collections": [("id",)], "collection_images": [("id",)],
}
REQUIRED = {
    "images": ("source", "source_url", "first_seen_at", "updated_at"), "image_artists": ("image_id", "position", "name_raw"), "image_dates": ("image_id", "date_precision"),
    "image_translations": ("image_id", "field", "lang", "text"), "image_artist_names": ("image_artist_id", "lang", "name"), "collections": ("id",), "collection_images": ("collection_id", "image_id"),
}
PARENTS = {"image_artists": ("image_id", "images"), "image_dates": ("image_id", "images"), "image_translations": ("image_id", "images"), "image_artist_names": ("image_artist_id", "image_artists")}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


#: So many rows of a table are grouped in one partition when keys are checked.
GROUPED_ROWS = 1_000_000


def _repeated(df: DataFrame, key: tuple[str, ...], rows: int) -> DataFrame:
    """Keys of several rows.  Rows are dealt by their key first, into partitions whose number follows that of the rows, so a hash table's size does not."""
    keys = df.select(*key)
    dealt = keys.repartition(math.ceil(rows / GROUPED_ROWS), *key) if rows > GROUPED_ROWS else keys
    return dealt.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")


def faults(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, n): how many rows or keys break each constraint; no row where none does."""
    out = None
    for name, df in tables.items():
        rows = df.count()
        found = [_repeated(df, key, rows).select(F.lit(name).alias("table"), F.lit(f"unique {', '.join(key)}").alias("rule")) for key in KEYS[name]]
        found += [df.where(F.col(c).isNull()).select(F.lit(name).alias("table"), F.lit(f"not null {c}").alias("rule")) for c in REQUIRED[name]]
        if name == "image_dates":
            found.append(df.where(~F.col("date_precision").isin(*PRECISIONS)).select(F.lit(name).alias("table"), F.lit("date_precision").alias("rule")))
        if name in PARENTS and PARENTS[name][1] in tables:
            column, parent = PARENTS[name]
            found.append(df.join(tables[parent].select(F.col("id").alias(column)), column, "left_anti").select(F.lit(name).alias("table"), F.lit(f"orphans {column}").alias("rule")))
        for f in found:
            out = f if out is None else out.unionByName(f)
    return out.groupBy("table", "rule").agg(F.count("*").alias("n"))


def cascade(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without children whose parent is gone, parents first."""
    out = dict(tables)
    for child in ("image_artists", "image_dates", "image_translations", "image_artist_names"):
        if child in out:
            column, parent = PARENTS[child]
            out[child] = out[child].join(out[parent].select(F.col("id").alias(column)), column, "left_semi").select(*out[child].columns)
    return out
