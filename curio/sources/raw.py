"""The raw layer: (source, key, value) rows, partitioned by source, last write wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curio import schemas
from curio.sources import xmlpull

#: Units of one source that are taken.
UNITS = ("saam", "npg", "hmsg", "fsg", "chndm", "nmafa")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last by ``order``."""
    place = F.struct(*order)
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), place).alias("_r"))
    return best.select(*(F.col("_r")[c].alias(c) for c in df.columns))


def put(store: DataFrame, batch: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The store after ``batch`` (source, key, value, and columns to order equal keys by)."""
    new = last_wins(batch, ["source", "key"], order or ["value"]).select("source", "key", "value")
    return store.join(new, ["source", "key"], "left_anti").select("source", "key", "value").unionByName(new)


def get(store: DataFrame, source: str, key: str) -> DataFrame:
    return store.where((F.col("source") == source) & (F.col("key") == key))


def has(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (source, key) that are stored."""
    return wanted.join(store, ["source", "key"], "left_semi")


def missing(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (source, key) that are still to fetch."""
    return wanted.join(store, ["source", "key"], "left_anti")


def write(store: DataFrame, path: str) -> None:
    store.write.partitionBy("source").mode("overwrite").parquet(path)


def scan(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """The stored rows; a source's own partition alone is read where one is named."""
    df = spark.read.schema(schemas.RAW).parquet(path)
    return df if source is None else df.where(F.col("source") == source)


def from_pages(pages: DataFrame, source: str, items: str, key: Column) -> DataFrame:
    """Raw rows of landed REST pages: one for each element of the JSON array at ``items`` in ``value``."""
    each = pages.select(F.explode(F.from_json(F.get_json_object("value", items), "array<string>")).alias("value"))
    return each.where(F.col("value").isNotNull()).select(F.lit(source).alias("source"), key.alias("key"), "value").where(F.col("key").isNotNull())


def next_url(page: Column) -> Column:
    """The URL that a landed page names as the next; null at the end."""
    return F.get_json_object(page, "$.pagination.next_url")


def next_urls(pages: DataFrame) -> DataFrame:
    """:func:`next_url` of each landed page."""
    return pages.select(next_url(F.col("value")).alias("url"))


def from_graphql(pages: DataFrame, source: str = "parismusees") -> DataFrame:
    """Raw rows of landed GraphQL pages: one for each entity that is not null, by its entityId."""
    return from_pages(pages, source, "$.data.nodeQuery.entities", F.get_json_object("value", "$.entityId"))


def ndjson_key(line: Column) -> Column:
    """The key of a line of JSON."""
    return F.coalesce(F.get_json_object(line, "$.content.descriptiveNonRepeating.record_ID"), F.get_json_object(line, "$.id"))


def from_ndjson(lines: DataFrame, source: str = "smithsonian") -> DataFrame:
    """Raw rows of newline-delimited JSON: blank lines and records without a key go, the line is kept as it is."""
    return lines.where(F.trim("value") != "").select(F.lit(source).alias("source"), ndjson_key(F.col("value")).alias("key"), "value").where(F.col("key").isNotNull())


def shards_to_do(index: DataFrame, done: DataFrame) -> DataFrame:
    """Shards (unit, shard) of the allowed units that are not logged as done."""
    return index.where(F.col("unit").isin(*UNITS) & (F.trim("shard") != "")).join(done, ["unit", "shard"], "left_anti")


def from_oai(records: DataFrame, source: str = "rijksmuseum") -> DataFrame:
    """Raw rows of harvested records (status, identifier, datestamp, rdf_xml): deleted and empty ones go, the rest is wrapped as JSON."""
    kept = records.where((F.coalesce("status", F.lit("")) != "deleted") & F.col("rdf_xml").isNotNull())
    wrapped = F.to_json(F.struct("identifier", "datestamp", "rdf_xml"))
    return kept.select(F.lit(source).alias("source"), F.element_at(F.split("identifier", "/"), -1).alias("key"), wrapped.alias("value"))


def harvested(pages: DataFrame) -> DataFrame:
    """Records (status, identifier, datestamp, rdf_xml) of harvested pages of XML in ``value``: see :func:`xmlpull.records`."""
    return xmlpull.harvested(pages)


def token_of(page: Column) -> tuple[Column, Column]:
    """The token of a landed page to go on with, null at the end; whether the page says that the token it was asked for is bad."""
    token = F.nullif(F.trim(F.regexp_extract(page, r"(?s)<(?:[\w.-]+:)?resumptionToken[^>/]*>(.*?)</(?:[\w.-]+:)?resumptionToken\s*>", 1)), F.lit(""))
    bad = F.coalesce(F.regexp_like(page, F.lit(r"""<(?:[\w.-]+:)?error\s[^>]*code\s*=\s*["']badResumptionToken["']""")), F.lit(False))
    return F.when(~bad, token), bad


def resume_token(pages: DataFrame) -> DataFrame:
    """(token, restart): the token of each page to go on with, URL-encoded, null at the end; whether the harvest must begin anew since its token is bad."""
    token, bad = token_of(F.col("value"))
    return pages.select(F.url_encode(token).alias("token"), bad.alias("restart"))


def next_skips(pages: DataFrame, limit: int = 100) -> DataFrame:
    """(source, skip) to fetch next, of landed pages (source, skip, value) numbered by how many records they skip; null once a source is done.

    A source is done when its last page has no records, or the next skip reaches ``info.total``.
    """
    last = last_wins(pages, ["source"], ["skip"])
    empty = F.coalesce(F.json_array_length(F.get_json_object("value", "$.data")), F.lit(0)) == 0
    after = F.col("skip") + limit
    total = F.get_json_object("value", "$.info.total").cast("long")
    return last.select("source", F.when(~(empty | F.coalesce(after >= total, F.lit(False))), after).alias("skip"))


def next_offsets(store: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, offset) for each row of ``sources``: as many as are stored, for pages in the order of creation."""
    stored = store.groupBy("source").agg(F.count("*").alias("n"))
    return sources.select("source").join(stored, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("offset"))
