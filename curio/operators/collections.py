"""Collections: sets of images whose artist matches any of a list of patterns."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curio.functions.text import contains_like, fold, fold_ascii, image_path, like_pattern


#: Patterns from which on they are filtered by their trigrams first.
MANY = 32


def _trigrams(pattern: str) -> set[str]:
    """Those that every matching text has: of the pattern's parts between wildcards."""
    parts = re.split("[%_]", fold(pattern))
    return {part[i : i + 3] for part in parts for i in range(len(part) - 2)}


def _filters(patterns: list[tuple[int, str]]) -> tuple[list[tuple[str, int, str]], dict[int, list[str]]]:
    """(trigram, collection, LIKE pattern) of the patterns that have one, the trigram that fewest patterns have; and the others."""
    times = Counter(g for _, p in patterns for g in _trigrams(p))
    rows, short = [], {}
    for k, p in patterns:
        grams = _trigrams(p)
        if grams:
            rows.append((min(grams, key=lambda g: (times[g], g)), k, like_pattern(p)))
        else:
            short.setdefault(k, []).append(p)
    return rows, short


def _any(images: DataFrame, collections: dict[int, list[str]], column: str) -> DataFrame:
    hit = [F.when(contains_like(F.col(column), *patterns), F.lit(k).cast("long")) for k, patterns in collections.items()]
    return images.select(F.col("id").alias("image_id"), F.explode(F.array_compact(F.array(*hit))).alias("collection_id")).select("collection_id", "image_id")


def members(images: DataFrame, collections: dict[int, list[str]], column: str = "artist") -> DataFrame:
    """(collection_id, image_id), each pair once, in one scan.

    A few patterns are an OR of LIKE for each collection.  Of many, each is known by a trigram of its own: the trigrams of
    a text meet those of the patterns in a hash table, and only patterns whose trigram a text has are tried on it.
    The patterns are the caller's list, so the table that is broadcast is as large as that.
    """
    patterns = sorted({(k, p) for k, of in collections.items() for p in of})
    if len(patterns) < MANY:
        return _any(images, collections, column)
    rows, short = _filters(patterns)
    table = images.sparkSession.createDataFrame(rows, "gram string, collection_id long, pattern string")
    text = images.select(F.col("id").alias("image_id"), fold_ascii(F.col(column)).alias("text")).where(F.char_length("text") >= 3)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("text") - 2), lambda i: F.substr(F.col("text"), i, F.lit(3))))
    met = text.select("image_id", "text", F.explode(grams).alias("gram")).join(F.broadcast(table), "gram")
    found = met.where(F.expr("text LIKE pattern")).select("collection_id", "image_id")
    return (found.unionByName(_any(images, short, column)) if short else found).distinct()


def index_image(images: DataFrame, text: str, column: str = "title") -> DataFrame:
    """The first image, by id, whose title contains the text; no row where there is none."""
    return images.where(contains_like(F.col(column), text)).orderBy("id").limit(1)


def replace_members(table: DataFrame, new: DataFrame, collection_ids: list[int]) -> DataFrame:
    """(collection_id, image_id) after the members of the named collections were replaced."""
    return table.where(~F.col("collection_id").isin(*collection_ids)).select("collection_id", "image_id").unionByName(new.select("collection_id", "image_id"))


def build(images: DataFrame, definitions: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(collections, members) of definitions {id, title, author, index_art, artists}; an error where an index image is missing.

    The first image of each title is found in one aggregation for all definitions.
    """
    first = images.agg(*(F.min(F.when(contains_like(F.col("title"), d["index_art"]), F.col("id"))).alias(f"c{i}") for i, d in enumerate(definitions))).first()
    rows = []
    for i, d in enumerate(definitions):
        if first[i] is None:
            raise ValueError(f"no image for the collection {d['title']!r}")
        rows.append((d["id"], d["title"], d.get("author"), d.get("description"), str(first[i]), d.get("tag")))
    table = images.sparkSession.createDataFrame(rows, "id long, title string, author string, description string, index_image_id string, tag string")
    return table, members(images, {d["id"]: d["artists"] for d in definitions})


def listing(collections: DataFrame, images: DataFrame, table: DataFrame, size: str = "800") -> DataFrame:
    """Every collection with the URL of its index image and the number of its images."""
    counts = table.groupBy("collection_id").agg(F.count("image_id").alias("count"))
    index = collections.select("id", F.col("index_image_id").try_cast("bigint").alias("image_id"))
    found = index.join(images.select(F.col("id").alias("image_id"), "image_url"), "image_id").select("id", image_path(F.col("image_id"), size).alias("image_url"))
    joined = collections.join(found, "id").join(counts, collections["id"] == counts["collection_id"], "left")
    return joined.select(*(collections[c] for c in collections.columns), "image_url", F.coalesce("count", F.lit(0)).alias("count"))


def with_random(listed: DataFrame, title: str = "Random", count: str = "400000~") -> DataFrame:
    """The listing and a row for the whole store; counts become text."""
    texts = listed.withColumn("count", F.col("count").cast("string"))
    given = {"id": F.lit(9999).cast("long"), "title": F.lit(title), "count": F.lit(count)}
    row = listed.sparkSession.range(1).select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in texts.schema))
    return texts.unionByName(row)


def union_of(images: DataFrame, patterns: list[str], column: str = "artist") -> DataFrame:
    """Images that match any pattern, each once."""
    return images.where(reduce(lambda a, b: a | b, (contains_like(F.col(column), p) for p in patterns)))
