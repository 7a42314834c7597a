"""Benchmark decontamination (operator 10), in DataFrame functions only.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.  A window is
``SIZE`` consecutive words of a benchmark item; an item of fewer words is one window.  Documents'
windows are hashed where they stand, within generated code, one pass for each window length that the
benchmark has (1 to ``SIZE``), and looked up in the benchmark's set of hashes; what it hits is
verified word by word.

The set is broadcast while it has at most ``BROADCAST_WINDOWS`` rows and ``BROADCAST_BYTES`` bytes; a larger
benchmark is joined by a shuffle of hashes instead, with the same result.  It holds windows alone: which items
have a window is looked up for the hits.  A document's hits are gathered by document only.

Definedness: null texts, and texts without words, have no words, hits or items; very long texts are scanned
whole; items of a null id are ignored, and so are items without words; repeated items each count; rows that
repeat an id are documents of their own, equal rows have equal results; extra columns are ignored, or kept
whatever their names; an empty table gives no rows, and with an empty benchmark nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.llm import common

SIZE = 10
#: Bounds of what is broadcast, in windows of a length and in bytes (twice each text and a hundred more).
BROADCAST_WINDOWS, BROADCAST_BYTES = 200_000, 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, lower-cased; an empty array for null."""
    text = F.coalesce(text, F.lit(""))
    # lower() folds letters beyond ASCII too, so it only serves texts that have none
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    parts = F.split(plain, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    # only the first and the last part can be empty
    before, after = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0), F.when(F.get(parts, F.size(parts) - 1) == "", 1).otherwise(0)
    return F.slice(parts, before + 1, F.greatest(F.size(parts) - before - after, F.lit(0)))


def row_key() -> Column:
    """Tells documents apart, those too that repeat an id with another text: 128 bits."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(" "), F.coalesce(F.col("text"), F.lit(""))).cast("binary"))


def benchmark_windows(benchmark: DataFrame, size: int = SIZE, item_id: str = "item_id") -> DataFrame:
    """(item_id, length, gram): the distinct windows of each item, words joined by blanks."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col("text")).alias("w")).where(F.col("item_id").isNotNull() & (F.size("w") > 0))
    items = items.withColumn("length", F.least(F.size("w"), F.lit(size)))
    places = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1), lambda i: F.array_join(F.slice("w", i, F.col("length")), " "))
    return common.cut(items.select("item_id", "length", F.explode(places).alias("gram")).distinct(), "benchmark-windows")


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, position, length, gram): each occurrence of a window in a document, positions from 0; row is :func:`row_key`."""
    grams = common.cut(windows.select("length", "gram").distinct(), "benchmark-grams")
    stats = grams.groupBy("length").agg(F.count("*").alias("n"), F.sum(F.octet_length("gram") * 2 + 100).alias("bytes")).collect()  # at most SIZE rows
    found = None
    base = docs.select(row_key().alias("row"), words(F.col("text")).alias("w"))
    for row in sorted(stats, key=lambda r: r["length"]):
        length = row["length"]
        word = F.split("gram", " ")
        mine = grams.where(F.col("length") == length).select(F.xxhash64(*(F.get(word, F.lit(k)) for k in range(length))).alias("h"), "gram")
        # a condition on w alone (an inner explode implies one) would be evaluated below the split, which it would run again
        spots = base.select("row", "w", F.posexplode_outer("w").alias("position", "word")).where(F.col("position") <= F.size("w") - length)
        rows = spots.select("row", "w", "position", F.xxhash64("word", *(F.get("w", F.col("position") + k) for k in range(1, length))).alias("h"))
        here = F.array_join(F.slice("w", F.col("position") + 1, length), " ")
        if row["n"] <= BROADCAST_WINDOWS and row["bytes"] <= BROADCAST_BYTES:
            # on what the hash has met; written as an equality it would be a join key, and cut a slice for every row
            same = (here <= F.col("gram")) & (here >= F.col("gram"))
            met = rows.join(F.broadcast(mine), "h").where(same)
        else:  # shuffles carry the window, not the text
            met = rows.select("row", "position", "h", here.alias("here")).join(mine, "h").where("here = gram")
        met = met.select("row", "position", F.lit(length).alias("length"), "gram")
        found = met if found is None else found.unionByName(met)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "row string, position int, length int, gram string")
    return found


def hit_words(found: DataFrame) -> DataFrame:
    """(row, hit_words): the distinct positions of hit words, ascending."""
    got = found.groupBy("row").agg(F.collect_set(F.struct("position", "length")).alias("p"))
    spots = F.flatten(F.transform("p", lambda x: F.sequence(x["position"], x["position"] + x["length"] - 1)))
    return got.select("row", F.array_sort(F.array_distinct(spots)).alias("hit_words"))


def hit_items(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, item_ids): the items whose windows occur; items are looked up after the hit, so none is ever broadcast."""
    return found.select("row", "gram").distinct().join(windows.select("gram", "item_id"), "gram").groupBy("row").agg(F.collect_set("item_id").alias("item_ids"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents that no window occurs in."""
    found = hits(docs, benchmark_windows(benchmark, size)).select("row").distinct()
    (name,) = common.unused(docs.columns, "row")
    return docs.join(found.withColumnRenamed("row", name), row_key() == F.col(name), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """All documents, their hit words gone: words that stay are joined by single blanks where one was hit, else the text is as it was."""
    got = hit_words(hits(docs, benchmark_windows(benchmark, size)))
    row, hit = common.unused(docs.columns, "row", "hit")
    kept = F.filter(F.split(F.col("text"), "(?<=[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F])(?=[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F])"), lambda w: w != "")
    first = F.when(F.col("text").rlike("^[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"), 1).otherwise(0)
    rest = F.array_join(F.filter(kept, lambda w, i: ~F.array_contains(hit, i - first)), "")
    joined = docs.join(got.select(F.col("row").alias(row), F.col("hit_words").alias(hit)), row_key() == F.col(row), "left")
    text = F.when(F.col(hit).isNull(), F.col("text")).otherwise(rest).alias("text")
    return joined.select(*(text if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def report(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """One row a document: n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = benchmark_windows(benchmark, size)
    found = common.cut(hits(docs, windows), "benchmark-hits")
    got = hit_words(found).join(hit_items(found, windows), "row")
    ids = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    joined = docs.select("doc_id", row_key().alias("row"), F.size(words(F.col("text"))).cast("long").alias("n_words")).join(got, "row", "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("hit_words"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join(ids, ","), F.lit("")), 256).alias("items_sha256"),
        F.col("hit_words").isNotNull().alias("contaminated"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' '))) AS g FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS g FROM d, ks WHERE len(w) >= k),
hit AS (SELECT DISTINCT doc_id, i, dw.k AS k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
"""
