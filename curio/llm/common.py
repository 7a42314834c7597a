"""Helpers shared by the text operators: Arrow buffers as numpy bytes, word hashes, shared folders.

Everything here is vectorised over a *slice*: consecutive whole documents of one Arrow batch that
together hold about ``SLICE_BYTES`` bytes (a longer document is a slice of its own), which bounds
the temporary arrays however many rows a batch has.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.tables import cut, shared_folder, unused  # noqa: F401

SLICE_BYTES = 2_000_000
U64 = np.uint64
#: Odd multiplier of the polynomial hashes (modulo 2^64) and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def process_cache() -> dict:
    """A dict that lives as long as the worker process.

    Functions of this package reach workers by value, with new globals for each task; what should
    outlast a task is kept with the interpreter instead.
    """
    import sys

    return sys.__dict__.setdefault("_curio_process_cache", {})


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done with.

    It does so when the plans are garbage, which a driver with memory to spare may not notice for long;
    asking after a large step keeps the peak of disk use down.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remainder(doc_id: str, m: int):
    """crc32 of the id's decimal text, modulo ``m``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % m


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1024)
        have = np.ones(size, U64)
        done = 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * U64(pow(base, done, 1 << 64))
            done += step
        if size <= 4 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_values(seed: int, fold_case: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with ``fold_case`` A-Z share those of a-z."""
    values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
    if fold_case:
        values[65:91] = values[97:123]
    return values


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Prefix polynomial sums; see :func:`span_hash`."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * powers(len(data)), dtype=U64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] in constant time each, wherever the span stands."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), BASE_INV)[start] + end.astype(U64) - start.astype(U64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its rows; null is the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their bytes, their offsets) for runs of whole documents."""
    for batch in batches:
        data, at = utf8(batch.column(batch.schema.get_field_index(text)))
        first, n = 0, batch.num_rows
        while first < n:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            last = min(last, n)
            yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


def unpack(sizes, packed) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of zstd-packed texts one after another, and their n+1 offsets."""
    codec = pa.Codec("zstd")
    raw = b"".join(codec.decompress(z, int(n), asbytes=True) if n else b"" for n, z in zip(sizes, packed, strict=True))
    return np.frombuffer(raw, np.uint8), np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64)))).astype(np.int64)


def unpacked(batches: Iterator[pa.RecordBatch], rows: bool = False, limit: int = SLICE_BYTES) -> Iterator[tuple]:
    """As :func:`slices` for columns (n_bytes, z) of packed texts: (bytes, offsets), with the rows before them if asked for."""
    for batch in batches:
        sizes, packed = (batch.column(batch.schema.get_field_index(c)) for c in ("n_bytes", "z"))
        total = np.concatenate(([0], np.cumsum(np.asarray(sizes))))
        first, n = 0, batch.num_rows
        while first < n:
            last = min(n, max(first + 1, int(np.searchsorted(total, total[first] + limit, "right")) - 1))
            some = slice(first, last)
            data, at = unpack(np.asarray(sizes)[some], packed.slice(first, last - first).to_pylist())
            yield (batch.slice(first, last - first), data, at) if rows else (data, at)
            first = last


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows that agree in the first ``keys`` columns (whole numbers), whole across batches."""
    held: list[pa.RecordBatch] = []
    last = None

    def whole() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.column_stack([np.asarray(batch.column(c)) for c in range(keys)])
        at = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        for a, b in zip(at[:-1], at[1:], strict=True):
            if held and (k[a] != last).any():
                yield whole()
                held = []
            held.append(batch.slice(a, b - a))
            last = k[a]
    if held:
        yield whole()


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, at: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of other than ``space`` bytes within each row, and the n+1 offsets of the rows' words."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    word = ~space[data]
    border = np.zeros(len(data) + 1, bool)
    border[at] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | border[1:-1]
    end = word
    end[:-1] &= ~word[1:] | border[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at)


WORD_VALUES = byte_values(20_011, fold_case=True)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated words, A-Z lower-cased, and the n+1 offsets of the rows' words."""
    starts, ends, words_at = word_spans(data, at)
    return span_hash(prefix_hash(data, WORD_VALUES), starts, ends), words_at


def row_of(at: np.ndarray) -> np.ndarray:
    """The row number of each element, given the n+1 offsets of rows."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Offsets at which a new value begins, with the length at the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each pair, one after another."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket 0..n-1 by the hash's upper 32 bits, so that buckets are ranges of the hash."""
    return (((hashes >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


def by_bucket(batch_buckets: np.ndarray, n: int) -> np.ndarray:
    """n+1 offsets of each bucket in ascending bucket numbers."""
    return np.searchsorted(batch_buckets, np.arange(n + 1))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest id reachable over undirected ``edges`` (a, b): rows (id, component_id) for the ids in edges.

    Alternating large-star and small-star steps, each a shuffle of the edges that are left with a
    grouping that only keeps minima, so a hub's edges are never gathered.  Stops when the set of
    edges no longer changes.
    """
    pairs = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo <> hi").distinct()
    pairs = cut(pairs, name)
    before = None
    while True:
        both = pairs.select("lo", "hi").unionByName(pairs.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy("lo").agg(F.least(F.min("hi"), F.first("lo")).alias("m"))
        # large star: each larger neighbour of u is linked with u's minimum
        large = both.join(least, "lo").where("hi > lo").select(F.col("m").alias("lo"), "hi").where("lo <> hi").distinct()
        # small star: u and its smaller neighbours are linked with their minimum
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.explode(F.array(F.struct("m", "hi"), F.struct("m", F.col("lo").alias("hi")))).alias("e")).select("e.m", "e.hi")
        pairs = cut(small.select(F.col("m").alias("lo"), "hi").where("lo <> hi").distinct(), name)
        state = pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)")), F.lit(0))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    children = pairs.select(F.col("hi").alias("id"), F.col("lo").alias("component_id"))
    return children.unionByName(pairs.select(F.col("lo").alias("id"), F.col("lo").alias("component_id")).distinct())


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int, seed: int = 0) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents of each class, for fitting.

    Rows with crc32(doc_id) mod ``modulus`` = ``held_out`` never take part.  The choice is by a hash of
    the id, so it does not depend on the order or the partitions; its size bounds what is broadcast.  An id
    counts once, however many rows and labels it has: with its least text and its largest label.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != held_out))
    usable = usable.groupBy("doc_id").agg(F.max(label).alias(label))
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    chosen = None
    for y in (0, 1):
        part = usable.where(F.col(label) == y).select("doc_id", F.lit(y).alias("y")).orderBy(order, "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id", "y").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")).select("doc_id", "text", "y")


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def letter_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of ASCII letters and bytes beyond ASCII, and the n+1 offsets of the rows' runs."""
    return word_spans(data, at, ~_LETTER)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
