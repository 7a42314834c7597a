"""Hard negatives from an STR-packed R-tree (operator 13).

Components become whole numbers floor(256 * x); a row's score is its integer inner product with an anchor.  An
anchor's positives are its first rows of the same label, the negatives of a positive its first rows of other
labels whose score is within a window below the positive's.

1. *Packing* (sort-tile-recursive).  Rows are range-partitioned by label, length, the coordinate of the largest
   variance and row number, so that neither a common label nor a common vector fills a partition.  Each task
   sorts its slab by further coordinates, cuts it into leaves of ``LEAF`` rows of one label and writes tiles of
   ``TILE`` rows: the leaves of a tile, and ``FAN`` of them each, are the nodes of its tree.
2. *Search.*  Anchors come in rounds of a bounded size; a task goes through its tiles, one at a time in memory.
   A node's minimum bounding box gives an interval for each coordinate's product, and their sums an interval for
   the score.  A queue of nodes, best bound first, drops those outside all windows, strictly below the k-th
   score found so far, or equal to it with greater ids only.  Tasks return their first ones, which are merged.

Definedness: rows with a null label, a null vector or null or non-finite components take no part; vectors of
unequal length are never compared; ties go to the smaller id, null ids last, and rows that repeat an id or a
vector are rows of their own (an anchor is not its own positive); a score that no long can hold is the nearest
one; a positive of negative score has an empty window, and one without negatives gives no row; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curio.llm import common

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
ANCHOR_EVERY = 100
#: Rows of a leaf, nodes of a node, rows of a tile (one row of the packed table), rows of a slab (one task of the packing).
LEAF, FAN, TILE, SLAB = 128, 8, 4_096, 32_768
#: Coordinates by which a slab is tiled.
TILED_BY = 3
#: Anchors and components of anchors in a round, which every task of the round is given.
ROUND_ANCHORS, ROUND_NUMBERS = 16_384, 2_000_000
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_EXACT = float(1 << 53)


# ---- points and tiles


def points_of(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, d, x) of the rows that take part."""
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    most = F.lit(np.finfo(np.float64).max)
    # floor as a double: Spark's own returns a long, which large components exceed
    scaled = F.transform("embedding", lambda c: F.greatest(-most, F.least(most, F.lit(float(SCALE)) * c.cast("double"))))
    whole = F.transform(scaled, lambda c: F.rint(c) - F.when(F.rint(c) > c, F.lit(1.0)).otherwise(F.lit(0.0)))
    label = F.col("label").cast("long")
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return vectors.where(sound).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), shifted.alias("label"), F.size("embedding").alias("d"), whole.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), d)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    d = np.asarray(batch.column("d"))
    for one in np.unique(d).tolist():
        yield one, batch.take(pa.array(np.flatnonzero(d == one)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, tuple] = {}
    for batch in batches:
        for d, part in _by_length(batch):
            x = np.clip(_matrix(part.column("x"), d), -1e100, 1e100)
            n, s, t = total.get(d, (0, 0.0, 0.0))
            total[d] = n + len(x), s + x.sum(axis=0), t + (x * x).sum(axis=0)
    for d, (n, s, t) in total.items():
        if d:
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * d, pa.int32()), "k": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "s": s, "t": t})


def _leading(points: DataFrame) -> DataFrame:
    """(d, k): for each length the coordinate of the largest variance."""
    sums = points.select("d", "x").mapInArrow(_moments, "d int, k int, n long, s double, t double")
    spread = sums.groupBy("d", "k").agg((F.sum("t") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)).alias("v"))
    return spread.groupBy("d").agg(F.max_by("k", F.struct("v", -F.col("k"))).alias("k"))


def tiled_order(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Rows in the order of the leaves: consecutive runs of LEAF rows."""
    by = np.argsort(-x.var(axis=0), kind="stable")[:TILED_BY].tolist() if x.shape[1] else []

    def tile(rows: np.ndarray, dims: list[int]) -> list[np.ndarray]:
        rows = rows[np.lexsort((ids[rows], x[rows, dims[0]]))] if dims else rows[np.argsort(ids[rows], kind="stable")]
        if len(dims) <= 1 or len(rows) <= LEAF:
            return [rows]
        leaves = -(-len(rows) // LEAF)
        slab = LEAF * int(np.ceil(leaves ** (1 - 1 / len(dims))))
        return [part for k in range(0, len(rows), slab) for part in tile(rows[k : k + slab], dims[1:])]

    return np.concatenate(tile(np.arange(len(x)), by))


_TILE = pa.schema([("label", pa.int64()), ("d", pa.int32()), ("row", pa.list_(pa.int64())), ("vec_id", pa.list_(pa.int64())), ("x", pa.binary())])
_TILE_SQL = "label long, d int, row array<long>, vec_id array<long>, x binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of the rows of a slab."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    slab = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    key = np.column_stack((np.asarray(slab.column("label")), np.asarray(slab.column("d")).astype(np.int64)))
    for label, d in np.unique(key, axis=0).tolist():
        part = slab.take(pa.array(np.flatnonzero((key == (label, d)).all(axis=1))))
        x, ids = _matrix(part.column("x"), d), part.column("vec_id")
        order = tiled_order(x, np.asarray(ids.fill_null(_MOST)))
        for k in range(0, len(order), TILE):
            some = order[k : k + TILE]
            at = pa.array(some)
            yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([d], pa.int32()), pa.array([part.column("row").take(at).to_pylist()], pa.list_(pa.int64())), pa.array([ids.take(at).to_pylist()], pa.list_(pa.int64())), pa.array([_small(x[some]).tobytes()], pa.binary())], schema=_TILE)


def _small(x: np.ndarray) -> np.ndarray:
    """As float32 where that holds every value."""
    with np.errstate(over="ignore"):
        y = x.astype(np.float32)
    return y if (y == x).all() else x


def tiles_of(points: DataFrame) -> DataFrame:
    """The packed rows: (label, d, row, vec_id, x), a row a tile."""
    n = points.count()
    placed = points.join(F.broadcast(_leading(points)), "d", "left") if n else points.withColumn("k", F.lit(None).cast("int"))
    parts = max(1, -(-n // SLAB), min(common.shuffle_parts(points.sparkSession), n // LEAF))  # small tables are dealt over all tasks too
    first = F.coalesce(F.get("x", F.col("k")), F.lit(0.0))
    slabs = placed.withColumn("c", first).repartitionByRange(parts, "label", "d", "c", "row")
    return slabs.select("row", "vec_id", "label", "d", "x").mapInArrow(_packed, _TILE_SQL)


class Tree:
    """The nodes of a tile: boxes of leaves first, then of FAN nodes below each, the root last."""

    def __init__(self, label: int, d: int, rows: np.ndarray, ids: pa.Array, x: bytes):
        n = len(rows)
        self.label, self.rows = label, rows
        self.null = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(_MOST))
        self.x = np.frombuffer(x, np.float32 if len(x) == 4 * n * d else np.float64).astype(np.float64).reshape(n, d)
        at = np.arange(0, n, LEAF)
        self.ends = np.minimum(at + LEAF, n)
        low, high, least = np.minimum.reduceat(self.x, at, axis=0), np.maximum.reduceat(self.x, at, axis=0), np.minimum.reduceat(self.ids, at)
        lows, highs, leasts, self.below = [low], [high], [least], [None] * len(at)
        base = 0
        while len(low) > 1:
            at = np.arange(0, len(low), FAN)
            self.below += [range(base + k, base + min(k + FAN, len(low))) for k in at.tolist()]
            base += len(low)
            low, high, least = np.minimum.reduceat(low, at, axis=0), np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(least, at)
            lows.append(low), highs.append(high), leasts.append(least)
        self.low, self.high, self.least = np.concatenate(lows), np.concatenate(highs), np.concatenate(leasts)
        self.largest = float(np.abs(self.x).max(initial=0.0))

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible scores of every node for every anchor, by the interval of each coordinate's product."""
        plus, minus = np.maximum(a, 0), np.minimum(a, 0)
        return plus @ self.low.T + minus @ self.high.T, plus @ self.high.T + minus @ self.low.T

    def exact(self, a: np.ndarray) -> bool:
        """Whether all sums of products are whole numbers that a double holds."""
        return self.largest * float(np.abs(a).max(initial=0.0)) * max(1, a.shape[-1]) < _EXACT

    def scores(self, leaf: int, a: np.ndarray, exact: bool) -> np.ndarray:
        some = self.x[leaf * LEAF : self.ends[leaf]]
        if exact:
            return (some @ a).astype(np.int64)
        whole = [[int(v) for v in r] for r in some]
        b = [int(v) for v in a]
        return np.array([max(_LEAST, min(_MOST, sum(u * v for u, v in zip(r, b, strict=True)))) for r in whole], np.int64)


class Query:
    """The first ``k`` rows of score within [low, high] so far; entries are (-score, id is null, id, row)."""

    __slots__ = ("found", "high", "k", "key", "low", "tag")

    def __init__(self, tag: int, low: int, high: int, k: int):
        self.tag, self.low, self.high, self.k = tag, low, high, k
        self.found: list[tuple] = []
        self.key = (low, _MOST)  # a node must reach this score, and at it hold an id up to this one

    def offer(self, entries: list[tuple]) -> None:
        self.found = heapq.nsmallest(self.k, self.found + entries)
        if len(self.found) == self.k:
            last = self.found[-1]
            self.key = (-last[0], last[2])

    def wants(self, low: float, high: float, least: int) -> bool:
        score, last = self.key
        return low <= self.high and (high > score or high == score and least <= last)


def search(tree: Tree, a: np.ndarray, own: int, queries: list[Query], low: list[float], high: list[float], least: list[int], exact: bool) -> None:
    """Best-first through the nodes of a tile, whose bounds for the anchor are given; row ``own`` is passed over."""
    root = len(high) - 1
    if not any(q.wants(low[root], high[root], least[root]) for q in queries):
        return
    queue = [(-high[root], root)]
    while queue:
        _, node = heapq.heappop(queue)
        if not any(q.wants(low[node], high[node], least[node]) for q in queries):
            continue
        if (below := tree.below[node]) is not None:
            for child in below:
                if any(q.wants(low[child], high[child], least[child]) for q in queries):
                    heapq.heappush(queue, (-high[child], child))
            continue
        scores = tree.scores(node, a, exact)
        bottom, top = min(q.key[0] for q in queries), max(q.high for q in queries)
        hit = np.flatnonzero((scores >= bottom) & (scores <= top))
        if not len(hit):
            continue
        at = hit + node * LEAF
        entries = list(zip((-scores[hit]).tolist(), tree.null[at].tolist(), tree.ids[at].tolist(), tree.rows[at].tolist(), strict=True))
        for q in queries:
            if some := [e for e in entries if q.key[0] <= -e[0] <= q.high and e[3] != own]:
                q.offer(some)


# ---- rounds of anchors

_FOUND_SQL = "anchor long, positive long, row long, vec_id long, score long"
_FOUND = pa.schema([("anchor", pa.int64()), ("positive", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
#: A round's anchors by length: rows, labels, vectors, and for each the (row, score) of its positives, or None while those are sought.
Anchors = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list | None]]


def _searched(anchors: Anchors, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, positive, row, vec_id, score): what a task's tiles have for each query; ``positive`` is null while those are sought."""
    state: dict[int, list] = {}
    for d, (_, _, _, positives) in anchors.items():
        if positives is None:
            state[d] = [[Query(-1, _LEAST, _MOST, POSITIVES)] for _ in range(len(anchors[d][0]))]
        else:
            state[d] = [[Query(row, -(-80 * score // 100), score, NEGATIVES) for row, score in some if score >= 0] for some in positives]
    for batch in batches:
        for i in range(batch.num_rows):
            d = batch.column("d")[i].as_py()
            if d not in anchors:
                continue
            rows, labels, x, positives = anchors[d]
            tree = Tree(batch.column("label")[i].as_py(), d, np.asarray(batch.column("row")[i].values), batch.column("vec_id")[i].values, batch.column("x")[i].as_py())
            asked = np.flatnonzero((labels == tree.label) if positives is None else (labels != tree.label))
            least = tree.least.tolist()
            for k in range(0, len(asked), 512):
                some = asked[k : k + 512]
                low, high = tree.bounds(x[some])
                exact = tree.exact(x[some])
                if not exact:  # no bound is safe
                    low[:], high[:] = -np.inf, np.inf
                for j, (lo, hi) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
                    if queries := state[d][some[j]]:
                        search(tree, x[some[j]], int(rows[some[j]]), queries, lo, hi, least, exact)
    for d, of in state.items():
        anchor, tag, found = [], [], []
        for row, queries in zip(anchors[d][0].tolist(), of, strict=True):
            for q in queries:
                anchor += [row] * len(q.found)
                tag += [None if q.tag < 0 else q.tag] * len(q.found)
                found += q.found
        for k in range(0, len(found), 50_000):
            part = found[k : k + 50_000]
            columns = [anchor[k : k + 50_000], tag[k : k + 50_000], [e[3] for e in part], [None if e[1] else e[2] for e in part], [-e[0] for e in part]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_FOUND)


def _firsts(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _round(anchors: DataFrame, positives: DataFrame | None = None) -> Anchors:
    """The anchors of a round by length, with their positives if those are known; bounded by the rounds' sizes."""
    known: dict[int, list] | None = None
    if positives is not None:
        known = {}
        for r in positives.select("anchor", "row", "score").collect():  # POSITIVES for each anchor of the round
            known.setdefault(r["anchor"], []).append((r["row"], r["score"]))
    out: Anchors = {}
    for batch in anchors.select("row", "label", "d", "x").toArrow().combine_chunks().to_batches():
        for d, part in _by_length(batch):
            rows = np.asarray(part.column("row"))
            out[d] = rows, np.asarray(part.column("label")), _matrix(part.column("x"), d), None if known is None else [known.get(r, []) for r in rows.tolist()]
    return out


def mine(vectors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    points = common.cut(points_of(vectors), "negatives-points")
    tiles = common.cut(tiles_of(points), "negatives-tiles")
    anchors = points.where(F.col("vec_id") % ANCHOR_EVERY == 0)
    size = anchors.agg(F.count("*").alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("numbers")).first()
    rounds = max(1, -(-size["n"] // ROUND_ANCHORS), -(-size["numbers"] // ROUND_NUMBERS))
    out = None
    for k in range(rounds):
        asked = anchors.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == k)
        given = _round(asked)
        if not given:
            continue
        near = _firsts(tiles.mapInArrow(lambda b, g=given: _searched(g, b), _FOUND_SQL), ["anchor"], POSITIVES)
        near = common.cut(near.select("anchor", "row", "vec_id", "score"), "negatives-positives")
        given = _round(asked, near)
        hard = _firsts(tiles.mapInArrow(lambda b, g=given: _searched(g, b), _FOUND_SQL), ["anchor", "positive"], NEGATIVES)
        pairs = near.select("anchor", F.col("row").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        named = hard.join(pairs, ["anchor", "positive"]).join(asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
        part = named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        part = common.cut(part, "negatives-round") if rounds > 1 else part
        out = part if out is None else out.unionByName(part)
    if out is None:  # no anchors
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(common.read(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH points AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM points a JOIN points b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
    n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
