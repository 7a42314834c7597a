"""Quality classifier (operator 7): random-indexing vectors, a two-layer network, a calibrated probability.

A text is read as *units*: runs of letters (case folded), runs of punctuation, digits, and the shape
of each run of letters (case pattern and length).  Each of ``BUCKETS`` hashed units has a fixed sparse
ternary index vector; its word vector adds the index vectors of its neighbours, summed over the
fitting rows and scaled to unit length.  A document is the mean of its units' word vectors.  A network
of two layers (numpy, Adam) and a temperature, chosen on a fifth of the fitting rows, make the score.

The fit uses at most ``SAMPLE_ROWS`` labelled rows of each class, the bound of what is broadcast and
sent to the driver; every document is scored whole, in one pass without a shuffle.

Definedness: null and empty texts pool to the zero vector and get its score; very long texts are pooled whole,
a part at a time; equal texts have equal scores; of rows that repeat an id one is learnt from, and all are
scored; null ids and labels other than 0 and 1 are never learnt from; other columns are never read, and the
score takes the name that the caller gives it; with labels of one class or none every score is
(ones + 1) / (rows + 2); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.llm import common

BUCKETS, DIMENSIONS, HIDDEN, BLOCKS = 1 << 15, 64, 24, 16
#: Bound of the fitting sample, in rows of each class.
SAMPLE_ROWS = 4_000
_VALUES = common.byte_values(7_001, fold_case=True)
_SHAPE_VALUES = np.zeros(256, np.uint64)
_U, _D = np.zeros(256, bool), np.zeros(256, bool)
_U[65:91], _D[48:58] = True, True
_CLASS = np.full(256, 3, np.uint8)  # 0 letters, 1 digits, 2 white space and control, 3 others
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_CLASS[48:58] = 1
_CLASS[:33] = 2


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, eight entries each, the same wherever they are made."""
    rng = np.random.default_rng(71)
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    place = rng.integers(0, DIMENSIONS, (BUCKETS, 8))
    np.put_along_axis(out, place, rng.choice(np.array([-1, 1], np.float32), (BUCKETS, 8)), axis=1)
    return out / np.sqrt(8)


def units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the units of the rows' texts, in order, and the n+1 offsets of the rows."""
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(at), np.int64)
    kind = _CLASS[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[at] = True
    cuts = np.flatnonzero(new)
    if cuts[-1] != len(data):
        cuts = np.append(cuts, len(data))
    starts, ends = cuts[:-1], cuts[1:]
    of = kind[starts]
    starts, ends, of = starts[of != 2], ends[of != 2], of[of != 2]
    # long runs of punctuation or digits count by their first bytes and length class, letters as they are
    short = np.where(of == 0, ends, np.minimum(ends, starts + 3))
    h = common.span_hash(common.prefix_hash(data, _VALUES), starts, short)
    size = np.minimum(ends - starts, 31)
    h = np.where(of == 1, size.astype(np.uint64) + np.uint64(900_000), h)
    upper = np.concatenate(([0], np.cumsum(_U[data])))
    capitals = upper[ends] - upper[starts]
    shape = np.where(capitals == 0, 0, np.where(capitals == ends - starts, 1, np.where((capitals == 1) & _U[data[starts]], 2, 3)))
    shape_hash = common.mix((shape * 32 + np.minimum(size, 16)).astype(np.uint64) + np.uint64(77_000))
    both = np.column_stack((h, np.where(of == 0, shape_hash, common.mix(of.astype(np.uint64) * np.uint64(64) + size.astype(np.uint64)))))
    return (both.ravel() >> np.uint64(49)).astype(np.int64), 2 * np.searchsorted(starts, at)


def pool(buckets: np.ndarray, at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean of each row's unit vectors, zero without units."""
    out = np.zeros((len(at) - 1, vectors.shape[1]))
    step = 200_000
    row = common.row_of(at)
    for a in range(0, len(buckets), step):
        b = min(a + step, len(buckets))
        r = row[a:b]
        first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        out[r[first]] += np.add.reduceat(vectors[buckets[a:b]], first, axis=0)
    return out / np.maximum(np.diff(at), 1)[:, None]


def word_vectors(sample: DataFrame) -> np.ndarray:
    """Index vector plus context vector of every bucket, counted over the sample in Spark."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        total = np.zeros((BUCKETS, DIMENSIONS), np.float32)
        for _, data, at in common.slices(batches, limit=500_000):
            b, offsets = units(data, at)
            if len(b) < 3:
                continue
            row = common.row_of(offsets)
            for gap in (2, 4):  # neighbouring runs, two units each
                for here, there in ((b[:-gap], b[gap:]), (b[gap:], b[:-gap])):
                    same = row[:-gap] == row[gap:]
                    x, y = here[same], there[same]
                    order = np.argsort(x, kind="stable")
                    x, y = x[order], y[order]
                    first = common.runs(x)[:-1]
                    if len(first):
                        total[x[first]] += np.add.reduceat(index[y], first, axis=0)
        size = BUCKETS // BLOCKS
        blobs = [total[k * size : (k + 1) * size].tobytes() for k in range(BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(blobs, pa.binary())], names=["block", "sums"])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BUCKETS // BLOCKS * DIMENSIONS, np.float64)
        for x in rows["sums"]:
            total += np.frombuffer(x, np.float32)
        return pd.DataFrame([(key[0], total.astype(np.float32).tobytes())], columns=["block", "sums"])

    blocks = sample.select("text").coalesce(8).mapInArrow(contexts, "block int, sums binary").groupBy("block").applyInPandas(add, "block int, sums binary").collect()
    context = np.zeros((BLOCKS, BUCKETS // BLOCKS * DIMENSIONS), np.float32)
    for r in blocks:
        context[r["block"]] = np.frombuffer(bytes(r["sums"]), np.float32)
    context = context.reshape(BUCKETS, DIMENSIONS)
    length = np.linalg.norm(context, axis=1, keepdims=True)
    return index_vectors() + np.where(length > 0, context / np.maximum(length, 1e-9), 0).astype(np.float32)


def fit_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, seed: int = 5) -> dict:
    """Two layers and a temperature; a fifth of the rows is kept back for the latter."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    hold, fit = order[: len(x) // 5], order[len(x) // 5 :]
    mean, sd = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-4
    z = (x - mean) / sd
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 256)):
            a = np.tanh(z[batch] @ p[0] + p[1])
            e = (common.logistic(a @ p[2] + p[3][0]) - y[batch]) * weight[batch] / weight[batch].sum()
            back = np.outer(e, p[2]) * (1 - a * a)
            grads = [z[batch].T @ back + 1e-3 * p[0], back.sum(axis=0), a.T @ e + 1e-3 * p[2], np.array([e.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    raw = np.tanh(z[hold] @ p[0] + p[1]) @ p[2] + p[3][0]
    grid = np.exp(np.linspace(np.log(0.3), np.log(8), 60))
    loss = [-(weight[hold] * np.log(np.clip(np.where(y[hold] == 1, common.logistic(raw / t), 1 - common.logistic(raw / t)), 1e-9, 1))).sum() for t in grid]
    first = p[0] / sd[:, None]
    return {"first": first.astype(np.float32), "bias": p[1] - mean @ first, "second": p[2], "last": float(p[3][0]), "temperature": float(grid[int(np.argmin(loss))]) if len(hold) else 1.0}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held_out: int = 1, rows: int = SAMPLE_ROWS) -> dict:
    """A model for :func:`score`; what reaches the driver is bounded by ``rows``, a vector each, and by BUCKETS."""
    sample = common.cut(common.labelled_sample(docs, labels, label, modulus, held_out, rows), "quality-sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2 or sum(sizes.values()) < 20:
        return {"constant": (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)}
    vectors = word_vectors(sample)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in common.slices(batches, limit=500_000):
            x = pool(*units(data, at), vectors)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("y")), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows_ = sample.mapInArrow(pooled, "doc_id long, y int, x array<double>").orderBy("doc_id", "y").collect()  # bounded by the sample
    x, y = np.array([r["x"] for r in rows_]), np.array([r["y"] for r in rows_], float)
    # classes weigh as they do among all labelled rows that may be learnt from
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (common.remainder("doc_id", modulus) != held_out))
    share = {r[label]: r["n"] for r in usable.groupBy(label).agg(F.count("*").alias("n")).collect()}
    weight = np.where(y == 1, share[1] / sizes[1], share[0] / sizes[0])
    net = fit_network(x, y, weight / weight.mean())
    # the mean of vectors times a matrix is the mean of the products: pool in the hidden layer's space
    return net | {"vectors": (vectors @ net.pop("first")).astype(np.float32)}


def predict(model: dict, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(at) - 1, model["constant"])
    hidden = np.tanh(pool(*units(data, at), model["vectors"]) + model["bias"])
    return common.logistic((hidden @ model["second"] + model["last"]) / model["temperature"])


def score(docs: DataFrame, model: dict, keep: tuple[str, ...], predict_=None, into: str = "score") -> DataFrame:
    """The columns ``keep`` and the score, as ``into``, of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of a size set by BUCKETS and HIDDEN
    predict_ = predict_ or predict

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in common.slices(batches):
            out = [part.column(part.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*out, pa.array(predict_(held.value, data, at), pa.float64())], names=[*keep, into])

    columns = lambda names: [F.col(f"`{c}`") for c in dict.fromkeys(names)]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns(keep)).schema]
    return docs.select(*columns([*keep, "text"])).mapInArrow(rows, ", ".join([*fields, f"`{into}` double"]))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = fit(docs, common.read(spark, sf_dir, "labels"))
    scored = score(docs.withColumn("held_out", common.remainder("doc_id", 3) == 1), model, ("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
