"""Whitening of embeddings by a bidiagonal qd solver (operator 11).

Each component c becomes the whole number x = floor(64 * c) + 1000000; the *fit list* is each distinct x vector
once, all n of them.

1. *Sums.*  n and the per-dimension sums S are exact: partial sums of each task in whole numbers.
2. *Blockwise QR.*  A task centres its rows, block by block, as (n * x - S) / n, where the numerator is exact,
   and keeps only the triangle R of a QR of [R; block].  Triangles are merged the same way, so what moves is
   dimension x dimension whatever the number of rows.
3. *Householder bidiagonalisation* of the last R, then *dqds* (differential quotient-difference with shifts) for
   its singular values to high relative accuracy, then a *twisted factorisation* of B'B - sigma^2 for each
   direction.  Directions of (nearly) equal values are told apart by inverse iteration within their cluster.
4. *Audit.*  The covariance of the whitened fit list, from centred co-moments merged pairwise, against the identity.

Definedness: rows whose vector is null or holds null or non-finite entries are dropped; vectors of unequal
length are whitened apart, each length with its own fit list; an empty vector has no components and gives no
row; fewer dimensions than 16 give fewer components.  A component without variance (fewer distinct vectors than
dimensions) has whitened 0, explained 0 and no part in the audit.  Entries beyond 2^62 / 64 are as that bound;
a deviation that no long can hold is null.  Equal rows give equal rows, null and repeated ids are kept as they
are, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.llm import common

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Rows of a QR block.
BLOCK = 4_096
#: Partitions in which triangles of tasks are merged before the last.
MERGERS = 32
#: Bytes of sums and directions that tasks are given at once; more lengths than fit are dealt with one batch of lengths after another.
MODEL_BYTES = 64_000_000
EPS = np.finfo(np.float64).eps
#: Singular values apart by less than this, relatively, are a cluster.
CLUSTER = 1e-7
_TINY = 1e-290


# ---- the solver


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of U'RW, and W, by Householder reflections."""
    a = np.array(r, np.float64)
    n = len(a)
    w = np.eye(n)

    def mirror(x: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(x)
        if norm == 0:
            return None
        v = x / norm
        v[0] += 1.0 if v[0] >= 0 else -1.0
        return v / np.linalg.norm(v)

    for k in range(n):
        if (v := mirror(a[k:, k].copy())) is not None:
            a[k:, k:] -= 2.0 * np.outer(v, v @ a[k:, k:])
        if k < n - 2 and (v := mirror(a[k, k + 1 :].copy())) is not None:
            a[k:, k + 1 :] -= 2.0 * np.outer(a[k:, k + 1 :] @ v, v)
            w[:, k + 1 :] -= 2.0 * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _dqds(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float], bool]:
    """One transform by shift ``tau``; False when it shows the shift to be over the least value."""
    qs, es, d = [], [], q[0] - tau
    for k in range(len(e)):
        if d < 0:
            return q, e, False
        top = max(d + e[k], _TINY)
        t = q[k + 1] / top
        qs.append(top)
        es.append(e[k] * t)
        d = d * t - tau
    return [*qs, max(d, 0.0)], es, d >= 0


def singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling, by dqds with deflation."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    q, e = [float(x) ** 2 for x in diagonal / scale], [float(x) ** 2 for x in above / scale]
    found, sigma = [], 0.0
    while q:
        if len(q) == 1 or e[-1] <= EPS * EPS * (sigma + q[-1]) or e[-1] <= _TINY:
            found.append(q.pop() + sigma)
            e = e[: max(0, len(q) - 1)]
            if len(q) > 1 and q[0] < q[-1]:  # read from its end, an array has the same values; small ones should come out last
                q, e = q[::-1], e[::-1]
            continue
        # the last two rows give an estimate of the least value; a shift over it is seen and lessened
        a, b, c = q[-2], e[-1], q[-1]
        s = a + b + c
        least = 2.0 * a * c / (s + np.sqrt(max(s * s - 4.0 * a * c, 0.0))) if s > 0 else 0.0
        tau = 0.999 * least
        for _ in range(6):
            qs, es, fits = _dqds(q, e, tau)
            if fits:
                break
            tau *= 0.3
        else:
            tau = 0.0
            qs, es, _ = _dqds(q, e, tau)
        q, e, sigma = qs, es, sigma + tau
    return np.sort(np.array(found))[::-1] * scale * scale


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """The unit vector z with B'Bz = value * z, from the twist of least residual."""
    n = len(diagonal)
    a = np.where(np.abs(diagonal) < EPS * EPS * np.abs(diagonal).max(), EPS * EPS * max(np.abs(diagonal).max(), _TINY), diagonal)
    d, low = a * a, above / a[:-1] if n > 1 else np.zeros(0)
    z = np.ones(n)
    for _ in range(3):
        s, plus = np.empty(n), np.empty(max(n - 1, 0))
        s[0] = -value
        for k in range(n - 1):
            pivot = s[k] + d[k]
            plus[k] = d[k] * low[k] / (pivot if abs(pivot) > _TINY else _TINY)
            s[k + 1] = plus[k] * low[k] * s[k] - value
        p, minus = np.empty(n), np.empty(max(n - 1, 0))
        p[n - 1] = d[n - 1] - value
        for k in range(n - 2, -1, -1):
            pivot = d[k] * low[k] * low[k] + p[k + 1]
            t = d[k] / (pivot if abs(pivot) > _TINY else _TINY)
            minus[k] = low[k] * t
            p[k] = p[k + 1] * t - value
        gamma = s + p + value
        r = int(np.argmin(np.where(np.isfinite(gamma), np.abs(gamma), np.inf)))
        z = np.zeros(n)
        z[r] = 1.0
        for k in range(r - 1, -1, -1):
            z[k] = -plus[k] * z[k + 1]
        for k in range(r, n - 1):
            z[k + 1] = -minus[k] * z[k]
        norm = z @ z
        step = gamma[r] / norm  # the Rayleigh quotient's correction
        z /= np.sqrt(norm)
        if not np.isfinite(step) or abs(step) <= 2 * EPS * value:
            break
        value += step
    return z


def directions(r: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, falling; their unit directions as rows; trace) of R'R / rows, up to COMPONENTS."""
    diagonal, above, w = bidiagonal(r)
    values = singular_values(diagonal, above)
    k = min(COMPONENTS, len(values))
    usable = int((values[:k] > (8 * len(values) * EPS) ** 2 * values[0]).sum()) if values[0] > 0 else 0
    z = np.zeros((k, len(values)))
    gram = np.zeros((len(values), len(values)))
    gram[np.arange(len(diagonal)), np.arange(len(diagonal))] = diagonal**2 + np.concatenate(([0.0], above**2))
    off = diagonal[:-1] * above
    gram[np.arange(len(off)), np.arange(1, len(diagonal))] = off
    gram[np.arange(1, len(diagonal)), np.arange(len(off))] = off
    for c in range(usable):
        z[c] = twisted(diagonal, above, float(values[c]))
        first = c
        while first and values[first - 1] - values[c] <= CLUSTER * values[c]:
            first -= 1
        if first < c or not np.isfinite(z[c]).all():
            z[c] = _in_cluster(gram, values[c], z[first:c], c)
    return values[:k] / rows, z @ w.T, float(values.sum() / rows)


def _in_cluster(gram: np.ndarray, value: float, others: np.ndarray, seed: int) -> np.ndarray:
    """A direction of ``value`` at right angles to ``others``, by inverse iteration."""
    v = np.random.default_rng(seed).normal(size=len(gram))
    near = gram - value * (1 + 8 * EPS) * np.eye(len(gram))
    for _ in range(4):
        for _ in range(2):
            v = v - others.T @ (others @ v)
        v = np.linalg.solve(near, v / np.linalg.norm(v))
    for _ in range(2):
        v = v - others.T @ (others @ v)
        v = v / np.linalg.norm(v)
    return v


# ---- on Spark


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector is usable."""
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    bound = F.lit(1 << 62)
    whole = F.transform("embedding", lambda c: F.greatest(-bound, F.least(bound, F.floor(c.cast("double") * F.lit(float(SCALE))))) + F.lit(SHIFT))
    return vectors.where(sound).select("vec_id", whole.alias("x"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, x) for the rows of each length."""
    column = batch.column(batch.schema.get_field_index("x"))
    sizes = np.asarray(column.value_lengths())
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        if d:
            yield d, rows, np.asarray(column.take(pa.array(rows)).flatten(), np.int64).reshape(-1, d)


def _centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """(n * x - S) as doubles, exact before the conversion."""
    if max(int(x.max(initial=0)), -int(x.min(initial=0))) < (1 << 61) // n:
        return (n * x - s).astype(np.float64)
    return (n * x.astype(object) - s.astype(object)).astype(np.float64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for d, _, x in _matrices(batch):
            n, s = total.get(d, (0, 0))
            small = max(int(x.max()), -int(x.min())) < (1 << 62) // len(x)
            total[d] = n + len(x), s + (x.sum(axis=0) if small else x.astype(object).sum(axis=0)).astype(object)
    for d, (n, s) in total.items():
        yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "n": pa.array([n], pa.int64()), "s": pa.array([[str(v) for v in s]], pa.list_(pa.string()))})


def _add(part: pd.DataFrame) -> pd.DataFrame:
    s = sum(np.array([int(v) for v in row], object) for row in part["s"])
    return pd.DataFrame({"d": [part["d"].iloc[0]], "n": [part["n"].sum()], "s": [[str(v) for v in s]]})


def _triangles(model: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, _, x in _matrices(batch):
            if d not in model:
                continue
            n, s = model[d]
            for k in range(0, len(x), BLOCK):
                block = _centred(x[k : k + BLOCK], n, s) / n
                held[d] = _r(np.vstack((held[d], block)) if d in held else block)
    yield from _packed(held)


def _r(a: np.ndarray) -> np.ndarray:
    """The square triangle of a QR of ``a``."""
    r = np.linalg.qr(a, mode="r")
    return r if len(r) == a.shape[1] else np.vstack((r, np.zeros((a.shape[1] - len(r), a.shape[1]))))


def _packed(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for d, r in held.items():
        yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "r": pa.array([r.tobytes()], pa.binary())})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            one = np.frombuffer(r, np.float64).reshape(d, d)
            held[d] = _r(np.vstack((held[d], one)) if d in held else one)
    yield from _packed(held)


def _solve(counts: dict[int, int], part: pd.DataFrame) -> pd.DataFrame:
    d = int(part["d"].iloc[0])
    r = _r(np.vstack([np.frombuffer(one, np.float64).reshape(d, d) for one in part["r"]]))
    values, v, trace = directions(r, counts[d])
    return pd.DataFrame({"d": [d], "e": [values.tolist()], "v": [v.ravel().tolist()], "trace": [trace]})


def _whitened(x: np.ndarray, n: int, s: np.ndarray, e: np.ndarray, v: np.ndarray) -> np.ndarray:
    usable = (v != 0).any(axis=1)
    v = v / np.where(usable, np.sqrt(np.where(usable, e, 1.0)), 1.0)[:, None]
    return np.einsum("ij,kj->ik", _centred(x, n, s) / n, v)  # not a matrix product, whose last bits depend on the batch


def _moments(model: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple] = {}
    for batch in batches:
        for d, _, x in _matrices(batch):
            if d in model:
                w = _whitened(x, *model[d])
                mean = w.mean(axis=0)
                one = (len(w), mean, (w - mean).T @ (w - mean))
                held[d] = _pooled(held[d], one) if d in held else one
    for d, (n, mean, m) in held.items():
        yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "n": pa.array([n], pa.int64()), "mean": pa.array([mean.tobytes()], pa.binary()), "m": pa.array([m.tobytes()], pa.binary())})


def _pooled(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred co-moments of two parts together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _identity_error(ranks: dict[int, int], part: pd.DataFrame) -> pd.DataFrame:
    d = int(part["d"].iloc[0])
    k, total = min(COMPONENTS, d), None
    for n, mean, m in zip(part["n"], part["mean"], part["m"], strict=True):
        one = (int(n), np.frombuffer(mean, np.float64), np.frombuffer(m, np.float64).reshape(k, k))
        total = one if total is None else _pooled(total, one)
    gap = np.abs(total[2] / total[0] - np.eye(k))[: ranks[d], : ranks[d]]
    return pd.DataFrame({"d": [d], "identity_error": [float(gap.max(initial=0.0))]})


def _deviation(x: np.ndarray, n: int, s: np.ndarray) -> list[int | None]:
    """Sums over the dimensions of (n * x - S)^2, exact; None where a long does not hold it."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if most < (1 << 61) // n and len(s):
        gap = n * x - s
        most = max(int(gap.max(initial=0)), -int(gap.min(initial=0)))
        if most * most * len(s) < 1 << 63:
            return (gap * gap).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - s.astype(object)) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def _scored(model: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for d, rows, x in _matrices(batch):
            if d not in model:
                continue
            n, s, e, v, explained, error = model[d]
            w, k = _whitened(x, n, s, e, v), len(e)
            of = np.repeat(np.arange(len(x)), k)
            columns = [ids.take(pa.array(rows[of])), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(of), n), pa.array(_deviation(x, n, s), pa.int64()).take(pa.array(of)), w.ravel(), np.tile(explained, len(x)), np.full(len(of), error)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=_OUT)


def _batches_of(sums: DataFrame) -> Iterator[dict[int, tuple[int, np.ndarray]]]:
    """The exact sums of the vector lengths (one, as a rule), in parts of at most MODEL_BYTES with their directions."""
    some, held = {}, 0
    for r in sums.orderBy("d").toLocalIterator():
        cost = 8 * r["d"] * (COMPONENTS + 2)
        if some and held + cost > MODEL_BYTES:
            yield some
            some, held = {}, 0
        s = np.array([int(v) for v in r["s"]], object)
        some[r["d"]] = r["n"], s.astype(np.int64) if all(abs(v) < 1 << 61 for v in s) else s
        held += cost
    if some:
        yield some


def whiten(vectors: DataFrame) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of the usable rows of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = whole_numbers(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    fit = common.cut(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "whitening-fit")
    sums = common.cut(fit.mapInArrow(_sums, "d int, n long, s array<string>").groupBy("d").applyInPandas(_add, "d int, n long, s array<string>"), "whitening-sums")
    out = None
    for some in _batches_of(sums):
        triangles = fit.mapInArrow(lambda b, m=some: _triangles(m, b), "d int, r binary").repartition(MERGERS).mapInArrow(_merged, "d int, r binary")
        counts = {d: n for d, (n, _) in some.items()}
        solved = triangles.groupBy("d").applyInPandas(lambda part: _solve(counts, part), "d int, e array<double>, v array<double>, trace double").collect()
        model, ranks, explained = {}, {}, {}
        for r in solved:  # a row for each length of this part
            e, v = np.array(r["e"]), np.array(r["v"]).reshape(-1, r["d"])
            model[r["d"]] = (*some[r["d"]], e, v)
            ranks[r["d"]] = int((v != 0).any(axis=1).sum())
            explained[r["d"]] = np.where((v != 0).any(axis=1), e / (r["trace"] or 1.0), 0.0)
        moments = fit.mapInArrow(lambda b, m=model: _moments(m, b), "d int, n long, mean binary, m binary")
        errors = moments.groupBy("d").applyInPandas(lambda part: _identity_error(ranks, part), "d int, identity_error double").collect()
        final = {r["d"]: (*model[r["d"]], explained[r["d"]], r["identity_error"]) for r in errors}
        part = rows.mapInArrow(lambda b, m=final: _scored(m, b), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.read(spark, sf_dir, "embeddings"))
