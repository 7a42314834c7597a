"""Operator 11 against numpy, and its defined results in odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curio.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x double, n long, component string"


def rows_of(spark, vectors):
    """Embeddings with clashing extra columns."""
    return spark.createDataFrame([(i, v, 1, 0.5, 7, "c") for i, v in vectors], SCHEMA)


def brute(vectors):
    """{(vec_id, component): (n, deviation, whitened up to sign, explained)} of vectors of one length."""
    x = np.array([[int(np.floor(64.0 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v in vectors], object)
    fit = np.array(sorted({tuple(r) for r in x}), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = ((n * fit - s).astype(float)) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for (i, _), r in zip(vectors, x, strict=True):
        dev = int(((n * r - s) ** 2).sum())
        for c in range(min(16, len(e))):
            out[i, c + 1] = n, dev, abs(float((n * r - s).astype(float) / n @ v[:, c]) / np.sqrt(e[c])), e[c] / e.sum()
    return out


@pytest.mark.parametrize(("dims", "n"), [(20, 300), (64, 200), (3, 50)])
def test_equals_numpy(spark, dims, n):
    rng = np.random.default_rng(dims)
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(n, dims)) * np.geomspace(4, 0.3, dims))]
    vectors += [(n + i, vectors[0][1]) for i in range(60)]  # a common vector counts once in the fit
    got = whitening.whiten(rows_of(spark, vectors).repartition(7)).collect()
    want = brute(vectors)
    assert {(r["vec_id"], r["component"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n_, dev, w, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n_, dev)
        assert abs(r["whitened"]) == pytest.approx(w, rel=1e-7, abs=1e-7) and r["explained"] == pytest.approx(share, rel=1e-9) and r["identity_error"] < 1e-9
    signs = {}
    for r in got:  # one sign for all rows: equal vectors have equal coordinates
        if r["vec_id"] == 0 or r["vec_id"] >= n:
            assert signs.setdefault(r["component"], r["whitened"]) == r["whitened"]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, []), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [3.0, 1.0]), (7, [0.5]), (8, [2.5, -1.0]), (9, [1.0, 2.0, 3.0])]
    got = whitening.whiten(rows_of(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {6: 4, None: 2, 8: 2, 7: 1, 9: 3}
    assert by[7][0]["n"] == 1 and by[7][0]["deviation"] == 0 and by[7][0]["whitened"] == 0 and by[7][0]["explained"] == 0 and by[7][0]["identity_error"] == 0
    assert all(r["whitened"] == 0 for r in by[9])
    assert {r["n"] for r in by[6]} == {3} and all(r["identity_error"] < 1e-9 for r in by[6])
    assert whitening.whiten(rows_of(spark, [])).count() == 0


def test_huge_entries_and_lengths_in_parts(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MODEL_BYTES", 1)
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0]), (4, [1.0]), (5, [2.0])]
    got = whitening.whiten(rows_of(spark, rows)).collect()
    assert {(r["vec_id"], r["component"]) for r in got} == {(i, c) for i in (1, 2, 3) for c in (1, 2)} | {(4, 1), (5, 1)}
    assert all(r["deviation"] is None for r in got if r["vec_id"] in (1, 2)) and {r["deviation"] for r in got if r["vec_id"] > 3} == {64**2}


def test_solver_finds_small_and_equal_values():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    v = (q * np.repeat([4.0, 2.0, 1.0], [5, 10, 15])) @ q.T
    e, d, trace = whitening.directions(np.linalg.cholesky(v).T, 1)
    assert np.allclose(e, [4] * 5 + [2] * 10 + [1]) and np.abs(d @ d.T - np.eye(16)).max() < 1e-13 and np.abs(v @ d.T - d.T * e).max() < 1e-12 and trace == pytest.approx(55)
    diagonal, above, _ = whitening.bidiagonal(np.triu(rng.normal(size=(40, 40))) * np.geomspace(1, 1e-6, 40)[:, None])
    b = np.diag(diagonal) + np.diag(above, 1)
    got, want = np.sqrt(whitening.singular_values(diagonal, above)), np.linalg.svd(b, compute_uv=False)
    assert np.allclose(got[want > 1e-8], want[want > 1e-8], rtol=1e-7)


def test_query_columns(spark):
    from curio.llm.queries import QUERIES

    got = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.agg(F.max("identity_error")).first()[0] < 1e-4 and got.count() == 500 * 16
