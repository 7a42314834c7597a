"""Operator 13 against brute force, and its defined results in odd cases."""

import math

import duckdb
import numpy as np
import pytest

from curio.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, score double, row string, x int"
MOST = (1 << 63) - 1


def table(spark, rows):
    """Embeddings with clashing extra columns."""
    return spark.createDataFrame([(i, v, y, 0.5, "r", 3) for i, v, y in rows], SCHEMA)


def brute(rows):
    usable = []
    for i, v, y in rows:
        if y is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        usable.append((i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, [math.floor(256 * c) for c in v]))
    out = []
    for k, (a, y, x) in enumerate(usable):
        if a is None or a % 100:
            continue
        scored = [(-max(-MOST - 1, min(MOST, sum(p * q for p, q in zip(x, z, strict=True)))), i is None, i or 0, i, w) for j, (i, w, z) in enumerate(usable) if j != k and len(z) == len(x)]
        for p in sorted(s for s in scored if s[4] == y)[:5]:
            window = sorted(s for s in scored if s[4] != y and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0])[:5]
            out += [(a, p[3], r, s[3], -p[0], -s[0]) for r, s in enumerate(window, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, parts=5):
    return sorted((tuple(r) for r in hn.mine(table(spark, rows).repartition(parts)).collect()), key=repr)


def clustered(n, dims, rng, labels=4):
    centres = rng.normal(size=(12, dims))
    return [(i, (centres[c := int(rng.integers(12))] + 0.3 * rng.normal(size=dims)).tolist(), int((c + rng.integers(2)) % labels)) for i in range(n)]


@pytest.mark.parametrize("dims", [3, 24])
def test_equals_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(hn, "LEAF", 8)
    monkeypatch.setattr(hn, "FAN", 3)
    monkeypatch.setattr(hn, "TILE", 64)
    monkeypatch.setattr(hn, "SLAB", 200)
    rows = clustered(900, dims, np.random.default_rng(dims))
    rows += [(1000 + i, rows[100][1], i % 3) for i in range(150)]  # a vector with many copies, of several labels
    want = brute(rows)
    assert len(want) > 50 and mined(spark, rows) == want


def test_rounds_and_long_windows_agree(spark, monkeypatch):
    rows = clustered(700, 6, np.random.default_rng(5))
    want = brute(rows)
    monkeypatch.setattr(hn, "ROUND_ANCHORS", 3)
    assert mined(spark, rows) == want


def test_pruning_skips_nodes(monkeypatch):
    monkeypatch.setattr(hn, "LEAF", 8)
    x = np.floor(256 * np.array([v for _, v, _ in clustered(600, 4, np.random.default_rng(2))]))
    order = hn.tiled_order(x, np.arange(len(x)))
    assert sorted(order.tolist()) == list(range(600))
    import pyarrow as pa

    tree = hn.Tree(1, 4, order, pa.array(order), x[order].tobytes())
    seen = []
    plain = tree.scores
    tree.scores = lambda leaf, a, exact: seen.append(leaf) or plain(leaf, a, exact)
    low, high = tree.bounds(x[:1])
    q = hn.Query(-1, -(1 << 63), MOST, 5)
    hn.search(tree, x[0], 0, [q], low[0].tolist(), high[0].tolist(), tree.least.tolist(), True)
    score = (x @ x[0]).astype(int)
    assert [e[3] for e in q.found] == sorted((i for i in range(1, 600)), key=lambda i: (-score[i], i))[:5]
    assert len(seen) < 0.4 * len(tree.ends)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (100, [1.0, 0.25], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 0.0], 1), (5, [1.0, 1.0], None)]
    rows += [(6, [0.9, 0.4], 2), (6, [0.9, 0.4], 2), (None, [0.95, 0.4], 3), (8, [1.0, 0.5], 2), (9, [], 1), (200, [], 2), (10, [], 3), (11, [1e30, 1e30], 2), (12, [-1e300, 4.0], 2), (300, [1e20, 3.0], 3), (13, [1e20, 3.0], 3), (14, [1e19, 2.0], 9)]
    rows += [(15, [0.1, 0.1], 2), (15, [0.1, 0.1], 2), (100, [1.0, 0.25], 1)]
    assert mined(spark, rows) == brute(rows) != []
    assert mined(spark, [], 1) == [] and hn.mine(table(spark, [])).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    sql = hn.OP13_SQL.replace("FROM embeddings", f"FROM '{folder}/embeddings.parquet'")
    got = hn.op13_hard_negatives(spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(sql).fetchall())
