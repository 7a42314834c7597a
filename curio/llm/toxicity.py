"""Toxicity (operator 9): class-conditional Kneser-Ney models with shared backoff counts.

Two bigram models over runs of letters (case folded), one of toxic and one of ordinary texts, with
absolute discounts.  What a class leaves to rare expressions goes to continuation counts that both
classes share, so a word seen in neither says nothing.  Each token has the difference of its two log
likelihoods; a text's features are that difference per token over the whole text and over its most
toxic spans of 1, 8 and 32 tokens.  A logistic curve over these, fitted on a quarter of the fitting
rows that the counts do not see, makes the score.

The fit uses at most ``SAMPLE_ROWS`` labelled rows of each class (equal classes, so that both models
leave alike shares to rare words); bigrams seen a few times are left to the backoff.  Both bound what is
broadcast.  Every document is scored whole, in one pass without a shuffle.

Definedness: texts without a letter, empty or null ones have no tokens and features of zero; very long texts
are scored whole; equal texts have equal scores; of rows that repeat an id one is learnt from, and all are
scored; null ids and labels other than 0 and 1 are never learnt from; extra columns are ignored whatever their
names; with labels of one class or none every score is (ones + 1) / (rows + 2); an empty table gives no rows.

Strong discounts are what makes this work: with the discounts that the counts of counts give, one or two texts
(and their copies) decide about rare words; README has the figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.llm import common, quality

#: Bound of the fitting sample, in rows of each class.
SAMPLE_ROWS = 4_000
SPANS = (1, 8, 32)
U64 = np.uint64
_VALUES = common.byte_values(9_001, fold_case=True)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, bigram hashes with the word before, n+1 offsets of the rows)."""
    starts, ends, offsets = common.letter_runs(data, at)
    h = common.span_hash(common.prefix_hash(data, _VALUES), starts, ends)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[offsets[:-1][offsets[:-1] < len(h)]] = 0
    return h, before, offsets


def _tally(values: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, counts in class 0 and 1)."""
    order = np.argsort(values)
    v, y = values[order], y[order]
    first = common.runs(v)[:-1]
    return (v[first], np.column_stack([np.add.reduceat((y == k).astype(np.int64), first) for k in (0, 1)])) if len(v) else (v, np.zeros((0, 2), np.int64))


def count(sample: DataFrame, buckets: int = 16) -> dict:
    """Counts of both models over the fitting rows, merged in Spark by ranges of the word's hash."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in common.slices(batches):
            h, before, offsets = words(data, at)
            y = np.asarray(part.column(part.schema.get_field_index("y")))[common.row_of(offsets)].astype(np.uint8)
            place = common.bucket_of(h, buckets)
            order = np.argsort(place, kind="stable")
            to = common.by_bucket(place[order], buckets)
            h, before, y = h[order], before[order], y[order]
            some = np.flatnonzero(np.diff(to))
            blobs = [[x[to[k] : to[k + 1]].tobytes() for k in some] for x in (h, before, y)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(b, pa.binary()) for b in blobs)], names=["bucket", "h", "u", "y"])

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h, u = (np.concatenate([np.frombuffer(x, np.uint64) for x in rows[c]]) for c in ("h", "u"))
        y = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["y"]])
        w, n = _tally(h, y)
        pair = common.mix(u * U64(0x9FB21C651E98DF25) + h)
        b, nb = _tally(pair, y)
        _, one = np.unique(pair, return_index=True)
        spread = np.zeros((len(w), 2), np.int64)  # distinct words before each word, by class
        np.add.at(spread, np.searchsorted(w, h[one]), nb > 0)
        big = nb.max(axis=1) > 4
        context, kinds = u[one], nb  # each class's bigram types and tokens by their first word
        order = np.argsort(context)
        first = common.runs(context[order])[:-1]
        begun = np.column_stack([np.add.reduceat((kinds[order, k] > 0).astype(np.int64), first) for k in (0, 1)] + [np.add.reduceat(kinds[order, k], first) for k in (0, 1)])
        return pd.DataFrame([(key[0], w.tobytes(), n.tobytes(), spread.tobytes(), b[big].tobytes(), nb[big].astype(np.uint32).tobytes(), context[order][first].tobytes(), begun.tobytes())], columns=["bucket", "w", "n", "spread", "b", "nb", "c", "begun"])

    schema = "bucket int, w binary, n binary, spread binary, b binary, nb binary, c binary, begun binary"
    rows = sample.select("text", "y").mapInArrow(pieces, "bucket int, h binary, u binary, y binary").groupBy("bucket").applyInPandas(merge, schema).collect()  # bounded by the sample

    def whole(name: str, kind, width: int = 0) -> np.ndarray:
        x = np.concatenate([np.frombuffer(bytes(r[name]), kind) for r in rows] or [np.zeros(0, kind)])
        return x.reshape(-1, width) if width else x

    w, n, spread = whole("w", np.uint64), whole("n", np.int64, 2), whole("spread", np.int64, 2).min(axis=1)
    b, nb = whole("b", np.uint64), whole("nb", np.uint32, 2)
    c, begun = whole("c", np.uint64), whole("begun", np.int64, 4)
    order = np.argsort(c)
    first = common.runs(c[order])[:-1]
    c, begun = c[order][first], np.add.reduceat(begun[order], first, axis=0) if len(c) else begun
    order = np.argsort(w)
    w, n, spread = w[order], n[order], spread[order]
    order = np.argsort(b)
    b, nb = b[order], nb[order]
    # words that only one text's handful of tokens has stay with the shared counts
    usual = n.sum(axis=1) >= 2
    total = n.sum(axis=0)
    # continuation counts that the classes share: what only one class knows gets the floor
    shared = (spread + 1.0) / (spread.sum() + len(w) + 1)
    left = sum(float(d) * ((n == k) if k < 3 else (n >= 3)).sum() for k, d in enumerate(D1)) / max(1, total.sum())
    known = begun[:, 2:].min(axis=1) >= CONTEXT_TOKENS
    return {
        "words": w[usual], "counts": n[usual].astype(np.float32), "shared": shared[usual].astype(np.float32), "rare": float(np.median(shared)) if len(w) else 1.0, "total": np.maximum(total, 1), "left": left,
        "pairs": b, "pair_counts": nb.astype(np.float32), "contexts": c[known], "begun": begun[known].astype(np.float32),
    }


#: Discounts of words seen once, twice, more often, and of bigrams; few sightings of a bigram are left to its word.
D1, D2 = np.array([0.0, 0.9, 1.2, 1.4]), 4.0
#: Tokens that a word must begin in each class before its bigrams count.
CONTEXT_TOKENS = 400


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def differences(m: dict, h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """log p(word | word before, toxic) - log p(word | word before, ordinary) of each token."""
    distinct, which = np.unique(h, return_inverse=True)
    i, hit = _find(m["words"], distinct)
    counts = np.where(hit[:, None], m["counts"][i] if len(m["words"]) else np.zeros((len(i), 2)), 0.0)
    shared = np.where(hit, m["shared"][i] if len(m["words"]) else 0.0, m["rare"])
    # what a class leaves is dealt by the shared counts, in the same measure for both classes
    left = m["left"]
    word = np.maximum(counts - D1[np.minimum(counts, 3).astype(int)], 0) / m["total"] + left * shared[:, None]
    first, at = np.unique(before, return_inverse=True)
    j, known = _find(m["contexts"], first)
    begun = np.where(known[:, None], m["begun"][j] if len(m["contexts"]) else np.zeros((len(j), 4)), 0.0)
    usable = known & (begun[:, 2:].min(axis=1) >= CONTEXT_TOKENS)  # both classes know the word before
    k, met = _find(m["pairs"], common.mix(before * U64(0x9FB21C651E98DF25) + h))
    pair = np.where(met[:, None], m["pair_counts"][k] if len(m["pairs"]) else np.zeros((len(k), 2)), 0.0)
    tokens = np.maximum(begun[at, 2:], 1)
    rest = np.minimum(1.0, D2 * begun[:, :2].sum(axis=1) / np.maximum(begun[:, 2:].sum(axis=1), 1))[at]
    p = np.where(usable[at][:, None], np.maximum(pair - D2, 0) / tokens + rest[:, None] * word[which], word[which])
    alone = (np.log(word[:, 1]) - np.log(word[:, 0]))[which]
    # passages that a few texts of one class share have bigrams of that class: those add a little only
    return np.minimum(np.log(p[:, 1]) - np.log(p[:, 0]), np.maximum(alone, 0) + 2.0)


def features(m: dict, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Difference of the log likelihoods per token: over the text, and over its most toxic span of each length."""
    h, before, offsets = words(data, at)
    size = np.diff(offsets)
    out = np.zeros((len(at) - 1, 1 + len(SPANS)))
    if not len(h):
        return out
    d = np.clip(differences(m, h, before), -3, 8)
    total = np.concatenate(([0.0], np.cumsum(d)))
    some = size > 0
    out[:, 0] = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)
    end = offsets[1:][common.row_of(offsets)]
    here = np.arange(len(h))
    for k, span in enumerate(SPANS, 1):
        # spans that would leave the text stop at its end but count as whole: short texts gain nothing
        mean = (total[np.minimum(here + span, end)] - total[:-1]) / span
        out[some, k] = np.maximum.reduceat(mean, offsets[:-1][some])
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS) -> dict:
    sample = common.cut(common.labelled_sample(docs, labels, label, modulus, held_out, rows), "toxicity-sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2 or sum(sizes.values()) < 20:
        return {"constant": (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)}
    sample = sample.dropDuplicates(["text", "y"])  # a text and its copies say a thing once
    aside = F.pmod(F.xxhash64("text", F.lit(4)), F.lit(4)) == 0
    model = count(sample.where(~aside))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in common.slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("y")), pa.array(list(features(model, data, at)), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = sample.where(aside).mapInArrow(measured, "doc_id long, y int, x array<double>").orderBy("doc_id", "y").collect()
    x, y = np.array([r["x"] for r in got]).reshape(len(got), 1 + len(SPANS)), np.array([r["y"] for r in got], float)
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (common.remainder("doc_id", modulus) != held_out))
    share = {r[label]: r["n"] for r in usable.groupBy(label).agg(F.count("*").alias("n")).collect()}
    weight = np.where(y == 1, share[1] / sizes[1], share[0] / sizes[0])
    mean, sd = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.column_stack(((x - mean) / sd, np.ones(len(x))))
    b = np.zeros(z.shape[1])
    for _ in range(40):  # Newton's steps with a small ridge
        p = common.logistic(z @ b)
        g = z.T @ (weight * (p - y)) + 0.1 * b
        b -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(b)), g)
    return model | {"mean": mean, "sd": sd, "slope": b}


def predict(model: dict, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(at) - 1, model["constant"])
    z = (features(model, data, at) - model["mean"]) / model["sd"]
    return common.logistic(z @ model["slope"][:-1] + model["slope"][-1])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = fit(docs, common.read(spark, sf_dir, "labels"))
    scored = quality.score(docs.withColumn("held_out", common.remainder("doc_id", 4) == 2), model, ("doc_id", "held_out"), predict)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
