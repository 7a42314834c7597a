"""Mixing to target weights by soft membership (operator 4), in DataFrame functions only.

* Domains come from the labelled table: ``toxic`` (toxic = 1), ``low`` (quality = 0), ``clean``.
* A naive Bayes classifier over hashed words and word shapes, counted on at most ``SAMPLE_ROWS``
  labelled rows a domain, gives every document posteriors p over the domains: its log likelihoods
  are divided by the root of the number of words, so membership stays soft.
* Nonnegative rates r of the documents are fitted by projected-gradient least squares, so that the
  expected tokens of each domain, sum of r * tokens * p, match the targets.  A step takes
  r <- max(0, r - sum_k p_k (total_k - target_k) / now_k): the gradient in a metric in which a step
  of one is safe.  Totals are sums of whole numbers, so the fit does not depend on the partitions; a
  step is one aggregation over the table of memberships, and the driver holds one number a domain.

``copies`` rounds a rate by a hash of the id: the expected number of copies is the rate.

Definedness: rows with the same id (null included) are one document: their words are pooled and they
share a rate.  A document without words has the prior as membership and a rate of one, for it has no
tokens to fit.  Very long texts count with all their words.  Equal documents have equal rates.  Extra columns
are ignored, and kept whatever their names by :func:`resample`.  Without labels all documents are of the first
domain.  An empty table gives no rows.  A fit that has not come close in time warns; :func:`shares` tells the gap.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.llm import common

DOMAINS = ("clean", "low", "toxic")
#: Default target weights; the tokens to reach are as many as keep the domain of most weight as it is.
TARGETS = {"clean": 0.90, "low": 0.06, "toxic": 0.04}
#: Bound of the fitting sample, in rows of each domain, and of the broadcast weights, in rows.
SAMPLE_ROWS, BUCKETS, SHAPES = 3_000, 1 << 18, 1 << 12
_STEPS, _REPLAYED, _CLOSE, _UNIT = 60, 15, 1e-4, 1000


def domain(labels: DataFrame) -> DataFrame:
    """(doc_id, k) of the labelled documents, k an index of DOMAINS; an id with several labels has the largest index."""
    known = labels.where("doc_id is not null and (toxic is not null or quality is not null)")
    k = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    return known.groupBy("doc_id").agg(F.max(k).alias("k"))


def _buckets(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each word (one without for a text without words): the bucket of the word and that of its shape.

    The shape is the word's ending of two characters and whether it has capitals.  All of it is generated
    code; no lambda is run for a word.
    """
    text = F.replace(F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    w = docs.select(*keep, F.explode(F.split(text, " ")).alias("w"))
    lower = F.lower("w")
    word = F.pmod(F.xxhash64(F.rtrim(lower, F.lit(".,;:!?"))), F.lit(BUCKETS))
    shape = F.pmod(F.xxhash64(F.substring("w", -2, 2), lower == F.col("w")), F.lit(SHAPES)) + BUCKETS
    some = F.col("w") != ""
    return w.select(*keep, F.when(some, word).alias("b"), F.when(some, shape).alias("s"))


def weights(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, smoothing: float = 4.0) -> tuple[DataFrame, list[float]]:
    """(b, w0, w1, ...): log likelihoods less their mean, and the log priors."""
    known = domain(labels)
    share = {r["k"]: r["n"] for r in known.groupBy("k").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(4))
    sample = reduce(DataFrame.unionByName, (known.where(F.col("k") == k).orderBy(order, "doc_id").limit(rows) for k in range(len(DOMAINS))))
    counts = _buckets(docs.join(F.broadcast(sample), "doc_id"), "k").select("k", F.explode(F.array("b", "s")).alias("b")).where("b is not null")
    table = common.cut(counts.groupBy("b").agg(*(F.count(F.when(F.col("k") == k, 1)).alias(f"n{k}") for k in range(len(DOMAINS)))), "mixing-counts")
    total = table.agg(*(F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in range(len(DOMAINS)))).first()
    logs = [F.log((F.col(f"n{k}") + smoothing * (total[k] + 1.0) / (max(total) + 1.0)) / F.lit(total[k] + 1.0)) for k in range(len(DOMAINS))]
    mean = reduce(lambda a, b: a + b, logs) / len(logs)
    alls = sum(share.values())
    # a domain that no row is labelled with is left out
    priors = [math.log((share.get(k, 0) + (k == 0)) / (alls + 1.0)) if share.get(k, 0) or k == 0 else -60.0 for k in range(len(DOMAINS))]
    return table.select("b", *((x - mean).alias(f"w{k}") for k, x in enumerate(logs))), priors


def memberships(docs: DataFrame, table: DataFrame, priors: list[float]) -> DataFrame:
    """(doc_id, n_tokens, p0, p1, ...) of every document."""
    ks = range(len(DOMAINS))
    shapes = table.where(F.col("b") >= BUCKETS).select(F.col("b").alias("s"), *(F.col(f"w{k}").alias(f"v{k}") for k in ks))
    scored = _buckets(docs.select("doc_id", "text"), "doc_id").join(F.broadcast(table.where(F.col("b") < BUCKETS)), "b", "left").join(F.broadcast(shapes), "s", "left")
    one = lambda k: F.coalesce(f"w{k}", F.lit(0.0)) + F.coalesce(f"v{k}", F.lit(0.0))
    sums = scored.groupBy("doc_id").agg((2 * F.count("b")).alias("units"), *(F.sum(one(k)).alias(f"s{k}") for k in ks))
    logit = [F.col(f"s{k}") / F.sqrt(F.greatest(F.col("units"), F.lit(1))) + F.lit(priors[k]) for k in ks]
    top = F.greatest(*logit)
    sums = sums.select("doc_id", (F.col("units") / 2).cast("long").alias("n_tokens"), *(F.exp(x - top).alias(f"e{k}") for k, x in zip(ks, logit, strict=True)))
    whole = reduce(lambda a, b: a + b, (F.col(f"e{k}") for k in ks))
    return sums.select("doc_id", "n_tokens", *(F.round(F.col(f"e{k}") / whole, 6).alias(f"p{k}") for k in ks))


def _rate(steps: list[list[float]]) -> Column:
    """The rate ``r0`` after the steps' corrections, each followed by the projection to what is not negative."""
    if not steps:
        return F.col("r0")
    listed = F.array(*(F.array(*(F.lit(float(c)) for c in step)) for step in steps))
    dot = lambda c: reduce(lambda a, b: a + b, (F.col(f"p{k}") * c[k] for k in range(len(DOMAINS))))
    return F.aggregate(listed, F.col("r0"), lambda r, c: F.greatest(F.lit(0.0), r - dot(c)))


def fit(members: DataFrame, targets: dict[str, float] | None = None, tokens: float | None = None) -> DataFrame:
    """``members`` with ``rate``.  ``tokens``: expected tokens of the mix; by default so many that the domain of most weight keeps its own."""
    ks = range(len(DOMAINS))
    weight = [(targets or TARGETS).get(d, 0.0) for d in DOMAINS]
    weight = [w / sum(weight) for w in weight]

    def totals(steps: list[list[float]]) -> list[float]:
        r = _rate(steps)
        found = members.select("n_tokens", *(f"p{k}" for k in ks), r.alias("r")).agg(*(F.sum(F.round(F.col("n_tokens") * F.col(f"p{k}") * F.col("r") * _UNIT).cast("long")).alias(f"t{k}") for k in ks)).first()
        return [float(x or 0) / _UNIT for x in found]

    members = members.withColumn("r0", F.lit(1.0))
    now = totals([])
    weight = [w if n > 0 else 0.0 for w, n in zip(weight, now, strict=True)]
    weight = [w / (sum(weight) or 1.0) for w in weight]
    if tokens is None:
        lead = max(ks, key=lambda k: weight[k])
        tokens = now[lead] / weight[lead] if weight[lead] else 0.0
    target = [w * tokens for w in weight]
    steps: list[list[float]] = []
    have = now
    for _ in range(_STEPS):
        if max((abs(h - t) for h, t in zip(have, target, strict=True)), default=0.0) <= _CLOSE * max(tokens, 1.0):
            break
        steps.append([(h - t) / max(n, 1.0) for h, t, n in zip(have, target, now, strict=True)])
        if len(steps) == _REPLAYED:  # so that a row never replays more steps than these
            members = common.cut(members.withColumn("r0", _rate(steps)), "mixing-rates")
            steps = []
        have = totals(steps)
    else:
        gap = max(abs(h - t) for h, t in zip(have, target, strict=True)) / max(tokens, 1.0)
        if gap > _CLOSE:
            warnings.warn(f"after {_STEPS} steps a domain is {gap:.2%} of all tokens from its target", stacklevel=2)
    rate = F.when(F.col("n_tokens") == 0, 1.0).otherwise(_rate(steps))
    return members.withColumn("rate", F.round(rate, 6)).drop("r0")


def copies(rate: Column, doc_id: Column) -> Column:
    """Whole copies of a document: the rate, rounded up or down by the id's hash."""
    chance = F.pmod(F.xxhash64(doc_id, F.lit(41)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(rate + chance).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, tokens: float | None = None) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate, copies) of every document."""
    table, priors = weights(docs, labels)
    fitted = fit(common.cut(memberships(docs, table, priors), "mixing-members"), targets, tokens)
    return fitted.select("doc_id", "n_tokens", *(F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, tokens: float | None = None) -> DataFrame:
    """The documents, each as often as its copies say."""
    n = mix(docs, labels, targets, tokens).where("copies > 0").select(F.col("doc_id").alias("id"), "copies")
    kept = docs.select(F.struct("*").alias("r")).join(n, F.col("r.doc_id").eqNullSafe(F.col("id")))
    return kept.select("r", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col("r")[c].alias(c) for c in docs.columns))


def shares(mixed: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(domain, target, by_rate, by_copies): how far the expected and the whole-numbered mix of :func:`mix` are from the targets."""
    weight = targets or TARGETS
    sums = [F.sum(F.col("n_tokens") * F.col(f"p_{d}") * F.col(r)).alias(f"{r}_{d}") for d in DOMAINS for r in ("rate", "copies")]
    whole = lambda r: reduce(lambda a, b: a + b, (F.coalesce(f"{r}_{d}", F.lit(0.0)) for d in DOMAINS))
    rows = [F.struct(F.lit(d).alias("domain"), F.lit(weight.get(d, 0.0) / sum(weight.values())).alias("target"), F.try_divide(F.col(f"rate_{d}"), whole("rate")).alias("by_rate"), F.try_divide(F.col(f"copies_{d}"), whole("copies")).alias("by_copies")) for d in DOMAINS]
    return mixed.agg(*sums).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
