"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes each stage's result to the shared folder and reads it again, so a lost
executor never sends work back beyond the stage at hand.

Definedness of every stage: rows of a null or repeated id are documents of their own (the mix gives rows of
one id one rate); null and empty texts pass the stages that look for something in them, and have the score of
the zero vector; very long texts are worked on whole; ties are settled by ids, then texts; equal rows are
equal in all that is decided; extra columns go through whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.llm import common, decontam, jaccard, mixing, quality, token_shards

#: Documents that score below are rejected.
LEAST_QUALITY = 0.5
#: What reaches the mix is mostly clean; the little else is kept down.
TARGETS = {"clean": 0.96, "low": 0.01, "toxic": 0.03}


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the quality classifier rejects go."""
    model = quality.fit(docs, common.read(spark, sf_dir, "labels"))
    (name,) = common.unused(docs.columns, "score")
    return quality.score(docs, model, tuple(docs.columns), into=name).where(F.col(name) >= LEAST_QUALITY).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group of near duplicates stays."""
    return jaccard.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents with a benchmark window go."""
    return decontam.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents as often as their fitted rates say."""
    return mixing.resample(docs, common.read(spark, sf_dir, "labels"), TARGETS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: token shards are written and read back."""
    path = common.shared_folder(spark, "pipeline-tokens")
    token_shards.encode(docs, path, token_shards.default_tokenizer())
    return token_shards.digests(spark, path)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: A trained network, transitive links and tokenization: not for SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
