"""Results that must be computed once: tables in the folder which the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which the cluster names in ``spark.checkpoint.dir``.

    Only a local master, whose driver and executors are one machine, may go without: it gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = jdir.get() if jdir.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        root = f"file://{tempfile.mkdtemp(prefix='curio-checkpoint-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a short lineage that survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores appended as keep it apart from the ``taken`` ones, whatever their case."""
    have = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out
