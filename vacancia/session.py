"""Session settings and the way lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What the engine expects of a session. All of it can be given at submit time instead.
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Left anti joins and the like may pay an extra shuffle to have a hot key split.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app_name: str = "vacancia", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread_scan(df: DataFrame) -> DataFrame:
    """A plain scan, spread over all cores if its files give fewer splits than there are.

    Small inputs in one file would otherwise be worked on by one task, and the expressions here
    cost far more than reading. Large inputs have more splits than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def working_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as ``spark.checkpoint.dir`` names it.

    Only a local master may do without the setting; there a temporary folder is fine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    in_force = spark.sparkContext.getCheckpointDir()
    if in_force:
        return in_force.rstrip("/")
    # executors of local-cluster[...] are processes of their own, as on any cluster
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    fallback = tempfile.mkdtemp(prefix="vacancia-")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


class TableSpool:
    """Writes intermediate tables under one new folder of the working folder.

    A written table cuts lineage, survives lost executors, is computed once and, unlike a
    checkpointed RDD, is read back with column pruning and pushed-down filters.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self._spark = spark
        self._root = f"{working_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
        self._count = 0

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self._root}/{self._count:04d}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)
