"""What every operator needs of a session: the shared folder for lineage cuts, and parallelism for small inputs."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Numbers of rows that are broadcast; longer lists of them are joined by a shuffle.
MANY = 1_000_000
ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and make sure that checkpoint() has a folder.

    A cluster names the shared folder in spark.checkpoint.dir; only where that is unset and the session runs on
    this machine alone (tests) a temporary folder is taken. Elsewhere it is an error, since executors would
    write to their own disks.
    """
    sc = spark.sparkContext
    paths = (sc.environment.get("PYTHONPATH") or "").split(os.pathsep)
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="skein-checkpoint-"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder: later stages reread files, not lost executors."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared checkpoint folder: like cut(), but compressed, and each reader reads its columns only."""
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a costly per-row function all cores: a scan with fewer splits than cores is redistributed.

    At scale scans have more splits than cores and this adds no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
