"""Session settings: none of them change results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "gaugegrid", cores: int | None = None, memory: str | None = None) -> SparkSession:
    """Start or reuse a session; the environment overrides cores, memory, shuffle partitions and local directory."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true")
    cores = cores or os.environ.get("GAUGEGRID_CORES")
    if cores:
        builder = builder.master(f"local[{cores}]")
    for variable, key in (
        ("GAUGEGRID_MEMORY", "spark.driver.memory"),
        ("GAUGEGRID_SHUFFLE_PARTITIONS", "spark.sql.shuffle.partitions"),
        ("GAUGEGRID_LOCAL_DIR", "spark.local.dir"),
        ("GAUGEGRID_TIME_ZONE", "spark.sql.session.timeZone"),
        ("GAUGEGRID_ARROW_ROWS", "spark.sql.execution.arrow.maxRecordsPerBatch"),
    ):
        if os.environ.get(variable):
            builder = builder.config(key, os.environ[variable])
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    return spark


def use_checkpoints(spark: SparkSession) -> str:
    """Make sure a checkpoint directory is set: the cluster's ``spark.checkpoint.dir``, or a fresh one where all runs on one machine."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gaugegrid-checkpoints-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the checkpoint folder and read back, for steps that read them several times."""
    path = f"{use_checkpoints(df.sparkSession).rstrip('/')}/gaugegrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
