"""Spark session and lineage helpers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "jobsieve", shuffle_partitions: int | None = None) -> SparkSession:
    """Return a session configured for this library (UTC clock, AQE, no UI). The number of shuffle partitions is
    left to the cluster unless given here or in ``JOBSIEVE_SHUFFLE_PARTITIONS`` (tests, local runs)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    parts = shuffle_partitions or os.environ.get("JOBSIEVE_SHUFFLE_PARTITIONS")
    if parts:
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    spark = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``. Only a local session (one machine) may leave it unset and gets
    a fresh scratch folder; on a cluster a missing shared folder is an error."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="jobsieve-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Written once under the shared checkpoint folder and read back (survives executor loss): compressed columns instead of
    a checkpoint's plain rows, and the plans that follow see the size of what was written, not a guess from its inputs. What
    Parquet cannot hold (equal column names, columns without a type) is checkpointed."""
    names = [c.lower() for c in df.columns]
    if not names or len(set(names)) < len(names) or any(t in df.schema.simpleString() for t in ("void", "interval", "variant")):
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate files under the shared checkpoint folder."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"
