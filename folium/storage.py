"""What driver and executors share: this package, and a folder with data kept there."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def attach(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master, where it is unset, a temporary folder takes its place."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="folium-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder: lineage ends there."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df, written as compressed Parquet beside the checkpoints: lineage ends there, and texts take less room than in a checkpoint."""
    at = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
