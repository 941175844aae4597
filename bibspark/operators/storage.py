"""Writing intermediate tables: one place that knows the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. A local master without one (tests) gets a temporary one; a cluster must name a shared one in spark.checkpoint.dir."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    """The name of a new folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the checkpoint folder of the session, its lineage dropped."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
