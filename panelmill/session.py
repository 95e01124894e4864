"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Partitions that a shuffle starts with, and bytes to which adaptive execution puts them together again: what a task
#: sorts and holds follows these bytes and not the size of the input.
SHUFFLE_PARTS, TASK_BYTES = 2_000, "8m"
#: Bytes of a file that a task reads: its map-side sums hold about as many groups as it reads rows.
SCAN_BYTES = "16m"
#: Bytecode of a generated method; above it the virtual machine interprets, so Spark splits such stages instead.
METHOD_LIMIT = 8_000


def configure(spark: SparkSession) -> SparkSession:
    """Settings that change results (time zone) or plans (adaptive execution)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", SHUFFLE_PARTS)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
    spark.conf.set("spark.sql.files.maxPartitionBytes", SCAN_BYTES)
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", METHOD_LIMIT)
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables in the cluster's shared folder.

    The folder is the one named by ``spark.checkpoint.dir`` or set with
    ``setCheckpointDir``. Without either, a temporary folder is used if the master
    is local (it goes when Python ends); on a cluster that would put each
    executor's part on its own disk, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir: executors are separate processes")
        base = tempfile.mkdtemp(prefix="panelmill-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """*df* written once as a table in the scratch folder and read back.

    Used where several later steps read one expensive result: it is computed
    once, survives lost executors, and gives the planner true sizes.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
