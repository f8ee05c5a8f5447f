"""Session helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app: str = "gearwatch", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    folder = tempfile.mkdtemp(prefix="gearwatch-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster.

    Where none is set a session of one machine gets a scratch folder of its own, removed
    when the process ends. On a cluster executors would each write to their own disk and
    later reads would miss rows, so there a missing setting is an error.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if re.fullmatch(r"local(\[[^\]]*\])?", master):
        return _local_scratch()
    raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share (master {master})")


def materialize(df: DataFrame) -> DataFrame:
    """Write a table that several branches read into the shared checkpoint folder and read it back.

    Cuts the lineage, so the branches do not repeat the work and a lost executor
    does not either; unlike a checkpointed RDD the copy has size statistics, which
    join planning needs.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/gearwatch/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
