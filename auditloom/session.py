"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. They are all session-level and safe to set on a cluster.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "auditloom", **conf: str) -> SparkSession:
    """Create (or get) a session with the settings above; extra ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is absent and the master is local, as in tests, a folder under the warehouse is used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    spark.sparkContext.setCheckpointDir(f"{warehouse.rstrip('/')}/_checkpoints")
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


TASK_BYTES = 2**25  # of rows that a task of a shuffle should have


@contextmanager
def shuffles_for(spark: SparkSession, size: int) -> Iterator[None]:
    """Inside, shuffles have a partition for each ``TASK_BYTES`` of ``size`` bytes, or as many as are set if those are more.

    It holds for what is run inside; a stream keeps the number that its checkpoint began with.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, max(int(before), -(-size // TASK_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it survives the loss of executors, unlike a local checkpoint.

    A reliable checkpoint computes its rows twice and hides their size; a written table is one job, and joins see how small
    it is.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
