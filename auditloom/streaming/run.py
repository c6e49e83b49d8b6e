"""Starting streams: source, state backend, and a bounded run to completion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State that outgrows memory needs RocksDB; custom processors require it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None):
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def run_to_files(stream: DataFrame, path: str, checkpoint: str | None = None, partition_by: list[str] | None = None):
    """Process what is there, append it to parquet files and stop. The sink is exactly-once."""
    spark = stream.sparkSession
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint or scratch_path(spark, "checkpoint"))
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start(path).awaitTermination()


def run_available(stream: DataFrame) -> DataFrame:
    """Run ``stream`` over the data that is there and return its output as a batch."""
    spark = stream.sparkSession
    path = scratch_path(spark, "stream-out")
    run_to_files(stream, path)
    return spark.read.schema(stream.schema).parquet(path)
