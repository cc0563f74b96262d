"""Packet streams, stream runs to completion, and the detection log sink."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from flowweir.schema import PACKET_SCHEMA
from flowweir.session import stage_path

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Counting the rows of a store looks every key up once more before it is written.
COUNT_ROWS = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's settings stay."""
    settings = {STATE_STORE: ROCKSDB, COUNT_ROWS: "false"}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def packet_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """Packet rows from a folder of Parquet files."""
    reader = spark.readStream.schema(PACKET_SCHEMA)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.parquet(path)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process all input there is now and return what the stream emitted."""
    spark = stream.sparkSession
    out, marks = stage_path(spark, name), stage_path(spark, f"{name}-progress")
    with rocksdb_state(spark):
        run = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", marks)
            .trigger(availableNow=True)
            .start(out)
        )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def log_batches(path: str):
    """foreachBatch writer for the detection log.

    Each batch owns one folder and replaces it when it is retried, so a batch
    that runs twice is logged once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def run_detection_log(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    out, marks = stage_path(spark, name), stage_path(spark, f"{name}-progress")
    run = (
        stream.writeStream.foreachBatch(log_batches(out))
        .outputMode("append")
        .option("checkpointLocation", marks)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(out)
