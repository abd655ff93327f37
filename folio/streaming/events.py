"""Structured Streaming over event logs: latest status, windowed counts, stall watch."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folio.operators.events import micros
from folio.session import keep_scratch

STALL_OUT = "key string, last_us long, idle_s double"
STALL_STATE = "last_us long, told boolean"


def read_log(spark: SparkSession, path: str, schema, fmt: str = "parquet", files: int = 1000) -> DataFrame:
    """A directory of an append-only log as a stream; the checkpoint remembers what was read."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files).load(path)


def latest_counts(stream: DataFrame, key: str = "user_id") -> DataFrame:
    """Running count and last event of each key, for complete or update mode."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"))


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts in event-time windows with a watermark, for update or append mode."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def _watch(limit_s: float):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told = state.get if state.exists else (None, False)
        if state.hasTimedOut:
            if last is not None and not told:
                yield pd.DataFrame({"key": [str(key[0])], "last_us": [last], "idle_s": [limit_s]})
                state.update((last, True))
            return
        for pdf in batches:
            newest = int(pdf["us"].max())
            last, told = (newest if last is None else max(last, newest)), False
        if last is not None:
            state.update((last, told))
            state.setTimeoutDuration(max(1, int(limit_s * 1000)))

    return step


def stall_watch(stream: DataFrame, key: str, limit_s: float) -> DataFrame:
    """Keys from which nothing came for limit_s of processing time, told once; state is one row for each key."""
    rows = stream.select(F.col(key).cast("string").alias("k"), micros(F.col("ts")).alias("us"))
    return rows.groupBy("k").applyInPandasWithState(_watch(limit_s), STALL_OUT, STALL_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_to_end(result: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a streaming result until its source is used up: its last state in complete mode, else all it wrote, with its batch."""
    spark = result.sparkSession
    out, written = keep_scratch(spark, name), []

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        written.append(number)

    query = result.writeStream.outputMode(mode).option("checkpointLocation", keep_scratch(spark, f"{name}-log")).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], result.schema).withColumn("batch", F.lit(0))
    rows = spark.read.schema(StructType([*result.schema.fields, StructField("batch", IntegerType())])).parquet(out)
    return rows.filter(F.col("batch") == max(written)) if mode == "complete" else rows


def _stream_of(table: DataFrame) -> DataFrame:
    """A table's own files as a stream."""
    path = table.inputFiles()[0]
    pattern = os.path.basename(path)
    return table.sparkSession.readStream.schema(table.schema).option("pathGlobFilter", pattern if len(table.inputFiles()) == 1 else "*.parquet").parquet(os.path.dirname(path))


def replay_latest(events: DataFrame) -> DataFrame:
    return run_to_end(latest_counts(_stream_of(events)), "complete", "latest").drop("batch")


def replay_counts(events: DataFrame) -> DataFrame:
    """(start, event_type, n, total) through windows with a watermark, in update mode: state is dropped when the watermark has passed a
    window, and of the updates of a window the last counts."""
    updates = run_to_end(windowed_counts(_stream_of(events)), "update", "counts")
    last = updates.groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("m"))
    return last.select(F.col("window.start").alias("start"), "event_type", "m.n", "m.total")
