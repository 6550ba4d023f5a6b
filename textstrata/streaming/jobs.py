"""Streams: lock-out counts, feeds of changed states, job leases, conversation memory, sessions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.conversation import job_fold
from ..sources.commits import shared_dir


def event_stream(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def drained(stream: DataFrame, name: str, idle_batches: bool = True) -> DataFrame:
    """What a stream appends until its input is used up, as a table in the shared folder.

    Without ``idle_batches`` no batch runs without new input; streams with processing-time timers need
    that to end, and those with watermarks need the idle batch to emit what the watermark closes.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(idle_batches).lower())
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/table").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(files)
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def lockout_counts(events: DataFrame, key: str = "user_id", span: str = "15 minutes", step: str = "5 minutes", late: str = "1 hour", least: int = 5) -> DataFrame:
    """Keys with at least ``least`` failures in a sliding window. The watermark bounds the state; later events are dropped by it."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", span, step).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return windows.filter(F.col("n") >= least).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n")


def session_stream(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    got = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def changed_states(events: DataFrame, key: str, state: str, order: str = "ts") -> DataFrame:
    """Events that change their key's state, in order within each batch; the last state is kept between batches."""
    kinds = dict(events.dtypes)

    def run(k, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order)
        was = held.get[0] if held.exists else None
        before = rows[state].shift(1)
        before.iloc[0] = was
        held.update((rows[state].iloc[-1],))
        yield rows.loc[rows[state] != before, [key, order, state]]

    return events.select(key, order, state).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {state} {kinds[state]}", f"was {kinds[state]}", "append", GroupStateTimeout.NoTimeout)


def conversation_memory(turns: DataFrame, keep: int = 5, idle_ms: int = 1_800_000) -> DataFrame:
    """Per conversation and batch: its last ``keep`` texts; forgotten after ``idle_ms`` without a turn."""

    def run(k, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(frames)).sort_values("turn")
        texts = [*(list(held.get[0]) if held.exists else []), *rows["text"].tolist()][-keep:]
        held.update((texts,))
        held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"conv_id": [k[0]], "texts": [texts]})

    return turns.select("conv_id", "turn", "text").groupBy("conv_id").applyInPandasWithState(run, "conv_id long, texts array<string>", "texts array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def job_states(spark: SparkSession, events: DataFrame, table: str, checkpoint: str, most: int = 3):
    """Job events to a table of all events so far, in available-now batches; read it through ``job_table``. A batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_table(spark: SparkSession, table: str, most: int = 3) -> DataFrame:
    return job_fold(spark.read.parquet(table), most=most)
