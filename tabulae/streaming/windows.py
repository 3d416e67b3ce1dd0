"""Streaming forms: de-duplicated windowed counts, upserts by batch, and rolling memory as state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabulae.session import read


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        from tabulae.session import checkpoint

        checkpoint(spark.range(1))
    return f"{context._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, folder: str, table: str, files_a_batch: int = 4) -> DataFrame:
    """A table as a stream of its files."""
    return spark.readStream.schema(read(spark, folder, table).schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{folder}/{table}.parquet*")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all input that is there now, as a table in the shared folder."""
    folder = shared_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def windowed_counts(events: DataFrame, time: str, key: str, kind: str, size: str, late: str) -> DataFrame:
    """Counts per window and kind; an event counts once however often it is delivered within the watermark."""
    once = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return once.groupBy(F.window(time, size), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("begins"), kind, "n")


def merge_batches(stream: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], empty: DataFrame) -> DataFrame:
    """The state that ``merge(state, batch)`` reaches over all batches; each state is a table of its own, so a repeated batch writes the same again."""
    folder = shared_folder(stream.sparkSession)
    spark = stream.sparkSession
    empty.write.parquet(f"{folder}/state-0")

    def step(batch: DataFrame, number: int) -> None:
        state = spark.read.schema(empty.schema).parquet(f"{folder}/state-{number}")
        merge(state, batch).write.mode("overwrite").parquet(f"{folder}/state-{number + 1}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    last = (query.lastProgress or {}).get("batchId", -1)
    done = max([0, *(i + 1 for i in [last] if i >= 0)])
    return spark.read.schema(empty.schema).parquet(f"{folder}/state-{done}")


def memory_triggers(messages: DataFrame, step: int = 6) -> DataFrame:
    """A row each time a user's messages beyond the summarised ones reach ``step``: ``user_id``, ``done`` and ``total``; state is two numbers a user."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, total = state.get if state.exists else (0, 0)
        total += sum(len(b) for b in batches)
        fired = []
        while total - done >= step:
            done += step
            fired.append((key[0], done, total))
        state.update((done, total))
        yield pd.DataFrame(fired, columns=["user_id", "done", "total"])

    return messages.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, done bigint, total bigint", "done bigint, total bigint", "append", GroupStateTimeout.NoTimeout)
