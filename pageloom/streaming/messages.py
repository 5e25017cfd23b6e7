"""Recorded model events as streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.plans.chat import END, STREAM, answers, dispatch, tool_calls
from pageloom.sources import stores

EVENT_COLUMNS = ("conv_id", "run_id", "seq", "pass", "event", "chunk", "tool_calls")


def route(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text chunks and calls of a stream; all other events are ignored."""
    chunks = events.where(F.col("event") == STREAM)
    calls = events.where((F.col("event") == END) & (F.size("tool_calls") > 0))
    return chunks, calls


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("conv_id", "run_id"), F.lit(buckets)).cast("int")


def assemble(batch: DataFrame, batch_id: int, path: str, tools: Sequence[str] | None = None, buckets: int = 64) -> None:
    """Land one batch of events and put the messages of its runs together anew.

    Events lie by bucket of their run and by batch, so a batch that is repeated overwrites itself.  Of the buckets that the batch
    touches, the events of its runs are read, late ones and those of earlier batches alike, and those runs'
    messages replaced; other buckets are neither read nor written.
    """
    spark = batch.sparkSession
    rows = batch.where(F.col("event").isin(STREAM, END)).select(
        *EVENT_COLUMNS, _bucket(buckets).alias("bucket"), F.lit(batch_id).cast("long").alias("batch"))
    with stores.scratch(spark, "batch") as folder:
        rows = stores.stored(rows, f"{folder}/rows")
        runs = stores.stored(rows.select("bucket", "conv_id", "run_id").distinct(), f"{folder}/runs")
        if runs.isEmpty():
            return
        stores.overwrite_partitions(rows, f"{path}/events", ["bucket", "batch"])
        events = spark.read.schema(rows.schema).parquet(f"{path}/events")
        mine = events.join(runs, ["bucket", "conv_id", "run_id"], "left_semi")
        said = answers(mine, tools).withColumn("bucket", _bucket(buckets))
        stores.replace_rows(said, f"{path}/messages", ["conv_id", "run_id"], ["bucket"])


def land_events(events: DataFrame, path: str, checkpoint: str, tools: Sequence[str] | None = None, buckets: int = 64) -> None:
    """Process the events that are there: land each exactly once and keep the messages they make up to date.

    Nothing has to wait for a run to end and no run is too late.  The work of a batch is that of the buckets it touches;
    the number of buckets of a table must not change.
    """
    query = (
        events.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: assemble(batch, batch_id, path, tools, buckets)).start()
    )
    query.awaitTermination()


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Whole messages of the landed events, by the rule of both passes: conv_id, run_id, text."""
    return spark.read.parquet(f"{path}/messages").select("conv_id", "run_id", "text")


def stream_responses(events: DataFrame, registry: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Tool responses on a stream: a stream-static join per call."""
    _, calls = route(events)
    return dispatch(tool_calls(calls), registry)


def run_available(out: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; files are committed exactly once."""
    query = (
        out.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("path", path).option("checkpointLocation", checkpoint).start()
    )
    query.awaitTermination()


def session_history(messages: DataFrame, path: str, checkpoint: str) -> None:
    """Append a stream of messages (conv_id, turn, role, text) to a conversation table.

    A restarted run goes on from the checkpoint and writes no message twice;
    the table is read back by ``read_conversations``.
    """
    run_available(messages.select("conv_id", "turn", "role", "text"), path, checkpoint)
