"""Streaming queries, driven to the end of the given tables and checked like the others."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logferry.operators import events as E
from logferry.plans import views as V
from logferry.plans.registry import query
from logferry.plans.views import millis, with_sql
from logferry.sources.scratch import scratch
from logferry.streaming.collect import day_counts, upsert_days

_EVENTS = (V.RAW_EVENTS, V.PARSED, V.ROUTED)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream of log lines."""
    schema = V.table(spark, sf_dir, "events").schema
    # A pattern, as the table may be one file or a folder of part files.
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return V.raw_lines(rows).drop("ts").withColumnRenamed("raw", "message")


def drain(stream: DataFrame, mode: str, write: Callable[[DataFrame, int, str], None]) -> DataFrame:
    """Run a stream until its input is used up and read back the table that ``write`` has made of its batches."""
    spark = stream.sparkSession
    root = scratch(spark)
    q = (
        stream.writeStream.outputMode(mode).foreachBatch(lambda df, epoch: write(df, epoch, f"{root}/out"))
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def by_epoch(df: DataFrame, epoch: int, table: str) -> None:
    """Every micro-batch writes its own folder and would write it again if it were repeated."""
    df.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")


@query("stream_events", with_sql(*_EVENTS, final="""
  select event_id, log_group, log_stream, cost, ts_ms from routed"""))
def stream_events(spark, sf_dir):
    """Parsing, filtering, routing and cutting without state."""
    events = E.to_events(event_stream(spark, sf_dir), V.SETTINGS, F.lit("user"), F.col("device"), F.lit("INFO"))
    return drain(events, "append", by_epoch).select("event_id", "log_group", "log_stream", "cost", millis("ts"))


@query("stream_day_windows", with_sql(*_EVENTS, final="""
  select ts_ms // 86400000 * 86400000 as day_ms, log_group, log_stream, count(*) as n_events, cast(sum(cost) as bigint) as n_bytes
  from routed group by 1, 2, 3"""))
def stream_day_windows(spark, sf_dir):
    """Tumbling UTC days over the time of the event itself; late events go to their old day, whose state ends
    a day after the age limit."""
    events = E.to_events(event_stream(spark, sf_dir), V.SETTINGS, F.lit("user"), F.col("device"), F.lit("INFO"))
    days = day_counts(events, V.SETTINGS.max_event_age + dt.timedelta(days=1))
    return drain(days, "update", upsert_days).select(millis("day"), "log_group", "log_stream", "n_events", "n_bytes")
