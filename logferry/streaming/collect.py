"""Running collection as Structured Streaming queries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from logferry.operators import events as E
from logferry.operators import records as R
from logferry.plans.cycle import Sink, Store, run_cycle, table_sink
from logferry.settings import Settings
from logferry.sources.tail import LogTail


def run_periodically(
    spark: SparkSession, rules: Callable[[], DataFrame], settings: Callable[[], Settings], store: Store,
    interval_sec: float, checkpoint_dir: str, sink: Sink = table_sink, delete: bool = False,
) -> StreamingQuery:
    """A cycle every ``interval_sec``. Rules and clock are asked for anew each time, so rules may
    change while it runs; offsets belong to files and are not touched by that."""

    def cycle(_: DataFrame, __: int) -> None:
        run_cycle(spark, rules(), settings(), store, sink=sink, delete=delete)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        ticks.writeStream.foreachBatch(cycle)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(processingTime=f"{max(int(interval_sec * 1000), 1)} milliseconds")
        .start()
    )


def tail_blocks(spark: SparkSession, directory: str, file_regex: str = ".", range_bytes: int = 8 << 20) -> DataFrame:
    """Stream of blocks of finished lines from the files of a directory, growing ones included."""
    spark.dataSource.register(LogTail)
    return (
        spark.readStream.format("logtail")
        .option("fileRegex", file_regex)
        .option("rangeBytes", str(range_bytes))
        .load(directory)
    )


def block_events(
    blocks: DataFrame, settings: Settings, component: str, start_regex: str | None = None,
    component_type: str = "user", min_level: str = "INFO",
) -> DataFrame:
    """Blocks of one component to events without shuffle or state, streaming or not.

    Age is measured against the clock of the batch, and late events go to the stream of their own
    day, so there is no watermark. A record that crosses blocks is left to the periodic cycle, which
    stitches; here each block begins a record.
    """
    df = blocks.withColumn("component", F.lit(component)).withColumn("block_no", F.lit(0).cast("bigint"))
    keep = ["component", "path", "fingerprint"]
    records = R.reassemble_records(df, None if start_regex is None else F.lit(start_regex), joiner=settings.joiner, keep=keep)
    return E.to_events(
        records.drop("is_head", "is_tail"), settings, F.lit(component_type), F.lit(settings.device), F.lit(min_level)
    )


def day_counts(events: DataFrame, lateness: dt.timedelta | None = None) -> DataFrame:
    """Events and bytes per tumbling UTC day and stream, as a streaming aggregation.

    With ``lateness`` the state of a day is given up once events are newer than its end by that much, so it
    doesn't grow for ever; later events of the day would be left out. Events beyond the age limit are dropped
    before, so that limit and some room for clocks that are ahead leave out nothing.
    """
    if lateness is not None:
        events = events.withWatermark("ts", f"{lateness // dt.timedelta(milliseconds=1)} milliseconds")
    return events.groupBy(F.window("ts", "1 day").alias("day"), "log_group", "log_stream").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("cost").alias("n_bytes")
    ).select(F.col("day.start").alias("day"), "log_group", "log_stream", "n_events", "n_bytes")


def upsert_days(batch: DataFrame, epoch: int, table: str) -> None:
    """Put changed counts of :func:`day_counts` in update mode into ``table``, which is partitioned by day.

    Only the days that changed are written anew. The counts are totals, so a repeated batch changes nothing.
    """
    spark, keys = batch.sparkSession, ["day", "log_group", "log_stream"]
    staged = f"{table}/_staged/epoch={epoch}"
    # Written before anything else: each use of the batch would run the streaming query's plan again.
    batch.withColumn("date", F.to_date("day")).write.mode("overwrite").parquet(f"{staged}/changed")
    changed = spark.read.parquet(f"{staged}/changed")
    try:
        current = spark.read.schema(changed.schema).parquet(table)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        current = changed.limit(0)
    same_days = current.join(changed.select("date").distinct(), "date", "left_semi")
    kept = same_days.join(changed.select(*keys), keys, "left_anti")
    changed.unionByName(kept).write.mode("overwrite").parquet(f"{staged}/days")
    spark.read.parquet(f"{staged}/days").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "date"
    ).parquet(table)


class CycleListener(StreamingQueryListener):
    """Tells registered callbacks when a micro-batch has ended."""

    def __init__(self) -> None:
        self._callbacks: dict[str, Callable] = {}

    def register(self, name: str, callback: Callable) -> None:
        self._callbacks.setdefault(name, callback)

    def unregister(self, name: str) -> None:
        self._callbacks.pop(name, None)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for callback in list(self._callbacks.values()):
            callback(event.progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def with_listeners(sink: Sink, listeners: dict[str, Callable[[DataFrame, int], None]]) -> Sink:
    """A sink that tells listeners the outcome of each delivery."""

    def notify(events: DataFrame, epoch: int) -> DataFrame:
        outcome = sink(events, epoch)
        for listener in list(listeners.values()):
            listener(outcome, epoch)
        return outcome

    return notify
