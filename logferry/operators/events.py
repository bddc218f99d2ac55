"""From records to events: parse, filter, timestamp, route and cut to size. No row leaves its task.

What is parsed is passed on through a generator of one row. Filters on it can then not be pushed below,
where the planner would have to repeat the parsing inside each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logferry import settings as S
from logferry.functions import text as T
from logferry.settings import Settings


def _once(df: DataFrame, column: Column, name: str) -> DataFrame:
    """Add a column that is computed exactly once per row, whatever is filtered by it later."""
    return df.select("*", F.explode_outer(F.array(column)).alias(name))


def parse_structured(records: DataFrame, message: str = "message") -> DataFrame:
    """Add ``structured``, ``level`` and ``json_ts_ms`` (NULL for text records).

    A record whose level has an unknown name is kept and treated as text.
    """
    df = _once(records, T.parse_structured(F.col(message)), "_json")
    known = T.level_rank(F.col("_json.level")).isNotNull()
    return df.withColumns(
        {
            "structured": F.coalesce(known, F.lit(False)),
            "level": F.when(known, F.col("_json.level")),
            "json_ts_ms": F.when(known, F.col("_json.ts_ms")),
            "unknown_level": F.col("_json").isNotNull() & ~F.coalesce(known, F.lit(False)),
        }
    ).drop("_json")


def filter_min_level(records: DataFrame, min_level: Column) -> DataFrame:
    """Drop structured records below the minimum level; text records always stay."""
    floor = T.level_rank(F.coalesce(min_level, F.lit(S.DEFAULT_MIN_LEVEL)))
    return records.where(~F.col("structured") | (T.level_rank(F.col("level")) >= floor))


def resolve_event_ts(records: DataFrame, ingest_ts: Column, message: str = "message") -> DataFrame:
    """Add ``ts``: the JSON timestamp, else the text timestamp, else the time of ingestion (ms)."""
    text_ts = F.when(~F.col("structured"), T.extract_text_ts(F.col(message)))
    ts = F.coalesce(F.timestamp_millis("json_ts_ms"), text_ts, ingest_ts)
    others = records.drop("ts") if "ts" in records.columns else records
    return _once(others, T.to_millis(ts), "ts")


def drop_expired(records: DataFrame, as_of: Column, max_age=S.MAX_EVENT_AGE) -> DataFrame:
    """Drop events strictly older than ``max_age``; the boundary itself is kept."""
    return records.where(F.col("ts") >= as_of - F.lit(max_age))


def route(records: DataFrame, settings: Settings, component_type: Column, device: Column) -> DataFrame:
    """Add ``log_group`` and ``log_stream``."""
    return records.withColumns(
        {
            "log_group": T.group_name(settings.group_template, component_type, F.lit(settings.region), F.col("component")),
            "log_stream": T.stream_name(F.col("ts"), device),
        }
    )


def split_oversize(records: DataFrame, cap: int = S.MAX_EVENT_BYTES, message: str = "message") -> DataFrame:
    """One row per chunk of at most ``cap`` bytes: chunk_no, size, cost, emit and the chunk's text."""
    others = [c for c in records.columns if c != message]
    text, i = F.col(message), F.col("chunk_no")
    # Only the numbers of the chunks are unnested; nearly always there is one.
    numbers = F.sequence(F.lit(0), T.chunk_count(text, cap) - 1)
    df = records.select(*others, message, F.explode_outer(numbers).alias("chunk_no"))
    size = T.chunk_size(text, i, cap)
    return df.select(
        *others,
        "chunk_no",
        size.alias("size"),
        T.event_cost(size).alias("cost"),
        T.is_emitted(T.byte_chunk(text, i, cap)).alias("emit"),
        T.byte_chunk(text, i, cap).alias(message),
    )


def drop_blank_events(events: DataFrame) -> DataFrame:
    """Events that are sent. Blank ones have taken their share of the batch all the same."""
    return events.where("emit")


def to_events(records: DataFrame, settings: Settings, component_type: Column, device: Column, min_level: Column) -> DataFrame:
    """Records to routed events of bounded size: the operators above, in order."""
    moment = F.timestamp_millis(F.lit(settings.as_of_ms))
    df = parse_structured(records)
    df = filter_min_level(df, min_level)
    df = resolve_event_ts(df, moment)
    df = drop_expired(df, moment, settings.max_event_age)
    df = route(df, settings, component_type, device)
    return split_oversize(df, settings.max_event_bytes)


def group_streams(events: DataFrame) -> DataFrame:
    """Per stream: number of events, bytes, first and last time."""
    return events.groupBy("log_group", "log_stream").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum("cost").alias("n_bytes"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
