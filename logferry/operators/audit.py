"""Checks on what was delivered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logferry.operators.ordering import running, total_order
from logferry.sources.scratch import settle

SEQ_PATTERN = r"\(seq: (\d+)\)"


def stream_exists(expected: DataFrame, delivered: DataFrame) -> DataFrame:
    """Add ``found`` to expected (log_group, log_stream) rows."""
    keys = ["log_group", "log_stream"]
    there = delivered.select(*keys).distinct().withColumn("_there", F.lit(True))
    return expected.join(there, keys, "left").withColumn("found", F.coalesce("_there", F.lit(False))).drop("_there")


def count_check(delivered: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delivered against expected number of events; keys of either side are reported."""
    counts = delivered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_delivered"))
    joined = counts.join(expected.select(*keys, "n_expected"), list(keys), "full")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        *keys,
        F.coalesce("n_delivered", zero).alias("n_delivered"),
        F.coalesce("n_expected", zero).alias("n_expected"),
    ).withColumn("matches", F.col("n_delivered") == F.col("n_expected"))


def gaps_and_duplicates(events: DataFrame, keys: Sequence[str], message: str = "message", part: int = 4096) -> DataFrame:
    """Numbers from 1 on that are missing or occur more than once.

    Events carry ``(seq: n)``. Rows: keys, from_seq, to_seq, problem, n. A gap is one row however wide
    it is, so a single wrong number cannot blow up the result. Numbers are counted first, and their
    neighbours found in ranges of ``part`` numbers, so no key is gathered in one place.
    """
    seq = F.regexp_extract(message, SEQ_PATTERN, 1).try_cast("bigint")
    counts = (
        events.select(*keys, seq.alias("seq")).where("seq is not null").groupBy(*keys, "seq").agg(
            F.count(F.lit(1)).alias("n")
        )
    )
    duplicate = F.when(F.col("n") > 1, F.struct(F.col("seq").alias("from_seq"), F.col("seq").alias("to_seq"), F.lit("duplicate").alias("problem"), F.col("n").alias("n")))
    before = F.coalesce("_before", F.lit(0).cast("bigint"))
    missing = F.when(F.col("seq") - before > 1, F.struct((before + 1).alias("from_seq"), (F.col("seq") - 1).alias("to_seq"), F.lit("missing").alias("problem"), F.lit(0).cast("bigint").alias("n")))
    placed = running(
        counts.withColumn("_part", F.floor(F.col("seq") / part)), list(keys), [F.col("seq")],
        {"_before": ("max", F.col("seq"))}, [["_part"]], through_current=False,
    )
    return placed.select(*keys, F.inline_outer(F.array_compact(F.array(duplicate, missing)))).where("problem is not null")


def order_breaks(events: DataFrame, keys: Sequence[str], order: Sequence[str], message: str = "message") -> DataFrame:
    """Events whose place by time is not the number they carry; events need ``ts``."""
    seq = F.regexp_extract(message, SEQ_PATTERN, 1).try_cast("bigint")
    df = total_order(events.withColumn("seq", seq), list(keys), [F.col(c) for c in order], "nth", settle)
    return df.where(~F.col("nth").eqNullSafe(F.col("seq")))


def ingest_rate(events: DataFrame, keys: Sequence[str], size: str = "size", ingest_ts: str = "ingest_ts") -> DataFrame:
    """MiB per second between first and last ingestion; NULL if that is no time at all."""
    span = (F.unix_millis(F.max(ingest_ts)) - F.unix_millis(F.min(ingest_ts))) / 1000
    return events.groupBy(*keys).agg(
        F.sum(size).alias("n_bytes"),
        F.try_divide(F.sum(size), F.nullif(span, F.lit(0.0)) * (1024 * 1024)).alias("mib_per_sec"),
    )


def files_remaining(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Files per component before and after the plan, components without any included."""
    gone = plan.select("component", "path").withColumn("_gone", F.lit(True))
    return (
        files.join(gone, ["component", "path"], "left")
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("n_before"), F.sum(F.col("_gone").isNull().cast("bigint")).alias("n_after"))
    )


def byte_conservation(files: DataFrame, records: DataFrame) -> DataFrame:
    """Bytes of input against bytes of records, terminators counted, per component."""
    size_in = files.groupBy("component").agg(F.sum("length").alias("bytes_in"))
    size_out = records.groupBy("component").agg(
        F.sum(F.col("end_off") - F.col("start_off")).alias("bytes_read"),
        F.sum(F.octet_length("message")).alias("bytes_kept"),
        F.sum("n_lines").alias("n_lines"),
    )
    zero = F.lit(0).cast("bigint")
    return size_in.join(size_out, "component", "left").select(
        "component",
        "bytes_in",
        *[F.coalesce(c, zero).cast("bigint").alias(c) for c in ("bytes_read", "bytes_kept", "n_lines")],
    ).withColumn("conserved", F.col("bytes_in") == F.col("bytes_read"))
