"""Delivery of stream batches: what was tried, what is new, in which order, and what came back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logferry import settings as S
from logferry.operators.ordering import running

# Outcomes of one try. The first two end it well, the third ends it badly, the last two ask for
# another try.
OK, ALREADY_ACCEPTED = "ok", "already_accepted"
SERVICE_ERROR = "service_error"
BAD_TOKEN, MISSING_TARGET = "bad_token", "missing_target"

BATCH_KEYS = ("log_group", "log_stream", "batch_no")


def retry_outcome(attempts: DataFrame, keys: Sequence[str] = BATCH_KEYS, max_tries: int = S.MAX_TRIES) -> DataFrame:
    """Reduce a log of tries (keys, try_no, outcome) to one row per batch: delivered, n_tries, outcome.

    The first success or service error settles the batch; tries after that, or beyond ``max_tries``,
    do not count.
    """
    counted = F.col("try_no") <= max_tries
    settled = counted & F.col("outcome").isin(OK, ALREADY_ACCEPTED, SERVICE_ERROR)
    pair = F.struct("try_no", "outcome")
    per_batch = attempts.groupBy(*keys).agg(
        F.min(F.when(settled, pair)).alias("end"),
        F.max(F.when(counted, pair)).alias("last"),
    )
    final = F.coalesce("end", "last")
    return per_batch.select(
        *keys,
        F.coalesce(F.col("end.outcome").isin(OK, ALREADY_ACCEPTED), F.lit(False)).alias("delivered"),
        final["try_no"].cast("bigint").alias("n_tries"),
        final["outcome"].alias("outcome"),
    )


def dedupe_delivered(batches: DataFrame, ledger: DataFrame, keys: Sequence[str] = BATCH_KEYS) -> DataFrame:
    """Batches that the ledger does not list as accepted."""
    return batches.join(ledger.select(*keys), list(keys), "left_anti")


def stream_sequence(
    batches: DataFrame, ledger: DataFrame, streams: Sequence[str] = ("log_group", "log_stream"), part: int = 4096
) -> DataFrame:
    """Add ``seq``: batches of a stream continue the numbers of the batches accepted before."""
    last = ledger.groupBy(*streams).agg(F.max("seq").alias("_last"))
    df = batches.withColumn("_part", F.floor(F.col("batch_no") / part))
    one = F.lit(1).cast("bigint")
    df = running(df, list(streams), [F.col("batch_no")], {"seq": ("sum", one)}, [["_part"]])
    df = df.drop("_part").join(last, list(streams), "left")
    return df.withColumn("seq", F.col("seq") + F.coalesce("_last", F.lit(0))).drop("_last")


def missing_targets(batches: DataFrame, catalog: DataFrame) -> DataFrame:
    """Groups and streams that have to be created; those in ``catalog`` (log_group, log_stream) exist."""
    wanted = batches.select("log_group", "log_stream").distinct()
    groups = (
        wanted.select("log_group").distinct().join(catalog.select("log_group"), "log_group", "left_anti")
        .select(F.lit("group").alias("kind"), "log_group", F.lit("").alias("log_stream"))
    )
    streams = wanted.join(
        catalog.select("log_group", "log_stream"), ["log_group", "log_stream"], "left_anti"
    ).select(F.lit("stream").alias("kind"), "log_group", "log_stream")
    return groups.unionByName(streams)


def empty_batch_ok(delivery: DataFrame) -> DataFrame:
    """A batch without events counts as delivered, so that its input is not read again."""
    return delivery.withColumn(
        "delivered", F.coalesce("delivered", F.lit(False)) | (F.coalesce("n_events", F.lit(0)) == 0)
    )


def partial_failure(delivery: DataFrame, attempt: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Status per stream of an attempt in which a client error stops the rest.

    ``delivery`` has ``delivered`` and ``fatal``. Streams up to the first fatal one keep their own
    result; those after it were not tried.
    """
    at = F.struct(*order)
    stop = delivery.groupBy(*attempt).agg(F.min(F.when(F.col("fatal"), at)).alias("_stop"))
    status = (
        F.when(F.col("_stop").isNotNull() & (at > F.col("_stop")), "not_tried")
        .when(F.col("delivered") & ~F.col("fatal"), "delivered")
        .otherwise("failed")
    )
    return delivery.join(stop, list(attempt)).withColumn("status", status).drop("_stop")


def hold_after_failure(delivery: DataFrame) -> DataFrame:
    """A stream takes its batches in order: what follows an undelivered batch counts as undelivered."""
    failed = F.min(F.when(~F.col("delivered"), F.col("batch_no")))
    first = delivery.groupBy("log_group", "log_stream").agg(failed.alias("_failed"))
    held = F.col("_failed").isNotNull() & (F.col("batch_no") > F.col("_failed"))
    return (
        delivery.join(first, ["log_group", "log_stream"])
        .withColumn("delivered", F.col("delivered") & ~held)
        .drop("_failed")
    )


def judged(batches: DataFrame, outcome: DataFrame) -> DataFrame:
    """``batches`` (BATCH_KEYS, n_events) with ``delivered``, from what a sink says of them.

    ``outcome`` has a row per batch with ``delivered``, or a row per try with ``try_no`` and ``outcome``;
    a batch that it leaves out failed. After a batch with ``fatal`` the streams behind it in the same
    attempt, a batch number of a group, were not tried. Batches without events are fine in any case, and
    what follows an undelivered batch in its stream counts as undelivered.
    """
    keys = list(BATCH_KEYS)
    fatal = outcome.groupBy(*keys).agg(F.max("fatal").alias("fatal")) if "fatal" in outcome.columns else None
    if "try_no" in outcome.columns:
        outcome = retry_outcome(outcome)
    found = batches.join(outcome.select(*keys, "delivered"), keys, "left")
    if fatal is not None:
        found = found.join(fatal, keys, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("delivered", "fatal")})
        stopped = partial_failure(found, ["log_group", "batch_no"], ["log_stream"])
        found = stopped.withColumn("delivered", F.col("status") == "delivered").drop("fatal", "status")
    return hold_after_failure(empty_batch_ok(found))


def rejected_events(rejected: DataFrame) -> DataFrame:
    """Report of events refused inside accepted batches: number and bytes per stream and reason."""
    return rejected.groupBy("log_group", "log_stream", "reason").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("cost").alias("n_bytes")
    )
