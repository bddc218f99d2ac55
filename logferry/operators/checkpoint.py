"""Saved state: how far each file has been delivered, and what to forget.

``checkpoint`` rows: component, fingerprint, path, position, chunk_no, mtime, last_accessed.
``position`` is the byte offset of the next record, ``chunk_no`` the next chunk of that record.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logferry import settings as S

ENTRY = ["component", "fingerprint"]


def read_so_far(reads: DataFrame, receipts: DataFrame, range_bytes: int) -> DataFrame:
    """``reads`` with ``read_end`` moved back to where the unbroken chain of receipts ends, and ``unread``.

    ``receipts``: component, fingerprint, block_no and ``read_to``, which is NULL where a range was not
    read; a range without a receipt was not read either. What lies behind the first such range doesn't count,
    even if it was read: it will be read again.

    No range is listed that should have been read: the first one missing is 0 or follows one that was read.
    Receipts meet files in merge joins, since the planner takes frames made of ``reads`` for as small as these.
    """
    ends = F.array(F.struct("block_no", "read_to"), F.struct((F.col("block_no") + 1).alias("block_no"), F.lit(None).alias("read_to")))
    ends = receipts.where("read_to is not null").select(*ENTRY, F.inline(ends))
    ends = ends.groupBy(*ENTRY, "block_no").agg(F.max("read_to").alias("read_to"))  # NULL: follows one that was read, and was not
    here = F.col("read_to").isNotNull()
    chain = ends.groupBy(*ENTRY).agg(
        F.min(F.when(here, F.col("block_no"))).alias("_first"), F.min(F.when(~here, F.col("block_no"))).alias("_next")
    )
    chain = chain.select(*ENTRY, F.when(F.col("_first") == 0, F.col("_next")).otherwise(0).alias("_broken"))
    before = ends.where(here).join(chain.hint("merge"), ENTRY).where("block_no < _broken")
    reached = before.groupBy(*ENTRY).agg(F.first("_broken").alias("_broken"), F.max("read_to").alias("_reached"))
    last = F.floor((F.col("read_end") - 1 - F.col("position")) / range_bytes)
    unread = (F.col("position") < F.col("read_end")) & (F.coalesce("_broken", F.lit(0)) <= last)
    end = F.when(unread, F.coalesce("_reached", "position")).otherwise(F.col("read_end"))
    joined = reads.join(reached.hint("merge"), ENTRY, "left")
    return joined.withColumns({"read_end": end, "unread": unread}).drop("_broken", "_reached")


def delivered_positions(progress: DataFrame, delivery: DataFrame, reads: DataFrame) -> DataFrame:
    """New position per file that was read.

    ``progress``: one row per batch, stream and file with ``start_off`` and ``first_chunk`` of its
    first event. ``reads``: component, fingerprint, path, length, mtime, is_active, position and
    ``read_end``. A file advances to its first event that was not delivered; if there is none, to the
    end of what was read, dropped records included. Where it doesn't move, its ``chunk_no`` stays too.
    """
    status = delivery.select("log_group", "log_stream", "batch_no", "delivered")
    failed = ~F.coalesce("delivered", F.lit(False))
    stop = (
        progress.join(status, ["log_group", "log_stream", "batch_no"], "left")
        .where(failed)
        .groupBy(*ENTRY)
        .agg(F.min(F.struct("start_off", "first_chunk")).alias("_stop"))
    )
    moved = F.greatest(F.col("position"), F.coalesce("_stop.start_off", "read_end"))
    saved = F.col("chunk_no") if "chunk_no" in reads.columns else F.lit(0)
    chunk = F.when(moved > F.col("position"), F.coalesce(F.col("_stop.first_chunk"), F.lit(0))).otherwise(
        F.coalesce(F.col("_stop.first_chunk"), saved)
    )
    return reads.join(stop, ENTRY, "left").withColumns({"position": moved, "chunk_no": chunk}).drop("_stop", "read_end")


def completed_files(positions: DataFrame) -> DataFrame:
    """Files that are not active and have been delivered to their end."""
    return positions.where(~F.col("is_active") & (F.col("position") == F.col("length")))


def advance_checkpoint(checkpoint: DataFrame, positions: DataFrame, now: Column) -> DataFrame:
    """The checkpoint after a cycle: new positions replace old ones, completed files drop out."""
    moved = positions.select(
        *ENTRY, "path", "position", "chunk_no", "mtime", now.alias("last_accessed"),
        (~F.col("is_active") & (F.col("position") == F.col("length"))).alias("_done"),
    )
    merged = upsert_entries(checkpoint.withColumn("_done", F.lit(False)), moved)
    return merged.where(~F.col("_done")).drop("_done")


def advance_watermark(watermark: DataFrame, completed: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """Per component the latest mtime of a completed file; it never goes back.

    ``pending`` are files still to be delivered: the watermark stays below the oldest of its component,
    so that none of them counts as processed.
    """
    done = completed.select("component", F.col("mtime").alias("last_mtime"))
    if pending is not None:
        oldest = pending.groupBy("component").agg(F.min("mtime").alias("_oldest"))
        done = done.join(oldest, "component", "left").where("_oldest is null or last_mtime < _oldest").drop("_oldest")
    return (
        watermark.select("component", "last_mtime").unionByName(done)
        .groupBy("component").agg(F.max("last_mtime").alias("last_mtime"))
    )


def evict_stale(checkpoint: DataFrame, now: Column, idle: dt.timedelta = S.IDLE_LIMIT) -> DataFrame:
    """Drop entries not accessed for longer than ``idle``."""
    return checkpoint.where(F.col("last_accessed") >= now - F.lit(idle))


def touch_accessed(checkpoint: DataFrame, looked_up: DataFrame, now: Column) -> DataFrame:
    """Entries that were looked up count as accessed now."""
    hit = looked_up.select(*ENTRY).distinct().withColumn("_hit", F.lit(True))
    touched = F.when(F.col("_hit"), now).otherwise(F.col("last_accessed"))
    return checkpoint.join(hit, ENTRY, "left").withColumn("last_accessed", touched).drop("_hit")


def most_recent_entry(checkpoint: DataFrame) -> DataFrame:
    """The entry used last, per component."""
    rest = [c for c in checkpoint.columns if c not in ("component", "last_accessed", "fingerprint")]
    return (
        checkpoint.groupBy("component")
        .agg(F.max(F.struct("last_accessed", "fingerprint", *rest)).alias("e"))
        .select("component", "e.*")
    )


def upsert_entries(checkpoint: DataFrame, put: DataFrame) -> DataFrame:
    """Put entries: they replace those with the same key."""
    rest = [c for c in checkpoint.columns if c not in ENTRY]
    both = checkpoint.withColumn("_new", F.lit(0)).unionByName(put.withColumn("_new", F.lit(1)))
    return (
        both.groupBy(*ENTRY).agg(F.max(F.struct("_new", *rest)).alias("e")).select(*ENTRY, *[f"e.{c}" for c in rest])
    )


def put_if_absent(checkpoint: DataFrame, put: DataFrame) -> DataFrame:
    """Add entries whose key is not there yet."""
    return checkpoint.unionByName(put.join(checkpoint.select(*ENTRY), ENTRY, "left_anti"))


def remove_entries(checkpoint: DataFrame, removed: DataFrame) -> DataFrame:
    """Remove the entries with the given keys; unknown keys are ignored."""
    return checkpoint.join(removed.select(*ENTRY), ENTRY, "left_anti")


def export_entries(checkpoint: DataFrame) -> DataFrame:
    """Entries as rows of (component, fingerprint, field, value), the form :func:`snapshot_diff` reads."""
    fields = [c for c in checkpoint.columns if c not in ENTRY]
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields])
    return checkpoint.select(*ENTRY, F.inline(pairs))


def restore_state(saved: DataFrame, watermark: DataFrame) -> DataFrame:
    """Saved entries that may still matter: modified after the watermark, or there is none."""
    return (
        saved.join(watermark.select("component", "last_mtime"), "component", "left")
        .where(F.col("last_mtime").isNull() | (F.col("mtime") > F.col("last_mtime")))
        .drop("last_mtime")
    )


def import_legacy_state(checkpoint: DataFrame, legacy: DataFrame, files: DataFrame, enabled: bool = True) -> DataFrame:
    """Add old entries, one per component, that know a path but perhaps no fingerprint.

    A missing fingerprint is taken from the file at that path; without one the entry is dropped.
    Present keys stay as they are.
    """
    if not enabled:
        return checkpoint
    known = files.select("component", "path", F.col("fingerprint").alias("_found"))
    found = (
        legacy.join(known, ["component", "path"], "left")
        .withColumn("fingerprint", F.coalesce("fingerprint", "_found"))
        .where(F.col("fingerprint").isNotNull())
        .drop("_found")
    )
    added = found.join(checkpoint.select(*ENTRY), ENTRY, "left_anti")
    return checkpoint.unionByName(added, allowMissingColumns=True)


def purge_removed(checkpoint: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop the state of components without a rule."""
    return checkpoint.join(rules.select("component"), "component", "left_semi")


def flatten_json(df: DataFrame, keys: Sequence[str], column: str, at_once: int = 6) -> DataFrame:
    """Nested JSON objects as rows of (keys, path, value), without a shuffle.

    Names on the path are lower-cased and joined by ``/``. The first ``at_once`` levels are unnested
    within the row, deeper ones level by level as long as any row holds an object.
    """

    def entries(text: Column, prefix: Column | None) -> Column:
        found = F.map_entries(F.from_json(text, "map<string,string>"))
        return F.transform(
            found,
            lambda e: F.struct(
                (F.lower(e["key"]) if prefix is None else F.concat(prefix, F.lit("/"), F.lower(e["key"]))).alias("path"),
                e["value"].alias("value"),
            ),
        )

    def unnested(path: Column, value: Column) -> Column:
        own = F.array(F.struct(path.alias("path"), value.alias("value")))
        return F.when(F.startswith(value, F.lit("{")), F.coalesce(entries(value, path), own)).otherwise(own)

    leaves = entries(F.col(column), None)
    for _ in range(at_once - 1):
        leaves = F.flatten(F.transform(leaves, lambda e: unnested(e["path"], e["value"])))
    rows = df.select(*keys, F.inline_outer(leaves)).where("path is not null")
    is_object = F.startswith("value", F.lit("{")) & entries(F.col("value"), F.col("path")).isNotNull()
    while not rows.where(is_object).isEmpty():
        rows = rows.select(*keys, F.inline_outer(unnested(F.col("path"), F.col("value")))).where("path is not null")
    return rows


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Real changes between two flat snapshots (keys, path, value): insert, update, delete."""
    on = [*keys, "path"]
    left = old.select(*on, F.col("value").alias("old_value"), F.lit(True).alias("_old"))
    right = new.select(*on, F.col("value").alias("new_value"), F.lit(True).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), "delete")
        .when(~F.col("old_value").eqNullSafe(F.col("new_value")), "update")
    )
    return left.join(right, on, "full").withColumn("change", change).where("change is not null").drop("_old", "_new")
