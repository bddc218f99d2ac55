"""Running totals and positions that do not pull a whole key into one task.

A plain window hands all rows of a key to one task. Here the rows of a key are cut into blocks that
follow the sort order (an hour, a file, a byte range). Blocks are summed first, with partial sums
before the shuffle; only one narrow row per block goes through the window of its key; the rows
themselves meet in windows of one block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _merge(fn: str, a: Column, b: Column) -> Column:
    if fn == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.least(a, b) if fn == "min" else F.greatest(a, b)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    measures: dict[str, tuple[str, Column]],
    blocks: Sequence[Sequence[str]] = (),
    through_current: bool = True,
) -> DataFrame:
    """Add running ``sum``, ``min`` or ``max`` of columns within ``keys``, in ``order``.

    ``blocks`` lists block columns from coarse to fine. Sorting by a level's columns must agree with
    ``order``, and a finer level starts with the columns of the coarser one. Block columns are never
    NULL. With ``through_current=False`` the current row is left out.
    """
    end = 0 if through_current else -1
    local_keys = [*keys, *(blocks[-1] if blocks else ())]
    frame = Window.partitionBy(*local_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = {n: _AGG[fn](c).over(frame) for n, (fn, c) in measures.items()}
    if not blocks:
        return df.withColumns(local)

    names = list(blocks[-1])
    per_block = df.groupBy(*keys, *names).agg(
        *[_AGG[fn](c).alias(f"_part_{n}") for n, (fn, c) in measures.items()]
    )
    before = running(
        per_block,
        keys,
        [F.col(c) for c in names],
        {f"_before_{n}": (fn, F.col(f"_part_{n}")) for n, (fn, _) in measures.items()},
        blocks[:-1],
        through_current=False,
    ).select(*keys, *names, *[f"_before_{n}" for n in measures])
    joined = df.join(before, [*keys, *names])
    merged = {n: _merge(fn, F.col(f"_before_{n}"), local[n]) for n, (fn, _) in measures.items()}
    return joined.withColumns(merged).drop(*[f"_before_{n}" for n in measures])


def positions(df: DataFrame, keys, order, out: str, blocks=()) -> DataFrame:
    """Add the 1-based position of each row within its key as a bigint."""
    return running(df, keys, order, {out: ("sum", F.lit(1).cast("bigint"))}, blocks)


_INDEX_BITS = 33  # of monotonically_increasing_id: the place of a row in its partition


def total_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, settle: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Add the 1-based position of each row within its key in ``order``, whatever the size of a key.

    Rows are dealt over ranges of (keys, order) with sampled split points and sorted there, so neither
    a key nor a moment that very many rows share makes a task larger than the others; rows equal in all
    of these are told apart by a row number, their mutual order is not defined. ``settle`` writes a frame
    and returns it as it was written: the ranges must not be sampled twice. Per key and range one narrow
    row then says how many rows of the key lie in the ranges before. Keys may be NULL.
    """
    sorting = [*[F.col(k).asc_nulls_first() for k in keys], *order, F.col("_row")]
    placed = settle(
        df.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(*sorting)
        .sortWithinPartitions(*sorting)
        .withColumn("_at", F.monotonically_increasing_id())
        .drop("_row")
    ).withColumn("_range", F.shiftright("_at", _INDEX_BITS))
    spans = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + 1 - F.col("_first")
    # Written too, so that the planner knows its size; a row per key and range.
    shifts = settle(spans.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
                                 F.col("_range").alias("_of_range"), shift.alias("_shift")))
    same = placed["_range"] == shifts["_of_range"]
    for i, k in enumerate(keys):
        same &= placed[k].eqNullSafe(shifts[f"_key_{i}"])
    return placed.join(shifts, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(out))
