"""Pack ordered events into batches limited in bytes, in events per stream and in time per stream.

Batches of a component are filled in read order: the first event that would break a limit closes the
batch for all streams of the component, and opens the next. Each batch thus depends on the one
before it, which looks like one task per component. It need not be: every limit is monotone (a batch
that opens later never has to close earlier), so what a block of events does to its successor is a
monotone function from "where the first batch of this block opens" to "where the first batch of the
next block opens". All blocks compute their function at the same time, the functions are composed in a
tree, and then all blocks cut their own batches at the same time.

A batch holds at most ``max_bytes // EVENT_OVERHEAD`` events, since each costs that much. So a block
needs to see only so many events past its end, and only so many of its first events can open the
first batch. A block is of bounded size, however large the component is. Blocks that are small are
handled many at a time, so that their number doesn't count.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logferry import settings as S
from logferry.operators.ordering import positions, running, total_order
from logferry.sources.scratch import settle

_NEVER = np.iinfo(np.int64).max


def _last_break_by_span(stream: np.ndarray, ts: np.ndarray, emit: np.ndarray, span: int):
    """Pairs (a, b): the last emitted a before b in b's stream with ts[a] + span < ts[b]."""
    frame = pd.DataFrame({"s": stream, "t": ts})
    low = frame["s"].map(frame["t"].where(emit).groupby(frame["s"]).min()).to_numpy()
    high = frame["s"].map(frame.groupby("s")["t"].max()).to_numpy()
    # Few events lie so near to both ends of a stream that they can be part of such a pair.
    opens = emit & (ts + span < high)
    closes = ts > low + span
    stacks: dict = {}
    for b in np.flatnonzero(opens | closes):
        times, places = stacks.setdefault(stream[b], ([], []))
        if closes[b]:
            at = bisect_left(times, ts[b] - span) - 1
            if at >= 0:
                yield places[at], b
        if opens[b]:
            # Only events earlier than all later ones can be the last one below a bound.
            while times and times[-1] >= ts[b]:
                times.pop()
                places.pop()
            times.append(ts[b])
            places.append(b)


def next_starts(cost, stream, ts, emit, max_bytes: int, max_events: int, max_span: int) -> np.ndarray:
    """For each event: where the next batch opens if a batch opens here. Index past the end = open."""
    n = len(cost)
    sums = np.cumsum(cost)
    limit = np.searchsorted(sums, sums - cost + max_bytes, side="right")

    # Emitted events of a stream are numbered; the batch closes at the first event of the stream that
    # comes when max_events of them have been taken.
    by_stream = np.lexsort((np.arange(n), stream))
    s, e = stream[by_stream], emit[by_stream].astype(np.int64)
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if n else np.array([], np.int64)
    code = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))
    before = np.cumsum(e) - e
    before -= before[first][code] if n else before
    width = n + max_events + 1
    rank = code * width + before
    hit = np.searchsorted(rank, rank + max_events, side="left")
    inside = hit < n
    inside[inside] &= code[hit[inside]] == code[inside]
    inside &= e.astype(bool)
    breaks = np.full(n, _NEVER)
    breaks[by_stream[inside]] = by_stream[hit[inside]]
    for a, b in _last_break_by_span(stream, ts, emit, max_span):
        breaks[a] = min(breaks[a], b)
    # A batch meets every break of an event it holds.
    breaks = np.minimum.accumulate(breaks[::-1])[::-1]
    return np.maximum(np.minimum(np.minimum(limit, breaks), n), np.arange(n) + 1)


def _follow(nxt: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each event: the last batch start of its chain before the ``end`` of its block, and the number
    of batches on the way there, that one included."""
    own = np.arange(len(nxt))
    tail = np.where(nxt < end, nxt, own)
    hops = (tail != own).astype(np.int64)
    while True:
        further = tail[tail]
        if np.array_equal(further, tail):
            return tail, hops + 1
        hops = hops + hops[tail]
        tail = further


def _runs(node: np.ndarray, entry: np.ndarray, leave: np.ndarray, count: np.ndarray) -> pd.DataFrame:
    """Compress entry -> (leave, count) of each node to pieces: count stays the same, and leave stays or
    moves along with entry."""
    same = (np.diff(count) == 0) & (np.diff(node) == 0)
    stay = same & (np.diff(leave) == 0)
    move = same & (np.diff(leave) == 1)
    kind = np.r_[np.where(stay, 0, np.where(move, 1, 2)), 0][: len(entry)]  # of the step to the next entry
    starts = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == 2)][: len(entry)])
    ends = np.r_[starts[1:], len(entry)][: len(starts)] - 1
    return pd.DataFrame(
        {
            "_blk": node[starts], "lo": entry[starts], "hi": entry[ends], "leave": leave[starts],
            "slope": kind[starts] % 2, "n_starts": count[starts],
        }
    )


def _ends(node: np.ndarray, lo: np.ndarray) -> pd.DataFrame:
    """The functions of last blocks: nothing follows, so nobody asks where the next block would be entered."""
    return pd.DataFrame({"_blk": node, "lo": lo, "hi": _NEVER, "leave": -1, "slope": 0, "n_starts": 0})


def _applied(runs: pd.DataFrame, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the next block is entered, and the batches opened on the way, for places of entry.

    ``runs`` of any number of neighbouring blocks, sorted: places grow from block to block.
    """
    lo, leave, slope, count = (runs[c].to_numpy() for c in ("lo", "leave", "slope", "n_starts"))
    at = np.searchsorted(lo, entry, side="right") - 1
    return leave[at] + slope[at] * (entry - lo[at]), count[at]


def composed(pdf: pd.DataFrame, keys: Sequence[str], fan_in: int) -> pd.DataFrame:
    """The functions of ``fan_in`` neighbouring blocks as one, for every place where the first can be entered.

    All nodes (``_up``) of ``pdf`` at once. Only the last node of a key, which has no function, has fewer blocks.
    """
    pdf = pdf.sort_values(["_blk", "lo"], ignore_index=True)
    up, lo = pdf["_up"].to_numpy(), pdf["lo"].to_numpy()
    last = np.unique(up[pdf["leave"].to_numpy() < 0])
    first = pdf[(pdf["_blk"].to_numpy() == up * fan_in) & ~np.isin(up, last)]
    n = (first["hi"] - first["lo"] + 1).to_numpy()
    entry = np.repeat(first["lo"].to_numpy() - np.cumsum(n) + n, n) + np.arange(n.sum())
    leave, count = entry, np.zeros(len(entry), np.int64)
    for _ in range(fan_in if len(entry) else 0):
        leave, more = _applied(pdf, leave)
        count = count + more
    runs = [_runs(np.repeat(first["_up"].to_numpy(), n), entry, leave, count), _ends(last, lo[np.searchsorted(up, last)])]
    runs = pd.concat([r for r in runs if len(r)], ignore_index=True)
    for i, k in enumerate(keys):
        runs.insert(i, k, pdf[k].iloc[0])
    return runs


def entered(pdf: pd.DataFrame, keys: Sequence[str], fan_in: int) -> pd.DataFrame:
    """Where each block is entered, for some nodes of ``fan_in`` neighbouring blocks; a row without a block says it of the
    first block of a node."""
    own = pdf["_blk"].isna()
    up, entry, before = (pdf.loc[own, c].to_numpy(np.int64) for c in ("_up", "lo", "n_starts"))
    nodes = pdf.loc[~own, ["_blk", "lo", "leave", "slope", "n_starts"]].astype(np.int64).sort_values(["_blk", "lo"])
    out = []
    for k in range(fan_in):
        here = np.isin(up * fan_in + k, nodes["_blk"].to_numpy())
        up, entry, before = up[here], entry[here], before[here]
        out.append(pd.DataFrame({"_blk": up * fan_in + k, "_entry": entry, "_n_before": before}))
        entry, more = _applied(nodes, entry)
        before = before + more
    rows = pd.concat(out, ignore_index=True)
    for i, k in enumerate(keys):
        rows.insert(i, k, pdf[k].iloc[0])
    return rows


def pack_batches(
    events: DataFrame,
    keys: Sequence[str] = ("component",),
    order: Sequence[str] = ("mtime", "path", "start_off", "chunk_no"),
    blocks: Sequence[Sequence[str]] = (("mtime", "path", "block_no"),),
    stream: str = "log_stream",
    max_bytes: int = S.MAX_BATCH_BYTES,
    max_events: int = S.MAX_BATCH_EVENTS,
    max_span: dt.timedelta = S.MAX_BATCH_SPAN,
    block_size: int = 1 << 19,
    fan_in: int = 16,
    at_once: int = 1 << 16,
) -> DataFrame:
    """Add ``batch_no``, counted from 1 per key, to events with cost, emit and ts.

    ``order`` is the read order and unique within a key. ``blocks`` are column lists as in
    :func:`logferry.operators.ordering.running`; rows of a finest block lie together in read order.
    ``fan_in`` blocks are composed to one. Blocks and nodes are handled in stretches of about ``at_once`` events
    or places, or one by one if they are larger.
    """
    keys, order, fine = list(keys), list(order), list(blocks[-1])
    reach = max_bytes // S.EVENT_OVERHEAD + 1
    block_size = max(block_size, reach)
    span_ms = max_span // dt.timedelta(milliseconds=1)
    columns = list(dict.fromkeys([*keys, *[c for level in blocks for c in level], *order]))
    narrow = events.select(
        *columns, F.col("cost").cast("bigint").alias("_cost"), F.col(stream).alias("_stream"),
        F.unix_millis("ts").alias("_ts"), F.col("emit").alias("_emit"),
    )
    numbered = total_order(narrow, keys, [F.col(c) for c in order], "_p", settle).withColumn("_p", F.col("_p") - 1)
    n_blocks = (numbered.agg(F.max("_p")).first()[0] or 0) // block_size + 1
    stretch = max(at_once // block_size, 1) * block_size
    nodes_at_once = max(at_once // (reach * fan_in), 1)
    own = F.floor(F.col("_p") / stretch)
    shared = F.when((F.col("_p") % stretch < reach) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    spread = numbered.withColumn("_part_no", F.explode_outer(shared))

    key_types = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)

    def arrays(pdf: pd.DataFrame):
        pdf = pdf.sort_values("_p", ignore_index=True)
        codes = pd.factorize(pdf["_stream"])[0]
        n_own = int((pdf["_p"] // stretch == pdf["_part_no"]).sum())
        nxt = next_starts(
            pdf["_cost"].to_numpy(), codes, pdf["_ts"].to_numpy(), pdf["_emit"].to_numpy(bool),
            max_bytes, max_events, span_ms,
        )
        return pdf, n_own, nxt

    def transfer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, n_own, nxt = arrays(pdf)
        p = pdf["_p"].to_numpy()[:n_own]
        base, blk, at = p[0], p // block_size, p % block_size
        opens = np.where(blk > 0, at < reach, at == 0)
        last = blk[-1:] if n_own == len(pdf) else blk[:0]
        entry = np.flatnonzero(opens & ~np.isin(blk, last))
        tail, count = (x[entry] for x in _follow(nxt[:n_own], np.minimum((blk + 1) * block_size - base, n_own)))
        runs = [_runs(blk[entry], entry + base, nxt[tail] + base, count), _ends(last, last * block_size)]
        runs = pd.concat([r for r in runs if len(r)], ignore_index=True)
        for i, k in enumerate(keys):
            runs.insert(i, k, pdf[k].iloc[0])
        return runs

    runs_schema = f"{key_types}, _blk bigint, lo bigint, hi bigint, leave bigint, slope bigint, n_starts bigint"
    runs = spread.groupBy(*keys, "_part_no").applyInPandas(transfer, runs_schema)

    # Composition tree: functions of neighbouring blocks are composed until one node per key is left; its
    # entry is known, and from there each node tells its children where they are entered.
    up, some = F.floor(F.col("_blk") / fan_in), F.floor(F.col("_up") / nodes_at_once)
    levels = [runs]
    while n_blocks > fan_in:
        levels[-1] = settle(levels[-1])
        levels.append(
            levels[-1].withColumn("_up", up).withColumn("_some", some).groupBy(*keys, "_some").applyInPandas(
                lambda pdf: composed(pdf, keys, fan_in), runs_schema
            )
        )
        n_blocks = -(-n_blocks // fan_in)
    entries = levels[-1].select(*keys).distinct().withColumns({c: F.lit(0).cast("bigint") for c in ("_blk", "_entry", "_n_before")})
    for level in reversed(levels):
        asked = entries.select(*keys, F.col("_blk").alias("_up"), F.col("_entry").alias("lo"), F.col("_n_before").alias("n_starts"))
        nodes = level.withColumn("_up", up).unionByName(asked, allowMissingColumns=True).withColumn("_some", some)
        entries = nodes.groupBy(*keys, "_some").applyInPandas(
            lambda pdf: entered(pdf, keys, fan_in), f"{key_types}, _blk bigint, _entry bigint, _n_before bigint"
        )

    id_columns = list(dict.fromkeys([*keys, *fine, *order]))
    out_schema = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in id_columns)

    def cut(pdf: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        pdf, n_own, nxt = arrays(pdf)
        base, nxt = int(pdf["_p"].iloc[0]), nxt.tolist()
        number = np.empty(n_own, np.int64)
        for blk, entry, no in zip(*(blocks[c].tolist() for c in ("_blk", "_entry", "_n_before"))):
            begin, i = blk * block_size - base, entry - base
            end = min(begin + block_size, n_own)
            number[begin : min(i, end)] = no  # the batch that was open when the block began
            while i < end:
                no += 1
                number[i : min(nxt[i], end)] = no
                i = nxt[i]
        out = pdf.loc[: n_own - 1, id_columns].copy()
        out["_no"] = number
        # One row per batch and event block is all that is needed to place the events.
        return out.drop_duplicates([*fine, "_no"])

    entries = entries.withColumn("_part_no", F.floor(F.col("_blk") * block_size / stretch))
    firsts = spread.groupBy(*keys, "_part_no").cogroup(entries.groupBy(*keys, "_part_no")).applyInPandas(cut, f"{out_schema}, _no bigint")
    # Every event has the number of the last of these rows before it in its event block. A batch that is met
    # in two stretches has two of them, which does no harm.
    both = events.withColumn("_event", F.lit(True)).unionByName(firsts.withColumn("_event", F.lit(False)), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, *fine).orderBy(*order, "_event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("batch_no", F.last("_no", ignorenulls=True).over(so_far)).where("_event").drop("_event", "_no")


def first_batch_bytes(events: DataFrame, keys, order, blocks, cap: int = S.MAX_BATCH_BYTES) -> DataFrame:
    """Events that fit a first batch by bytes: the running cost reaches ``cap`` at most."""
    return running(events, keys, [F.col(c) for c in order], {"running_cost": ("sum", F.col("cost"))}, blocks).where(
        F.col("running_cost") <= cap
    )


def first_batch_count(events: DataFrame, keys, order, blocks, cap: int = S.MAX_BATCH_EVENTS) -> DataFrame:
    """The first ``cap`` events of each key, usually a stream."""
    return positions(events, keys, [F.col(c) for c in order], "nth", blocks).where(F.col("nth") <= cap)


def within_span(events: DataFrame, keys, order, blocks, span: dt.timedelta = S.MAX_BATCH_SPAN) -> DataFrame:
    """Add ``first_ts``, the earliest time so far, and ``fits``: not more than ``span`` after it.

    Only the forward distance counts; an event earlier than all before it always fits.
    """
    df = running(events, keys, [F.col(c) for c in order], {"first_ts": ("min", F.col("ts"))}, blocks)
    return df.withColumn("fits", F.col("ts") <= F.col("first_ts") + F.lit(span))


def sort_events(events: DataFrame, tie: Sequence[str], keys=("log_group", "log_stream")) -> DataFrame:
    """Add ``nth``, the place of an event by time in its stream (or stream batch).

    ``tie`` orders events of the same time, of which there may be any number, as records without a
    timestamp have the time of the run.
    """
    return total_order(events, list(keys), [F.col("ts"), *[F.col(c) for c in tie]], "nth", settle)


def merge_files(events: DataFrame, keys=("component",), order=("mtime", "path", "start_off", "chunk_no")) -> DataFrame:
    """Add ``nth``, the place of an event in the read order of its component across all files."""
    return total_order(events, list(keys), [F.col(c) for c in order], "nth", settle)


def progress_by_stream_file(events: DataFrame, keys=("component", "fingerprint", "log_stream", "batch_no")) -> DataFrame:
    """Per batch, stream and file: first byte, end of the last accepted event, bytes in between."""
    return (
        events.groupBy(*keys)
        .agg(F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off"), F.max("mtime").alias("mtime"))
        .withColumn("bytes_read", F.col("end_off") - F.col("start_off"))
    )


def batch_summary(events: DataFrame, keys=("log_group", "log_stream", "batch_no")) -> DataFrame:
    """Per stream batch: events sent, bytes, first and last time."""
    sent = F.col("emit")
    return events.groupBy(*keys).agg(
        F.sum(sent.cast("bigint")).alias("n_events"),
        F.sum("cost").alias("n_bytes"),
        F.min(F.when(sent, F.col("ts"))).alias("first_ts"),
        F.max(F.when(sent, F.col("ts"))).alias("last_ts"),
    )
