"""Batches against a plain loop, with blocks far smaller than a key."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logferry.operators import packing as P
from logferry.operators.ordering import running


def loop(cost, stream, ts, emit, max_bytes, max_events, span):
    out, no, used, count, first = [], 1, 0, {}, {}
    for c, s, t, e in zip(cost, stream, ts, emit):
        if used and (used + c > max_bytes or count.get(s, 0) >= max_events or (s in first and first[s] + span < t)):
            no, used, count, first = no + 1, 0, {}, {}
        used += c
        if e:
            count[s] = count.get(s, 0) + 1
            first[s] = min(first.get(s, t), t)
        out.append(no)
    return out


def test_next_starts_agree_with_the_loop():
    rng = np.random.default_rng(7)
    for trial in range(400):
        n, k = rng.integers(1, 80), rng.integers(1, 4)
        cost, stream, emit = rng.integers(34, 80, n), rng.integers(0, k, n), rng.random(n) < 0.8
        ts = rng.integers(0, 50, n).astype(np.int64)
        ts = np.sort(ts) if trial % 2 else ts
        limits = int(rng.integers(80, 900)), int(rng.integers(1, 8)), int(rng.integers(1, 60))
        nxt, got, i, no = P.next_starts(cost, stream, ts, emit, *limits), [], 0, 0
        while i < n:
            no += 1
            got += [no] * int(nxt[i] - i)
            i = int(nxt[i])
        assert got == loop(cost, stream, ts, emit, *limits)


@pytest.mark.parametrize("equal_sizes, fan_in", [(False, 2), (True, 5), (False, 64)])
def test_blocks_chain_to_the_same_batches(spark, equal_sizes, fan_in):
    """One key holds nearly all events and is cut into many blocks. Equal sizes never synchronise."""
    rng = np.random.default_rng(3)
    rows = []
    for key, n in (("hot", 2500), ("small", 30), ("one", 1)):
        for i in range(n):
            cost = 50 if equal_sizes else int(rng.integers(34, 70))
            rows.append((key, i // 37, f"p{i // 37}", i, 0, f"s{rng.integers(0, 3)}", cost, int(i * 100 + rng.integers(0, 3000)), bool(rng.random() < 0.9)))
    pdf = pd.DataFrame(rows, columns="component minute path start_off chunk_no log_stream cost ts emit".split())
    events = spark.createDataFrame(pdf).withColumns(
        {"ts": F.timestamp_millis("ts"), "mtime": F.timestamp_seconds("minute"), "block_no": F.lit(0)}
    )
    span = 10**8 if equal_sizes else 20_000
    got = P.pack_batches(
        events, max_bytes=34 * 60, max_events=7, max_span=dt.timedelta(milliseconds=span), block_size=61, fan_in=fan_in
    ).select("component", "start_off", "batch_no").toPandas()
    for key, g in pdf.groupby("component"):
        mine = got[got.component == key].sort_values("start_off").batch_no.tolist()
        assert mine == loop(g.cost, g.log_stream, g.ts, g.emit, 34 * 60, 7, span), key


@pytest.mark.parametrize("at_once", [1, 150, 100_000])
def test_small_blocks_are_handled_together(spark, at_once):
    """Blocks of the least size in stretches of one, three and all blocks; nodes likewise."""
    rng = np.random.default_rng(5)
    rows = [("hot", 3000), ("small", 30), ("one", 1), ("even", 122)]
    rows = [(k, i // 100, i, f"s{rng.integers(0, 3)}", int(rng.integers(34, 90)), int(i * 100 + rng.integers(0, 3000)), bool(rng.random() < 0.9)) for k, n in rows for i in range(n)]
    pdf = pd.DataFrame(rows, columns="component _part event_id log_stream cost ts emit".split())
    got = P.pack_batches(
        spark.createDataFrame(pdf).withColumn("ts", F.timestamp_millis("ts")), order=["event_id"], blocks=[["_part"]], max_bytes=34 * 40,
        max_events=9, max_span=dt.timedelta(seconds=20), block_size=1, fan_in=3, at_once=at_once,
    ).select("component", "event_id", "batch_no").toPandas()
    assert len(got) == len(pdf)
    for key, g in pdf.groupby("component"):
        mine = got[got.component == key].sort_values("event_id").batch_no.tolist()
        assert mine == loop(g.cost, g.log_stream, g.ts, g.emit, 34 * 40, 9, 20_000), key


def test_running_totals_by_blocks(spark):
    df = spark.range(1000).select(
        F.lit("k").alias("k"), "id", F.floor(F.col("id") / 100).alias("a"), F.floor(F.col("id") / 10).alias("b"),
        ((F.col("id") * 7919) % 101).alias("v"),
    )
    for end in (True, False):
        measures = {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}
        plain = running(df, ["k"], [F.col("id")], measures, (), end)
        cut = running(df, ["k"], [F.col("id")], measures, [["a"], ["a", "b"]], end)
        a = plain.select("id", F.coalesce("s", F.lit(0)), "lo", "hi").orderBy("id").collect()
        assert a == cut.select("id", "s", "lo", "hi").orderBy("id").collect()
