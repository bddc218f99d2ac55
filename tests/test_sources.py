"""Byte ranges, the tailing source and the streaming queries."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from logferry.operators import files as FL
from logferry.operators import records as R
from logferry.plans.cycle import Store, table_sink
from logferry.settings import Settings
from logferry.sources.logfiles import inspect_files, list_directories, list_files, read_blocks
from logferry.streaming.collect import CycleListener, block_events, day_counts, run_periodically, tail_blocks, with_listeners
from logferry.streaming.state import track_offsets
from tests_support import RULE_SCHEMA, line, rule

NOON = dt.datetime(2024, 5, 2, 12)


def work_of(spark, paths):
    rows = [(str(p), os.path.getsize(p)) for p in paths]
    return spark.createDataFrame(rows, "path string, length bigint").select(
        F.lit("c").alias("component"), "path", F.lit(0).cast("bigint").alias("position"), F.col("length").alias("read_end")
    )


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 1 << 20])
def test_each_line_is_read_once(spark, tmp_path, range_bytes):
    data = ("é line %d\r\n" * 3 % (1, 2, 3) + "\n\r\rlone\rcr\n" + "x" * 150 + "\nlast").encode()
    (tmp_path / "a.log").write_bytes(data)
    (tmp_path / "b.log").write_bytes(b"\r\n" * 9)
    blocks = read_blocks(work_of(spark, sorted(tmp_path.iterdir())), ["component", "path"], range_bytes, tasks=3)
    lines = R.read_lines(blocks).orderBy("path", "start_off").collect()
    a = [(r.start_off, r.end_off) for r in lines if r.path.endswith("a.log")]
    assert a[0][0] == 0 and a[-1][1] == len(data)
    assert all(x[1] == y[0] for x, y in zip(a, a[1:]))
    assert len(a) == len(data.decode().splitlines())
    assert [r.line for r in lines if r.path.endswith("b.log")] == [""] * 9


def test_listing_and_inspection(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.log").write_text("no")
    (tmp_path / "a.log").write_text("one\ntwo\nthr")
    (tmp_path / "b.txt").write_text("one\n")
    found = FL.discover_files(list_files(spark, [str(tmp_path), str(tmp_path / "nowhere")]), F.lit(str(tmp_path)), F.lit("log$"))
    rows = inspect_files(found).collect()
    assert [(r.name, r.length, bytes(r.head), r.complete_end) for r in rows] == [("a.log", 11, b"one\ntwo\nthr", 8)]


def test_thousand_directories_and_any_name(spark, tmp_path, monkeypatch):
    names = ["_hidden.log", ".dot.log", "a b.log", "k=v.log", "ä+%20.log", "plain.log"]
    folders = [tmp_path / f"{'x=1' if i % 3 else '_d'} {i}" for i in range(1000)]
    for i, d in enumerate(folders):
        d.mkdir()
        (d / names[i % 6]).write_text("x" * i)
    (folders[0] / "sub").mkdir()
    (folders[0] / "sub" / "inner.log").write_text("not listed")
    (tmp_path / "empty").mkdir()
    wanted = [*map(str, folders), str(tmp_path / "empty"), str(tmp_path / "missing"), "file:" + str(folders[1])]
    dirs = spark.createDataFrame([(d,) for d in [*wanted, None]], "dir string")

    def refuse(*_):
        raise AssertionError("the driver has listed a directory")

    for name in ("listdir", "scandir"):
        monkeypatch.setattr(os, name, refuse)
    rows = list_directories(dirs).collect()
    monkeypatch.undo()
    by_dir = {r.dir: r for r in rows}
    assert len(rows) == len(by_dir) == 1002 and str(tmp_path / "missing") not in by_dir
    assert by_dir[str(tmp_path / "empty")].path is None
    for i, d in enumerate(folders):
        r = by_dir[str(d)]
        assert (r.path, r.name, r.length) == (f"{d}/{names[i % 6]}", names[i % 6], i)
        assert abs(r.mtime.replace(tzinfo=dt.timezone.utc).timestamp() - os.stat(r.path).st_mtime) < 1e-3
    assert by_dir["file:" + str(folders[1])].path == f"file:{folders[1]}/{names[1]}"


def test_metadata_scan_reads_no_content(spark, tmp_path):
    (tmp_path / "a.log").write_text("x")
    plan = list_files(spark, [str(tmp_path)])._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_tail_follows_growth_and_rotation(spark, tmp_path):
    logs, ck = tmp_path / "logs", str(tmp_path / "ck")
    logs.mkdir()
    got = []

    def run():
        blocks = tail_blocks(spark, str(logs), r"\.log", range_bytes=50)
        q = (
            blocks.writeStream.foreachBatch(lambda df, _: got.extend(R.read_lines(df, keep=("path",)).collect()))
            .option("checkpointLocation", ck).trigger(availableNow=True).start()
        )
        q.awaitTermination(120)

    (logs / "app.log").write_text("".join(line(i) for i in range(10)) + "half")
    run()
    assert len(got) == 10
    os.rename(logs / "app.log", logs / "app_1.log")
    with open(logs / "app_1.log", "a") as f:
        f.write(" done\n" + line(11))
    (logs / "app.log").write_text(line(12))
    run()
    assert sorted(r.line for r in got) == sorted([*[line(i)[:-1] for i in (*range(10), 11, 12)], "half done"])


def test_stream_to_day_windows(spark, tmp_path):
    (tmp_path / "app.log").write_text("".join(line(i, day=1 + i % 2) for i in range(20)))
    events = block_events(tail_blocks(spark, str(tmp_path)), Settings(as_of=NOON), "app")
    q = (
        day_counts(events).writeStream.outputMode("complete").format("memory").queryName("days")
        .option("checkpointLocation", str(tmp_path / "ck")).start()
    )
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n_events for r in spark.table("days").collect()) == [10, 10]


def test_days_end_and_their_counts_stay(spark, tmp_path):
    """State is given up day by day, batches may be repeated, and the table holds all days."""
    from logferry.streaming.collect import upsert_days

    src, table, states = tmp_path / "in", str(tmp_path / "days"), []
    schema = "ts timestamp, log_group string, log_stream string, cost bigint"
    days = [(0, 1, 2), (2, 3, 4, 1), (20, 21), (21, 22, 8), (40,)]  # the 8th is still within 15 days of the 22nd
    for n, own in enumerate(days):
        rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h), "g", f"s{d}", 10) for d in own for h in (1, 5)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"n={n}"))
        events = spark.readStream.schema(schema).parquet(str(src / "n=*"))

        def write(df, epoch):
            upsert_days(df, epoch, table)
            upsert_days(df, epoch, table)

        q = (
            day_counts(events, dt.timedelta(days=15)).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        )
        q.awaitTermination(120)
        states.append(q.recentProgress[-1].stateOperators[0].numRowsTotal)
    got = {r.log_stream: (r.n_events, r.n_bytes) for r in spark.read.parquet(table).collect()}
    want = {}
    for own in days:
        for d in own:
            want[f"s{d}"] = (want.get(f"s{d}", (0, 0))[0] + 2, want.get(f"s{d}", (0, 0))[1] + 20)
    assert got == want and spark.read.parquet(table).count() == len(want)
    assert states[-1] <= 2 < states[2] < states[1]  # each counted twice, as each batch runs twice here


def test_idle_offsets_expire(spark, tmp_path):
    """A file that wasn't seen for longer than the limit is read from its start again; one that was isn't."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    out = []
    schema = "component string, fingerprint string, path string, length bigint"
    (tmp_path / "in").mkdir()
    for n, wait in enumerate((0, 12)):
        time.sleep(wait)
        spark.createDataFrame([("c", "f", "a.log", 100 + n)], schema).coalesce(1).write.parquet(str(tmp_path / f"in/n={n}"))
        for idle in (dt.timedelta(seconds=10), dt.timedelta(hours=1)):
            seen = spark.readStream.schema(schema).parquet(str(tmp_path / "in/n=*"))
            done = []
            q = (
                track_offsets(seen, idle).writeStream.outputMode("append")
                .foreachBatch(lambda df, _: done.extend((r.from_off, r.to_off) for r in df.collect()))
                .option("checkpointLocation", str(tmp_path / f"ck-{idle.seconds}")).trigger(processingTime="1 second").start()
            )
            deadline = time.time() + 240
            while time.time() < deadline and not done:
                time.sleep(0.3)
            q.stop()
            out.append(done)
    assert out == [[(0, 100)], [(0, 100)], [(0, 101)], [(100, 101)]]


def test_offsets_are_kept_per_file(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    src, out = tmp_path / "in", []
    src.mkdir()
    schema = "component string, fingerprint string, path string, length bigint"

    def see(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"n={n}"))

    def run():
        seen = spark.readStream.schema(schema).parquet(str(src / "n=*"))
        q = (
            track_offsets(seen).writeStream.outputMode("append")
            .foreachBatch(lambda df, _: out.extend((r.path, r.from_off, r.to_off) for r in df.collect()))
            .option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
        )
        # Expiry needs batches without data too, so the query never comes to rest by itself.
        deadline = time.time() + 90
        while time.time() < deadline and sum(p.numInputRows for p in q.recentProgress) < 2:
            time.sleep(0.3)
        q.stop()

    see(1, [("c", "f", "a.log", 100), ("c", "g", "b.log", 10)])
    run()
    see(2, [("c", "f", "a_1.log", 150), ("c", "g", "b.log", 10)])
    run()
    assert sorted(out) == [("a.log", 0, 100), ("a_1.log", 100, 150), ("b.log", 0, 10)]


def test_periodic_cycles_and_listeners(spark, tmp_path):
    """Rules change while the query runs; listeners hear of deliveries and of ended cycles."""
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "app.log").write_text(line(1) + line(2))
    store = Store(spark, str(tmp_path / "store"))
    names, heard, ended = ["one"], [], []
    listener = CycleListener()
    listener.register("t", lambda progress: ended.append(progress.batchId))
    listener.register("t", lambda progress: ended.append("second registration is ignored"))
    spark.streams.addListener(listener)
    sink = with_listeners(table_sink, {"t": lambda outcome, epoch: heard.append((epoch, outcome.count()))})
    q = run_periodically(
        spark, lambda: spark.createDataFrame([rule(n, tmp_path / n) for n in names], RULE_SCHEMA),
        lambda: Settings(as_of=NOON), store, 0.5, str(tmp_path / "ck"), sink=sink,
    )
    try:
        deadline = time.time() + 200
        while time.time() < deadline and not heard:
            time.sleep(0.5)
        names.append("two")
        while time.time() < deadline and not any(n for e, n in heard[1:]):
            time.sleep(0.5)
    finally:
        q.stop()
        spark.streams.removeListener(listener)
    assert heard[0] == (0, 1) and [n for _, n in heard if n] == [1, 1]
    assert ended and "second registration is ignored" not in ended
    listener.unregister("t")
