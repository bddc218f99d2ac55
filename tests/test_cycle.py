"""Whole cycles on real files. Each component is a scenario of its own; they share the cycles."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from logferry.plans.cycle import Store, run_cycle, table_sink
from logferry.settings import Settings
from tests_support import RULE_SCHEMA, line, rule

NOON = dt.datetime(2024, 5, 2, 12)
SETTINGS = Settings(as_of=NOON, range_bytes=100, max_batch_events=4, max_batch_bytes=2000, max_event_bytes=120, pack_block=64)

def write(path, text, minute):
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(text.encode())
    stamp = dt.datetime(2024, 5, 2, 11, minute, tzinfo=dt.timezone.utc).timestamp()
    os.utime(path, (stamp, stamp))


def delivered(store, upto, component):
    out = []
    for e in range(upto + 1):
        done = store.read("delivery", e).where("delivered").select("log_group", "log_stream", "batch_no")
        rows = store.read("batches", e).where(F.col("emit") & (F.col("component") == component))
        out += rows.join(done, ["log_group", "log_stream", "batch_no"]).select("path", "start_off", "chunk_no", "message").collect()
    return out


def state(store, epoch, component):
    return {os.path.basename(r.path): r for r in store.read("checkpoint", epoch).where(F.col("component") == component).collect()}


FLOW = [line(i) for i in range(120)]
SPLIT = [line(i, day=1 + i % 2) for i in range(40)]
LONG = line(0) + "2024-05-02T01:00:00Z " + "x" * 500 + "\n" + line(1)
LOW = '{"level":"DEBUG","timestamp":1714640400000,"message":"m"}\n'
BODY = "".join(line(i) for i in range(20))


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cycles")
    store = Store(spark, str(root / "store"))
    limit = 2 * len(line(1000) + BODY) + len(line(2000))
    names = {"flow": {}, "split": {}, "long": {}, "low": {"delete_after": True}, "full": {"max_bytes": limit}, "still": {}}
    rules = [rule(n, root / n, **more) for n, more in names.items()] + [rule("ghost", root / "nowhere")]
    rules = spark.createDataFrame(rules, RULE_SCHEMA)
    seen = {}

    def broken(events, epoch):
        late = F.col("log_group").contains("split") & F.col("log_stream").contains("/05/01/") & (F.col("batch_no") >= 3)
        cut = F.col("log_group").contains("long") & (F.col("batch_no") >= 2)
        return table_sink(events, epoch).withColumn("delivered", ~(late | cut))

    def dies(events, epoch):
        raise RuntimeError("the sink is gone")

    write(root / "flow/app.log", "".join(FLOW[:30]) + FLOW[30][:10], 1)
    write(root / "split/app_1.log", "".join(SPLIT), 1)
    write(root / "split/app.log", line(100), 2)
    write(root / "long/app_1.log", LONG, 1)
    write(root / "long/app.log", line(100), 2)
    write(root / "low/app_1.log", LOW + "2024-01-01T00:00:00Z too old\n" + LOW, 1)
    write(root / "low/app_2.log", line(1) + LOW, 2)
    write(root / "low/app.log", line(2), 3)
    for n in range(4):
        write(root / f"full/app_{n}.log", line(1000 + n) + BODY, n + 1)
    write(root / "full/app.log", line(2000), 9)
    write(root / "still/app.log", BODY, 1)

    with pytest.raises(RuntimeError):
        run_cycle(spark, rules, SETTINGS, store, sink=dies)
    seen["after_death"] = store.last_epoch()
    run_cycle(spark, rules, SETTINGS, store, sink=broken, delete=True)
    seen["full_0"] = sorted(os.listdir(root / "full"))
    seen["low_0"] = sorted(os.listdir(root / "low"))

    # The rest of the broken line comes, and the file rotates.
    write(root / "flow/app_1.log", "".join(FLOW[:50]), 2)
    write(root / "flow/app.log", "".join(FLOW[50:60]), 3)
    run_cycle(spark, rules, SETTINGS, store, delete=True)
    seen["full_1"] = sorted(os.listdir(root / "full"))
    write(root / "flow/app_2.log", "".join(FLOW[50:90]), 4)
    write(root / "flow/app.log", "".join(FLOW[90:120]), 5)
    last = run_cycle(spark, rules, SETTINGS, store)
    # A cycle that is committed already is not run again.
    assert run_cycle(spark, rules, SETTINGS, store, epoch=0) == 0
    return store, last, seen


def test_lost_cycle_leaves_no_trace(runs):
    store, last, seen = runs
    assert seen["after_death"] == -1 and last == 2


def test_growth_and_rotation_lose_nothing(runs):
    store, last, _ = runs
    assert sorted(r.message + "\n" for r in delivered(store, last, "flow")) == sorted(FLOW)
    # Rotated files are done and forgotten; the watermark has reached the newest of them.
    assert {k: r.position for k, r in state(store, last, "flow").items()} == {"app.log": len("".join(FLOW[90:]))}
    mark = store.read("watermark", last).where("component = 'flow'").first().last_mtime
    assert mark == dt.datetime(2024, 5, 2, 11, 4)


def test_batches_keep_their_limits(runs):
    store, last, _ = runs
    for e in range(last + 1):
        batches = store.read("batches", e)
        per_stream = batches.where("emit").groupBy("component", "batch_no", "log_stream").count()
        assert per_stream.where("count > 4").count() == 0
        assert batches.groupBy("component", "batch_no").agg(F.sum("cost").alias("c")).where("c > 2000").count() == 0


def test_failed_stream_is_sent_again_and_only_it(runs):
    store, last, _ = runs
    some = {r.message + "\n" for r in delivered(store, 0, "split")}
    assert 0 < len(some) < 41
    # The position stands at the first event that did not arrive.
    text = "".join(SPLIT)
    assert state(store, 0, "split")["app_1.log"].position == min(text.index(x) for x in set(SPLIT) - some)
    rows = delivered(store, last, "split")
    assert sorted(r.message + "\n" for r in rows) == sorted([*SPLIT, line(100)])
    assert list(state(store, last, "split")) == ["app.log"]


def test_partly_delivered_record_resumes_at_its_chunk(runs):
    store, last, _ = runs
    entry = state(store, 0, "long")["app_1.log"]
    assert entry.position == len(line(0)) and entry.chunk_no > 0
    rows = [r for r in delivered(store, last, "long") if r.path.endswith("app_1.log")]
    assert len(rows) == len({(r.start_off, r.chunk_no) for r in rows}) == 7
    by_record = {}
    for r in sorted(rows, key=lambda r: (r.start_off, r.chunk_no)):
        by_record[r.start_off] = by_record.get(r.start_off, "") + r.message
    assert [by_record[k] + "\n" for k in sorted(by_record)] == LONG.splitlines(keepends=True)


def test_dropped_records_advance_and_finished_files_are_deleted(runs):
    store, last, seen = runs
    assert len(delivered(store, last, "low")) == 2
    assert seen["low_0"] == ["app.log"]
    events = store.read("events", 0).where("component = 'low'")
    reasons = {r.dropped: r["count"] for r in events.groupBy("dropped").count().collect()}
    assert reasons == {None: 2, "below_level": 3, "expired": 1}


def test_disk_limit_removes_oldest_processed(runs):
    _, _, seen = runs
    # Planned from the watermark before the cycle: nothing had been processed the first time.
    assert len(seen["full_0"]) == 5
    assert seen["full_1"] == ["app.log", "app_2.log", "app_3.log"]


def test_nothing_new_is_idle(runs):
    store, last, _ = runs
    assert len(delivered(store, last, "still")) == 20
    assert store.read("batches", last).where("component = 'still'").count() == 0


def test_hold_last_record(spark, tmp_path):
    """A stack trace that is still being written is not cut in two."""
    store = Store(spark, str(tmp_path / "store"))
    rules = spark.createDataFrame([rule("app", tmp_path / "logs")], RULE_SCHEMA)
    settings = Settings(as_of=NOON, hold_last_record=True)
    write(tmp_path / "logs/app.log", line(1) + line(2) + "  at a\n", 1)
    run_cycle(spark, rules, settings, store)
    write(tmp_path / "logs/app.log", line(1) + line(2) + "  at a\n  at b\n" + line(3), 2)
    last = run_cycle(spark, rules, settings, store)
    rows = sorted(delivered(store, last, "app"), key=lambda r: r.start_off)
    assert [r.message for r in rows] == [line(1)[:-1], line(2)[:-1] + "  at a  at b"]
