"""Files that change between listing, reading and deleting; ranges that can't be read; sinks that die."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from logferry.operators import checkpoint as CK
from logferry.operators import retention as RT
from logferry.plans import cycle as C
from logferry.settings import Settings
from tests_support import RULE_SCHEMA, line, rule

SETTINGS = Settings(as_of=dt.datetime(2024, 5, 2, 12), range_bytes=100, max_batch_events=4, pack_block=64)


def lines(a, b):
    return "".join(line(i) for i in range(a, b))


def put(path, text, minute=1):
    path.parent.mkdir(exist_ok=True, parents=True)
    path.write_text(text)
    stamp = dt.datetime(2024, 5, 2, 11, minute, tzinfo=dt.timezone.utc).timestamp()
    os.utime(path, (stamp, stamp))


def sent(store, component, upto=None):
    out = []
    for e in range((store.last_epoch() if upto is None else upto) + 1):
        done = store.read("delivery", e).where("delivered").select("log_group", "log_stream", "batch_no")
        rows = store.read("batches", e).where(F.col("emit") & (F.col("component") == component))
        out += [r.message + "\n" for r in rows.join(done, ["log_group", "log_stream", "batch_no"]).select("message").collect()]
    return sorted(out)


def all_lines(*texts):
    return sorted(x for t in texts for x in t.splitlines(keepends=True))


def test_changes_between_listing_and_reading(spark, tmp_path, monkeypatch):
    names = ["renamed", "replaced", "copied", "shorter", "grown", "twice"]
    rules = spark.createDataFrame([rule(n, tmp_path / n) for n in names], RULE_SCHEMA)
    store = C.Store(spark, str(tmp_path / "store"))
    for i, n in enumerate(names):
        put(tmp_path / n / "app.log", lines(100 * i, 100 * i + 20))
    first = lines(300, 301)

    def change():
        d = tmp_path
        os.rename(d / "renamed/app.log", d / "renamed/app_1.log")
        put(d / "renamed/app.log", lines(50, 60), 5)
        put(d / "replaced/app.log", lines(150, 190), 5)
        shutil.copy2(d / "copied/app.log", d / "copied/app_1.log")
        (d / "copied/app.log").write_text(lines(250, 260))
        os.utime(d / "copied/app.log", (4e9, 4e9))
        put(d / "shorter/app.log", first + lines(350, 353), 5)
        with open(d / "grown/app.log", "a") as f:
            f.write(lines(420, 425))
        os.rename(d / "twice/app.log", d / "twice/app_2.log")
        put(d / "twice/app.log", lines(550, 555), 4)
        put(d / "twice/app_1.log", lines(560, 565), 3)

    real = C.plan_batches

    def disturbed(*args):
        change()
        return real(*args)

    monkeypatch.setattr(C, "plan_batches", disturbed)
    C.run_cycle(spark, rules, SETTINGS, store)
    assert sent(store, "renamed") == all_lines(lines(0, 20)) and sent(store, "copied") == all_lines(lines(200, 220))
    assert sent(store, "replaced") == sent(store, "shorter") == []  # what was listed isn't there any more
    assert sent(store, "grown") == all_lines(lines(400, 420)) and sent(store, "twice") == all_lines(lines(500, 520))
    positions = {r.component: r.position for r in store.read("checkpoint", 0).collect()}
    assert positions["replaced"] == positions["shorter"] == 0 and positions["renamed"] == len(lines(0, 20))
    monkeypatch.setattr(C, "plan_batches", real)
    C.run_cycle(spark, rules, SETTINGS, store)
    wanted = {
        "renamed": [lines(0, 20), lines(50, 60)], "replaced": [lines(150, 190)], "copied": [lines(200, 220), lines(250, 260)],
        "shorter": [first, lines(350, 353)], "grown": [lines(400, 425)], "twice": [lines(500, 520), lines(550, 555), lines(560, 565)],
    }
    for n, texts in wanted.items():
        assert sent(store, n) == all_lines(*texts), n


def test_unread_ranges_hold_the_position(spark, tmp_path, monkeypatch):
    """Ranges 3 and 7 of a file fail, and the first of another; what lies behind is neither lost nor sent twice."""
    text = "".join(line(i) + "  at a\n" * (i % 4) for i in range(60))
    put(tmp_path / "logs/app.log", text)
    put(tmp_path / "other/app.log", lines(100, 130))
    rules = spark.createDataFrame([rule("app", tmp_path / "logs"), rule("other", tmp_path / "other")], RULE_SCHEMA)
    store = C.Store(spark, str(tmp_path / "store"))
    real = C.read_pieces

    def broken(work, rules, settings):
        failed = F.expr("component = 'app' and block_no in (3, 7) or component = 'other' and block_no = 0")
        null = {c: F.when(~failed, F.col(c)) for c in ("start_off", "end_off", "message", "read_to")}
        return real(work, rules, settings).withColumns(null)

    monkeypatch.setattr(C, "read_pieces", broken)
    C.run_cycle(spark, rules, SETTINGS, store)
    some = sent(store, "app")
    position = {r.component: r.position for r in store.read("checkpoint", 0).collect()}
    assert 0 < len(some) < 20 and 0 < position["app"] < 400 and position["other"] == 0 and sent(store, "other") == []
    assert text.encode()[: position["app"]].decode().count("2024-") == len(some)
    monkeypatch.setattr(C, "read_pieces", real)
    C.run_cycle(spark, rules, SETTINGS, store)
    records = sorted(("2024-" + r).replace("\n", "") + "\n" for r in text.split("2024-")[1:])
    assert sent(store, "app") == records and sent(store, "other") == all_lines(lines(100, 130))


def test_chain_of_receipts(spark):
    reads = spark.createDataFrame(
        [("c", "whole", 5, 25), ("c", "gap", 0, 40), ("c", "none", 7, 9), ("c", "missing", 0, 30), ("c", "idle", 4, 4)],
        "component string, fingerprint string, position bigint, read_end bigint",
    )
    receipts = [("whole", 0, 16), ("whole", 1, 25), ("gap", 0, 11), ("gap", 1, 22), ("gap", 2, None), ("gap", 3, 40), ("none", 0, None)]
    receipts += [("missing", 0, 12), ("missing", 2, 30), ("gap", 0, 11)]
    receipts = spark.createDataFrame([("c", *r) for r in receipts], "component string, fingerprint string, block_no bigint, read_to bigint")
    got = {r.fingerprint: (r.read_end, r.unread) for r in CK.read_so_far(reads, receipts, 10).collect()}
    assert got == {"whole": (25, False), "gap": (22, True), "none": (7, True), "missing": (12, True), "idle": (4, False)}


def test_receipts_are_not_broadcast(spark):
    """Ten files become 200,000 receipts. The planner sees the size of the files only and sent all receipts to the driver."""
    reads = spark.range(10).select(
        F.lit("c").alias("component"), F.col("id").cast("string").alias("fingerprint"), F.lit(0).cast("bigint").alias("position"),
        F.lit(200_000).cast("bigint").alias("read_end"),
    )
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(19_999).cast("bigint"))).alias("block_no")
    receipts = reads.select("component", "fingerprint", number).withColumn("read_to", (F.col("block_no") + 1) * 10)
    receipts = receipts.where("not (fingerprint = '3' and block_no in (0, 70)) and not (fingerprint = '4' and block_no = 19999)")
    df = CK.read_so_far(reads, receipts, 10)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.fingerprint: (r.read_end, r.unread) for r in df.collect()}
    assert got == {**{str(i): (200_000, False) for i in range(10)}, "3": (0, True), "4": (199_990, True)}


def test_only_the_planned_file_is_deleted(spark, tmp_path):
    from logferry.sources.byteranges import identity

    plan = []
    for n in ("plain", "moved", "replaced", "grown", "gone"):
        put(tmp_path / n / "app.log", lines(len(n), 30))
        plan.append((f"file:{tmp_path / n / 'app.log'}", identity(lines(len(n), 30).encode()), len(lines(len(n), 30))))
    os.rename(tmp_path / "moved/app.log", tmp_path / "moved/app_1.log")
    put(tmp_path / "moved/app.log", lines(40, 50))
    put(tmp_path / "replaced/app.log", lines(50, 60))
    with open(tmp_path / "grown/app.log", "a") as f:
        f.write("more\n")
    os.remove(tmp_path / "gone/app.log")
    RT.delete_files(spark.createDataFrame(plan, "path string, fingerprint string, length bigint"))
    left = {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.log")}
    assert left == {"moved/app.log", "replaced/app.log", "grown/app.log"}


@pytest.mark.parametrize("dies", ["in the sink", "after the sink"])
def test_a_broken_cycle_goes_on_with_the_same_batches(spark, tmp_path, monkeypatch, dies):
    put(tmp_path / "logs/app_1.log", lines(0, 30), 1)
    put(tmp_path / "logs/app.log", lines(30, 40), 2)
    rules = spark.createDataFrame([rule("app", tmp_path / "logs", delete_after=True)], RULE_SCHEMA)
    store = C.Store(spark, str(tmp_path / "store"))
    calls = []

    def sink(events, epoch):
        rows = events.select("log_group", "log_stream", "batch_no", "message").collect()
        calls.append((epoch, sorted(rows)))
        if dies == "in the sink" and len(calls) == 1:
            raise RuntimeError("the answer was lost")
        return C.table_sink(events, epoch)

    real = C.C.delivered_positions

    def fails(*args):
        raise RuntimeError("the driver is gone")

    if dies == "after the sink":
        monkeypatch.setattr(C.C, "delivered_positions", fails)
    with pytest.raises(RuntimeError):
        C.run_cycle(spark, rules, SETTINGS, store, sink=sink)
    monkeypatch.setattr(C.C, "delivered_positions", real)
    # Meanwhile files grow and rotate, and another clock would drop and pack differently.
    os.rename(tmp_path / "logs/app.log", tmp_path / "logs/app_2.log")
    with open(tmp_path / "logs/app_2.log", "a") as f:
        f.write(lines(40, 45))
    put(tmp_path / "logs/app.log", lines(45, 50), 6)
    later = Settings(as_of=dt.datetime(2024, 5, 2, 13), range_bytes=70, max_batch_events=3, pack_block=64)
    assert C.run_cycle(spark, rules, later, store, sink=sink, delete=True) == 0
    if dies == "in the sink":
        assert len(calls) == 2 and calls[0] == calls[1]  # called again, with equal content under equal keys
    else:
        assert len(calls) == 1
    assert sorted(os.listdir(tmp_path / "logs")) == ["app.log", "app_2.log"]
    C.run_cycle(spark, rules, later, store, sink=sink)
    assert sent(store, "app") == all_lines(lines(0, 50))


def test_tries_targets_and_refused_events(spark, tmp_path):
    """A sink that answers with a row per try: outcomes are judged, targets made once, refusals reported."""
    for n in ("a", "b", "c"):
        put(tmp_path / n / "app.log", "".join(line(i, day=1 + i % 2) for i in range(8)))
    rules = spark.createDataFrame([rule(n, tmp_path / n) for n in ("a", "b", "c")] + [rule("none", tmp_path / "nowhere")], RULE_SCHEMA)
    store = C.Store(spark, str(tmp_path / "store"))
    settings = Settings(as_of=dt.datetime(2024, 5, 2, 12))
    made, keys = [], ["log_group", "log_stream", "batch_no"]

    def targets(missing, epoch):
        made.append(sorted(r.kind for r in missing.collect()))

    def sink(events, epoch):
        batches = events.select(*keys).distinct()
        outcomes = F.when(F.col("log_group").endswith("a"), F.expr("array('bad_token', 'missing_target', 'ok')")).when(
            F.col("log_group").endswith("b"), F.expr("array('bad_token', 'bad_token', 'bad_token', 'ok')")
        ).otherwise(F.expr("array('ok')"))
        tries = batches.select(*keys, F.posexplode(outcomes).alias("try_no", "outcome")).withColumn("try_no", F.col("try_no") + 1)
        fatal = F.col("log_group").endswith("c") & F.col("log_stream").contains("/05/01/") & F.lit(epoch == 0)
        refused = events.where("message like '%seq: 3)%'").withColumn("reason", F.lit("odd"))
        return tries.withColumn("fatal", fatal), refused

    C.run_cycle(spark, rules, settings, store, sink=sink, targets=targets)
    assert made == [["group"] * 3 + ["stream"] * 6]
    ok = {(r.log_group[-1], r.log_stream[6:11]) for r in store.read("delivery", 0).where("delivered").collect()}
    assert ok == {("a", "05/01"), ("a", "05/02")}  # b's third try was its last; behind c's fatal error nothing was tried
    assert store.read("rejected", 0).agg(F.sum("n_events")).first()[0] == 3
    assert {r.component: r.status for r in store.read("diagnostics", 0).collect()} == {"a": "ok", "b": "ok", "c": "ok", "none": "missing_dir"}
    C.run_cycle(spark, rules, settings, store, sink=sink, targets=targets)
    assert made[1] == [] and sent(store, "c") == sorted(line(i, day=1 + i % 2) for i in range(8))


def test_records_of_any_size(spark, tmp_path):
    """Records far longer than a range, and than what is handled as a whole, give the same events for any range size."""
    body = "".join(f"  at frame é {i} 中\n" for i in range(120))
    text = line(1) + "2024-05-02T03:00:00Z long " + body + line(2) + '{"level":"DEBUG","x":"' + "y" * 700 + '"}\n' + body
    text += "2020-01-01T00:00:00Z too old " + body + line(3) + " " * 900 + "\n" + line(4) + "no time\n"
    put(tmp_path / "app" / "app_1.log", text)
    put(tmp_path / "app" / "app.log", line(5), 5)
    rules = spark.createDataFrame([rule("app", tmp_path / "app")], RULE_SCHEMA)
    found = {}
    for size, whole, joiner in ((60, 500, "|"), (333, 500, "|"), (1 << 20, 500, "|"), (333, 1 << 20, "|"), (60, 500, ""), (1 << 20, 500, "")):
        store = C.Store(spark, str(tmp_path / f"store-{size}-{whole}-{len(joiner)}"))
        settings = Settings(as_of=dt.datetime(2024, 5, 2, 12), range_bytes=size, whole_bytes=whole, head_bytes=100, max_event_bytes=150, joiner=joiner)
        C.run_cycle(spark, rules, settings, store)
        rows = store.read("events", 0).where("path like '%app_1.log'").select("start_off", "end_off", "n_lines", "chunk_no", "message", "size", "emit", "dropped", "ts", "level")
        found[size, whole, joiner] = sorted(map(str, rows.collect()))
        if size == 60:
            whole_text = store.read("events", 0).where("dropped is null and path like '%app_1.log'")
            by_record = {}
            for r in whole_text.orderBy("start_off", "chunk_no").collect():
                by_record[r.start_off] = by_record.get(r.start_off, 0) + r.size
            starts = [0, *[i + 1 for i, c in enumerate(text.encode()) if c == 10 and text.encode()[i + 1 : i + 2] in (b"2", b"{")], len(text.encode())]
            parts = [text.encode()[a:b].decode().split("\n")[:-1] for a, b in zip(starts, starts[1:])]
            assert by_record == {a: len(joiner.join(p).encode()) for a, p in zip(starts, parts) if not p[0].startswith("2020")}
    assert found[60, 500, "|"] == found[333, 500, "|"] == found[1 << 20, 500, "|"]
    assert found[60, 500, ""] == found[1 << 20, 500, ""]
