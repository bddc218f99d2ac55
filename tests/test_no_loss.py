"""What a failed stream must not cost, and what the text part of a cycle must not do."""

import datetime as dt
import os

from pyspark.sql import functions as F

from logferry.operators import records as R
from logferry.plans import cycle as C
from logferry.settings import Settings
from tests_support import RULE_SCHEMA, line, rule

SETTINGS = Settings(as_of=dt.datetime(2024, 5, 4, 12), range_bytes=64)


def put(folder, name, day):
    path = folder / name
    path.write_text("".join(line(10 * day + i, day=day) for i in range(5)))
    stamp = dt.datetime(2024, 5, day, 12, tzinfo=dt.timezone.utc).timestamp()
    os.utime(path, (stamp, stamp))


def test_a_refused_older_file_arrives_later(spark, tmp_path):
    logs = tmp_path / "app"
    logs.mkdir()
    for day, name in enumerate(("app_1.log", "app_2.log", "app.log"), 1):
        put(logs, name, day)
    rules = spark.createDataFrame([rule("app", logs, max_bytes=10)], RULE_SCHEMA)
    store = C.Store(spark, str(tmp_path / "store"))

    def refuses(events, epoch):
        return C.table_sink(events, epoch).withColumn("delivered", ~F.col("log_stream").contains("/05/01/"))

    def sent(epoch):
        done = store.read("delivery", epoch).where("delivered").select("log_group", "log_stream", "batch_no")
        rows = store.read("batches", epoch).where("emit").join(done, ["log_group", "log_stream", "batch_no"])
        return sorted(os.path.basename(r.path) for r in rows.select("path").collect())

    def planned(epoch):
        return {os.path.basename(r.path) for r in store.read("retention", epoch).collect()}

    C.run_cycle(spark, rules, SETTINGS, store, sink=refuses)
    assert sent(0) == ["app.log"] * 5 + ["app_2.log"] * 5
    C.run_cycle(spark, rules, SETTINGS, store, sink=refuses)
    assert sent(1) == [] and planned(1) == set()
    C.run_cycle(spark, rules, SETTINGS, store)
    assert sent(2) == ["app_1.log"] * 5 and planned(2) == set()
    C.run_cycle(spark, rules, SETTINGS, store)
    assert sent(3) == [] and "app.log" not in planned(3) and "app_1.log" in planned(3)


def test_text_meets_no_join(spark, tmp_path):
    work = spark.createDataFrame(
        [("app", "f", "/x", dt.datetime(2024, 5, 1), False, 0, 0, 100)],
        "component string, fingerprint string, path string, mtime timestamp, is_active boolean, position bigint, chunk_no int, read_end bigint",
    )
    rules = spark.createDataFrame([rule("app", tmp_path)], RULE_SCHEMA)
    plan = C.read_pieces(work, rules, SETTINGS)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("MapInArrow")
    assert "Join" not in above and "Join" in below and below.count("MapInArrow") == 0


def test_lines_are_repaired_one_by_one(spark):
    files = spark.createDataFrame([("c", "/x", bytearray(b"a \xc3\n\xa9 tail"))], "component string, path string, content binary")
    rows = R.reassemble_records(R.as_blocks(files), F.lit("^a")).collect()
    assert [r.message for r in rows] == ["a \ufffd\ufffd tail"]
