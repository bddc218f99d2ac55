"""Rule documents drive cycles; the state of an earlier collector is taken over."""

import datetime as dt
import json
import os
import time

from pyspark.sql import functions as F

from logferry.operators.files import fingerprint
from logferry.plans import service as SV
from logferry.plans.cycle import Store, run_cycle
from logferry.settings import Settings
from tests_support import line

NOON = dt.datetime(2024, 5, 2, 12)
LOGGERS = "component string, file_stem string, dir string"


def put(path, text, minute=1):
    path.parent.mkdir(exist_ok=True, parents=True)
    path.write_text(text)
    stamp = dt.datetime(2024, 5, 2, 11, minute, tzinfo=dt.timezone.utc).timestamp()
    os.utime(path, (stamp, stamp))


def document(spark, root, **more):
    config = {
        "componentLogsConfigurationMap": {"app": {"logFileDirectoryPath": str(root / "app"), "diskSpaceLimit": "3"}},
        "componentLogsConfiguration": [{"componentName": "other", "logFileRegex": "^o", "logFileDirectoryPath": str(root / "other"), "minimumLogLevel": "WARN"}],
        "systemLogsConfiguration": {"upload": "true"}, **more,
    }
    return spark.createDataFrame([(json.dumps(config),)], "config string")


def test_documents_to_cycles(spark, tmp_path):
    loggers = spark.createDataFrame([("app", "app.x", "/unused")], LOGGERS)
    put(tmp_path / "app/app.x_1.log", line(1))
    put(tmp_path / "app/appyx.log", line(2))  # the dot of the stem is no wildcard
    put(tmp_path / "other/o.txt", line(3))
    put(tmp_path / "root/main.log", line(4))
    rules = SV.rules_of(document(spark, tmp_path), loggers, str(tmp_path / "root"), "main")
    assert {r.component: (r.min_level, r.max_bytes, r.component_type) for r in rules.collect()} == {
        "app": ("INFO", 3072, "user"), "other": ("WARN", None, "user"), "System": ("INFO", None, "system"),
    }
    store = Store(spark, str(tmp_path / "store"))
    run_cycle(spark, rules, Settings(as_of=NOON), store)
    sent = {r.log_group.rsplit("/", 1)[1]: r.message + "\n" for r in store.read("batches", 0).collect()}
    assert sent == {"app": line(1), "other": line(3), "System": line(4)}
    # A rule that went takes its state with it, and the system rule can be switched off.
    fewer = document(spark, tmp_path, componentLogsConfiguration=[], systemLogsConfiguration={"upload": "false"})
    run_cycle(spark, SV.rules_of(fewer, loggers, str(tmp_path / "root"), "main"), Settings(as_of=NOON), store)
    assert {r.component for r in store.read("checkpoint", 1).collect()} == {"app"}


def test_state_of_an_earlier_collector(spark, tmp_path):
    body = [line(i) for i in range(10)]
    for n in ("app", "old", "done"):
        put(tmp_path / n / f"{n}.log", f"{n} " + "".join(body))
    put(tmp_path / "done/done_1.log", "earlier " + body[0], 0)
    docs = spark.createDataFrame([(json.dumps({"componentLogsConfigurationMap": {n: {"logFileDirectoryPath": str(tmp_path / n)} for n in ("app", "old", "done")}}),)], "config string")
    rules = SV.rules_of(docs, spark.createDataFrame([], LOGGERS), "/nowhere", "x")
    at = lambda n, k: len(f"{n} " + "".join(body[:k]))
    head = spark.createDataFrame([(bytearray(("app " + body[0]).encode()),)], "b binary").select(fingerprint(F.col("b"))).first()[0]
    when = dt.datetime(2024, 5, 2, 11, 1)
    saved = spark.createDataFrame([("app", head, "elsewhere/app.log", at("app", 4), when, when), ("gone", "f", "x", 1, when, when)], SV.STATE)
    legacy = spark.createDataFrame([("old", None, str(tmp_path / "old/old.log"), at("old", 7), when, when), ("app", head, "y", 0, when, when)], SV.STATE)
    mark = spark.createDataFrame([("done", dt.datetime(2024, 5, 2, 11, 0, 30))], "component string, last_mtime timestamp")
    store = Store(spark, str(tmp_path / "store"))
    assert SV.take_over(spark, store, rules, Settings(as_of=NOON), saved, mark, legacy) == 0
    assert SV.take_over(spark, store, rules, Settings(as_of=NOON), legacy=saved) == 0
    assert run_cycle(spark, rules, Settings(as_of=NOON), store) == 1
    sent = {}
    for r in store.read("batches", 1).collect():
        sent.setdefault(r.component, []).append(r.message + "\n")
    assert {n: sorted(x) for n, x in sent.items()} == {"app": sorted(body[4:]), "old": sorted(body[7:]), "done": sorted([f"done {body[0]}", *body[1:]])}


def test_service_reads_documents_anew(spark, tmp_path):
    for n in ("app", "other"):
        put(tmp_path / n / f"{n[0]}.log", line(1))
    store, current = Store(spark, str(tmp_path / "store")), [{"app": {"logFileRegex": "log", "logFileDirectoryPath": str(tmp_path / "app")}}]
    q = SV.run_service(
        spark, lambda: spark.createDataFrame([(json.dumps({"componentLogsConfigurationMap": current[0]}),)], "config string"),
        spark.createDataFrame([], LOGGERS), "/nowhere", "x", lambda: Settings(as_of=NOON), store, 0.2, str(tmp_path / "ck"),
    )
    try:
        deadline = time.time() + 300
        while time.time() < deadline and store.last_epoch() < 0:
            time.sleep(1)
        current[0] = {"other": {"logFileRegex": "log", "logFileDirectoryPath": str(tmp_path / "other")}}
        while time.time() < deadline and (store.last_epoch() < 1 or {r.component for r in store.read("checkpoint", store.last_epoch()).collect()} != {"other"}):
            time.sleep(1)
    finally:
        q.stop()
    assert {r.component for r in store.read("checkpoint", store.last_epoch()).collect()} == {"other"}
