"""Known results of the log data model, from content to first batches. One component per case."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logferry.operators import events as E
from logferry.operators import files as FL
from logferry.operators import packing as P
from logferry.operators import records as R
from logferry.settings import MAX_EVENT_BYTES, Settings

NOON = dt.datetime(2020, 12, 17, 12)
WS = r"^\S"


def structured(level, message, cause=False):
    extra = '"cause":{"message":"boom","stackTrace":[{"className":"C","lineNumber":5}],"suppressed":[]},' if cause else ""
    level = "null" if level is None else f'"{level}"'
    return f'{{{extra}"contexts":{{"device":"d"}},"level":{level},"message":"{message}","timestamp":1608292800000}}\n'


MIXED = (
    structured(None, "no level") + structured("INFO", "one") + structured("DEBUG", "two") + structured("INFO", "three")
    + structured("ERROR", "four", cause=True) + '{"parses": "but is no log record"}\n'
)
PLAIN = "".join(
    f"2020-12-17T22:58:52.{686 + i}Z [INFO] (pool-{i}) app.Service: state. {{k={i}}}\n" for i in range(12)
) + "2020-12-17T14:58:52.700+08:00 [INFO] (pool-9) app.Service: done. {k=13}\n"

CASES = {
    # name: (content, start rule)
    "plain": (PLAIN, None),
    "mixed": (MIXED, None),
    "count": (("a" * 70 + "\r\n") * 10_001, WS),
    "bytes": (("b" * 1024 + "\r\n") * 1024, WS),
    "days": ("2020-12-16T01:00:00Z a\n2020-12-16T02:00:00Z b\n2020-12-17T01:00:00Z c\n2020-12-17T02:00:00Z d\n", None),
    "expired": ("2020-06-08T01:00:00Z a\n" * 2 + "2020-06-09T01:00:00Z b\n" * 2 + "2020-12-17T02:00:00Z d\n", None),
    "oversize": ("x" * 1024 + "\n" + "y" * 262_144 + "\n" + "z" * 1024 + "\n", WS),
    "both": ("a" * 1027 + "\n" + "b" * (2 * MAX_EVENT_BYTES) + "\n" + ("c" * 262_147 + "\n") * 2, WS),
    "null": ("null\n", None),
    "blank": ("p" * MAX_EVENT_BYTES + " " * MAX_EVENT_BYTES + "q" * MAX_EVENT_BYTES + "\r\n", None),
    "trace": (
        "[2020-12-10] [INFO] (p) M:\n[2020-12-10] [ERROR] (p) D:\nsome.Exception: E\n    at x\n    at y\nCaused by: F\n", None,
    ),
    "custom": ("1[INFO] M:\n2[ERROR] D:\n3some.Exception\n   at x\n   at y\n4Caused by\n", r"^\d.*$"),
}


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rows = [(n, f"/{n}.log", dt.datetime(2020, 12, 17, 11), bytearray(c.encode()), r) for n, (c, r) in CASES.items()]
    files = spark.createDataFrame(rows, "component string, path string, mtime timestamp, content binary, start_regex string")
    records = R.reassemble_records(R.as_blocks(files), F.col("start_regex"), keep=("component", "path", "mtime"))
    df = E.to_events(records, Settings(as_of=NOON), F.lit("user"), F.lit("a:zA_Z:0-9"), F.lit("INFO"))
    packed = P.pack_batches(df, blocks=[["mtime", "path", "block_no"]])
    where = str(tmp_path_factory.mktemp("golden"))
    packed.drop("is_head", "is_tail").write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def sent(events, case, batch=1):
    return events.where((F.col("component") == case) & F.col("emit") & (F.col("batch_no") == batch))


def by_day(events, case):
    rows = sent(events, case).groupBy("log_stream").count().collect()
    return {r.log_stream: r["count"] for r in rows}


def end_of(events, case):
    return events.where((F.col("component") == case) & (F.col("batch_no") == 1)).agg(F.max("end_off")).first()[0]


def test_plain_lines(events):
    assert by_day(events, "plain") == {"/2020/12/17/thing/a+zA_Z+0-9": 13}
    assert end_of(events, "plain") == len(PLAIN)


def test_structured_lines(events):
    """DEBUG is dropped; records without a level are text and get the time of ingestion."""
    assert by_day(events, "mixed") == {"/2020/12/18/thing/a+zA_Z+0-9": 3, "/2020/12/17/thing/a+zA_Z+0-9": 2}


def test_count_cap(events):
    assert sent(events, "count").count() == 10_000 and end_of(events, "count") == 720_000
    assert sent(events, "count", 2).count() == 1


def test_byte_cap(events):
    assert sent(events, "bytes").count() == 991 and end_of(events, "bytes") == 1_016_766
    assert sent(events, "bytes", 2).count() == 33


def test_days_and_age(events):
    # 26 hours lie between the first and the last event, but each stream spans one day only.
    assert sorted(by_day(events, "days").values()) == [2, 2]
    assert by_day(events, "expired") == {"/2020/12/17/thing/a+zA_Z+0-9": 1}


def test_oversize(events):
    sizes = [r["size"] for r in sent(events, "oversize").orderBy("start_off", "chunk_no").collect()]
    assert sizes == [1024, 262_110, 34, 1024]
    assert end_of(events, "oversize") == len(CASES["oversize"][0])


def test_oversize_meets_byte_cap(events):
    assert sent(events, "both").count() == 5
    # The last line starts the next batch: nothing of it was accepted.
    assert [r.chunk_no for r in sent(events, "both", 2).orderBy("chunk_no").collect()] == [0, 1]


def test_odd_records(events):
    rows = sent(events, "null").collect()
    assert [r.message for r in rows] == ["null"] and rows[0].ts == NOON
    assert sent(events, "blank").count() == 2
    assert events.where("component = 'blank'").count() == 3
    assert sent(events, "trace").count() == 2
    assert sent(events, "custom").count() == 4


def test_fingerprint_limits(spark):
    a = "a" * 924
    texts = ["", a, "a" * 1024, "a" * 1124, a + "\n", a + "\n" + "b" * 100]
    rows = [(i, bytearray(t.encode())) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, content binary").select("i", FL.fingerprint(F.col("content")).alias("f"))
    f = [r.f for r in df.orderBy("i").collect()]
    assert f[0] is None and f[1] is None
    assert f[2] == f[3] and f[4] == f[5] and f[2] != f[4]
