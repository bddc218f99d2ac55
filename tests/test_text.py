"""Terminators, malformed bytes, JSON and timestamps."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logferry.functions import text as T
from logferry.operators.events import split_oversize
from logferry.operators import records as R


def expected_lines(data: bytes):
    out, begin, i = [], 0, 0
    while i < len(data):
        if data[i : i + 1] in (b"\n", b"\r"):
            end = i + 2 if data[i : i + 2] == b"\r\n" else i + 1
            out.append((begin, end, data[begin:i].decode("utf-8", "replace")))
            begin = i = end
        else:
            i += 1
    if begin < len(data):
        out.append((begin, len(data), data[begin:].decode("utf-8", "replace")))
    return out


def lines_of(spark, contents):
    rows = [("c", str(i), bytearray(c)) for i, c in enumerate(contents)]
    files = spark.createDataFrame(rows, "component string, path string, content binary")
    out = {i: [] for i in range(len(contents))}
    for r in R.read_lines(R.as_blocks(files)).orderBy("path", "line_no").collect():
        out[int(r.path)].append((r.start_off, r.end_off, r.line))
    return out


def test_terminators_and_malformed_bytes(spark):
    contents = [
        b"", b"\n", b"\r", b"\r\n", b"\n\n", b"a", b"a\nb\r\nc\rd", b"a\r\r\nb", "é\nü\r".encode(), b"x\xc3\ny\n",
        b"\xff\xfe\r\n\xe6\xbc", b"a\n\rb", b"\n" * 300 + b"end", ("ä" * 999 + "\n").encode() * 200,
    ]
    got = lines_of(spark, contents)
    for i, c in enumerate(contents):
        assert got[i] == expected_lines(c), c[:40]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \r\n\té漢", max_size=40).map(str.encode), min_size=5, max_size=30))
def test_random_lines(spark, contents):
    got = lines_of(spark, contents)
    assert [got[i] for i in range(len(contents))] == [expected_lines(c) for c in contents]


def test_records_do_not_depend_on_blocks(spark):
    """Cut after every line, or not at all: the records are the same."""
    text = "head\n more\n2024-01-01 a\n  b\n\n{x\n2024-01-02 c\nlast"
    cuts = expected_lines(text.encode())
    whole = [("c", "p", 0, 0, bytearray(text.encode()))]
    parts = [("c", "p", n, b, bytearray(text.encode()[b:e])) for n, (b, e, _) in enumerate(cuts)]
    schema = "component string, path string, block_no bigint, block_start bigint, content binary"
    out = []
    for rows in (whole, parts):
        records = R.stitch_records(R.reassemble_records(spark.createDataFrame(rows, schema)))
        out.append([(r.start_off, r.end_off, r.n_lines, r.message) for r in records.orderBy("start_off").collect()])
    assert out[0] == out[1]
    assert [m for *_, m in out[0]] == ["head more", "2024-01-01 a  b", "{x", "2024-01-02 clast"]


def test_long_lines_fall_back_to_the_first_character(spark):
    df = spark.createDataFrame([("abc" * 10,), (" abc" * 10,), ("abc",)], "line string")
    got = df.select(T.is_record_start(F.col("line"), F.lit("^z"), F.lit(20))).collect()
    assert [r[0] for r in got] == [True, False, False]


def test_structured(spark):
    cases = {
        '{"Level":"INFO","timestamp":12}': ("INFO", 12),
        '{"level":null,"timestamp":12}': None,
        '{"level":"","timestamp":12}': None,
        '{"level":"INFO","LEVEL":"WARN"}': ("WARN", None),
        "{bad": None,
        '{"level":"INFO","timestamp":"x"}': None,
        '{"level":"X","timestamp":1.6e12,"c":{"a":1}}': ("X", 1600000000000),
        '{"level":"INFO"} tail': ("INFO", None),
        " {}": None,
        "null": None,
    }
    df = spark.createDataFrame([(m,) for m in cases], "m string")
    got = df.select("m", T.parse_structured(F.col("m")).alias("p")).collect()
    assert {r.m: None if r.p is None else (r.p.level, r.p.ts_ms) for r in got} == cases


def test_text_timestamps(spark):
    day = dt.datetime(2020, 12, 17)
    cases = {
        "2020-12-17T22:58:52.686Z [I": day + dt.timedelta(hours=22, minutes=58, seconds=52.686),
        "2020-12-17T14:58:52.692+08:00 x": day + dt.timedelta(hours=6, minutes=58, seconds=52.692),
        "2020-12-17T22:58Z": day + dt.timedelta(hours=22, minutes=58),
        "[2020-12-17T22:58:52Z]": day + dt.timedelta(hours=22, minutes=58, seconds=52),
        "2020-12-17T22:58:52.123456789z": day + dt.timedelta(hours=22, minutes=58, seconds=52.123456),
        "2020-12-17": None, "2020": None, "12:30": None, "2020-12-17T22:58:52": None, "2020-02-30T22:58:52Z": None,
        "at 2020-12-17T22:58:52Z": None, "": None,
    }
    df = spark.createDataFrame([(m,) for m in cases], "m string")
    assert {r.m: r.t for r in df.select("m", T.extract_text_ts(F.col("m")).alias("t")).collect()} == cases


def test_chunks_are_cut_at_bytes(spark):
    text = "aé漢😀z"
    df = split_oversize(spark.createDataFrame([(1, text), (2, ""), (3, " \t\x00"), (4, "\u00a0")], "k int, message string"), 2)
    got = {}
    for r in df.orderBy("k", "chunk_no").collect():
        got.setdefault(r.k, []).append((r["size"], r.message, r.emit))
    data = text.encode()
    assert got[1] == [
        (len(data[i : i + 2]), data[i : i + 2].decode("utf-8", "replace"), True) for i in range(0, len(data), 2)
    ]
    assert got[2] == [(0, "", False)]
    assert [e for *_, e in got[3]] == [False, False] and [e for *_, e in got[4]] == [True]
