"""Positions over sampled ranges: equal to a plain window, and even where one key holds nearly all rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logferry.operators.ordering import total_order
from logferry.sources.scratch import settle


@pytest.mark.parametrize("keys", [["k"], ["k", "s"], []])
def test_positions_equal_a_plain_window(spark, keys):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.when(F.col("id") % 5 > 0, F.col("id").cast("string"))).alias("k"),
        (F.col("id") % 2).alias("s"), (F.col("id") * 7919 % 613).alias("t"), "id",
    ).repartition(7)
    order = [F.col("t").desc(), F.col("id")]
    want = df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    got = total_order(df, keys, order, "n", settle)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_repeated_rows_and_empty_input(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [(None, 1)] * 3, "k string, t int")
    rows = total_order(df, ["k"], [F.col("t")], "n", settle).collect()
    assert sorted(r.n for r in rows if r.k == "a") == list(range(1, 51)) and sorted(r.n for r in rows if r.k is None) == [1, 2, 3]
    assert total_order(df.limit(0), ["k"], [F.col("t")], "n", settle).count() == 0


def test_one_key_and_one_moment_are_dealt_evenly(spark):
    """A key that holds all rows, all of the same time: no range above twice the median."""
    df = spark.range(40_000).select(F.lit("k").alias("k"), F.lit(1).alias("t"), "id").repartition(8)
    sizes = []

    def watched(frame):
        written = settle(frame)
        if "_at" in written.columns:
            sizes.extend(r["count"] for r in written.groupBy(F.shiftright("_at", 33).alias("r")).count().collect())
        return written

    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = total_order(df, ["k"], [F.col("t")], "n", watched)
        assert got.agg(F.countDistinct("n"), F.max("n")).first() == (40_000, 40_000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(sizes) > 1 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
