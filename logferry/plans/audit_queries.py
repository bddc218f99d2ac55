"""Queries that check what was delivered."""

from __future__ import annotations

from pyspark.sql import functions as F

from logferry.operators import audit as A
from logferry.operators import records as R
from logferry.plans import state_queries as SQ
from logferry.plans import views as V
from logferry.plans.registry import query
from logferry.plans.views import with_sql

_EVENTS = (V.RAW_EVENTS, V.PARSED, V.ROUTED)


@query("stream_exists", with_sql(*_EVENTS, final="""
  select log_group, log_stream, (log_group, log_stream) in (select (log_group, log_stream) from routed) as found
  from (select distinct log_group, log_stream from events_at)"""))
def stream_exists(spark, sf_dir):
    """Streams of all events, looked for among the delivered ones."""
    expected = V.events_at(spark, sf_dir).select("log_group", "log_stream").distinct()
    return A.stream_exists(expected, V.routed(spark, sf_dir))


@query("count_check", with_sql(*_EVENTS, final="""
  select log_stream, coalesce(n_delivered, 0) as n_delivered, coalesce(n_expected, 0) as n_expected,
    coalesce(n_delivered, 0) = coalesce(n_expected, 0) as matches
  from (select log_stream, count(*) as n_delivered from routed group by 1)
  full join (select log_stream, count(*) as n_expected from events_at group by 1) using (log_stream)"""))
def count_check(spark, sf_dir):
    expected = V.events_at(spark, sf_dir).groupBy("log_stream").agg(F.count(F.lit(1)).alias("n_expected"))
    return A.count_check(V.routed(spark, sf_dir), expected, ["log_stream"])


def numbered(spark, sf_dir):
    """Events that carry a number; numbers of a component have gaps and repeat."""
    number = F.floor(F.col("event_id") / 10) + 1
    return V.table(spark, sf_dir, "events").select(
        F.concat(F.lit("comp"), (F.col("user_id") % 10).cast("string")).alias("component"),
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.col("event_type"), F.lit(" - (seq: "), number.cast("string"), F.lit(")")).alias("message"),
    )


_NUMBERED = "numbered as (select 'comp' || (user_id % 10) as component, event_id, ts, event_id // 10 + 1 as seq from events)"


@query("gaps_and_duplicates", with_sql(_NUMBERED, final="""
  select component, seq as from_seq, seq as to_seq, 'duplicate' as problem, count(*) as n
  from numbered group by component, seq having count(*) > 1
  union all
  select component, before + 1, seq - 1, 'missing', 0 from (
    select component, seq, coalesce(lag(seq) over (partition by component order by seq), 0) as before
    from (select distinct component, seq from numbered)) where seq - before > 1"""))
def gaps_and_duplicates(spark, sf_dir):
    return A.gaps_and_duplicates(numbered(spark, sf_dir), ["component"], part=64)


@query("order_breaks", with_sql(_NUMBERED, final="""
  select component, event_id, seq, nth from (
    select *, row_number() over (partition by component order by ts, event_id) as nth from numbered) where nth <> seq"""))
def order_breaks(spark, sf_dir):
    return A.order_breaks(numbered(spark, sf_dir), ["component"], ["ts", "event_id"]).select("component", "event_id", "seq", "nth")


@query("ingest_rate", with_sql(*_EVENTS, final="""
  select component, cast(sum(strlen(raw)) as bigint) as n_bytes,
    sum(strlen(raw)) / ((max(ts_ms) - min(ts_ms)) / 1000 * 1048576) as mib_per_sec
  from events_at group by component"""))
def ingest_rate(spark, sf_dir):
    """The time of the event serves as the time of its ingestion."""
    return A.ingest_rate(V.events_at(spark, sf_dir), ["component"], "size", "ts")


@query("files_remaining", with_sql(*SQ._RETAIN, final="""
  select o.component, count(*) as n_before, count(*) - count(p.path) as n_after
  from owned o left join plan p on p.component = o.component and p.path = o.path group by o.component"""))
def files_remaining(spark, sf_dir):
    owned = V.owned(spark, sf_dir)
    return A.files_remaining(owned, SQ.plan(spark, sf_dir, owned))


@query("byte_conservation", with_sql(V.FILES, V.LINES, final="""
  select component, cast(sum(length) as bigint) as bytes_in, cast(sum(length) as bigint) as bytes_read,
    cast(sum((select sum(strlen(line)) from lines l where l.path = f.path)) as bigint) as bytes_kept,
    cast(sum((select count(*) from lines l where l.path = f.path)) as bigint) as n_lines, true as conserved
  from files f group by component"""))
def byte_conservation(spark, sf_dir):
    records = R.reassemble_records(V.blocks(spark, sf_dir), F.col("start_regex"))
    return A.byte_conservation(V.files(spark, sf_dir).drop("content"), records)
