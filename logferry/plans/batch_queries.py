"""Queries on streams and batches, their delivery and its results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from logferry.operators import delivery as D
from logferry.operators import events as E
from logferry.operators import packing as P
from logferry.operators import records as R
from logferry.plans import views as V
from logferry.plans.registry import query
from logferry.plans.views import millis, with_sql

_EVENTS = (V.RAW_EVENTS, V.PARSED, V.ROUTED)


def _narrow(spark, sf_dir):
    """Events without their text, with blocks of event ids."""
    events = V.events_at(spark, sf_dir).drop("message")
    return V.settle(events).withColumn("_part", F.floor(F.col("event_id") / 10_000))


@query("group_streams", with_sql(*_EVENTS, final="""
  select log_group, log_stream, count(*) as n_events, cast(sum(cost) as bigint) as n_bytes,
    min(ts_ms) as first_ts_ms, max(ts_ms) as last_ts_ms
  from routed group by log_group, log_stream"""))
def group_streams(spark, sf_dir):
    return E.group_streams(V.routed(spark, sf_dir)).select(
        "log_group", "log_stream", "n_events", "n_bytes", millis("first_ts"), millis("last_ts")
    )


@query("sort_events", with_sql(*_EVENTS, final="""
  select event_id, log_stream, row_number() over (partition by log_group, log_stream order by ts_ms, event_id) as nth
  from events_at"""))
def sort_events(spark, sf_dir):
    events = V.settle(V.events_at(spark, sf_dir).select("log_group", "log_stream", "ts", "event_id"))
    return P.sort_events(events, ["event_id"]).select("event_id", "log_stream", "nth")


@query("merge_files", with_sql(V.FILES, V.LINES, final="""
  select component, path, start_off, row_number() over (partition by component order by mtime_ms, path, start_off) as nth
  from lines"""))
def merge_files(spark, sf_dir):
    """Lines as events, numbered across all files of a component."""
    lines = R.read_lines(R.as_blocks(V.files(spark, sf_dir)), keep=("component", "path", "mtime"))
    lines = V.settle(lines.select("component", "path", "mtime", "start_off"))  # ranges are sampled from it first
    return P.merge_files(lines, order=("mtime", "path", "start_off")).select("component", "path", "start_off", "nth")


@query("cap_bytes", with_sql(*_EVENTS, final="""
  select component, event_id, running_cost from (
    select *, cast(sum(cost) over (partition by component order by event_id) as bigint) as running_cost from events_at)
  where running_cost <= 65536"""))
def cap_bytes(spark, sf_dir):
    events = _narrow(spark, sf_dir)
    return P.first_batch_bytes(events, ["component"], ["event_id"], [["_part"]], 65536).select(
        "component", "event_id", "running_cost"
    )


@query("cap_count", with_sql(*_EVENTS, final="""
  select log_stream, event_id, row_number() over (partition by log_group, log_stream order by event_id) as nth
  from events_at qualify nth <= 3"""))
def cap_count(spark, sf_dir):
    events = _narrow(spark, sf_dir)
    first = P.first_batch_count(events, ["log_group", "log_stream"], ["event_id"], [["_part"]], 3)
    return first.select("log_stream", "event_id", "nth")


@query("cap_span", with_sql(*_EVENTS, final="""
  select event_id, first_ts_ms, ts_ms <= first_ts_ms + 6 * 3600000 as fits from (
    select *, min(ts_ms) over (partition by log_group, log_stream order by event_id) as first_ts_ms from events_at)"""))
def cap_span(spark, sf_dir):
    events = _narrow(spark, sf_dir)
    df = P.within_span(events, ["log_group", "log_stream"], ["event_id"], [["_part"]], dt.timedelta(hours=6))
    return df.select("event_id", millis("first_ts"), "fits")


# Small limits, so that all three of them close batches.
_BYTES, _COUNT, _HOURS = 6000, 6, 20

def _pack_sql(max_bytes: int) -> str:
    return f"""numbered as (
  select *, row_number() over (partition by component order by event_id) as p,
    cast(sum(cost) over (partition by component order by event_id) as bigint) as total,
    lead(event_id, {_COUNT}) over (partition by component, log_stream order by event_id) as over_id
  from file_events),
breaks as (
  select a.component, a.p,
    (select min(b.p) from numbered b where b.component = a.component and b.p > a.p and b.p <= a.p + {max_bytes // 34 + 1}
       and b.total - a.total + a.cost > {max_bytes}) as by_bytes,
    (select b.p from numbered b where b.component = a.component and b.event_id = a.over_id) as by_count,
    (select min(b.p) from numbered b where b.component = a.component and b.log_stream = a.log_stream and b.p > a.p
       and b.ts_ms > a.ts_ms + {_HOURS} * 3600000) as by_span
  from numbered a),
nexts as (
  select component, p, min(least(coalesce(by_bytes, 1000000000), coalesce(by_count, 1000000000), coalesce(by_span, 1000000000)))
    over (partition by component order by p desc) as next_p
  from breaks),
starts as (
  with recursive walk as (
    select component, cast(1 as bigint) as p, cast(1 as bigint) as batch_no from (select distinct component from numbered)
    union all
    select w.component, cast(n.next_p as bigint), w.batch_no + 1 from walk w
    join nexts n on n.component = w.component and n.p = w.p where n.next_p < 1000000000)
  select * from walk),
packed as (
  select n.*, s.batch_no from numbered n asof join starts s on n.component = s.component and n.p >= s.p)"""


_PACK = _pack_sql(_BYTES)


def packed(spark, sf_dir, max_bytes=_BYTES, block_size=2048, fan_in=16):
    """All events packed per component in the order of event_id."""
    events = V.settle(V.file_events(spark, sf_dir).withColumn("mtime", F.lit(V.AS_OF).cast("timestamp")))
    return P.pack_batches(
        events, order=["event_id"], blocks=[["_part"]], max_bytes=max_bytes, max_events=_COUNT,
        max_span=dt.timedelta(hours=_HOURS), block_size=block_size, fan_in=fan_in,
    )


@query("pack_batches", with_sql(*_EVENTS, V.FILE_EVENTS, _PACK, final="""
  select component, event_id, batch_no from packed"""))
def pack_batches(spark, sf_dir):
    return packed(spark, sf_dir).select("component", "event_id", "batch_no")


@query("pack_many_blocks", with_sql(*_EVENTS, V.FILE_EVENTS, _pack_sql(1500), final="""
  select component, event_id, batch_no from packed"""))
def pack_many_blocks(spark, sf_dir):
    """As pack_batches with smaller batches and the smallest possible blocks, composed in a tree of several levels."""
    return packed(spark, sf_dir, 1500, 1500 // 34 + 1, 4).select("component", "event_id", "batch_no")


@query("progress_by_stream_file", with_sql(*_EVENTS, V.FILE_EVENTS, _PACK, final="""
  select component, fingerprint, log_stream, batch_no, min(start_off) as start_off, max(end_off) as end_off,
    max(end_off) - min(start_off) as bytes_read
  from packed group by component, fingerprint, log_stream, batch_no"""))
def progress_by_stream_file(spark, sf_dir):
    return P.progress_by_stream_file(packed(spark, sf_dir)).drop("mtime")


@query("deliver_batches", with_sql(*_EVENTS, V.FILE_EVENTS, _PACK, final="""
  select log_group, log_stream, batch_no, count(*) as n_events, cast(sum(cost) as bigint) as n_bytes,
    min(ts_ms) as first_ts_ms, max(ts_ms) as last_ts_ms
  from packed group by log_group, log_stream, batch_no"""))
def deliver_batches(spark, sf_dir):
    """The stream batches that are handed to the sink."""
    return P.batch_summary(packed(spark, sf_dir)).select(
        "log_group", "log_stream", "batch_no", "n_events", "n_bytes", millis("first_ts"), millis("last_ts")
    )


@query("retry_outcome", """
with attempts as (
  select l_orderkey as batch_no, l_linenumber as try_no,
    case l_returnflag || l_linestatus when 'AO' then 'ok' when 'AF' then 'already_accepted' when 'NO' then 'bad_token'
      when 'NF' then 'missing_target' else 'service_error' end as outcome
  from lineitem),
ends as (
  select batch_no, min(try_no * 10 + case outcome when 'already_accepted' then 0 when 'ok' then 1 else 2 end)
      filter (try_no <= 3 and outcome in ('ok', 'already_accepted', 'service_error')) as e,
    max(try_no * 10 + case outcome when 'bad_token' then 0 when 'missing_target' then 1 else -1 end)
      filter (try_no <= 3) as l
  from attempts group by batch_no)
select batch_no, coalesce(e % 10 < 2, false) as delivered, cast(coalesce(e, l) // 10 as bigint) as n_tries,
  case when e is not null then case e % 10 when 0 then 'already_accepted' when 1 then 'ok' else 'service_error' end
    when l is not null then case l % 10 when 0 then 'bad_token' else 'missing_target' end end as outcome
from ends""")
def retry_outcome(spark, sf_dir):
    """Line items as tries: the order is the batch, the line number the try."""
    outcome = F.concat("l_returnflag", "l_linestatus")
    attempts = V.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch_no"),
        F.col("l_linenumber").alias("try_no"),
        F.when(outcome == "AO", D.OK).when(outcome == "AF", D.ALREADY_ACCEPTED).when(outcome == "NO", D.BAD_TOKEN)
        .when(outcome == "NF", D.MISSING_TARGET).otherwise(D.SERVICE_ERROR).alias("outcome"),
    )
    return D.retry_outcome(attempts, ["batch_no"])


def stream_batches(spark, sf_dir):
    """Four batches per stream and day, one for each quarter of the day."""
    events = V.events_at(spark, sf_dir).withColumn("batch_no", (F.floor(F.hour("ts") / 6) + 1).cast("bigint"))
    kept = F.sum((~F.col("structured") | F.col("level").isin("INFO", "WARN", "ERROR")).cast("bigint"))
    return events.groupBy("component", "log_group", "log_stream", "batch_no").agg(
        kept.alias("n_events"), F.sum("cost").alias("n_bytes"), F.max("value").alias("top")
    )


_BATCHES = """batches as (
  select component, log_group, log_stream, ts_ms // 21600000 % 4 + 1 as batch_no,
    count(*) filter (not structured or level in ('INFO', 'WARN', 'ERROR')) as n_events,
    cast(sum(cost) as bigint) as n_bytes, max(value) as top
  from events_at group by 1, 2, 3, 4),
ledger as (
  select log_group, log_stream, batch_no, row_number() over (partition by log_group, log_stream order by batch_no) as seq
  from batches where batch_no <= 2)"""


def ledger(batches):
    """Batches of the first half of each day have been accepted."""
    old = batches.where("batch_no <= 2").withColumn("seq", F.lit(0).cast("bigint"))
    return D.stream_sequence(old.drop("seq"), old, part=2).select("log_group", "log_stream", "batch_no", "seq")


@query("dedupe_delivered", with_sql(*_EVENTS, _BATCHES, final="""
  select log_stream, batch_no, n_events from batches anti join ledger using (log_group, log_stream, batch_no)"""))
def dedupe_delivered(spark, sf_dir):
    batches = V.settle(stream_batches(spark, sf_dir))
    return D.dedupe_delivered(batches, ledger(batches)).select("log_stream", "batch_no", "n_events")


@query("stream_sequence", with_sql(*_EVENTS, _BATCHES, final="""
  select log_stream, batch_no, row_number() over (partition by log_group, log_stream order by batch_no)
    + coalesce((select max(seq) from ledger l where l.log_group = b.log_group and l.log_stream = b.log_stream), 0) as seq
  from batches b where batch_no > 2"""))
def stream_sequence(spark, sf_dir):
    batches = V.settle(stream_batches(spark, sf_dir))
    return D.stream_sequence(batches.where("batch_no > 2"), ledger(batches), part=2).select("log_stream", "batch_no", "seq")


@query("missing_targets", with_sql(*_EVENTS, """
catalog as (select log_group, log_stream from events_at where event_type = 'view' and value > 20)""", final="""
  select 'stream' as kind, log_group, log_stream from (select distinct log_group, log_stream from events_at)
    anti join catalog using (log_group, log_stream)
  union all
  select 'group', log_group, '' from (select distinct log_group from events_at) anti join catalog using (log_group)"""))
def missing_targets(spark, sf_dir):
    events = V.events_at(spark, sf_dir)
    return D.missing_targets(events, events.where("event_type = 'view' and value > 20"))


@query("empty_batch_ok", with_sql(*_EVENTS, _BATCHES, final="""
  select log_stream, batch_no, n_events, coalesce(case when top > 60 then null else top < 30 end, false) or n_events = 0 as delivered
  from batches"""))
def empty_batch_ok(spark, sf_dir):
    """Batches with a low top value succeeded, those with a high one have no result."""
    result = F.when(F.col("top") <= 60, F.col("top") < 30)
    df = D.empty_batch_ok(stream_batches(spark, sf_dir).withColumn("delivered", result))
    return df.select("log_stream", "batch_no", "n_events", "delivered")


@query("partial_failure", with_sql(*_EVENTS, _BATCHES, """
marked as (select *, top < 30 as delivered, top > 100 as fatal from batches),
stops as (select component, batch_no, min(log_stream) filter (fatal) as stop from marked group by 1, 2)""", final="""
  select log_stream, batch_no, case when stop is not null and log_stream > stop then 'not_tried'
    when delivered and not fatal then 'delivered' else 'failed' end as status
  from marked join stops using (component, batch_no)"""))
def partial_failure(spark, sf_dir):
    """A batch number of a component is an attempt; its streams are sent in the order of their names."""
    marked = stream_batches(spark, sf_dir).withColumns({"delivered": F.col("top") < 30, "fatal": F.col("top") > 100})
    return D.partial_failure(marked, ["component", "batch_no"], ["log_stream"]).select("log_stream", "batch_no", "status")


@query("hold_after_failure", with_sql(*_EVENTS, _BATCHES, """
marked as (select *, min(batch_no) filter (top >= 30) over (partition by log_group, log_stream) as failed from batches)""",
    final="select log_stream, batch_no, top < 30 and (failed is null or batch_no < failed) as delivered from marked"))
def hold_after_failure(spark, sf_dir):
    marked = stream_batches(spark, sf_dir).withColumn("delivered", F.col("top") < 30)
    return D.hold_after_failure(marked).select("log_stream", "batch_no", "delivered")


@query("rejected_events", with_sql(*_EVENTS, final="""
  select log_group, log_stream, case when ts_ms < 1705276800000 then 'too_old' else 'too_new' end as reason,
    count(*) as n_events, cast(sum(cost) as bigint) as n_bytes
  from events_at where ts_ms < 1705276800000 or ts_ms > 1706400000000 group by 1, 2, 3"""))
def rejected_events(spark, sf_dir):
    """Events before 15 January are too old for the sink, those after 28 January too new."""
    at = F.unix_millis("ts")
    reason = F.when(at < 1705276800000, "too_old").when(at > 1706400000000, "too_new")
    rejected = V.events_at(spark, sf_dir).withColumn("reason", reason).where("reason is not null")
    return D.rejected_events(rejected)
