"""Queries on records and events: parsing, predicates, timestamps, names, sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from logferry.functions import text as T
from logferry.operators import events as E
from logferry.operators import records as R
from logferry.plans import views as V
from logferry.plans.registry import query
from logferry.plans.views import millis, with_sql


@query("reassemble_records", with_sql(V.RULES, V.FILES, V.LINES, V.FLAGGED, V.RECORDS, final="""
  select component, path, start_off, end_off, n_lines, message from records"""))
def reassemble_records(spark, sf_dir):
    records = R.reassemble_records(V.blocks(spark, sf_dir), F.col("start_regex"))
    return records.select("component", "path", "start_off", "end_off", "n_lines", "message")


@query("stitch_records", with_sql(V.RULES, V.FILES, V.LINES, V.FLAGGED, V.RECORDS, final="""
  select component, path, start_off, end_off, n_lines, message from records"""))
def stitch_records(spark, sf_dir):
    """The same records when every line is a block of its own: nearly all of them cross blocks."""
    lines = R.read_lines(V.blocks(spark, sf_dir), keep=("component", "path", "start_regex", "content"))
    size = (F.col("end_off") - F.col("start_off")).cast("int")
    blocks = lines.select(
        "component", "path", "start_regex", F.col("line_no").alias("block_no"), F.col("start_off").alias("block_start"),
        F.substring("content", (F.col("start_off") + 1).cast("int"), size).alias("content"),
    )
    records = R.stitch_records(R.reassemble_records(blocks, F.col("start_regex")))
    return records.select("component", "path", "start_off", "end_off", "n_lines", "message")


@query("is_record_start", with_sql(V.RULES, V.FILES, V.LINES, V.FLAGGED, final="""
  select component, path, start_off, is_start from flagged"""))
def is_record_start(spark, sf_dir):
    lines = R.read_lines(V.blocks(spark, sf_dir), keep=("component", "path", "start_regex"))
    start = T.is_record_start(F.col("line"), F.col("start_regex"))
    return lines.select("component", "path", "start_off", start.alias("is_start"))


@query("is_record_start_ws", with_sql(V.FILES, V.LINES, r"""
ws as (select *, sum(case when line_no = 0 or regexp_matches(line, '^(?:[^\p{Z}\t-\r\x1c-\x1f]|[\x{00a0}\x{2007}\x{202f}])')
         then 1 else 0 end) over (partition by path order by line_no) as rec from lines)""", final="""
  select component, path, min(start_off) as start_off, count(*) as n_lines, string_agg(line, '' order by line_no) as message
  from ws group by component, path, rec"""))
def is_record_start_ws(spark, sf_dir):
    """Records by the fallback rule."""
    records = R.reassemble_records(R.as_blocks(V.files(spark, sf_dir)), whitespace_rule=True)
    return records.select("component", "path", "start_off", "n_lines", "message")


@query("parse_structured", with_sql(V.RAW_EVENTS, V.PARSED, final="""
  select event_id, structured, level, case when structured then found_ms end as json_ts_ms from parsed"""))
def parse_structured(spark, sf_dir):
    return E.parse_structured(V.raw_events(spark, sf_dir), "raw").select("event_id", "structured", "level", "json_ts_ms")


@query("filter_min_level", with_sql(V.RAW_EVENTS, V.PARSED, final=f"""
  select component, event_id, raw from parsed
  where not structured or {V._RANK.format(c='level')} >= {V._RANK.format(c='min_level')}"""))
def filter_min_level(spark, sf_dir):
    """Each component with its own minimum level."""
    df = V.event_rules(E.parse_structured(V.raw_events(spark, sf_dir), "raw"))
    return E.filter_min_level(df, F.col("min_level")).select("component", "event_id", "raw")


@query("extract_text_ts", with_sql(V.RAW_EVENTS, V.PARSED, final="""
  select event_id, case when not structured then found_ms end as text_ts_ms from parsed"""))
def extract_text_ts(spark, sf_dir):
    ts = F.unix_millis(T.extract_text_ts(F.col("raw")))
    return V.raw_events(spark, sf_dir).select("event_id", ts.alias("text_ts_ms"))


@query("resolve_event_ts", with_sql(V.RAW_EVENTS, V.PARSED, final="select event_id, ts_ms from stamped"))
def resolve_event_ts(spark, sf_dir):
    return V.stamped(spark, sf_dir).select("event_id", millis("ts"))


@query("drop_expired", with_sql(V.RAW_EVENTS, V.PARSED, final=f"""
  select event_id, ts_ms from stamped where ts_ms >= {V.AS_OF_MS} - 14 * 86400000"""))
def drop_expired(spark, sf_dir):
    moment = F.timestamp_millis(F.lit(V.AS_OF_MS))
    return E.drop_expired(V.stamped(spark, sf_dir), moment).select("event_id", millis("ts"))


@query("log_group_name", with_sql(V.FILES, V.RULES, final="""
  select f.path, r.component, '/logs/' || r.component_type || '/local/' || r.component as log_group
  from files f join rules r on f.component = r.component"""))
def log_group_name(spark, sf_dir):
    """The log group each file is delivered to."""
    kinds = V.rules(spark, sf_dir).select("component", "component_type")
    group = T.group_name(V.SETTINGS.group_template, F.col("component_type"), F.lit("local"), F.col("component"))
    return V.files(spark, sf_dir).select("component", "path").join(kinds, "component").select(
        "path", "component", group.alias("log_group")
    )


@query("log_stream_name", with_sql(V.RAW_EVENTS, V.PARSED, V.ROUTED, final="""
  select event_id, log_stream from events_at"""))
def log_stream_name(spark, sf_dir):
    return V.stamped(spark, sf_dir).select("event_id", T.stream_name(F.col("ts"), F.col("device")).alias("log_stream"))


@query("split_oversize", """
with chars as (
  select doc_id, c, n, cast(sum(strlen(c)) over (partition by doc_id order by n) as bigint) - strlen(c) as b
  from (select doc_id, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as n from documents)),
parts as (
  select doc_id, n, b // 1024 as chunk_no, least(b + strlen(c), (b // 1024 + 1) * 1024) - b as size,
    case when (b + strlen(c) - 1) // 1024 = b // 1024 then c else chr(65533) end as s
  from chars
  union all
  select doc_id, n, b // 1024 + 1, b + strlen(c) - (b // 1024 + 1) * 1024,
    repeat(chr(65533), cast(b + strlen(c) - (b // 1024 + 1) * 1024 as bigint))
  from chars where (b + strlen(c) - 1) // 1024 > b // 1024)
select doc_id, cast(chunk_no as bigint) as chunk_no, cast(sum(size) as bigint) as size,
  cast(sum(size) + 34 as bigint) as cost, string_agg(s, '' order by n) as message
from parts group by doc_id, chunk_no""")
def split_oversize(spark, sf_dir):
    """Whole documents as records, cut at 1,024 bytes."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("message"))
    return E.split_oversize(d, 1024).select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "size", "cost", "message"
    )


@query("drop_blank_events", with_sql(V.FILES, V.LINES, final=r"""
  select component, path, start_off, line as message from lines where regexp_matches(line, '[^\x00-\x20]')"""))
def drop_blank_events(spark, sf_dir):
    """Each line as a record of its own; empty ones are not sent."""
    lines = R.read_lines(R.as_blocks(V.files(spark, sf_dir))).withColumnRenamed("line", "message")
    return E.drop_blank_events(E.split_oversize(lines)).select("component", "path", "start_off", "message")


@query("event_cost", with_sql(V.RAW_EVENTS, final="select event_id, cast(strlen(raw) + 34 as bigint) as cost from raw_events"))
def event_cost(spark, sf_dir):
    return V.raw_events(spark, sf_dir).select("event_id", T.event_cost(F.octet_length("raw")).alias("cost"))
