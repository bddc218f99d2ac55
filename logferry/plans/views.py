"""The given tables seen as log data, once for Spark and once as SQL for the comparison.

documents are log files (one per document, the source is the component), events are log lines, and
customers are devices that carry a rule document each.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logferry.operators import events as E
from logferry.operators import files as FL
from logferry.operators import records as R
from logferry.operators.ordering import running
from logferry.settings import Settings
from logferry.sources.scratch import settle

AS_OF = dt.datetime(2024, 1, 31)
SETTINGS = Settings(as_of=AS_OF, region="local")
AS_OF_MS = SETTINGS.as_of_ms


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_sql(*ctes: str, final: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + final


def millis(name: str, alias: str | None = None):
    return F.unix_millis(name).alias(alias or f"{name}_ms")


# --- files ------------------------------------------------------------------------------------


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document, last modified ``doc_id`` minutes into 2024."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("component"),
        F.concat("source", F.lit("/"), "doc_id", F.lit(".log")).alias("path"),
        F.concat("doc_id", F.lit(".log")).alias("name"),
        F.col("source").alias("dir"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("mtime"),
        F.octet_length("text").cast("bigint").alias("length"),
        "lang",
        F.col("text").cast("binary").alias("content"),
    )


FILES = """files as (
  select source as component, source || '/' || doc_id || '.log' as path, doc_id || '.log' as name,
    source as dir, (1704067200 + doc_id * 60) * 1000 as mtime_ms, cast(strlen(text) as bigint) as length,
    lang, text as content
  from documents)"""


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their fingerprint and without their content."""
    return FL.eligible_files(
        files(spark, sf_dir).withColumn("fingerprint", FL.fingerprint(F.col("content"))).drop("content")
    )


PRINTS = """prints as (
  select * exclude (content), case
      when contains(content, chr(10)) and strlen(split_part(content, chr(10), 1)) < 1024
        then sha256(split_part(content, chr(10), 1) || chr(10))
      when length >= 1024 then sha256(array_slice(encode(content), 1, 1024)) end as fingerprint
  from files),
identified as (select * from prints where fingerprint is not null)"""


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identified files, one per fingerprint, with ``is_active``; metadata only, and written once, as
    in a cycle."""
    return settle(FL.active_file(FL.dedupe_fingerprint(settle(identified(spark, sf_dir)))))


OWNED = """owned as (
  select *, row_number() over (partition by component order by mtime_ms desc, path desc) = 1 as is_active
  from (select *, count(*) over (partition by component, fingerprint) as n_copies from identified
        qualify row_number() over (partition by component, fingerprint order by mtime_ms desc, path desc) = 1))"""


# --- rules, watermark, checkpoint ---------------------------------------------------------------

_NUM = "cast(substr(source, 4) as int)"
_LEVEL = "case {n} % 5 when 0 then 'TRACE' when 1 then 'DEBUG' when 2 then 'INFO' when 3 then 'WARN' else 'ERROR' end"

_RULES = f"""
  select source as component, case when n % 5 = 0 then 'system' else 'user' end as component_type, source as dir,
    case n % 4 when 1 then '[0-6]\\.log$' else '\\.log$' end as file_regex,
    case n % 3 when 1 then '^[A-M]' when 2 then '^\\W*[D-S]\\w* [a-e]' end as start_regex,
    {_LEVEL.format(n='n')} as min_level,
    case when n % 3 > 0 then cast(20000 * (n % 7) as bigint) end as max_bytes, n % 2 = 0 as delete_after
  from (select distinct source, {_NUM} as n from documents) s
  union all
  select source || '-even', 'user', source, '[02468]\\.log$', null, 'INFO', null, false
  from (select distinct source from documents) s
  union all
  select n_name, 'user', 'dir_' || n_name, '.*', null, 'INFO', null, true from nation
  union all
  select source || '-none', 'user', source, '^none', null, 'INFO', cast(1 as bigint), true
  from (select distinct source from documents) s"""

RULES = f"rules as ({_RULES})"


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules per source: its own, one for even files, one that finds none; and one per nation without a directory."""
    d = table(spark, sf_dir, "documents").select("source")
    # Backslashes are doubled, as Spark SQL reads escapes in string literals.
    return spark.sql(
        _RULES.replace("\\", "\\\\").replace("from documents", "from {documents}").replace("from nation", "from {nation}"),
        documents=d, nation=table(spark, sf_dir, "nation"),
    )


def watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the sources' files have been processed; every fourth source has no watermark."""
    d = table(spark, sf_dir, "documents")
    half = F.floor(F.max("doc_id") / 2).cast("bigint")
    return (
        d.where(F.expr(f"{_NUM} % 4 <> 0"))
        .groupBy(F.col("source").alias("component"))
        .agg(F.timestamp_seconds(F.lit(1704067200) + half * 60).alias("last_mtime"))
    )


WATERMARK = f"""watermark as (
  select source as component, (1704067200 + (max(doc_id) // 2) * 60) * 1000 as last_ms
  from documents where {_NUM} % 4 <> 0 group by source)"""


def checkpoint(spark: SparkSession, sf_dir: str, owners: DataFrame | None = None) -> DataFrame:
    """Saved positions: French files half read, German ones to the end, Spanish ones beyond it.

    ``owners`` are the :func:`owned` files, if the caller has them already.
    """
    owners = FL.dedupe_fingerprint(identified(spark, sf_dir)) if owners is None else owners
    owners = owners.where("lang <> 'en'")
    position = (
        F.when(F.col("lang") == "fr", F.floor(F.col("length") / 2))
        .when(F.col("lang") == "de", F.col("length"))
        .otherwise(F.col("length") + 100)
    )
    idle_hours = F.pmod(F.unix_seconds("mtime") / 60, F.lit(48)).cast("bigint")
    return owners.select(
        "component", "fingerprint", "path", position.cast("bigint").alias("position"),
        F.lit(0).alias("chunk_no"), "mtime",
        F.timestamp_millis(F.lit(AS_OF_MS) - idle_hours * 3_600_000).alias("last_accessed"),
    )


CHECKPOINT = f"""checkpoint as (
  select component, fingerprint, path,
    case lang when 'fr' then length // 2 when 'de' then length else length + 100 end as position,
    mtime_ms, {AS_OF_MS} - (((mtime_ms // 60000) % 48) * 3600000) as accessed_ms
  from owned where lang <> 'en')"""


# --- lines and records --------------------------------------------------------------------------


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as single blocks, with the start rule of their component."""
    own = rules(spark, sf_dir).where("component = dir").select("component", "start_regex")
    if own.count() <= 10_000:  # rules are short rows; beyond that the planner decides
        own = F.broadcast(own)
    return R.as_blocks(files(spark, sf_dir)).join(own, "component")


LINES = """split_lines as (
  select component, path, mtime_ms, length, unnest(l) as line, generate_subscripts(l, 1) - 1 as line_no
  from (select *, string_split(case when suffix(content, chr(10)) then left(content, length(content) - 1)
          else content end, chr(10)) as l from files)),
lines as (
  select *, cast(least(start_off + strlen(line) + 1, length) as bigint) as end_off
  from (select *, cast(coalesce(sum(strlen(line) + 1) over (partition by path order by line_no
          rows between unbounded preceding and 1 preceding), 0) as bigint) as start_off from split_lines))"""

# The default start rule, as in the settings.
FLAGGED = r"""flagged as (
  select l.*, regexp_matches(line, coalesce(start_regex, '^[\[(]?\d{4}-\d\d-\d\d|^\{')) as is_start
  from lines l join rules r on r.component = l.component and r.component = r.dir)"""

RECORDS = """records as (
  select component, path, min(start_off) as start_off, max(end_off) as end_off, count(*) as n_lines,
    string_agg(line, '' order by line_no) as message
  from (select *, sum(case when is_start or line_no = 0 then 1 else 0 end)
          over (partition by path order by line_no) as rec from flagged)
  group by component, path, rec)"""


# --- events -------------------------------------------------------------------------------------

# Severity of the event types, and every fifth line as plain text.
_RAW = """
  select concat('comp', user_id % 10) as component, concat('dev:', user_id) as device, event_id, ts, event_type, value,
    case when event_id % 5 = 0
      then concat({stamp}, 'Z [INFO] ', event_type, ' ', event_id)
      else concat('{{"Level":"', case event_type when 'error' then 'ERROR' when 'purchase' then 'WARN'
          when 'signup' then 'INFO' when 'click' then 'DEBUG' else 'TRACE' end,
        '","timestamp":', {millis}, ',"message":"', event_type, ' ', event_id, '"}}') end as raw
  from {events}"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines: JSON with the key ``Level``, or text with a leading timestamp."""
    return raw_lines(table(spark, sf_dir, "events"))


def raw_lines(events: DataFrame) -> DataFrame:
    """Rows of the events table as log lines; also for streams."""
    sql = _RAW.format(
        stamp="""date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")""",
        millis="unix_millis(cast(ts as timestamp))",
        events="{events}",
    ).replace("{\"Level", "{{\"Level").replace("\"}')", "\"}}')")
    return events.sparkSession.sql(sql, events=events)


RAW_EVENTS = "raw_events as (" + _RAW.format(
    stamp="strftime(ts, '%Y-%m-%dT%H:%M:%S.%g')", millis="epoch_us(ts) // 1000", events="events"
) + ")"


def event_rules(events: DataFrame) -> DataFrame:
    """Add the minimum level of the event's component."""
    n = "cast(substr(component, 5) as int)"
    return events.withColumn("min_level", F.expr(_LEVEL.format(n=n)))


PARSED = f"""parsed as (
  select *, starts_with(raw, '{{') as structured,
    case when starts_with(raw, '{{') then json_extract_string(raw, '$.Level') end as level,
    case when starts_with(raw, '{{') then cast(json_extract_string(raw, '$.timestamp') as bigint)
      else epoch_us(try_strptime(regexp_extract(raw, '[\\w\\-:.+]+'), '%Y-%m-%dT%H:%M:%S.%gZ')) // 1000 end as found_ms,
    {_LEVEL.format(n='cast(substr(component, 5) as int)')} as min_level
  from raw_events),
stamped as (select *, coalesce(found_ms, {AS_OF_MS}) as ts_ms from parsed)"""

_RANK = "case {c} when 'TRACE' then 0 when 'DEBUG' then 1 when 'INFO' then 2 when 'WARN' then 3 when 'ERROR' then 4 end"

ROUTED = f"""events_at as (
  select *, cast(strlen(raw) + 34 as bigint) as cost, '/logs/user/local/' || component as log_group,
    '/' || strftime(make_timestamp(ts_ms * 1000), '%Y/%m/%d') || '/thing/' || replace(device, ':', '+') as log_stream
  from stamped),
routed as (
  select * from events_at
  where (not structured or {_RANK.format(c='level')} >= 2) and ts_ms >= {AS_OF_MS} - 14 * 86400000)"""


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All log lines parsed and timestamped."""
    df = E.parse_structured(raw_events(spark, sf_dir), "raw")
    return E.resolve_event_ts(df, F.timestamp_millis(F.lit(AS_OF_MS)), "raw")


def events_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All log lines as routed events, none dropped."""
    df = stamped(spark, sf_dir).withColumnRenamed("raw", "message")
    df = E.route(df, SETTINGS, F.lit("user"), F.col("device"))
    return E.split_oversize(df, SETTINGS.max_event_bytes)


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of level INFO and above of the last 14 days, as events."""
    df = raw_events(spark, sf_dir).drop("ts").withColumnRenamed("raw", "message")
    return E.to_events(df, SETTINGS, F.lit("user"), F.col("device"), F.lit("INFO"))


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with a place in a file: one file per device, lines in the order of event_id."""
    df = settle(events_at(spark, sf_dir)).withColumn("fingerprint", F.col("device")).withColumn("_part", F.floor(F.col("event_id") / 10000))
    df = running(
        df, ["component", "fingerprint"], [F.col("event_id")], {"end_off": ("sum", F.col("size") + 1)}, [["_part"]]
    )
    return df.withColumn("start_off", F.col("end_off") - F.col("size") - 1)


FILE_EVENTS = """file_events as (
  select *, device as fingerprint, end_off - strlen(raw) - 1 as start_off
  from (select *, cast(sum(strlen(raw) + 1) over (partition by component, device order by event_id) as bigint) as end_off
        from events_at))"""
