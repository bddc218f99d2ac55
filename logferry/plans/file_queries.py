"""Queries on files: discovery, identity, order, state of reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from logferry.functions import text as T
from logferry.operators import files as FL
from logferry.operators import records as R
from logferry.plans import views as V
from logferry.plans.registry import query
from logferry.plans.views import millis, with_sql

_NAME = r"[13579]\d?\.log"


@query("discover_files", with_sql(V.FILES, final=rf"""
  select component, path, length, mtime_ms from files where regexp_matches(name, '{_NAME}')"""))
def discover_files(spark, sf_dir):
    found = FL.discover_files(V.files(spark, sf_dir).drop("content"), None, F.lit(_NAME))
    return found.select("component", "path", "length", millis("mtime"))


@query("match_rules", with_sql(V.FILES, V.RULES, final="""
  select r.component, f.path, f.length from files f join rules r on f.dir = r.dir and regexp_matches(f.name, r.file_regex)"""))
def match_rules(spark, sf_dir):
    files = V.files(spark, sf_dir).drop("content")
    return FL.match_rules(files, V.rules(spark, sf_dir)).select("component", "path", "length")


@query("fingerprint_files", with_sql(V.FILES, V.PRINTS, final="select component, path, fingerprint from prints"))
def fingerprint_files(spark, sf_dir):
    return V.files(spark, sf_dir).select("component", "path", FL.fingerprint(F.col("content")).alias("fingerprint"))


@query("eligible_files", with_sql(V.FILES, V.PRINTS, final="select component, path, length, fingerprint from identified"))
def eligible_files(spark, sf_dir):
    return V.identified(spark, sf_dir).select("component", "path", "length", "fingerprint")


@query("dedupe_fingerprint", with_sql(V.FILES, V.PRINTS, V.OWNED, final="""
  select component, fingerprint, path, mtime_ms, n_copies from owned"""))
def dedupe_fingerprint(spark, sf_dir):
    return FL.dedupe_fingerprint(V.identified(spark, sf_dir)).select(
        "component", "fingerprint", "path", millis("mtime"), "n_copies"
    )


@query("order_files", with_sql(V.FILES, V.PRINTS, final="""
  select component, path, row_number() over (partition by component order by mtime_ms, path) as file_no from identified"""))
def order_files(spark, sf_dir):
    return FL.order_files(V.identified(spark, sf_dir)).select("component", "path", "file_no")


@query("active_file", with_sql(V.FILES, V.PRINTS, final="""
  select component, path, fingerprint = first_value(fingerprint) over (partition by component
    order by mtime_ms desc, path desc) as is_active from identified"""))
def active_file(spark, sf_dir):
    return FL.active_file(V.identified(spark, sf_dir)).select("component", "path", "is_active")


@query("exclude_active", with_sql(V.FILES, V.PRINTS, final="""
  select component, path from identified
  qualify row_number() over (partition by component order by mtime_ms desc, path desc) > 1"""))
def exclude_active(spark, sf_dir):
    return FL.exclude_active(V.identified(spark, sf_dir)).select("component", "path")


@query("unprocessed_files", with_sql(V.FILES, V.PRINTS, V.WATERMARK, final="""
  select component, path, length from identified left join watermark using (component)
  where mtime_ms > coalesce(last_ms, 0)"""))
def unprocessed_files(spark, sf_dir):
    return FL.unprocessed_files(V.identified(spark, sf_dir), V.watermark(spark, sf_dir)).select("component", "path", "length")


@query("processed_files", with_sql(V.FILES, V.PRINTS, V.OWNED, V.WATERMARK, final="""
  select component, path, length from owned left join watermark using (component)
  where mtime_ms <= coalesce(last_ms, 0) and not is_active"""))
def processed_files(spark, sf_dir):
    return FL.processed_files(V.owned(spark, sf_dir), V.watermark(spark, sf_dir)).select("component", "path", "length")


_RESUMED = """resumed as (
  select o.*, coalesce(c.position, 0) as position,
    case when coalesce(c.position, 0) < o.length then 'read' when c.position > o.length then 'truncated'
      when is_active then 'idle' else 'finished' end as status
  from owned o left join checkpoint c on c.component = o.component and c.fingerprint = o.fingerprint)"""


@query("resume_positions", with_sql(V.FILES, V.PRINTS, V.OWNED, V.CHECKPOINT, _RESUMED, final="""
  select component, path, position, status from resumed"""))
def resume_positions(spark, sf_dir):
    owned = V.owned(spark, sf_dir)
    return FL.resume_positions(owned, V.checkpoint(spark, sf_dir, owned)).select(
        "component", "path", "position", "status"
    )


@query("skip_consumed", with_sql(V.FILES, V.PRINTS, V.OWNED, V.CHECKPOINT, _RESUMED, final="""
  select component, path, length - position as bytes_left from resumed where length > 0 and position < length"""))
def skip_consumed(spark, sf_dir):
    owned = V.owned(spark, sf_dir)
    files = FL.resume_positions(owned, V.checkpoint(spark, sf_dir, owned))
    return FL.skip_consumed(files).select("component", "path", (F.col("length") - F.col("position")).alias("bytes_left"))


@query("read_lines", with_sql(V.FILES, V.LINES, final="""
  select component, path, line_no, start_off, end_off, line from lines"""))
def read_lines(spark, sf_dir):
    return R.read_lines(R.as_blocks(V.files(spark, sf_dir))).drop("block_no")


@query("decode_utf8", """
with chars as (
  select doc_id, half, c, n, cast(sum(strlen(c)) over (partition by doc_id order by n) as bigint) - strlen(c) as b
  from (select doc_id, strlen(text) // 2 as half, unnest(string_split(text, '')) as c,
          generate_subscripts(string_split(text, ''), 1) as n from documents)),
parts as (
  select doc_id, n, 'head' as part, case when b + strlen(c) <= half then c else chr(65533) end as s
  from chars where b < half
  union all
  select doc_id, n, 'tail', case when b >= half then c else repeat(chr(65533), cast(b + strlen(c) - half as bigint)) end
  from chars where b + strlen(c) > half)
select doc_id, part, string_agg(s, '' order by n) as decoded from parts group by doc_id, part""")
def decode_utf8(spark, sf_dir):
    """Both halves of each document, cut at a byte that may lie within a character."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("bytes"))
    size = F.octet_length("bytes")
    half = F.floor(size / 2).cast("int")
    parts = F.array(
        F.struct(F.lit("head").alias("part"), F.substring("bytes", F.lit(1), half).alias("bytes")),
        F.struct(F.lit("tail").alias("part"), F.substring("bytes", half + 1, size).alias("bytes")),
    )
    halves = d.select("doc_id", F.inline(parts)).where(F.octet_length("bytes") > 0)
    return halves.select("doc_id", "part", T.decode_utf8(F.col("bytes")).alias("decoded"))


@query("rule_diagnostics", with_sql(V.FILES, V.RULES, final="""
  select r.component, r.dir, case when r.dir not in (select dir from files) then 'missing_dir'
      when count(f.path) = 0 then 'no_files' else 'ok' end as status,
    count(f.path) as n_files, cast(coalesce(sum(f.length), 0) as bigint) as n_bytes
  from rules r left join files f on f.dir = r.dir and regexp_matches(f.name, r.file_regex) group by r.component, r.dir"""))
def rule_diagnostics(spark, sf_dir):
    return FL.rule_diagnostics(V.rules(spark, sf_dir), V.files(spark, sf_dir).drop("content"))


@query("rotation_tracking", with_sql(V.FILES, V.PRINTS, V.OWNED, """
old as (select component, fingerprint, path, length from owned where lang <> 'es'),
cur as (select component, fingerprint, case lang when 'fr' then path || '.1' else path end as path,
          length + case when is_active then 50 else 0 end as length from owned where lang <> 'de')""", final="""
  select component, fingerprint, old.path as old_path, cur.path as new_path,
    case when cur.path is null then 'gone' when old.path is null then 'new' when old.path <> cur.path then 'renamed'
      when cur.length > old.length then 'grown' else 'same' end as change
  from old full join cur using (component, fingerprint)"""))
def rotation_tracking(spark, sf_dir):
    """German files vanish, Spanish ones appear, French ones are renamed, the active ones grow."""
    owned = V.owned(spark, sf_dir)
    after = (
        owned.where("lang <> 'de'")
        .withColumn("path", F.when(F.col("lang") == "fr", F.concat("path", F.lit(".1"))).otherwise(F.col("path")))
        .withColumn("length", F.col("length") + F.when(F.col("is_active"), 50).otherwise(0))
    )
    return FL.rotation_tracking(owned.where("lang <> 'es'"), after).select(
        "component", "fingerprint", "old_path", "new_path", "change"
    )
