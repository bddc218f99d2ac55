"""Queries on saved state and on retention."""

from __future__ import annotations


from pyspark.sql import functions as F

from logferry.operators import checkpoint as C
from logferry.operators import files as FL
from logferry.operators import retention as RT
from logferry.plans import views as V
from logferry.plans.registry import query
from logferry.plans.views import millis, with_sql

_NOW = V.AS_OF_MS
_STATE = (V.FILES, V.PRINTS, V.OWNED, V.CHECKPOINT)


def _now():
    return F.timestamp_millis(F.lit(_NOW))


def progress(reads):
    """What is left of a file goes to four streams, a quarter of the bytes each."""
    quarter = F.explode_outer(F.sequence(F.lit(0), F.lit(3))).alias("i")
    df = reads.select("component", "fingerprint", "position", "length", "lang", quarter)
    return df.select(
        "component", "fingerprint",
        (F.col("position") + F.floor((F.col("length") - F.col("position")) * F.col("i") / 4)).alias("start_off"),
        F.col("i").alias("first_chunk"),
        F.col("component").alias("log_group"),
        F.concat("lang", F.lit("/"), F.col("i")).alias("log_stream"),
        F.lit(1).cast("bigint").alias("batch_no"),
    )


def delivery(parts):
    """Some streams of some components were not delivered."""
    streams = parts.select("log_group", "log_stream", "batch_no").distinct()
    n = F.substring("log_group", 4, 10).cast("int") + F.expr("right(log_stream, 1)").cast("int")
    return streams.withColumn("delivered", n % 5 != 0)


def state(spark, sf_dir):
    """The checkpoint before a cycle, and the new position of each file the cycle has read."""
    owned = V.owned(spark, sf_dir)
    saved = V.checkpoint(spark, sf_dir, owned)
    reads = FL.skip_consumed(FL.resume_positions(owned, saved)).withColumn("read_end", F.col("length"))
    reads = V.settle(reads)
    parts = progress(reads)
    return saved, C.delivered_positions(parts, delivery(parts), reads)


def positions(spark, sf_dir):
    return state(spark, sf_dir)[1]


_POSITIONS = """reads as (
  select o.*, coalesce(c.position, 0) as position from owned o left join checkpoint c using (component, fingerprint)
  where coalesce(c.position, 0) < o.length),
progress as (
  select component, fingerprint, lang, i, position + (length - position) * i // 4 as start_off
  from reads, (select unnest([0, 1, 2, 3]) as i)),
stops as (
  select component, fingerprint, min(start_off * 10 + i) as stop from progress
  where (cast(substr(component, 4) as int) + i) % 5 = 0 group by 1, 2),
positions as (
  select r.* exclude (position), coalesce(stop // 10, length) as position, coalesce(stop % 10, 0) as chunk_no
  from reads r left join stops using (component, fingerprint))"""


@query("read_so_far", with_sql(*_STATE, _POSITIONS, """
ranges as (
  select component, fingerprint, length, unnest(range(0, (length - position + 199) // 200)) as k from reads),
gaps as (
  select component, fingerprint, min(k) as gap from ranges where (length + k) % 11 = 4 or (length + k) % 13 = 5 group by 1, 2)""",
    final="""
  select component, fingerprint, cast(position as bigint) as position, gap is not null as unread,
    cast(case when gap is null then length else position + gap * 200 end as bigint) as read_end
  from reads left join gaps using (component, fingerprint)"""))
def read_so_far(spark, sf_dir):
    """Files read in ranges of 200 bytes, of which some could not be read and some sent no receipt."""
    owned = V.owned(spark, sf_dir)
    reads = FL.skip_consumed(FL.resume_positions(owned, V.checkpoint(spark, sf_dir, owned)))
    reads = V.settle(reads.withColumn("read_end", F.col("length")))
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("read_end") - 1 - F.col("position")) / 200)))
    ranges = reads.select("component", "fingerprint", "position", "length", number.alias("block_no"))
    key = F.col("length") + F.col("block_no")
    end = F.least(F.col("position") + (F.col("block_no") + 1) * 200, F.col("length"))
    receipts = ranges.withColumn("read_to", F.when(key % 11 != 4, end)).where(key % 13 != 5)
    return C.read_so_far(reads, receipts, 200).select("component", "fingerprint", "position", "unread", "read_end")


@query("advance_checkpoint", with_sql(*_STATE, _POSITIONS, final=f"""
  select component, fingerprint, path, position, chunk_no, accessed_ms from (
    select component, fingerprint, path, cast(position as bigint) as position, cast(chunk_no as int) as chunk_no,
      {_NOW} as accessed_ms, not is_active and position = length as done from positions
    union all
    select component, fingerprint, path, position, 0, accessed_ms, false from checkpoint
      anti join positions using (component, fingerprint))
  where not done"""))
def advance_checkpoint(spark, sf_dir):
    df = C.advance_checkpoint(*state(spark, sf_dir), _now())
    return df.select("component", "fingerprint", "path", "position", "chunk_no", millis("last_accessed", "accessed_ms"))


@query("completed_files", with_sql(*_STATE, _POSITIONS, final="""
  select component, path, length from positions where not is_active and position = length"""))
def completed_files(spark, sf_dir):
    return C.completed_files(positions(spark, sf_dir)).select("component", "path", "length")


@query("advance_watermark", with_sql(*_STATE, _POSITIONS, V.WATERMARK, final="""
  select component, max(last_ms) as last_mtime_ms from (
    select component, last_ms from watermark union all
    select component, mtime_ms from positions where not is_active and position = length) group by component"""))
def advance_watermark(spark, sf_dir):
    completed = C.completed_files(positions(spark, sf_dir))
    return C.advance_watermark(V.watermark(spark, sf_dir), completed).select("component", millis("last_mtime"))


@query("evict_stale", with_sql(*_STATE, final=f"""
  select component, fingerprint, position from checkpoint where accessed_ms >= {_NOW} - 86400000"""))
def evict_stale(spark, sf_dir):
    return C.evict_stale(V.checkpoint(spark, sf_dir), _now()).select("component", "fingerprint", "position")


@query("touch_accessed", with_sql(*_STATE, V.WATERMARK, final=f"""
  select c.component, c.fingerprint, case when o.mtime_ms > coalesce(last_ms, 0) then {_NOW} else accessed_ms end as accessed_ms
  from checkpoint c join owned o using (component, fingerprint) left join watermark w on w.component = c.component"""))
def touch_accessed(spark, sf_dir):
    """Files after the watermark are looked up."""
    owned = V.owned(spark, sf_dir)
    looked_up = FL.unprocessed_files(owned, V.watermark(spark, sf_dir))
    return C.touch_accessed(V.checkpoint(spark, sf_dir, owned), looked_up, _now()).select(
        "component", "fingerprint", millis("last_accessed", "accessed_ms")
    )


@query("most_recent_entry", with_sql(*_STATE, final="""
  select component, fingerprint, path, position, accessed_ms from checkpoint
  qualify row_number() over (partition by component order by accessed_ms desc, fingerprint desc) = 1"""))
def most_recent_entry(spark, sf_dir):
    return C.most_recent_entry(V.checkpoint(spark, sf_dir)).select(
        "component", "fingerprint", "path", "position", millis("last_accessed", "accessed_ms")
    )


def entries_of(owned):
    """English and French files, read to their end now."""
    return owned.where("lang in ('en', 'fr')").select(
        "component", "fingerprint", "path", F.col("length").alias("position"), F.lit(0).alias("chunk_no"), "mtime",
        _now().alias("last_accessed"),
    )


_PUT = "put as (select component, fingerprint, path, length as position from owned where lang in ('en', 'fr'))"


@query("upsert_entries", with_sql(*_STATE, _PUT, final="""
  select component, fingerprint, position from put union all
  select component, fingerprint, position from checkpoint anti join put using (component, fingerprint)"""))
def upsert_entries(spark, sf_dir):
    owned = V.owned(spark, sf_dir)
    return C.upsert_entries(V.checkpoint(spark, sf_dir, owned), entries_of(owned)).select("component", "fingerprint", "position")


@query("put_if_absent", with_sql(*_STATE, _PUT, final="""
  select component, fingerprint, position from checkpoint union all
  select component, fingerprint, position from put anti join checkpoint using (component, fingerprint)"""))
def put_if_absent(spark, sf_dir):
    owned = V.owned(spark, sf_dir)
    return C.put_if_absent(V.checkpoint(spark, sf_dir, owned), entries_of(owned)).select("component", "fingerprint", "position")


@query("remove_entries", with_sql(*_STATE, _PUT, final="""
  select component, fingerprint, position from checkpoint anti join put using (component, fingerprint)"""))
def remove_entries(spark, sf_dir):
    owned = V.owned(spark, sf_dir)
    return C.remove_entries(V.checkpoint(spark, sf_dir, owned), entries_of(owned)).select("component", "fingerprint", "position")


@query("export_entries", with_sql(*_STATE, final="""
  select component, fingerprint, 'path' as field, path as value from checkpoint union all
  select component, fingerprint, 'position', cast(position as varchar) from checkpoint union all
  select component, fingerprint, 'chunk_no', '0' from checkpoint"""))
def export_entries(spark, sf_dir):
    return C.export_entries(V.checkpoint(spark, sf_dir).drop("mtime", "last_accessed"))


@query("restore_state", with_sql(*_STATE, V.WATERMARK, final="""
  select component, fingerprint, position from checkpoint left join watermark using (component)
  where last_ms is null or mtime_ms > last_ms"""))
def restore_state(spark, sf_dir):
    return C.restore_state(V.checkpoint(spark, sf_dir), V.watermark(spark, sf_dir)).select("component", "fingerprint", "position")


@query("import_legacy_state", with_sql(*_STATE, """
legacy as (select component, max(path) as path, cast(10 as bigint) as position from files group by component)""", final="""
  select component, fingerprint, path, position from checkpoint union all
  select l.component, i.fingerprint, l.path, l.position from legacy l
    join identified i on i.component = l.component and i.path = l.path
    anti join checkpoint c on c.component = l.component and c.fingerprint = i.fingerprint"""))
def import_legacy_state(spark, sf_dir):
    """One old entry per component: a path and a position, without a fingerprint."""
    identified = V.settle(V.identified(spark, sf_dir))
    legacy = V.files(spark, sf_dir).groupBy("component").agg(F.max("path").alias("path")).select(
        "component", "path", F.lit(10).cast("bigint").alias("position"), F.lit(None).cast("string").alias("fingerprint")
    )
    saved = V.checkpoint(spark, sf_dir, FL.dedupe_fingerprint(identified))
    return C.import_legacy_state(saved, legacy, identified).select(
        "component", "fingerprint", "path", "position"
    )


def _snapshots(spark, sf_dir):
    """State documents of the customers before and after: some fields change, move or vanish."""
    c = V.table(spark, sf_dir, "customer")
    nation, poor = F.col("c_nationkey").cast("string"), F.col("c_acctbal") < 0
    old = F.concat(
        F.lit('{"Name":"'), F.col("c_name"), F.lit('","seg":{"id":"'), "c_mktsegment", F.lit('","Nation":'), nation,
        F.lit(',"deep":{"k":'), F.col("c_custkey").cast("string"), F.lit("}}}"),
    )
    new = F.when(poor, F.concat(F.lit('{"name":"'), F.col("c_name"), F.lit('","seg":"none"}'))).otherwise(
        F.concat(
            F.lit('{"name":"'), F.col("c_name"), F.lit('","SEG":{"id":"'), F.lower("c_mktsegment"), F.lit('","nation":'),
            nation, F.lit(',"rank":null}}'),
        )
    )
    return (
        C.flatten_json(c.select("c_custkey", old.alias("doc")), ["c_custkey"], "doc"),
        C.flatten_json(c.select("c_custkey", new.alias("doc")), ["c_custkey"], "doc"),
    )


@query("snapshot_diff", """
with leaves as (
  select c_custkey, unnest(case when c_acctbal < 0
    then [{'path': 'seg/id', 'o': c_mktsegment, 'n': null, 'change': 'delete'},
          {'path': 'seg/nation', 'o': cast(c_nationkey as varchar), 'n': null, 'change': 'delete'},
          {'path': 'seg/deep/k', 'o': cast(c_custkey as varchar), 'n': null, 'change': 'delete'},
          {'path': 'seg', 'o': null, 'n': 'none', 'change': 'insert'}]
    else [{'path': 'seg/id', 'o': c_mktsegment, 'n': lower(c_mktsegment), 'change': 'update'},
          {'path': 'seg/deep/k', 'o': cast(c_custkey as varchar), 'n': null, 'change': 'delete'},
          {'path': 'seg/rank', 'o': null, 'n': null, 'change': 'insert'}] end) as x
  from customer)
select c_custkey, x.path as path, x.o as old_value, x.n as new_value, x.change as change from leaves""")
def snapshot_diff(spark, sf_dir):
    return C.snapshot_diff(*_snapshots(spark, sf_dir), ["c_custkey"])


@query("purge_removed", with_sql(*_STATE, V.RULES, final="""
  select component, fingerprint, position from checkpoint
  semi join (select * from rules where coalesce(max_bytes, 0) <= 80000) r using (component)"""))
def purge_removed(spark, sf_dir):
    """Components with a large limit lose their rule."""
    kept = V.rules(spark, sf_dir).where("coalesce(max_bytes, 0) <= 80000")
    return C.purge_removed(V.checkpoint(spark, sf_dir), kept).select("component", "fingerprint", "position")


# --- retention ----------------------------------------------------------------------------------

_PLAN = """candidates as (
  select o.*, sum(length) over (partition by component) as total from owned o),
deletable as (
  select c.component, path, length, total - r.max_bytes as need,
    coalesce(sum(length) over (partition by c.component order by mtime_ms, path rows between unbounded preceding and 1 preceding), 0) as freed
  from candidates c join rules r on r.component = c.component and r.max_bytes is not null
    join watermark w on w.component = c.component
  where mtime_ms <= last_ms and not is_active),
plan as (select component, path, length from deletable where freed < need)"""

_RETAIN = (V.FILES, V.PRINTS, V.OWNED, V.WATERMARK, V.RULES, _PLAN)


@query("component_usage", with_sql(V.FILES, V.PRINTS, V.OWNED, final="""
  select component, count(*) as n_files, cast(sum(length) as bigint) as n_bytes from owned group by component"""))
def component_usage(spark, sf_dir):
    return RT.component_usage(V.owned(spark, sf_dir))


def plan(spark, sf_dir, owned):
    return RT.retention_plan(owned, V.watermark(spark, sf_dir), V.rules(spark, sf_dir))


@query("retention_plan", with_sql(*_RETAIN, final="select component, path, length from plan"))
def retention_plan(spark, sf_dir):
    return plan(spark, sf_dir, V.owned(spark, sf_dir)).select("component", "path", "length")


@query("delete_after_delivery", with_sql(*_STATE, _POSITIONS, V.RULES, final="""
  select component, path from positions left join (select component, delete_after from rules
      where component_type = 'user') r using (component)
  where not is_active and position = length and coalesce(delete_after, true)"""))
def delete_after_delivery(spark, sf_dir):
    """System components have no rule here."""
    completed = C.completed_files(positions(spark, sf_dir))
    user = V.rules(spark, sf_dir).where("component_type = 'user'")
    return RT.delete_after_delivery(completed, user).select("component", "path")


@query("apply_retention", with_sql(*_RETAIN, final="""
  select component, path, length from owned anti join plan using (component, path)"""))
def apply_retention(spark, sf_dir):
    owned = V.owned(spark, sf_dir)
    return RT.apply_retention(owned, plan(spark, sf_dir, owned)).select("component", "path", "length")
