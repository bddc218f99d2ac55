"""One collection cycle: from rules and files to delivered batches and the next saved state.

Everything that later steps must agree on is written to the store first (the files as they were
found, the events, the batches), so a lost executor repeats a step and not a different step, and no
text is parsed twice. The state of a cycle counts only once its row in ``cycles`` is written, which
happens last. A cycle that fails is simply run again. Before anything is handed to the sink, a row in
``intents`` says that the batches of this epoch are settled; a cycle that finds it goes on with these
batches, whatever has become of the files since, so that a sink may be called again but always with
the same content under the same (epoch, stream, batch). A second row says that the outcome is known,
and then the sink isn't called again. The ledger keeps what earlier epochs have delivered from being
delivered twice.

Every range of a file that was to be read leaves a receipt. Positions move only as far as receipts
follow each other without a gap, and what was read behind a gap is neither sent nor counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logferry.functions import text as T
from logferry.operators import checkpoint as C
from logferry.operators import delivery as D
from logferry.operators import events as E
from logferry.operators import files as FL
from logferry.operators import packing as P
from logferry.operators import records as R
from logferry.operators import retention as RT
from logferry.settings import Settings
from logferry.sources.logfiles import inspect_files, list_directories, read_blocks

SCHEMAS = {
    "checkpoint": "component string, fingerprint string, path string, position bigint, chunk_no int, mtime timestamp, "
    "last_accessed timestamp",
    "watermark": "component string, last_mtime timestamp",
    "ledger": "component string, fingerprint string, log_stream string, start_off bigint, chunk_no int",
    "sequence": "log_group string, log_stream string, batch_no bigint, seq bigint",
    "catalog": "log_group string, log_stream string",
}
PLANNED, DELIVERED = "planned", "delivered"

# What reading and parsing need of a component's rule.
RULE_COLUMNS = ["component_type", "start_regex", "min_level"]

# Gets the events of all batches and the epoch. It returns a row per batch (log_group, log_stream, batch_no,
# delivered) or a row per try (try_no and outcome, see the operators of delivery), perhaps with ``fatal``; or a
# pair of that and the events that were refused inside accepted batches (with cost and reason).
Sink = Callable[[DataFrame, int], DataFrame | tuple[DataFrame, DataFrame]]
# Gets the groups and streams that have to be made before the sink is called (kind, log_group, log_stream).
Targets = Callable[[DataFrame, int], None]


class Store:
    """Tables of the cycles under one root that all executors can reach, a folder per epoch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str, epoch: int) -> str:
        return f"{self.root}/{name}/epoch={epoch}"

    def write(self, df: DataFrame, name: str, epoch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name, epoch))
        return self.read(name, epoch)

    def read(self, name: str, epoch: int) -> DataFrame:
        if epoch < 0:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.parquet(self.path(name, epoch))

    def rows(self, name: str) -> DataFrame | None:
        """A table that grows row by row; None before its first row."""
        try:
            return self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def append(self, name: str, row: tuple, schema: str) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def last_epoch(self) -> int:
        cycles = self.rows("cycles")
        last = None if cycles is None else cycles.agg(F.max("epoch")).first()[0]
        return -1 if last is None else last

    def phases(self, epoch: int) -> set[str]:
        """What an earlier run of this epoch has settled."""
        intents = self.rows("intents")
        return set() if intents is None else {r.phase for r in intents.where(F.col("epoch") == epoch).collect()}

    def settled(self, epoch: int, phase: str, as_of_ms: int) -> None:
        self.append("intents", (epoch, phase, as_of_ms), "epoch bigint, phase string, as_of_ms bigint")


def table_sink(events: DataFrame, epoch: int) -> DataFrame:
    """The batches in the store are the delivery; all of them arrive."""
    return events.select(*D.BATCH_KEYS).distinct().withColumn("delivered", F.lit(True))


def find_files(listing: DataFrame, rules: DataFrame) -> DataFrame:
    """Files selected by the rules, with fingerprint, one owner each, and ``is_active``."""
    selected = FL.match_rules(listing.where("path is not null"), rules)
    seen = inspect_files(selected).withColumn("fingerprint", FL.fingerprint(F.col("head"))).drop("head")
    return FL.active_file(FL.dedupe_fingerprint(FL.eligible_files(seen)).drop("n_copies"))


def read_pieces(work: DataFrame, rules: DataFrame, settings: Settings) -> DataFrame:
    """Records of the files to be read, range by range; those at the borders are pieces.

    What the rules say travels with the work rows, so text meets no join. Each range has at least one
    row, which carries its receipt; a range without records has a row without offsets.
    """
    # One number decides how many tasks read; the work itself stays distributed.
    n_bytes = work.agg(F.sum(F.col("read_end") - F.col("position"))).first()[0] or 0
    least = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, -(-n_bytes // settings.task_bytes))
    work = work.join(rules.select("component", *RULE_COLUMNS), "component")
    keep = ["component", "fingerprint", "path", "mtime", "is_active", "position", "chunk_no", *RULE_COLUMNS]
    blocks = read_blocks(work, keep, settings.range_bytes, tasks)
    return R.reassemble_records(
        blocks, F.col("start_regex"), joiner=settings.joiner, keep=[*keep, "read_to"], empty_blocks=True
    )


def judged(records: DataFrame, settings: Settings) -> DataFrame:
    """Parsed, timestamped and routed records, with the reason why one is ``dropped``."""
    moment = F.timestamp_millis(F.lit(settings.as_of_ms))
    text = F.col("message")
    head = T.decode_utf8(F.substring(text.cast("binary"), 1, settings.head_bytes))
    df = records.withColumn("_seen", F.when(F.octet_length(text) <= settings.whole_bytes, text).otherwise(head))
    df = E.parse_structured(df, "_seen")
    df = E.resolve_event_ts(df, moment, "_seen").drop("_seen")
    low = F.col("structured") & (T.level_rank(F.col("level")) < T.level_rank(F.col("min_level")))
    old = F.col("ts") < moment - F.lit(settings.max_event_age)
    df = df.withColumn("dropped", F.when(low, "below_level").when(old, "expired"))
    return E.route(df, settings, F.col("component_type"), F.lit(settings.device))


def _unsent(events: DataFrame) -> DataFrame:
    """Without the chunks of a record that was delivered in part by an earlier cycle."""
    seen = (F.col("start_off") == F.col("position")) & (F.col("chunk_no") < F.col("resume_chunk"))
    return events.where(~seen).drop("json_ts_ms", *RULE_COLUMNS)


def mark_events(records: DataFrame, settings: Settings) -> DataFrame:
    """Records as events. Dropped records stay as empty rows with the reason, for their positions."""
    df = judged(records, settings)
    df = df.withColumn("message", F.when(F.col("dropped").isNull(), F.col("message")).otherwise(F.lit("")))
    return _unsent(E.split_oversize(df, settings.max_event_bytes))


def mark_long_events(headers: DataFrame, chunks: DataFrame, settings: Settings) -> DataFrame:
    """The same for records of which there is a head and chunks; they meet chunk by chunk."""
    cap = settings.max_event_bytes
    df = judged(headers, settings).drop("message")
    kept = F.col("dropped").isNull()
    last = F.when(kept, F.ceil(F.col("record_bytes") / cap) - 1).otherwise(0).cast("int")
    df = df.withColumn("chunk_no", F.explode_outer(F.sequence(F.lit(0), last)))
    df = df.join(chunks, ["component", "path", "start_off", "chunk_no"], "left")
    text = F.when(kept, F.col("message")).otherwise(F.lit(""))
    size = F.when(kept, F.least(F.lit(cap), F.col("record_bytes") - F.col("chunk_no").cast("bigint") * cap)).otherwise(0).cast("bigint")
    df = df.withColumns({"message": text, "size": size, "cost": T.event_cost(size), "emit": T.is_emitted(text)})
    return _unsent(df.drop("record_bytes"))


def to_events(pieces: DataFrame, settings: Settings, store: Store, epoch: int) -> DataFrame:
    """Events of the written pieces; records of any size."""
    keys, limits = ["component", "path"], (settings.whole_bytes, settings.head_bytes)
    places = store.write(R.border_places(pieces, keys, settings.joiner), "places", epoch)
    marked = mark_events(R.stitch_records(pieces, keys, settings.joiner, places, settings.whole_bytes), settings)
    if places.where(F.col("record_bytes") > settings.whole_bytes).isEmpty():
        return marked
    headers = R.long_records(pieces, places, *limits, keys, settings.joiner)
    chunks = R.record_chunks(pieces, places, settings.whole_bytes, settings.max_event_bytes, keys, settings.joiner)
    return marked.unionByName(mark_long_events(headers, chunks, settings))


def open_ends(marked: DataFrame, reads: DataFrame, hold_last_record: bool) -> DataFrame:
    """(component, fingerprint, _cut): events of the file count only up to there.

    A file with unread ranges ends before the record that was open at the first of them, and with
    ``hold_last_record`` an active file before its last one.
    """
    held = F.col("unread") | (F.col("is_active") & F.lit(hold_last_record))
    ends = reads.where(held).select(*C.ENTRY, "read_end", "unread")
    inside = marked.select(*C.ENTRY, "start_off").join(ends, C.ENTRY).where("start_off < read_end")
    last = inside.groupBy(*C.ENTRY).agg(F.max("start_off").alias("_last"))
    cut = ends.join(last, C.ENTRY, "left").select(*C.ENTRY, F.coalesce("_last", F.when(F.col("unread"), F.col("read_end"))).alias("_cut"))
    return cut.where("_cut is not null")


def plan_batches(
    resumed: DataFrame, ledger: DataFrame, rules: DataFrame, settings: Settings, store: Store, epoch: int
) -> None:
    """Read, parse and pack what is new, and write it: ``reads`` and ``batches`` of the epoch."""
    # 2. Text to events, read once: the border pieces are joined from the written table.
    held = F.col("is_active") & F.lit(settings.hold_last_line)
    read_end = F.when(held, F.col("complete_end")).otherwise(F.col("length"))
    reads = FL.skip_consumed(resumed).withColumn("read_end", F.greatest(read_end, F.col("position")))
    pieces = store.write(read_pieces(reads, rules, settings).withColumnRenamed("chunk_no", "resume_chunk"), "pieces", epoch)
    reads = C.read_so_far(reads, pieces.select(*C.ENTRY, "block_no", "read_to"), settings.range_bytes)
    marked = store.write(to_events(pieces.where("start_off is not null").drop("read_to"), settings, store, epoch), "events", epoch)
    # Written, so that the planner knows how small it is, and text need not be dealt out for it.
    cuts = store.write(open_ends(marked, reads, settings.hold_last_record), "cuts", epoch)
    if not cuts.isEmpty():
        marked = marked.join(cuts, C.ENTRY, "left").where("_cut is null or start_off < _cut").drop("_cut")
        reads = reads.join(cuts, C.ENTRY, "left").withColumn("read_end", F.coalesce("_cut", "read_end")).drop("_cut")
    store.write(reads, "reads", epoch)

    # 3. Batches of what the ledger does not list yet.
    high = ledger.select(
        "component", "fingerprint", "log_stream", F.struct("start_off", "chunk_no").alias("_high")
    )
    fresh = (
        marked.where("dropped is null")
        .join(high, ["component", "fingerprint", "log_stream"], "left")
        .where(F.col("_high").isNull() | (F.struct("start_off", "chunk_no") > F.col("_high")))
        .drop("_high", "dropped")
        .withColumn("_hour", F.date_trunc("hour", "mtime"))
    )
    batched = P.pack_batches(
        fresh, blocks=[["_hour"], ["_hour", "mtime", "path"], ["_hour", "mtime", "path", "block_no"]],
        max_bytes=settings.max_batch_bytes, max_events=settings.max_batch_events, max_span=settings.max_batch_span,
        block_size=settings.pack_block,
    ).drop("_hour")
    # A stream batch is small; it lies in one task, in the order of time.
    batched = batched.repartition(*D.BATCH_KEYS).sortWithinPartitions(
        *D.BATCH_KEYS, "ts", "mtime", "path", "start_off", "chunk_no"
    )
    store.write(batched, "batches", epoch)


def deliver(batched: DataFrame, store: Store, epoch: int, last: int, sink: Sink, targets: Targets | None) -> None:
    """Hand the batches to the sink, and write what became of them: ``delivery``, ``rejected``, ``catalog``."""
    catalog = store.read("catalog", last)
    missing = store.write(D.missing_targets(batched, catalog), "targets", epoch)
    if targets is not None:
        targets(missing, epoch)
    result = sink(E.drop_blank_events(batched), epoch)
    outcome, rejected = result if isinstance(result, tuple) else (result, None)
    store.write(D.judged(P.batch_summary(batched), outcome), "delivery", epoch)
    if rejected is not None:
        store.write(D.rejected_events(rejected), "rejected", epoch)
    made = missing.where("kind = 'stream'").select("log_group", "log_stream")
    store.write(catalog.unionByName(made).distinct(), "catalog", epoch)


def run_cycle(
    spark: SparkSession, rules: DataFrame, settings: Settings, store: Store, epoch: int | None = None,
    sink: Sink = table_sink, delete: bool = False, targets: Targets | None = None,
) -> int:
    """Run one cycle and return its epoch. A cycle that is committed already is not run again; one that
    was broken off goes on from what it had settled."""
    last = store.last_epoch()
    epoch = last + 1 if epoch is None else epoch
    if epoch <= last:
        return epoch
    now = F.timestamp_millis(F.lit(settings.as_of_ms))
    rules = rules.withColumn("min_level", F.coalesce("min_level", F.lit("INFO")))
    checkpoint = C.purge_removed(store.read("checkpoint", last), rules)
    watermark = store.read("watermark", last)
    ledger = store.read("ledger", last)
    phases = store.phases(epoch)

    # 1. Files as they are now, or as they were when the batches were settled.
    if PLANNED not in phases:
        listing = store.write(list_directories(rules), "listing", epoch)
        store.write(FL.rule_diagnostics(rules, listing.where("path is not null"), listing), "diagnostics", epoch)
        store.write(find_files(listing, rules), "files", epoch)
    files = store.read("files", epoch)
    resumed = FL.resume_positions(FL.unprocessed_files(files, watermark), checkpoint)
    if PLANNED not in phases:
        plan_batches(resumed, ledger, rules, settings, store, epoch)
        store.settled(epoch, PLANNED, settings.as_of_ms)
    reads, batched = store.read("reads", epoch), store.read("batches", epoch)

    # 4. Delivery. A stream goes on only behind what has arrived.
    if DELIVERED not in phases:
        deliver(batched, store, epoch, last, sink, targets)
        store.settled(epoch, DELIVERED, settings.as_of_ms)
    delivery = store.read("delivery", epoch)
    ok = delivery.where("delivered")
    store.write(
        D.stream_sequence(ok.select(*D.BATCH_KEYS), store.read("sequence", last))
        .unionByName(store.read("sequence", last).groupBy("log_group", "log_stream").agg(
            F.lit(0).cast("bigint").alias("batch_no"), F.max("seq").alias("seq")))
        .groupBy("log_group", "log_stream").agg(F.max("batch_no").alias("batch_no"), F.max("seq").alias("seq")),
        "sequence", epoch,
    )
    arrived = batched.join(ok.select(*D.BATCH_KEYS), list(D.BATCH_KEYS), "left_semi")
    top = F.max(F.struct("start_off", "chunk_no")).alias("_top")
    keys = ["component", "fingerprint", "log_stream"]
    sent = arrived.groupBy(*keys).agg(top).select(*keys, "_top.start_off", "_top.chunk_no")
    merged = ledger.unionByName(sent).groupBy(*keys).agg(top).select(*keys, "_top.start_off", "_top.chunk_no")

    # 5. State.
    progress = batched.groupBy(*C.ENTRY, *D.BATCH_KEYS).agg(
        F.min(F.struct("start_off", "chunk_no")).alias("_first")
    ).select(*C.ENTRY, *D.BATCH_KEYS, "_first.start_off", F.col("_first.chunk_no").alias("first_chunk"))
    positions = C.delivered_positions(progress, delivery, reads.drop("unread"))
    finished = resumed.where("status = 'finished'")
    completed = C.completed_files(positions).select(*C.ENTRY, "path", "mtime", "length").unionByName(
        finished.select(*C.ENTRY, "path", "mtime", "length")
    )
    completed = store.write(completed, "completed", epoch)
    kept = C.remove_entries(C.touch_accessed(checkpoint, resumed, now), completed)
    kept = C.evict_stale(C.advance_checkpoint(kept, positions, now), now, settings.idle_limit)
    # The watermark stays below what is still to be delivered; completed files above it are remembered.
    pending = resumed.join(completed.select(*C.ENTRY), C.ENTRY, "left_anti")
    reached = store.write(C.advance_watermark(watermark, completed, pending), "watermark", epoch)
    above = FL.unprocessed_files(completed, reached).select(
        *C.ENTRY, "path", F.col("length").alias("position"), F.lit(0).alias("chunk_no"), "mtime", now.alias("last_accessed")
    )
    kept = store.write(kept.unionByName(above.dropDuplicates(C.ENTRY)), "checkpoint", epoch)
    # The ledger is needed only where a file has not been delivered to its end.
    store.write(merged.join(kept.select(*C.ENTRY), C.ENTRY, "left_semi"), "ledger", epoch)
    file = ["component", "path", "fingerprint", "length"]
    plan = RT.delete_after_delivery(completed, rules).select(*file).unionByName(
        RT.retention_plan(files, watermark, rules).select(*file)
    )
    plan = store.write(plan.distinct(), "retention", epoch)

    store.append("cycles", (epoch, settings.as_of_ms), "epoch bigint, as_of_ms bigint")
    if delete:
        RT.delete_files(plan)
    return epoch
