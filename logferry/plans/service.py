"""From rule documents to running cycles, and taking over the state of an earlier collector."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logferry.operators import checkpoint as C
from logferry.operators import files as FL
from logferry.operators import rules as RU
from logferry.plans.cycle import SCHEMAS, Sink, Store, table_sink
from logferry.settings import Settings
from logferry.sources.logfiles import inspect_files, list_directories
from logferry.sources.scratch import settle
from logferry.streaming.collect import run_periodically

RULES = ["component", "component_type", "dir", "file_regex", "start_regex", "min_level", "max_bytes", "delete_after"]
STATE = "component string, fingerprint string, path string, position bigint, mtime timestamp, last_accessed timestamp"


def rules_of(documents: DataFrame, loggers: DataFrame, root_dir: str, root_file: str, column: str = "config") -> DataFrame:
    """The rules that the cycle reads, from rule documents (JSON text) of one host: all shapes merged, defaults
    filled in, sizes in bytes, the system rule only if it is switched on."""
    named = RU.normalize_rules(documents.select(F.lit(0).alias("_host"), column), ["_host"], column)
    return RU.default_rules(named, loggers, root_dir, root_file).select(*RULES)


def take_over(
    spark: SparkSession, store: Store, rules: DataFrame, settings: Settings, saved: DataFrame | None = None,
    watermark: DataFrame | None = None, legacy: DataFrame | None = None,
) -> int:
    """Give an empty store the state of an earlier collector, as the epoch before its first cycle.

    ``saved`` (component, fingerprint, path, position, mtime, last_accessed) counts as far as it is newer than
    ``watermark`` (component, last_mtime). ``legacy`` has the same columns, but its fingerprint may be NULL and is
    then taken from the file at its path. Components without a rule are left out. A store that has run already
    is left as it is.
    """
    last = store.last_epoch()
    if last >= 0:
        return last
    none = spark.createDataFrame([], STATE)
    watermark = spark.createDataFrame([], SCHEMAS["watermark"]) if watermark is None else watermark
    state = C.restore_state(none if saved is None else saved, watermark)
    if legacy is not None:
        listing = settle(list_directories(rules)).where("path is not null")
        seen = inspect_files(FL.match_rules(listing, rules)).withColumn("fingerprint", FL.fingerprint(F.col("head")))
        state = C.import_legacy_state(state, legacy, FL.eligible_files(seen))
    state = C.purge_removed(state, rules).withColumn("chunk_no", F.lit(0))
    columns = [c.split()[0] for c in SCHEMAS["checkpoint"].split(", ")]
    store.write(state.select(*columns), "checkpoint", 0)
    store.write(C.purge_removed(watermark, rules).select("component", "last_mtime"), "watermark", 0)
    for name in ("ledger", "sequence", "catalog"):
        store.write(spark.createDataFrame([], SCHEMAS[name]), name, 0)
    store.append("cycles", (0, settings.as_of_ms), "epoch bigint, as_of_ms bigint")
    return 0


def run_service(
    spark: SparkSession, documents: Callable[[], DataFrame], loggers: DataFrame, root_dir: str, root_file: str,
    settings: Callable[[], Settings], store: Store, interval_sec: float | None, checkpoint_dir: str, sink: Sink = table_sink,
    delete: bool = False,
) -> StreamingQuery:
    """Cycles at the interval that is asked for, or at the default one if it isn't positive. The documents are
    read anew for each cycle: rules may come and go, and the state of a rule that went is purged with it."""
    asked = spark.createDataFrame([(interval_sec,)], "s double").select(*RU.validate_interval(F.col("s"), F.lit(None).cast("bigint")))
    return run_periodically(
        spark, lambda: rules_of(documents(), loggers, root_dir, root_file), settings, store, asked.first().interval_sec,
        checkpoint_dir, sink=sink, delete=delete,
    )
