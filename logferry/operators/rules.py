"""Collection rules as data: reading rule documents, filling in defaults, checking values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logferry import settings as S

# Fields of one rule in a rule document, and the columns they become.
RULE_FIELDS = {
    "componentName": "component",
    "logFileRegex": "file_regex",
    "logFileDirectoryPath": "dir",
    "multiLineStartPattern": "start_regex",
    "minimumLogLevel": "min_level",
    "diskSpaceLimit": "limit_value",
    "diskSpaceLimitUnit": "limit_unit",
    "deleteLogFileAfterCloudUpload": "delete_after",
}


def to_boolean(value: Column) -> Column:
    """Lenient reading of a flag kept as text: only ``true`` counts as set."""
    return F.coalesce(F.lower(F.trim(value)) == "true", F.lit(False))


def _blank_to_null(value: Column) -> Column:
    return F.when(F.length(value) > 0, value)


def _fields(rule: Column) -> list[Column]:
    return [F.try_element_at(rule, F.lit(k)).alias(c) for k, c in RULE_FIELDS.items()]


def normalize_rules(
    documents: DataFrame,
    keys: list[str],
    column: str = "config",
    system_name: str = "System",
    upload_flag: str = "upload",
) -> DataFrame:
    """One row per rule from rule documents (JSON text), keyed by ``keys``.

    A document may name rules in three shapes: a map by component name, a list of rules that name
    their component, and one block for the host system. If a component occurs more than once, the
    later shape wins, and within the list the later entry.
    """
    flat = "map<string,string>"
    shapes = documents.select(
        *keys,
        F.from_json(
            column,
            f"struct<`{S.RULE_MAP_KEY}`: map<string,{flat}>, `{S.RULE_LIST_KEY}`: array<{flat}>, "
            f"`{S.SYSTEM_RULE_KEY}`: {flat}>",
        ).alias("doc"),
    )
    by_map = shapes.select(
        *keys, F.explode_outer(F.col(f"doc.{S.RULE_MAP_KEY}")).alias("name", "rule")
    ).where("rule is not null").select(
        *keys, F.lit(1).alias("shape"), F.lit(0).alias("nth"), F.lit("user").alias("component_type"),
        F.lit(None).cast("string").alias("upload"), F.col("name").alias("given_name"), *_fields(F.col("rule")),
    )
    by_list = shapes.select(
        *keys, F.posexplode_outer(F.col(f"doc.{S.RULE_LIST_KEY}")).alias("nth", "rule")
    ).where("rule is not null").select(
        *keys, F.lit(2).alias("shape"), "nth", F.lit("user").alias("component_type"),
        F.lit(None).cast("string").alias("upload"), F.lit(None).cast("string").alias("given_name"),
        *_fields(F.col("rule")),
    )
    system = shapes.select(*keys, F.col(f"doc.{S.SYSTEM_RULE_KEY}").alias("rule")).where("rule is not null").select(
        *keys, F.lit(3).alias("shape"), F.lit(0).alias("nth"), F.lit("system").alias("component_type"),
        F.try_element_at("rule", F.lit(upload_flag)).alias("upload"),
        F.lit(system_name).alias("given_name"), *_fields(F.col("rule")),
    )
    every = by_map.unionByName(by_list).unionByName(system_rule_switch(system)).drop("upload")
    every = every.withColumn("component", F.coalesce("given_name", "component")).drop("given_name")
    # The newest definition per name is an aggregate, so it is reduced before the shuffle.
    rest = [c for c in every.columns if c not in (*keys, "component")]
    return (
        every.groupBy(*keys, "component")
        .agg(F.max(F.struct("shape", "nth", *[c for c in rest if c not in ("shape", "nth")])).alias("r"))
        .select(*keys, "component", *[F.col(f"r.{c}").alias(c) for c in rest])
    )


def system_rule_switch(rules: DataFrame) -> DataFrame:
    """The system rule counts only if its upload flag is set; user rules always do."""
    return rules.where((F.col("component_type") != "system") | to_boolean(F.col("upload")))


def default_rules(rules: DataFrame, loggers: DataFrame, root_dir: str, root_file: str) -> DataFrame:
    """Fill in file pattern, directory, level, limit and delete flag of rules that leave them out.

    ``loggers`` (component, file_stem, dir) holds what is known about a component's own logger. The
    system rule always reads the root log.
    """
    known = loggers.select(
        "component", F.col("file_stem").alias("_stem"), F.col("dir").alias("_dir")
    )
    system = F.col("component_type") == "system"
    stem = F.when(system, F.lit(root_file)).otherwise(F.coalesce("_stem", "component"))
    # Quoting keeps a stem literal, even if it holds the end-of-quote mark itself.
    quoted = F.concat(F.lit("\\Q"), F.replace(stem, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    prefix, suffix = S.DEFAULT_FILE_REGEX.split("%s")
    default_regex = F.concat(F.lit(prefix), quoted, F.lit(suffix))
    given_regex, given_dir = _blank_to_null(F.col("file_regex")), _blank_to_null(F.col("dir"))
    level = _blank_to_null(F.col("min_level"))
    return (
        rules.join(known, "component", "left")
        .withColumn("file_regex", F.when(system, default_regex).otherwise(F.coalesce(given_regex, default_regex)))
        .withColumn(
            "dir", F.when(system, F.lit(root_dir)).otherwise(F.coalesce(given_dir, F.col("_dir"), F.lit(root_dir)))
        )
        .withColumn("start_regex", _blank_to_null(F.col("start_regex")))
        .withColumn("min_level", F.coalesce(level, F.lit(S.DEFAULT_MIN_LEVEL)))
        .withColumn("max_bytes", size_limit_bytes(F.col("limit_value"), F.col("limit_unit")))
        .withColumn("delete_after", to_boolean(F.col("delete_after")))
        .drop("_stem", "_dir", "limit_value", "limit_unit")
    )


def size_limit_bytes(value: Column, unit: Column) -> Column:
    """A size limit in bytes; a missing or unknown unit means KB, an empty value no limit."""
    factor = F.lit(S.SIZE_UNITS["KB"]).cast("bigint")
    for name in ("MB", "GB"):
        factor = F.when(unit == name, F.lit(S.SIZE_UNITS[name]).cast("bigint")).otherwise(factor)
    return _blank_to_null(value).try_cast("bigint") * factor


def validate_interval(seconds: Column, save_seconds: Column) -> list[Column]:
    """Upload interval (300 s unless positive) and save interval (never below the upload one)."""
    upload = F.when(seconds > 0, seconds).otherwise(F.lit(S.DEFAULT_INTERVAL_SEC))
    save = F.greatest(F.coalesce(save_seconds, F.lit(0)).cast("bigint"), F.floor(upload).cast("bigint"))
    return [upload.cast("double").alias("interval_sec"), save.alias("save_interval_sec")]
