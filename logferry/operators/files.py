"""Which files belong to which component, and from where each of them is to be read.

``files`` rows have: component, path, name, dir, mtime, length, and usually content or fingerprint.
Everything here works on the narrow metadata; content takes part in :func:`fingerprint` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logferry import settings as S
from logferry.operators.ordering import positions


def discover_files(files: DataFrame, directory: Column | None, regex: Column) -> DataFrame:
    """Files directly in ``directory`` (all directories if None) whose name contains a match."""
    wanted = F.regexp_like(F.col("name"), regex)
    return files.where(wanted if directory is None else (F.col("dir") == directory) & wanted)


def match_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Give each file the component of every rule that selects it.

    The directories are equal, which makes this a hash join; the name pattern is its residual
    condition. No broadcast is forced: the planner broadcasts rules only if their size allows it.
    """
    on = (files["dir"] == rules["dir"]) & F.regexp_like(files["name"], rules["file_regex"])
    return files.join(rules.drop("component_type"), on).select(
        rules["component"], *[files[c] for c in files.columns if c != "component"]
    )


def fingerprint(content: Column) -> Column:
    """Identity of a file from its first bytes; NULL if they do not suffice.

    The first line with its LF if that ends within 1,024 bytes, else the first 1,024 bytes.
    """
    head = F.substring(content, 1, S.FINGERPRINT_BYTES)
    # One character per byte keeps positions exact.
    line_end = F.instr(F.decode(head, "ISO-8859-1"), "\n")
    first_line = F.substring(head, F.lit(1), line_end)
    return F.when(line_end > 0, F.sha2(first_line, 256)).when(
        F.octet_length(head) >= S.FINGERPRINT_BYTES, F.sha2(head, 256)
    )


def eligible_files(files: DataFrame) -> DataFrame:
    """Drop files without an identity: empty, or short and without a complete line."""
    return files.where(F.col("fingerprint").isNotNull())


def dedupe_fingerprint(files: DataFrame) -> DataFrame:
    """One owner per fingerprint in a component, the newest; ``n_copies`` counts the candidates.

    A maximum per group is reduced before the shuffle, so a fingerprint shared by very many files
    costs no more than any other.
    """
    rest = [c for c in files.columns if c not in ("component", "fingerprint", "mtime", "path")]
    newest = F.max(F.struct("mtime", "path", *rest)).alias("f")
    return (
        files.groupBy("component", "fingerprint")
        .agg(newest, F.count(F.lit(1)).alias("n_copies"))
        .select("component", "fingerprint", "f.*", "n_copies")
    )


def _with_hour(files: DataFrame) -> DataFrame:
    return files.withColumn("_hour", F.date_trunc("hour", "mtime"))


def order_files(files: DataFrame) -> DataFrame:
    """Add ``file_no``: the place of each file in its component by mtime, ties by path."""
    order = [F.col("mtime"), F.col("path")]
    return positions(_with_hour(files), ["component"], order, "file_no", [["_hour"]]).drop("_hour")


def newest_files(files: DataFrame) -> DataFrame:
    """The newest file per component, as (component, path, fingerprint)."""
    return files.groupBy("component").agg(F.max(F.struct("mtime", "path", "fingerprint")).alias("f")).select(
        "component", F.col("f.path").alias("path"), F.col("f.fingerprint").alias("fingerprint")
    )


def active_file(files: DataFrame, rotated: DataFrame | None = None) -> DataFrame:
    """Add ``is_active``: the newest file of its component, which may still be written to.

    Copies of the newest file count as active too. If ``rotated`` (component, fingerprint) lists the
    newest file as renamed meanwhile, its component has no active file.
    """
    active = newest_files(files).select("component", "fingerprint")
    if rotated is not None:
        active = active.join(rotated.select("component", "fingerprint"), ["component", "fingerprint"], "left_anti")
    # The fingerprint is part of the key, so files of one busy component spread over all tasks.
    return files.join(active.withColumn("_active", F.lit(True)), ["component", "fingerprint"], "left").withColumn(
        "is_active", F.coalesce("_active", F.lit(False))
    ).drop("_active")


def exclude_active(files: DataFrame) -> DataFrame:
    """Safe mode: leave out the newest file of each component altogether."""
    newest = newest_files(files).select("component", "path")
    return files.join(newest, ["component", "path"], "left_anti")


def with_watermark(files: DataFrame, watermark: DataFrame) -> DataFrame:
    """Add ``last_mtime`` of the component; components never seen start at the epoch."""
    epoch = F.timestamp_millis(F.lit(0).cast("bigint"))
    joined = files.join(watermark.select("component", "last_mtime"), "component", "left")
    return joined.withColumn("last_mtime", F.coalesce("last_mtime", epoch))


def unprocessed_files(files: DataFrame, watermark: DataFrame) -> DataFrame:
    """Files modified after the component's watermark."""
    return with_watermark(files, watermark).where(F.col("mtime") > F.col("last_mtime")).drop("last_mtime")


def processed_files(files: DataFrame, watermark: DataFrame) -> DataFrame:
    """Files at or before the watermark that are not active; ``files`` carry ``is_active``."""
    done = with_watermark(files, watermark).where(F.col("mtime") <= F.col("last_mtime"))
    return done.where(~F.col("is_active")).drop("last_mtime")


def resume_positions(files: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Add the saved ``position`` and what is to be done with the file.

    ``read``: bytes are left; ``finished``: none left and not active; ``idle``: none left but
    active; ``truncated``: shorter than the saved position.
    """
    saved = checkpoint.select("component", "fingerprint", "position", *(
        ["chunk_no"] if "chunk_no" in checkpoint.columns else []
    ))
    position, length = F.col("position"), F.col("length")
    status = (
        F.when(position < length, "read")
        .when(position > length, "truncated")
        .when(F.col("is_active"), "idle")
        .otherwise("finished")
    )
    joined = files.join(saved, ["component", "fingerprint"], "left")
    joined = joined.withColumn("position", F.coalesce("position", F.lit(0).cast("bigint")))
    if "chunk_no" in saved.columns:
        joined = joined.withColumn("chunk_no", F.coalesce("chunk_no", F.lit(0)))
    return joined.withColumn("status", status)


def skip_consumed(files: DataFrame) -> DataFrame:
    """Files with something left to read."""
    return files.where((F.col("length") > 0) & (F.col("position") < F.col("length")))


def rule_diagnostics(rules: DataFrame, files: DataFrame, directories: DataFrame | None = None) -> DataFrame:
    """Per rule: ``ok``, ``no_files`` or ``missing_dir``, with the files and bytes it selects.

    ``directories`` (dir) lists directories that exist; by default those that hold a file.
    """
    existing = files.select("dir") if directories is None else directories.select("dir")
    existing = existing.distinct().withColumn("_exists", F.lit(True))
    found = match_rules(files, rules).groupBy("component").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes")
    )
    status = F.when(F.col("_exists").isNull(), "missing_dir").when(F.col("n_files").isNull(), "no_files")
    return (
        rules.select("component", "dir")
        .join(existing, "dir", "left")
        .join(found, "component", "left")
        .select(
            "component", "dir", status.otherwise("ok").alias("status"),
            F.coalesce("n_files", F.lit(0)).cast("bigint").alias("n_files"),
            F.coalesce("n_bytes", F.lit(0)).cast("bigint").alias("n_bytes"),
        )
    )


def rotation_tracking(before: DataFrame, after: DataFrame) -> DataFrame:
    """Compare two snapshots of (component, fingerprint, path, length) by content identity.

    Change is ``gone``, ``new``, ``renamed``, ``grown`` or ``same``; a renamed file keeps its
    offset whatever its length.
    """
    old = before.select("component", "fingerprint", F.col("path").alias("old_path"), F.col("length").alias("old_length"))
    new = after.select("component", "fingerprint", F.col("path").alias("new_path"), F.col("length").alias("new_length"))
    change = (
        F.when(F.col("new_path").isNull(), "gone")
        .when(F.col("old_path").isNull(), "new")
        .when(F.col("old_path") != F.col("new_path"), "renamed")
        .when(F.col("new_length") > F.col("old_length"), "grown")
        .otherwise("same")
    )
    return old.join(new, ["component", "fingerprint"], "full").withColumn("change", change)
