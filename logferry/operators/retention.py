"""Which files may be deleted, and deleting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logferry.operators.files import processed_files
from logferry.operators.ordering import running
from logferry.sources.byteranges import Files


def component_usage(files: DataFrame) -> DataFrame:
    """Files and bytes per component."""
    return files.groupBy("component").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))


def retention_plan(files: DataFrame, watermark: DataFrame, rules: DataFrame) -> DataFrame:
    """Processed files to delete, oldest first, until each component is within its limit.

    ``files`` carry ``is_active``; active files count towards the total but stay. The plan uses the
    watermark of the time before the current cycle. Components without a limit keep everything.
    """
    limits = rules.where("max_bytes is not null").groupBy("component").agg(F.min("max_bytes").alias("max_bytes"))
    need = (
        component_usage(files)
        .join(limits, "component")
        .withColumn("_need", F.col("n_bytes") - F.col("max_bytes"))
        .where("_need > 0")
        .select("component", "_need")
    )
    candidates = processed_files(files, watermark).join(need, "component")
    candidates = candidates.withColumn("_hour", F.date_trunc("hour", "mtime"))
    freed = running(
        candidates, ["component"], [F.col("mtime"), F.col("path")], {"_freed": ("sum", F.col("length"))},
        [["_hour"]], through_current=False,
    )
    return freed.where(F.col("_freed") < F.col("_need")).drop("_freed", "_need", "_hour")


def delete_after_delivery(completed: DataFrame, rules: DataFrame) -> DataFrame:
    """Completed files that may go: the rule says so, or the component has no rule any more."""
    flags = rules.groupBy("component").agg(F.max("delete_after").alias("_delete"))
    return completed.join(flags, "component", "left").where(F.coalesce("_delete", F.lit(True))).drop("_delete")


def apply_retention(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Files that are left when the planned ones are gone."""
    return files.join(plan.select("component", "path"), ["component", "path"], "left_anti")


def delete_files(plan: DataFrame) -> None:
    """Delete the planned files (path, fingerprint, length), from the tasks.

    Deleted is what was planned, not what lies at the path by now: a file with another fingerprint stays, and
    the planned one is looked for beside it. One that has grown since stays too. A file that is gone already
    is no error; nor are two with the same fingerprint, of which neither is deleted.
    """

    def unlink(rows) -> None:
        files = Files()

        def holds(path: str, fingerprint: str | None, length: int) -> bool:
            try:
                f = files.open(path)
                return f.size() == length and files.is_known(f, fingerprint, length)
            except OSError:
                return False
            finally:
                files.close()

        for path, fingerprint, length in rows:
            here = [path] if holds(path, fingerprint, length) else [p for p in files.beside(path) if holds(p, fingerprint, length)]
            if len(here) == 1:
                system, name = files.locate(here[0])
                try:
                    system.delete_file(name)
                except FileNotFoundError:
                    pass

    plan.select("path", "fingerprint", "length").distinct().foreachPartition(unlink)
