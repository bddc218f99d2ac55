"""Listing log files and reading them by byte range, as DataFrames.

The list of work stays distributed: ranges are rows, spread over tasks by path and offset, and each
task reads its own ranges. A file of any size is read by many tasks; nothing reads a file whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logferry import settings as S
from logferry.sources.byteranges import Files, complete_end, line_start

_FLUSH_BYTES = 16 << 20
_LISTED_AT_ONCE = 10_000


LISTING = "dir string, path string, name string, mtime timestamp, length bigint"


def list_directories(directories: DataFrame, tasks: int | None = None) -> DataFrame:
    """The regular files directly in ``directories`` (dir): dir, path, name, mtime, length.

    Each directory is listed by a task, so no file system is touched on the driver, and names are taken as
    they are: hidden ones, blanks and ``=`` have no meaning. A directory without files gives one row without
    path. One that doesn't exist, or can't be listed, gives none; the others are not affected.
    """
    tasks = tasks or int(directories.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        schema = pa.schema([
            ("dir", pa.string()), ("path", pa.string()), ("name", pa.string()), ("mtime", pa.timestamp("us", tz="UTC")), ("length", pa.int64()),
        ])
        for batch in batches:
            rows = []
            for folder in batch.column(0).to_pylist():
                try:
                    found = [(folder, *f) for f in files.inside(folder)]
                except OSError:
                    continue
                rows += found or [(folder, None, None, None, None)]
                while len(rows) >= _LISTED_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[:_LISTED_AT_ONCE]), schema)], schema=schema)
                    rows = rows[_LISTED_AT_ONCE:]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    wanted = directories.select("dir").where("dir is not null").distinct()
    return wanted.repartition(tasks, "dir").mapInArrow(listed, LISTING)


def list_files(spark: SparkSession, directories: Sequence[str]) -> DataFrame:
    """The files of :func:`list_directories` for directories named here."""
    named = spark.createDataFrame([(d,) for d in directories], "dir string")
    return list_directories(named).where("path is not null")


def inspect_files(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Add ``head``, the first 1,024 bytes, and ``complete_end``, the end of the last finished line.

    A file that cannot be read gets an empty head; the others are not affected.
    """
    tasks = tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = files.schema

    def inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = Files()
        for batch in batches:
            heads, ends = [], []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                try:
                    f = opened.open(path)
                    heads.append(f.read_at(min(S.FINGERPRINT_BYTES, length), 0))
                    ends.append(complete_end(f, 0, length))
                except OSError:
                    heads.append(b"")
                    ends.append(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, pa.binary()), pa.array(ends, pa.int64())],
                names=[*batch.schema.names, "head", "complete_end"],
            )
        opened.close()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return files.repartition(tasks, "path").mapInArrow(inspect, f"{fields}, head binary, complete_end bigint")


def read_blocks(
    work: DataFrame, keep: Sequence[str], range_bytes: int = 8 << 20, tasks: int | None = None
) -> DataFrame:
    """Blocks of whole lines between ``position`` and ``read_end`` of each file, and a receipt for each range.

    A line belongs to the range in which it starts, so each line is read exactly once. ``position``
    has to be a line start. Rows: ``keep`` (path included), block_no, block_start, content, read_to; one
    for each range of ``range_bytes``, numbered from 0. ``read_to`` is the receipt: the end of the last line
    that starts in the range or before. It is NULL if the range was not read.

    If ``work`` has a fingerprint, a file is read only if it shows this fingerprint and reaches to
    ``read_end``, before and after reading. Where it was renamed since it was listed it is found by its
    content among the files beside it.
    """
    tasks = tasks or int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keep = list(keep)
    known = F.col("fingerprint") if "fingerprint" in work.columns else F.lit(None).cast("string")
    starts = F.sequence(F.col("position"), F.col("read_end") - 1, F.lit(range_bytes).cast("bigint"))
    ranges = work.where("position < read_end").select(
        *keep, F.col("position").alias("_first"), F.col("read_end").alias("_length"), known.alias("_known"),
        F.explode_outer(starts).alias("_start"),
    )
    # A fixed number of tasks: ranges are tiny rows, which adaptive execution would put into one task.
    ranges = ranges.repartition(tasks, "path", "_start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = Files()

        def of_range(path, known, first, length, start):
            """(begin, content, end) of the lines that start in a range; nothing if it can't be read."""
            f = opened.open_known(path, known, length)
            if f is None:
                return None, None, None
            try:
                begin = line_start(f, start, first, length)
                end = line_start(f, start + range_bytes, first, length)
                content = f.read_at(end - begin, begin) if begin < min(end, start + range_bytes) else None
                whole = content is None or len(content) == end - begin
                if whole and opened.is_known(f, known, length):
                    return begin, content, end
            except OSError:
                opened.close()
            return None, None, None

        for batch in batches:
            first, length, start, known = (batch.column(c).to_pylist() for c in ("_first", "_length", "_start", "_known"))
            rows, found, held = [], [], 0

            def flush():
                taken = [batch.column(c).take(pa.array(rows, pa.int64())) for c in keep]
                numbers = [(start[i] - first[i]) // range_bytes for i in rows]
                begins, contents, ends = zip(*found)
                return pa.RecordBatch.from_arrays(
                    [*taken, pa.array(numbers, pa.int64()), pa.array(begins, pa.int64()), pa.array(contents, pa.binary()),
                     pa.array(ends, pa.int64())],
                    names=[*keep, "block_no", "block_start", "content", "read_to"],
                )

            for i, path in enumerate(batch.column("path").to_pylist()):
                rows.append(i)
                found.append(of_range(path, known[i], first[i], length[i], start[i]))
                held += len(found[-1][1] or b"")
                if held >= _FLUSH_BYTES:
                    yield flush()
                    rows, found, held = [], [], 0
            if rows:
                yield flush()
        opened.close()

    types = {f.name: f.dataType.simpleString() for f in work.schema}
    fields = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return ranges.mapInArrow(read, f"{fields}, block_no bigint, block_start bigint, content binary, read_to bigint")
