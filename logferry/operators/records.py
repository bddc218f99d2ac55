"""From file content to lines and records, without moving text between tasks.

``blocks`` rows hold whole lines of one file: key columns, ``block_no``, ``block_start`` (byte offset
in the file) and ``content``. A small file is one block; a large file is cut at line starts by
:mod:`logferry.sources.ranges`. Lines and records of a block are built inside its row, so the only
text that is shuffled are the pieces of records that cross from one block into the next.

Arrays are unnested with the outer generators: for the others the planner adds a filter on the size of
the array, pushes it down to the scan and thereby computes the array twice, lambdas inlined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logferry.functions import text as T
from logferry.functions.arrays import with_prefix_sums


def as_blocks(files: DataFrame) -> DataFrame:
    """Whole files as one block each."""
    return files.withColumn("block_no", F.lit(0).cast("bigint")).withColumn("block_start", F.lit(0).cast("bigint"))


def from_position(files: DataFrame) -> DataFrame:
    """Whole files read from their saved ``position``: one block with the bytes after it."""
    rest = F.substring(F.col("content"), (F.col("position") + 1).cast("int"), F.octet_length("content"))
    return (
        files.withColumn("content", rest)
        .withColumn("block_no", F.lit(0).cast("bigint"))
        .withColumn("block_start", F.col("position"))
    )


def _with_lines(blocks: DataFrame) -> DataFrame:
    """Add ``_lines`` and ``_ends``, the end offset of each line within the block."""
    df = blocks.withColumn("_lines", T.line_structs(F.col("content")))
    df = df.withColumn("_sizes", F.transform("_lines", lambda x: x["size"]))
    df = with_prefix_sums(df, "_sizes", "_sums")
    # Only the last line can end beyond the block. Its bytes must not be looked at inside a lambda,
    # where they would be copied once per element.
    last = F.least(F.element_at("_sums", -1), F.octet_length("content").cast("bigint"))
    ends = F.when(F.size("_sums") > 0, F.concat(F.slice("_sums", F.lit(1), F.size("_sums") - 1), F.array(last)))
    return df.withColumn("_ends", F.coalesce(ends, F.col("_sums"))).drop("_sizes", "_sums")


def read_lines(blocks: DataFrame, keep: Sequence[str] = ("component", "path")) -> DataFrame:
    """One row per line: ``line_no`` in the block, byte offsets in the file, and the text."""
    df = _with_lines(blocks)
    df = df.withColumn("_begins", F.slice(F.concat(F.array(F.lit(0).cast("bigint")), "_ends"), F.lit(1), F.size("_ends")))
    df = df.select(
        *keep, "block_no", "block_start", F.posexplode_outer(F.arrays_zip("_lines", "_begins", "_ends")).alias("line_no", "x")
    ).where("line_no is not null")
    return df.select(
        *keep,
        "block_no",
        F.col("line_no").cast("bigint").alias("line_no"),
        (F.col("block_start") + F.col("x._begins")).alias("start_off"),
        (F.col("block_start") + F.col("x._ends")).alias("end_off"),
        F.make_valid_utf8(F.col("x._lines.line")).alias("line"),
    )


def reassemble_records(
    blocks: DataFrame,
    start_regex: Column | None = None,
    guard_bytes: Column | None = None,
    whitespace_rule: bool = False,
    joiner: str = "",
    keep: Sequence[str] = ("component", "path"),
    empty_blocks: bool = False,
) -> DataFrame:
    """Merge lines into records, block by block.

    The first line of a file starts a record; a later line starts one if the start rule says so, and
    is otherwise appended. Rows: ``keep``, block_no, ``start_off``, ``end_off`` (bytes in the file,
    terminators included), ``n_lines``, ``message``, ``is_head`` (continues a record of an earlier
    block), ``is_tail`` (last of its block). Pass the rows through :func:`stitch_records` if files
    may have several blocks. With ``empty_blocks`` a block without lines gives a row without offsets.
    """
    df = _with_lines(blocks)

    def starts(line: Column) -> Column:
        if whitespace_rule:
            return T.is_record_start_ws(line)
        return T.is_record_start(line, start_regex, guard_bytes)

    n = F.size("_lines")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.slice(F.array(F.lit(0)), 1, 0))
    df = df.withColumn(
        "_starts",
        F.filter(index, lambda i: (i == 0) | starts(F.get("_lines", i)["line"])),
    )
    # Named twice outside of a lambda, so that the planner keeps ``_starts`` and ``_lines`` as
    # columns and does not compute them again for each element.
    df = df.withColumn(
        "_spans",
        F.arrays_zip(
            F.col("_starts").alias("s"),
            F.concat(F.slice("_starts", 2, F.size("_starts")), F.array(F.size("_lines"))).alias("e"),
        ),
    )
    offset = F.col("block_start")

    def record(span: Column) -> Column:
        # Not a slice, which would copy all lines of the block for each record.
        # Each line is repaired by itself: bytes of two lines never make one character.
        lines = F.transform(F.sequence(span["s"], span["e"] - 1), lambda i: F.make_valid_utf8(F.get("_lines", i)["line"]))
        start = F.when(span["s"] == 0, F.lit(0).cast("bigint")).otherwise(F.get("_ends", span["s"] - 1))
        return F.struct(
            (offset + start).alias("start_off"),
            (offset + F.get("_ends", span["e"] - 1)).alias("end_off"),
            (span["e"] - span["s"]).cast("bigint").alias("n_lines"),
            (span["s"] == 0).alias("is_first"),
            (span["e"] == F.size("_lines")).alias("is_tail"),
            F.array_join(lines, joiner).alias("message"),
        )

    df = df.withColumn("_records", F.transform("_spans", record))
    first = F.get("_lines", F.lit(0))["line"]
    df = df.withColumn("_headless", (F.col("block_no") > 0) & ~F.coalesce(starts(first), F.lit(False)))
    df = df.select(*keep, "block_no", "_headless", F.explode_outer("_records").alias("r"))
    df = df if empty_blocks else df.where("r.start_off is not null")
    return df.select(
        *keep,
        "block_no",
        "r.start_off",
        "r.end_off",
        "r.n_lines",
        (F.col("r.is_first") & F.col("_headless")).alias("is_head"),
        "r.is_tail",
        "r.message",
    )


def border_places(records: DataFrame, keys: Sequence[str] = ("component", "path"), joiner: str = "") -> DataFrame:
    """Where the pieces at block borders belong; narrow rows, one per piece.

    Each block reports where its last record starts. A piece without a start goes to the last start in
    the blocks before it, ``owner``. ``begins`` is the place of the piece in the bytes of its record, a
    running total over the sizes of its pieces, and ``record_bytes`` the size of that record.
    """
    keys = list(keys)
    narrow = records.select(*keys, "block_no", "start_off", "is_head", "is_tail", F.octet_length("message").cast("bigint").alias("n"))
    per_block = narrow.groupBy(*keys, "block_no").agg(
        F.max(F.when(~F.col("is_head"), F.col("start_off"))).alias("_last_start")
    )
    earlier = Window.partitionBy(*keys).orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    open_at = per_block.select(*keys, "block_no", F.last("_last_start", ignorenulls=True).over(earlier).alias("_open_at"))
    edges = narrow.where(F.col("is_head") | F.col("is_tail")).join(open_at, [*keys, "block_no"])
    edges = edges.withColumn("owner", F.when(F.col("is_head"), F.col("_open_at")).otherwise(F.col("start_off")))
    joined = F.when(F.col("is_head"), F.lit(len(joiner.encode()))).otherwise(0)
    edges = edges.withColumn("piece_bytes", F.col("n") + joined)
    record = Window.partitionBy(*keys, "owner")
    before = record.orderBy("start_off").rowsBetween(Window.unboundedPreceding, -1)
    return edges.select(
        *keys, "block_no", "start_off", "owner", "piece_bytes", F.coalesce(F.sum("piece_bytes").over(before), F.lit(0)).alias("begins"),
        F.sum("piece_bytes").over(record).alias("record_bytes"),
    )


def _placed(records: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    return records.where(F.col("is_head") | F.col("is_tail")).join(places, [*keys, "block_no", "start_off"])


_OF_PIECE = ("block_no", "start_off", "end_off", "n_lines", "message", "is_head", "is_tail")


def stitch_records(
    records: DataFrame, keys: Sequence[str] = ("component", "path"), joiner: str = "", places: DataFrame | None = None,
    whole_bytes: int | None = None,
) -> DataFrame:
    """Join the pieces of records that cross block borders.

    Only the first and last record of a block can be such pieces (:func:`border_places`), so all other
    records pass through untouched. Records of more than ``whole_bytes`` that cross borders are left to
    :func:`long_records` and :func:`record_chunks`: those don't need a row that holds one.
    """
    keys = list(keys)
    places = border_places(records, keys, joiner) if places is None else places
    whole = records.where(~F.col("is_head") & ~F.col("is_tail"))
    edges = _placed(records, places, keys)
    edges = edges if whole_bytes is None else edges.where(F.col("record_bytes") <= whole_bytes)
    rest = [c for c in records.columns if c not in (*keys, *_OF_PIECE)]
    merged = edges.groupBy(*keys, "owner").agg(
        F.min("block_no").alias("block_no"),
        F.max("end_off").alias("end_off"),
        F.sum("n_lines").alias("n_lines"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("start_off", "message"))), lambda x: x["message"]), joiner
        ).alias("message"),
        *[F.first(c).alias(c) for c in rest],
    ).withColumnRenamed("owner", "start_off")
    out = [*keys, *rest, "block_no", "start_off", "end_off", "n_lines", "message"]
    return whole.select(*out).unionByName(merged.select(*out))


def _bytes_of(joiner: str) -> Column:
    """The bytes a piece adds to its record."""
    return F.when(F.col("is_head"), F.concat(F.lit(joiner), "message")).otherwise(F.col("message")).cast("binary")


def _joined(parts: Column) -> Column:
    """Bytes of (start_off, part) structs one after another."""
    return F.aggregate(F.sort_array(parts), F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["part"]))


def long_records(
    records: DataFrame, places: DataFrame, whole_bytes: int, head_bytes: int, keys: Sequence[str] = ("component", "path"), joiner: str = ""
) -> DataFrame:
    """Records of more than ``whole_bytes`` that cross block borders, with ``record_bytes``; the message is
    just its first ``head_bytes``."""
    keys = list(keys)
    edges = _placed(records, places.where(F.col("record_bytes") > whole_bytes), keys)
    part = F.substring(_bytes_of(joiner), F.lit(1), (F.lit(head_bytes) - F.col("begins")).cast("int"))
    rest = [c for c in records.columns if c not in (*keys, *_OF_PIECE)]
    return edges.groupBy(*keys, F.col("owner").alias("_start")).agg(
        *[F.first(c).alias(c) for c in rest],
        F.min("block_no").alias("block_no"), F.max("end_off").alias("end_off"), F.sum("n_lines").alias("n_lines"),
        F.max("record_bytes").alias("record_bytes"),
        T.decode_utf8(_joined(F.collect_list(F.when(F.col("begins") < head_bytes, F.struct("start_off", part.alias("part")))))).alias("message"),
    ).withColumnRenamed("_start", "start_off")


def record_chunks(
    records: DataFrame, places: DataFrame, whole_bytes: int, cap: int, keys: Sequence[str] = ("component", "path"), joiner: str = ""
) -> DataFrame:
    """The chunks of at most ``cap`` bytes of these records: keys, start_off, chunk_no, message.

    Each piece knows its bytes' place in the record, so it is cut at the borders of chunks, and what
    belongs to one chunk is joined: no row holds more than a piece or a chunk, however long the record is.
    """
    keys = list(keys)
    edges = _placed(records, places.where((F.col("record_bytes") > whole_bytes) & (F.col("piece_bytes") > 0)), keys)
    ends = F.col("begins") + F.col("piece_bytes")
    numbers = F.sequence(F.floor(F.col("begins") / cap), F.floor((ends - 1) / cap))
    rows = edges.select(*keys, "owner", "start_off", "begins", "piece_bytes", _bytes_of(joiner).alias("_b"), F.explode(numbers).alias("_c"))
    first = F.greatest(F.col("_c") * cap, F.col("begins"))
    size = F.least((F.col("_c") + 1) * cap, ends) - first
    part = F.substring(F.col("_b"), (first - F.col("begins") + 1).cast("int"), size.cast("int"))
    rows = rows.select(*keys, F.col("owner").alias("_start"), F.col("_c").cast("int").alias("chunk_no"), "start_off", part.alias("part"))
    joined = T.decode_utf8(_joined(F.collect_list(F.struct("start_off", "part"))))
    return rows.groupBy(*keys, "_start", "chunk_no").agg(joined.alias("message")).withColumnRenamed("_start", "start_off")
