"""Column functions over log text. All of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logferry import settings as S


def raw_string(content: Column) -> Column:
    """Bytes as a string column without touching them; malformed bytes stay as they are."""
    return content.cast("string")


def decode_utf8(content: Column) -> Column:
    """Bytes as text; malformed sequences become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def line_structs(content: Column) -> Column:
    """All lines of a byte column as ``array<struct<line string, size bigint>>``.

    A line ends at LF, CR or CRLF and a last line needs no terminator. ``size`` counts the bytes of
    the line with its terminator; an unterminated last line may count one too many. ``line`` holds
    the raw bytes: decode it before showing it.
    """
    text = raw_string(content)
    # Well-formed text without CR needs a plain split only. Otherwise each byte becomes one character
    # (ISO-8859-1), so that the regex neither changes lengths nor repairs malformed sequences.
    body = F.substring(content, F.lit(1), F.octet_length(content) - F.endswith(text, F.lit("\n")).cast("int"))
    by_lf = F.transform(
        F.split(raw_string(body), "\n"),
        lambda p: F.struct(p.alias("line"), (F.octet_length(p) + 1).cast("bigint").alias("size")),
    )
    pieces = F.split(F.decode(content, "ISO-8859-1"), r"(?<=\n)|(?<=\r)(?!\n)")
    by_any = F.transform(
        F.filter(pieces, lambda p: p != ""),
        lambda p: F.struct(
            F.encode(F.rtrim(p, F.lit("\r\n")), "ISO-8859-1").cast("string").alias("line"),
            F.length(p).cast("bigint").alias("size"),
        ),
    )
    none = F.slice(by_lf, 1, 0)
    return (
        F.when(F.octet_length(content) == 0, none)
        .when((F.instr(text, "\r") > 0) | ~F.is_valid_utf8(text), by_any)
        .otherwise(by_lf)
    )


def is_record_start(line: Column, start_regex: Column | None = None, guard_bytes: Column | None = None) -> Column:
    """Does the line start a record: the component's pattern, or the default one, is found in it.

    ``guard_bytes`` protects executors from patterns that exhaust the regex stack on long lines:
    longer lines are judged by the first-character rule instead.
    """
    default = F.lit(S.RECORD_START)
    pattern = default if start_regex is None else F.coalesce(start_regex, default)
    # Unlike regexp_like, this keeps the last pattern compiled when it comes from a column.
    found = F.regexp_like(line, pattern) if start_regex is None else F.regexp_instr(line, pattern) > 0
    if guard_bytes is None:
        return found
    return F.when(F.octet_length(line) > guard_bytes, is_record_start_ws(line)).otherwise(found)


def is_record_start_ws(line: Column) -> Column:
    """The fallback rule: the line is not empty and does not begin with whitespace."""
    return F.regexp_like(line, F.lit(S.NON_BLANK_START))


def level_rank(level: Column) -> Column:
    """Position of a level name in the severity order; NULL for an unknown name."""
    rank = F.array_position(F.array(*[F.lit(x) for x in S.LEVELS]), level)
    return F.when(rank > 0, rank.cast("int"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _last_field(entries: Column, name: str) -> Column:
    # The last of several spellings wins; get gives NULL if there is none.
    return let(
        F.filter(entries, lambda e: F.lower(e["key"]) == name), lambda found: F.get(found, F.size(found) - 1)["value"]
    )


def parse_structured(message: Column) -> Column:
    """``struct<level, ts_ms>`` of a JSON record, or NULL when the record is plain text.

    A record is structured if it starts with ``{``, is a JSON object and names a level. Key names
    are matched in any case. The prefix test comes first, as it spares most parsing.
    """

    def fields(entries: Column) -> Column:
        return F.struct(
            _last_field(entries, "level").alias("level"), _last_field(entries, "timestamp").alias("ts")
        )

    def checked(p: Column) -> Column:
        ts_ms = p["ts"].try_cast("decimal(38,6)").cast("bigint")
        valid = (F.length(p["level"]) > 0) & (p["ts"].isNull() | ts_ms.isNotNull())
        return F.when(valid, F.struct(p["level"].alias("level"), ts_ms.alias("ts_ms")))

    parsed = F.map_entries(F.from_json(message, "map<string,string>"))
    return F.when(F.startswith(message, F.lit("{")), let(let(parsed, fields), checked))


# ISO instants and date-times with an offset; a date, a local time or a year alone do not count.
_ISO_SHAPE = r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d(:\d\d(\.\d{1,9})?)?([Zz]|[+\-]\d\d(:?\d\d)?)$"


def extract_text_ts(message: Column) -> Column:
    """Timestamp of a text record: its first token, if that is an ISO date-time with an offset."""

    def parse(token: Column) -> Column:
        # The cast wants seconds and a colon inside the offset.
        full = F.regexp_replace(F.upper(token), r"^([^T]+T\d\d:\d\d)([Z+\-])", "$1:00$2")
        full = F.regexp_replace(full, r"([+\-]\d\d)$", "$1:00")
        full = F.regexp_replace(full, r"([+\-]\d\d)(\d\d)$", "$1:$2")
        return F.when(F.regexp_like(token, F.lit(_ISO_SHAPE)), full.try_cast("timestamp"))

    return let(F.regexp_extract(message, S.TIMESTAMP_TOKEN, 1), parse)


def to_millis(ts: Column) -> Column:
    """Truncate a timestamp to whole milliseconds."""
    return F.timestamp_millis(F.unix_millis(ts))


def _fill(template: str, parts: dict[str, Column]) -> Column:
    """Concatenate a template's literal text with columns in place of its ``{names}``."""
    pieces = re.split(r"(\{\w+\})", template)
    return F.concat(*[parts[p] if p in parts else F.lit(p) for p in pieces if p])


def group_name(template: str, component_type: Column, region: Column, component: Column) -> Column:
    """Fill the log group template; ``{type}``, ``{region}`` and ``{component}`` are replaced."""
    return _fill(template, {"{type}": component_type, "{region}": region, "{component}": component})


def stream_name(ts: Column, device: Column) -> Column:
    """Stream of an event: the UTC day of its own time, and the device with ``:`` made ``+``."""
    day = F.date_format(ts, "yyyy/MM/dd")
    return _fill(S.STREAM_TEMPLATE, {"{date}": day, "{device}": F.replace(device, F.lit(":"), F.lit("+"))})


def event_cost(size: Column) -> Column:
    """Bytes an event takes from a batch, given the UTF-8 size of its message."""
    return (size + S.EVENT_OVERHEAD).cast("bigint")


_BLANKS = "".join(chr(i) for i in range(0x21))


def is_emitted(message: Column) -> Column:
    """Blank chunks are not sent: some character must lie above U+0020."""
    # Trimming stops at the first such character; a regex would decode the whole message first.
    return F.ltrim(message, F.lit(_BLANKS)) != ""


def chunk_count(message: Column, cap: int) -> Column:
    """Number of pieces of at most ``cap`` bytes; an empty message is one empty piece."""
    return F.greatest(F.ceil(F.octet_length(message) / cap), F.lit(1)).cast("int")


def byte_chunk(message: Column, i: Column, cap: int) -> Column:
    """Piece ``i`` of a message cut every ``cap`` bytes.

    Characters cut in two leave U+FFFD on both sides.
    """
    part = F.substring(message.cast("binary"), i * cap + 1, F.lit(cap))
    return F.when(F.octet_length(message) <= cap, F.make_valid_utf8(message)).otherwise(decode_utf8(part))


def chunk_size(message: Column, i: Column, cap: int) -> Column:
    """Bytes of piece ``i`` in the message, before any replacement."""
    return F.least(F.lit(cap).cast("bigint"), F.octet_length(message).cast("bigint") - i.cast("bigint") * cap)
