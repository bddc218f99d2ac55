"""Importance resampling towards a target: hashed word n-grams, log ratios of their frequencies, Gumbel top-k.

The hash of a feature is the CRC-32 of its UTF-8 bytes, taken for all features of a block of texts at once.
Without its constants CRC-32 is linear: the register after a message is the XOR of what each byte adds, which
depends on the byte and on how many bytes follow it, and of a constant for the length. A table holds the part of
each byte value at each distance from the end; a feature's hash is then a XOR over its span. Spans longer than
the table are cut into blocks from the end and folded in pairs, each time shifting the left block past the right.

A NULL text has no words. A row without doc_id takes part under an empty id and comes first among ties; repeated
rows are documents of their own. With no documents there are no rows; with no benchmark T and every t are 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logferry.llm.common import checkpointed, chunks
from logferry.operators.ordering import total_order

POSITIONS = 64  # bytes that the table covers
BLOCK_BYTES = 1 << 20  # of text worked on at once

# --- hashes of spans ---------------------------------------------------------------------------------


def _without_constants(message: bytes) -> int:
    """What the bytes add to the register: CRC-32 without the constant of its length."""
    return zlib.crc32(message) ^ zlib.crc32(bytes(len(message)))


def position_table(positions: int = POSITIONS) -> np.ndarray:
    """[distance from the end, byte value] -> what that byte adds."""
    table = np.zeros((positions, 256), np.uint32)
    for distance in range(positions):
        # Linear in the bits of the byte: eight values give all others.
        for bit in range(8):
            part = np.uint32(_without_constants(bytes([1 << bit]) + bytes(distance)))
            table[distance] ^= np.where(np.arange(256) >> bit & 1, part, np.uint32(0)).astype(np.uint32)
    return table


def shift_table(n_bytes: int) -> np.ndarray:
    """[byte of a register, its value] -> that byte of the register after ``n_bytes`` zero bytes.

    The register behaves like the last four bytes of a message, so it is a table of four distances, reached
    by doubling: one zero byte is known from the definition, and shifts add up.
    """

    def applied(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bitwise_xor.reduce([tables[k][(x >> np.uint32(8 * k)) & np.uint32(255)] for k in range(4)], axis=0)

    values = np.arange(256, dtype=np.uint32)
    crcs = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    one = np.stack([crcs, *[values << np.uint32(8 * (k - 1)) for k in (1, 2, 3)]])
    out = np.stack([values << np.uint32(8 * k) for k in range(4)])
    while n_bytes:
        if n_bytes & 1:
            out = np.stack([applied(one, row) for row in out])
        one = np.stack([applied(one, row) for row in one])
        n_bytes >>= 1
    return out


class SpanHashes:
    """CRC-32 of many spans of a byte array."""

    def __init__(self, positions: int = POSITIONS):
        self._positions, self._table = positions, position_table(positions).ravel()
        self._constants: dict[int, int] = {}
        self._shifts: list[np.ndarray] = []

    def _constant(self, lengths: np.ndarray) -> np.ndarray:
        """CRC-32 of as many zero bytes."""
        distinct, places = np.unique(lengths, return_inverse=True)
        for n in map(int, distinct):
            if n not in self._constants:
                if len(self._constants) > 1 << 16:
                    self._constants.clear()
                self._constants[n] = zlib.crc32(bytes(n))
        return np.array([self._constants[int(n)] for n in distinct], np.uint32)[places.ravel()]

    def _shifted(self, x: np.ndarray, level: int) -> np.ndarray:
        while len(self._shifts) <= level:
            self._shifts.append(shift_table(self._positions << len(self._shifts)))
        tables = self._shifts[level]
        return np.bitwise_xor.reduce([tables[k][(x >> np.uint32(8 * k)) & np.uint32(255)] for k in range(4)], axis=0)

    def __call__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = self._constant(lengths)
        filled = np.flatnonzero(lengths)
        if not len(filled):
            return out
        starts, lengths, size = starts[filled], lengths[filled], self._positions
        # Blocks of a span from its first to its last; the first is the one that may be shorter.
        n_blocks = -(-lengths // size)
        first = np.cumsum(n_blocks) - n_blocks
        block_lengths = np.full(int(n_blocks.sum()), size, np.int64)
        block_lengths[first] = lengths - (n_blocks - 1) * size
        begins = np.cumsum(block_lengths) - block_lengths
        span_begins = begins[first]
        at = np.arange(int(lengths.sum())) - np.repeat(span_begins - starts, lengths)
        distances = np.repeat(begins + block_lengths - 1, block_lengths) - np.arange(len(at))
        parts = np.bitwise_xor.reduceat(self._table[(distances << 8) + data[at]], begins)
        level = 0
        while len(parts) > len(filled):
            # Pairs from the end; a block that is left over at the front stays as it is.
            last = np.cumsum(n_blocks) - 1
            of = np.repeat(np.arange(len(n_blocks)), n_blocks)
            from_end = last[of] - np.arange(len(parts))
            left = np.flatnonzero(from_end & 1)
            parts[left + 1] ^= self._shifted(parts[left], level)
            parts = parts[from_end & 1 == 0]
            n_blocks = (n_blocks + 1) // 2
            level += 1
        out[filled] ^= parts
        return out


# --- features ----------------------------------------------------------------------------------------

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 0x20, _BYTES).astype(np.uint8)
# What parts words are all ASCII characters but digits and letters; bytes above are parts of words.
_IN_WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of each word of the texts that lie between ``offsets`` in lower-cased ``data``."""
    inside = _IN_WORD[data]
    borders = np.zeros(len(data) + 1, bool)
    borders[offsets] = True
    opens = inside & ~np.r_[False, inside[:-1]] | inside & borders[:-1]
    closes = inside & ~np.r_[inside[1:], False] | inside & borders[1:]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1 - starts, np.searchsorted(offsets, starts, side="right") - 1


def joined_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after another, a space behind each, and where they start now."""
    places = np.cumsum(lengths + 1) - lengths - 1
    out = np.full(int(lengths.sum() + len(lengths)), 0x20, np.uint8)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(places, lengths) + within] = data[np.repeat(starts, lengths) + within]
    return out, places


def features(
    data: np.ndarray, offsets: np.ndarray, least: int, most: int, buckets: int, hashes: SpanHashes
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of all runs of ``least`` to ``most`` words, and the number of words of each text."""
    data = _LOWER[data]
    starts, lengths, texts = word_spans(data, offsets)
    n_words = np.bincount(texts, minlength=len(offsets) - 1)
    if most > 1:
        data, starts = joined_words(data, starts, lengths)
    found, owners = [], []
    for n in range(least, most + 1):
        if len(starts) < n:
            break
        head = np.flatnonzero(texts[: len(texts) - n + 1] == texts[n - 1 :])
        span = starts[head + n - 1] + lengths[head + n - 1] - starts[head]
        found.append(hashes(data, starts[head], span) % np.uint32(buckets))
        owners.append(texts[head])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
    return np.concatenate(found).astype(np.int64), np.concatenate(owners), n_words


def _blocks(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of an Arrow column of binary texts with their bytes and offsets; NULL is empty."""
    import pyarrow.compute as pc

    column = pc.fill_null(column, b"")
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    for begin, end in chunks(sizes.tolist(), BLOCK_BYTES):
        data = np.frombuffer(b"".join(column.slice(begin, end - begin).to_pylist()), np.uint8)
        yield begin, end, data, np.r_[0, np.cumsum(sizes[begin:end])]


# --- counts, weights, draw ---------------------------------------------------------------------------


def bucket_counts(texts: DataFrame, least: int, most: int, buckets: int) -> DataFrame:
    """(bucket, n) over all rows of ``texts`` (text); each task sends its sums, a row per bucket at most."""

    def count(batches):
        import pyarrow as pa

        hashes, total = SpanHashes(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in _blocks(batch.column(0)):
                total += np.bincount(features(data, offsets, least, most, buckets, hashes)[0], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    parts = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, least: int, most: int, buckets: int) -> list[int]:
    """The gain of each bucket in thousandths; ``buckets`` numbers come to the driver, whatever the input."""
    s, t = [0] * buckets, [0] * buckets
    for into, texts in ((s, source), (t, target)):
        for row in bucket_counts(texts, least, most, buckets).collect():
            into[row.bucket] = row.n
    all_s, all_t = sum(s), sum(t)
    return [
        math.floor(1000 * math.log(float((t[b] + 1) * (all_s + buckets)) / float((s[b] + 1) * (all_t + buckets))))
        for b in range(buckets)
    ]


def weights(docs: DataFrame, gain: list[int], least: int, most: int) -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of the gains of its features) of each row."""

    def weigh(batches):
        import pyarrow as pa

        hashes, table = SpanHashes(), np.array(gain, np.int64)
        for batch in batches:
            for begin, end, data, offsets in _blocks(batch.column(1)):
                found, owners, n_words = features(data, offsets, least, most, len(gain), hashes)
                order = np.argsort(owners, kind="stable")
                sums = np.r_[0, np.cumsum(table[found[order]])]
                n = np.bincount(owners, minlength=end - begin)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(n_words.astype(np.int64)),
                     pa.array(n.astype(np.int64)), pa.array(sums[ends] - sums[ends - n])],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def with_scores(weighted: DataFrame, seed: str) -> DataFrame:
    """Add ``score``: the weight and the Gumbel noise of the id, which is the same in every run."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighted.withColumn("score", F.col("weight") + noise)


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, least: int = 1, most: int = 1,
    buckets: int = 10_000, seed: str = "2024",
) -> DataFrame:
    """Every document with n_words, n_features, weight, score and, if it is drawn, its ``rank``.

    Of the documents with ``min_words`` words at least, ``percent`` of a hundred are drawn, rounded down.
    The draw is a total order over ranges of scores, so no task holds more than its range.
    """
    scored = with_scores(weights(docs, gains(docs, target, least, most, buckets), least, most), seed)
    scored = checkpointed(scored)
    fit = F.col("n_words") >= min_words
    ranked = total_order(
        scored.where(fit), [], [F.col("score").desc(), F.col("doc_id").asc_nulls_first()], "rank", checkpointed
    )
    drawn = scored.where(fit).count() * percent // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.withColumn("rank", rank).unionByName(rest)


# The same in DuckDB, whose CRC-32 is eight steps for each byte of a distinct word.
ORACLE = r"""
with recursive own as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
aim as (
  select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
vocabulary as (select distinct word from (select unnest(words) as word from own union all select word from aim)),
bytes as (
  select word, hex(encode(word)) as b, cast(4294967295 as bigint) as r, 0 as i from vocabulary
  union all
  select word, b, list_reduce([xor(r, cast('0x' || substr(b, 2 * i + 1, 2) as bigint)), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: case when (x & 1) = 1 then xor(x >> 1, 3988292384) else x >> 1 end), i + 1
  from bytes where 2 * i < length(b)),
hashed as (select word, xor(r, 4294967295) % 10000 as bucket from bytes where 2 * i = length(b)),
s as (select bucket, count(*) as n from (select unnest(words) as word from own) join hashed using (word) group by bucket),
t as (select bucket, count(*) as n from aim join hashed using (word) group by bucket),
gain as (
  select g.bucket, cast(floor(1000 * ln(cast((coalesce(t.n, 0) + 1) * (coalesce((select sum(n) from s), 0) + 10000) as double)
    / cast((coalesce(s.n, 0) + 1) * (coalesce((select sum(n) from t), 0) + 10000) as double))) as bigint) as gain
  from (select distinct bucket from hashed) g left join s using (bucket) left join t using (bucket)),
numbered as (select *, row_number() over () as k from own),
weighed as (
  select k, sum(gain) as weight from (select k, unnest(words) as word from numbered) join hashed using (word) join gain using (bucket) group by k),
scored as (
  select doc_id, cast(len(words) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
    cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double)
      / 4294967296))) as bigint) as score
  from numbered left join weighed using (k)),
ranked as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls first) as nth,
    count(*) filter (n_features >= 20) over () * 10 // 100 as drawn
  from scored)
select doc_id, n_features, weight, score, case when n_features >= 20 and nth <= drawn then nth end as rank from ranked
"""
