"""Packing token sequences: length combinations, non-negative least squares, greedy rest."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logferry.llm.common import checkpointed

WINDOW, BIN, DEPTH, END_ID = 2048, 8, 3, 1
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


# --- tokens ------------------------------------------------------------------------------------------


# Fixed value: the pattern that cuts a text before byte-level merges.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Ids by bytes: byte-level vocabularies write bytes that don't print as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token)}


class Encoder:
    """Ids of whole texts, as little-endian 32-bit bytes, equal to those of the byte-level tokenizer.

    A faster library merges with the same vocabulary and the same pattern. Its time grows with the square of a
    stretch that the pattern doesn't cut, so texts that may hold one of more than ``longest`` characters go to the
    tokenizer itself, whose time doesn't, and so do texts that hold an added token.
    """

    longest = 1000
    _own: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = {t: i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.added}
        self.merges = tiktoken.Encoding("merges", pat_str=PRE_TOKENS, mergeable_ranks=_ranks(vocabulary), special_tokens={})

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _is_cut(self, text: str) -> bool:
        """No stretch of more than ``longest`` characters without white space, or of white space."""
        if len(text) <= self.longest:
            return True
        sizes = [len(w) for w in text.split()]
        if max(sizes, default=0) > self.longest:
            return False
        blanks = len(text) - sum(sizes) - len(sizes)
        return blanks < self.longest or not re.search(rf"\s{{{self.longest + 1}}}", text)

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.added) or not self._is_cut(text):
            return self.whole(text)
        return np.array(self.merges.encode_ordinary(text), "<u4").tobytes()


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``window`` ids: full windows, then the rest. With ``keep_ids`` also ids."""

    def run(batches):
        import pyarrow as pa

        encode, end = Encoder.of(tokenizer), np.array([END_ID], "<u4").tobytes()
        names = [c.split()[0] for c in PIECE.split(", ")]
        schema = pa.schema([(n, pa.int64()) for n in names] + [("ids", pa.list_(pa.int64()))] * keep_ids)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encode(text.as_py() or "") + end
                n = len(data) // 4
                for start in range(0, n, window):
                    piece = data[4 * start : 4 * (start + window)]
                    ids = [np.frombuffer(piece, "<u4").astype(np.int64)] if keep_ids else []
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n, *ids))
                    if len(rows) == 20_000:
                        yield batch_of(rows)
                        rows = []
            if rows:
                yield batch_of(rows)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE + (", ids array<bigint>" if keep_ids else ""))


# --- plan --------------------------------------------------------------------------------------------


def combinations(bins: int, depth: int) -> np.ndarray:
    """All ways to fill ``bins`` with up to ``depth`` bin sizes, each row padded with zeros."""

    def fill(rest: int, most: int, left: int):
        if rest <= most:
            yield [rest]
        if left > 1:
            for size in range(min(most, rest - 1), 0, -1):
                if size * left >= rest:
                    yield from ([size, *more] for more in fill(rest - size, size, left - 1))

    rows = [row + [0] * (depth - len(row)) for row in fill(bins, bins, depth)]
    return np.array(rows)


def least_squares(combos: np.ndarray, wanted: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of ``combos`` that minimise |A x - wanted|, A counting the bins of each.

    Projected gradient steps with momentum; A is applied through the rows of ``combos``.
    """
    bins = len(wanted)

    def used(x):
        out = np.zeros(bins)
        for column in combos.T:
            out += np.bincount(column, x, bins)
        out[0] = 0
        return out

    def back(r):
        return sum(np.where(column > 0, r[column], 0.0) for column in combos.T)

    v = np.ones(len(combos))
    for _ in range(20):
        v = back(used(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(used(v))))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(used(y) - wanted))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x


def plan(histogram: dict[int, int], bins: int, depth: int = DEPTH) -> list[tuple[list[int], int]]:
    """(bins of a sequence, times) so that every piece counted in ``histogram`` has one place.

    The rounded solution of the least squares first; the pieces it leaves are packed greedily by count:
    the largest, then again the largest that still fits, as often as the counts allow at once.
    """
    left = np.zeros(bins + 1, np.int64)
    for size, n in histogram.items():
        left[size] = n
    combos = combinations(bins, depth)
    combos = combos[(left[combos] > 0)[:, 0] & ((left[combos] > 0) | (combos == 0)).all(1)]
    out: list[tuple[list[int], int]] = []
    if len(combos):
        counts = least_squares(combos, left.astype(float))
        for s in np.argsort(-counts, kind="stable"):
            sizes = [int(c) for c in combos[s] if c]
            times = min([int(counts[s] + 0.5)] + [int(left[c]) // k for c, k in Counter(sizes).items()])
            if times > 0:
                out.append((sizes, times))
                np.subtract.at(left, sizes, times)
    while left.any():
        room, sizes, rest = bins, [], left.copy()
        while (fits := np.flatnonzero(rest[1 : room + 1])).size:
            size = int(fits[-1]) + 1
            k = int(min(rest[size], room // size))
            sizes += [size] * k
            rest[size] -= k
            room -= k * size
        times = min(int(left[c]) // k for c, k in Counter(sizes).items())
        out.append((sizes, times))
        np.subtract.at(left, sizes, times)
    return out


def packed(pieces: DataFrame, window: int = WINDOW, width: int = BIN, depth: int = DEPTH, block_rows: int = 10_000) -> DataFrame:
    """Add sequence_id and offset to ``pieces``, a written table.

    Lengths are counted in bins of ``width``; only this histogram (``window / width`` rows) is seen by the
    driver, which makes the plan. Pieces are numbered within their bin block by block, with one row per block
    in the window of a bin, and find their place in the plan by that number.
    """
    bins = window // width
    pieces = pieces.withColumn("_bin", F.ceil(F.col("length") / width).cast("int"))
    total = pieces.count()
    blocks = max(1, total // block_rows + 1)
    # By the row itself, since rows may repeat; ``pieces`` are read from where they were written.
    pieces = pieces.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    counts = checkpointed(pieces.groupBy("_bin", "_block").agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("_bin").agg(F.sum("n")).collect()}

    places: dict[int, list[tuple[int, int, int, int]]] = {}  # by bin: first number, first sequence, copies in each, slot
    taken, sequence = Counter(), 0
    for sizes, times in plan(histogram, bins, depth):
        for slot, (size, k) in enumerate(Counter(sizes).items()):
            places.setdefault(size, []).append((taken[size], sequence, k, slot))
            taken[size] += k * times
        sequence += times
    rows = [(size << 44 | a, a, b, k, slot) for size, own in sorted(places.items()) for a, b, k, slot in own]
    table = np.array(rows, np.int64).reshape(-1, 5)

    before = Window.partitionBy("_bin").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_bin", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_bin", "_block").orderBy("doc_id", "start", "ids_crc32", "length")
    numbered = pieces.withColumn("_rank", F.row_number().over(inside)).join(F.broadcast(base) if blocks < 1000 else base, ["_bin", "_block"])
    numbered = numbered.withColumn("_rank", F.col("_rank") - 1 + F.col("_base")).drop("_base", "_block")

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            size, rank = batch.column("_bin").to_numpy().astype(np.int64), batch.column("_rank").to_numpy()
            own = table[np.searchsorted(table[:, 0], size << 44 | rank, "right") - 1]
            kept = [c for c in batch.schema.names if c not in ("_bin", "_rank")]
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(own[:, 2] + (rank - own[:, 1]) // own[:, 3]), pa.array(own[:, 4])]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "_slot"])

    kept = [f"`{n}` {t}" for n, t in numbered.dtypes if n not in ("_bin", "_rank")]
    placed = numbered.mapInArrow(place, ", ".join([*kept, "sequence_id bigint", "_slot bigint"]))
    earlier = Window.partitionBy("sequence_id").orderBy("_slot", "doc_id", "start", "ids_crc32", "length")
    offset = F.coalesce(F.sum("length").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("offset", offset).drop("_slot")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``window`` ids.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    ``keep_ids`` the ids. Documents end with id 1. Those longer than the window give full windows and a
    rest; the rest isn't cut further.

    NULL and empty texts are the single id 1. Repeated rows are packed as often as they occur. An empty
    table gives no rows. Only doc_id and text are read.
    """
    return packed(checkpointed(token_pieces(docs, tokenizer, window, keep_ids)), window)
