"""Helpers that the operators of this folder share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_BYTES = 32 << 20  # a side is broadcast only below this measured size
SHINGLE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that the session names in ``spark.checkpoint.dir``.

    A folder of this process is used only on a local master that names none, as in tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="llm-")
        sc.setCheckpointDir(root)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a copy in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows were measured to be below ``limit``, else as it is."""
    width = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) + 24 for c in df.columns), F.lit(0))
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def inlined(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generator, so that later uses read them and don't compute them again."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


# --- hashes of words and shingles, used inside tasks -------------------------------------------------


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    limit = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_WORDS = WordHashes()


def words_of(text: str | None) -> list[str]:
    """Lower-cased words between white space."""
    return text.lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalising permutation of 64-bit words (SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[str], n: int = SHINGLE) -> np.ndarray:
    """Hashes of the ``n``-word shingles in their order; a shorter text is one shingle, no word none."""
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    if not n:
        return h
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return mixed(out)


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])  # the white space of ASCII, as str.split has it
_WIDE_SPACE = re.compile(r"[^\S\x00-\x7f]")  # all other white space
_HALF, _32 = np.uint64(0xFFFFFFFF), np.uint64(32)
_SECRET = np.frombuffer(
    bytes.fromhex("b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671fcb79e64eccc0e578825ad07dccff7221b8084674f743248e"), "<u8"
)  # of XXH3, its beginning


def _hashed(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hashes that :class:`WordHashes` has (XXH3) of the words of ``size`` bytes, one at least, from ``begin`` on in ``data``.

    Each length up to 16 bytes has one formula, which is taken for all its words at once.
    """
    out = np.empty(len(begin), np.uint64)
    for low, high in ((1, 3), (4, 8), (9, 16)):
        which = np.flatnonzero((size >= low) & (size <= high))
        if not len(which):
            continue
        at, n = begin[which], size[which]
        length = n.astype(np.uint64)
        if high == 3:
            one, two, three = (data[k].astype(np.uint64) for k in (at, at + (n >> 1), at + n - 1))
            h = one << np.uint64(16) | two << np.uint64(24) | three | length << np.uint64(8)
            h ^= (_SECRET[0] & _HALF) ^ (_SECRET[0] >> _32)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
            h ^= h >> _32
        elif high == 8:
            words = np.ndarray(len(data) - 3, "<u4", data, strides=(1,))
            h = words[at + n - 4].astype(np.uint64) + (words[at].astype(np.uint64) << _32)
            h ^= _SECRET[1] ^ _SECRET[2]
            h ^= (h << np.uint64(49) | h >> np.uint64(15)) ^ (h << np.uint64(24) | h >> np.uint64(40))
            h *= np.uint64(0x9FB21C651E98DF25)
            h ^= (h >> np.uint64(35)) + length
            h *= np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(28)
        else:
            words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
            x, y = words[at] ^ (_SECRET[3] ^ _SECRET[4]), words[at + n - 8] ^ (_SECRET[5] ^ _SECRET[6])
            xl, xh, yl, yh = x & _HALF, x >> _32, y & _HALF, y >> _32
            least, inner = xl * yl, xh * yl
            cross = (least >> _32) + (inner & _HALF) + xl * yh
            product = ((inner >> _32) + (cross >> _32) + xh * yh) ^ (cross << _32 | least & _HALF)
            h = length + x.byteswap() + y + product
            h = (h ^ (h >> np.uint64(37))) * np.uint64(0x165667919E3779F9)
            h ^= h >> _32
        out[which] = h
    whole = None
    for k in np.flatnonzero(size > 16).tolist():
        whole = whole or data.tobytes()
        out[k] = xxhash.xxh3_64_intdigest(whole[begin[k] : begin[k] + size[k]])
    return out


def shingled(texts: list[str | None], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The :func:`shingles` of the words of many texts, one text after another, and how many each has."""
    parts = [t.lower() if t else "" for t in texts]
    parts = [(t if t.isascii() else _WIDE_SPACE.sub(" ", t)).encode("utf-8", "surrogatepass") for t in parts]
    data = np.frombuffer(b" ".join([b"", *parts, b" " * 8]), np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[data].view(np.int8))) + 1
    begin, end = edges[::2], edges[1::2]
    h = _hashed(data, begin, end - begin)
    ends = np.searchsorted(begin, np.cumsum([len(p) + 1 for p in parts]) + 1) if parts else np.zeros(0, np.int64)
    words = np.diff(ends, prepend=0)
    first = ends - words
    count = np.where(words > n, words - n + 1, np.minimum(words, 1))
    long = np.repeat(words, count) if len(h) else words[:0]  # of the text of each shingle
    at = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
    out = h[at]
    for i in range(1, n):
        some = slice(None) if not len(long) or long.min() > i else np.flatnonzero(long > i)
        out[some] = out[some] * np.uint64(0x9E3779B97F4A7C15) + h[at[some] + i]
    return mixed(out), count


def chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes sum to about ``most``."""
    begin = total = 0
    for i, s in enumerate(sizes):
        total += s
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


# --- pairs of texts ----------------------------------------------------------------------------------


def compare_texts(
    edges: DataFrame, docs: DataFrame, judge: Callable, schema: str, per_task: int = 256
) -> DataFrame:
    """Rows that ``judge`` finds for pairs of documents, given both texts.

    ``edges`` has leader and member, ``docs`` has doc_id and text. ``judge(leader_state, member_text)``
    returns rows; ``judge(None, leader_text)`` makes the state. The members of a leader are dealt over
    one group per ``per_task`` of them, each with its own copy of the leader's text, and a task reads its
    groups as a sorted stream: it holds one leader's text at a time, whatever the number of members.
    ``schema`` describes the returned rows, which follow leader and member.
    """
    counted = edges.groupBy("leader").agg(F.ceil(F.count("*") / per_task).cast("int").alias("salts"))
    counted = small(checkpointed(counted))  # its own table, so that a join on a frequent leader can be split
    members = edges.join(counted, "leader").select(
        F.col("member").alias("doc_id"), "leader",
        F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"),
    )
    leaders = counted.select(
        F.col("leader").alias("doc_id"), "leader",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"),
    )
    needed = leaders.unionByName(members)
    rows = needed.join(docs.select("doc_id", "text"), "doc_id").select("leader", "salt", "kind", "doc_id", "text")
    rows = rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "kind", "doc_id")
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches):
        import pyarrow as pa

        at, state = None, None
        for batch in batches:
            found = []
            for leader, salt, kind, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if at != (leader, salt):  # repeated rows of the leader change nothing
                        at, state = (leader, salt), judge(None, text)
                    continue
                found += [(leader, doc_id, *row) for row in judge(state, text)]
            if found:
                yield pa.RecordBatch.from_pydict(dict(zip(["leader", "member", *names], map(list, zip(*found)))))

    return rows.mapInArrow(run, f"leader bigint, member bigint, {schema}")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the smallest node connected to it.

    Alternating large-star and small-star steps; each is an aggregation to one row per node and a join,
    on narrow rows, until nothing changes.
    """
    edges = checkpointed(links.select("a", "b").where("a <> b").distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpointed(moved.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(own)
