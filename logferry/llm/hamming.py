"""Nearest neighbours by multi-index hashing: learned binary codes, an index per substring, floats at the end.

Vectors are rotated by matrices that iterative quantization has learned, and the signs are their codes. A code
is cut into substrings of 16 bits, and each substring has its index. If two codes differ in fewer than
``m * (t + 1)`` bits, one of their ``m`` substrings differs in ``t`` at most, so probing all values within t of
a query's substrings retrieves every code within that radius. Per query and shard the radius grows until it holds
``wanted`` codes; all codes within it, however many, are compared by the cosine of the original vectors.

The index holds every row. It lies in shards dealt by vec_id; queries come in blocks, and a task holds one shard
while it reads one block, so neither memory nor time of a task grows with the input, and a vector that a third of
all rows share is spread over all shards like any other.

Rows without vec_id, and vectors that are NULL, empty, zero or hold NULL or non-finite components, take no part,
nor do vectors of another length than most have (of two lengths as frequent, the smaller one). Repeated rows of a
vec_id count once; if they differ, the first in the order of arrays counts. Rows with the same vector are
neighbours of each other. Without candidates there are no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logferry.llm.common import checkpointed

BITS = 256
SUBSTRING = 16  # bits of a substring
FIT_ROWS = 16_384  # at most so many vectors come to the driver to learn the rotations
SHARD_ROWS = 65_536
BLOCK_ROWS = 16_384
WANTED = 512
ROUNDS = 25

# --- codes -------------------------------------------------------------------------------------------


def learned(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection with a column per bit) from unit vectors in the rows of ``sample``.

    Each group of bits is a rotation of the principal components of its own: iterative quantization turns it
    until the signs lie as near to the components as they can. Groups start from different rotations.
    """
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    rng = np.random.default_rng(0)
    columns: list[np.ndarray] = []
    while sum(c.shape[1] for c in columns) < bits:
        width = min(sample.shape[1], bits - sum(c.shape[1] for c in columns))
        axes = vectors[:, ::-1][:, :width]
        components = centred @ axes
        rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(rounds):
            signs = np.where(components @ rotation >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(components.T @ signs)
            rotation = u @ vt
        columns.append(axes @ rotation)
    return mean, np.concatenate(columns, axis=1)


def encoded(vectors: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(rows, bits / 64) words of 64 bits for unit vectors."""
    mean, projection = model
    bits = (vectors - mean) @ projection >= 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def by_popcount(width: int = SUBSTRING) -> list[np.ndarray]:
    """For t = 0, 1, ...: all values of a substring with t bits set."""
    values = np.arange(1 << width, dtype=np.int32)
    counts = np.bitwise_count(values)
    return [values[counts == t] for t in range(width + 1)]


class MultiIndex:
    """The codes of a shard, by the value of each of their substrings."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        parts = codes.view(np.uint16)
        n, self.m = parts.shape
        values = 1 << SUBSTRING
        # Rows in the order of each substring, one substring after another, and where each value starts.
        self._rows = np.empty(self.m * n, np.int32)
        self._starts = np.empty(self.m * (values + 1), np.int32)
        for j in range(self.m):
            order = np.argsort(parts[:, j], kind="stable")
            self._rows[j * n : (j + 1) * n] = order
            self._starts[j * (values + 1) : (j + 1) * (values + 1)] = j * n + np.searchsorted(parts[order, j], np.arange(values + 1))
        self._bases = np.arange(self.m, dtype=np.int32)[:, None] * (values + 1)
        self._rings = by_popcount()

    def _held(self, keys: np.ndarray) -> np.ndarray:
        """Rows in the buckets at ``keys``, places in the table of starts; a row may come several times."""
        begin, end = self._starts.take(keys), self._starts.take(keys + 1)
        full = np.flatnonzero(begin < end)
        begin = begin[full]
        sizes = end[full] - begin
        ends = np.cumsum(sizes)
        return self._rows.take(np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + sizes, sizes))

    def within(self, code: np.ndarray, wanted: int) -> np.ndarray:
        """Rows of all codes within the smallest radius that holds ``wanted`` of them, or of all codes.

        Rings of growing distance t are probed a few substrings at a time. When ring t is done in the
        first j substrings and ring t - 1 in all, a code that was not retrieved differs in m * t + j bits
        at least.
        """
        n = len(self.codes)
        seen = np.zeros(n, bool)
        rows, distances = [], []
        counts = np.zeros(64 * self.codes.shape[1] + 1, np.int64)  # codes retrieved, by distance
        own = code.view(np.uint16).astype(np.int32)[:, None]
        found, radius = 0, 0
        for t, ring in enumerate(self._rings):
            at_once = 4 if len(ring) > 500 else self.m
            for first in range(0, self.m, at_once):
                some = slice(first, first + at_once)
                hit = np.zeros(n, bool)
                hit[self._held(((own[some] ^ ring) + self._bases[some]).ravel())] = True
                new = np.flatnonzero(hit & ~seen)
                seen[new] = True
                rows.append(new)
                distances.append(np.bitwise_count(self.codes[new] ^ code).sum(axis=1, dtype=np.int64))
                counts += np.bincount(distances[-1], minlength=len(counts))
                found += len(new)
                radius = len(counts) if found == n else self.m * t + min(first + at_once, self.m)
                if found == n or counts[:radius].sum() >= wanted:
                    rows, distances = np.concatenate(rows), np.concatenate(distances)
                    least = np.searchsorted(np.cumsum(counts[:radius]), wanted)
                    return rows[distances <= least]
        raise AssertionError("all rings together hold all codes")


# --- search ------------------------------------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, one per vec_id."""
    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = own.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    lengths = own.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.agg(F.max(F.struct("n", (-F.col("d")).alias("d"))).alias("m")).first().m
    own = own.where(F.size("embedding") == (-most.d if most else 0))
    return own.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _dealt(n: int) -> Column:
    return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths; by their largest component first, so that no square leaves the doubles."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, wanted: int = WANTED, bits: int = BITS,
    fit_rows: int = FIT_ROWS, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found of each row with ``is_query``.

    The rotations are learned from ``fit_rows`` vectors at most, those with the smallest hash of their id.
    """
    own = checkpointed(usable(vectors))
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    sample = own.orderBy(F.xxhash64("vec_id", F.lit("fit")), "vec_id").limit(fit_rows).select("embedding").toArrow()
    if not sample.num_rows:
        return vectors.sparkSession.createDataFrame([], schema)
    model = learned(_unit(_matrix(sample.column(0).combine_chunks())), bits)
    queries = own.where(is_query)
    n_queries, n_shards = queries.count(), -(-own.count() // shard_rows)
    # Blocks change nothing in the result: few queries are cut finer, so that all tasks have some.
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(1, -(-n_queries // block_rows), min(-(-n_queries // 64), tasks // n_shards))

    def over(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    index = own.select(_dealt(n_shards).alias("shard"), over(n_blocks).alias("block"), F.lit(0).alias("kind"), "vec_id", "embedding")
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), _dealt(n_blocks).alias("block"),
        F.lit(1).alias("kind"), "vec_id", "embedding",
    )
    rows = index.unionByName(asked).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind", "vec_id")

    def probe(batches):
        import pyarrow as pa

        def answered(ids, vectors, multi, own_ids, own_vectors):
            found = []
            codes = encoded(vectors, model)
            for query_id, vector, code in zip(ids.tolist(), vectors, codes):
                near = multi.within(code, wanted + 1)  # the query's own row is among them
                near = near[own_ids[near] != query_id]
                score = (own_vectors[near] * vector).sum(axis=1)  # equal vectors, equal sums
                best = np.lexsort((own_ids[near], -score))[:k]
                found += [(query_id, int(own_ids[i]), float(s)) for i, s in zip(near[best], score[best])]
            if found:
                yield pa.RecordBatch.from_pydict(dict(zip(["query_id", "vec_id", "score"], map(list, zip(*found)))))

        at, parts, built = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, block, kind, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            group = shard.astype(np.int64) * n_blocks + block
            vectors = _unit(_matrix(batch.column(4)))
            cuts = np.flatnonzero(np.diff(group * 2 + kind)) + 1
            for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if group[b] != at:
                    at, parts, built = group[b], [], None
                if kind[b] == 0:
                    parts.append((ids[b:e], vectors[b:e]))
                    continue
                if not parts:
                    continue
                if built is None:
                    own_ids, own_vectors = (np.concatenate(x) for x in zip(*parts))
                    built = MultiIndex(encoded(own_vectors, model)), own_ids, own_vectors
                yield from answered(ids[b:e], vectors[b:e], *built)

    near = rows.mapInArrow(probe, "query_id bigint, vec_id bigint, score double")
    # k rows per query and shard, of which the best k are kept as they come.
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    merged = near.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part")).agg(best.alias("best"))
    merged = merged.select("query_id", F.inline("best")).groupBy("query_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("s", "vec_id"))), 1, k).alias("best")
    )
    return merged.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score")
    )
