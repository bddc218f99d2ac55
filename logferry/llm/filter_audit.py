"""How five filters overlap: what each removes at each place in each order, per part of the corpus.

Every document is reduced to five bits (which filters it fails). Counts of the 32 patterns, for all documents, the
good and the toxic ones, are all that any order of the filters depends on: reshaped to 2x2x2x2x2, a contraction
with a vector per axis gives a number, [1, 0] for "passes", [0, 1] for "fails" and [1, 1] for "all".

A NULL text is an empty one, a NULL source the part ''. Identical texts are told by their SHA-256. A row without
doc_id is no copy and nobody's original is looked up by it; rows that repeat a doc_id and its text are not copies of
each other. A document is good or toxic if any of its labels says so. No documents, no rows.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logferry.llm.common import chunks

FILTERS = "ABCDE"
BLOCK_BYTES = 4 << 20

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_CODE_POINT = (_BYTES & 0xC0) != 0x80
_SIGN = np.isin(_BYTES, list(b"#$%&*|"))  # fixed values


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(flags)]
    return sums[offsets[1:]] - sums[offsets[:-1]]


def failed(texts: list[bytes]) -> np.ndarray:
    """Bits 0 to 3 for the filters A to D of each text; E needs all texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    words = [t.split() for t in texts]  # bytes split at the six ASCII blanks only
    n = np.array([len(w) for w in words])
    distinct = np.array([len(set(w)) for w in words])
    upper, points, signs = (_per_text(c[data], offsets) for c in (_UPPER, _CODE_POINT, _SIGN))
    bits = [n < 50, 100 * distinct < 65 * n, 100 * upper > 5 * points, signs > 0]
    return sum(b.astype(np.int32) << i for i, b in enumerate(bits))


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, part, the bits of A to D and the digest of the text, a narrow row per document."""

    def mark(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            masks = [failed(texts[b:e]) for b, e in chunks([len(t) for t in texts], BLOCK_BYTES)]
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.concatenate([*masks, np.zeros(0, np.int32)]), pa.int32()), digests],
                names=["doc_id", "part", "mask", "digest"],
            )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.col("text").cast("binary").alias("text"),
    )
    return rows.mapInArrow(mark, "doc_id bigint, part string, mask int, digest binary")


def pattern_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters they fail, all five.

    Rows are summed before every shuffle, by text and document first, then by text: a text that a third of all
    rows repeat is a few rows per part in the end, and only these meet what is known of the text.
    """
    said = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    own = marked(docs).groupBy("digest", "part", "mask", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    own = own.join(said, "doc_id", "left").select("digest", "part", "mask", "doc_id", "n", *flags)
    # Per text and kind: its rows, and those of them that have its smallest id or none.
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    kinds = own.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), least.alias("least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id")
    )
    texts = kinds.groupBy("digest").agg(F.min("least.doc_id").alias("original"))
    first = F.when(F.col("least.doc_id") == F.col("original"), F.col("least.n")).otherwise(0)
    kinds = kinds.join(texts, "digest").withColumn("first", F.coalesce(first, F.lit(0)) + F.col("no_id"))
    both = F.array(
        F.struct(F.col("mask").alias("m"), F.col("first").alias("k")),
        F.struct((F.col("mask") + 16).alias("m"), (F.col("n") - F.col("first")).alias("k")),
    )
    split = kinds.select("part", "good", "toxic", F.inline(both)).where("k > 0")
    return split.groupBy("part", F.col("m").alias("mask"), "good", "toxic").agg(F.sum("k").alias("n"))


# --- contractions ------------------------------------------------------------------------------------

_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)


def selectors(orders: list[str], choose) -> list[np.ndarray]:
    """For each axis (orders * steps, 2): ``choose(place of the axis's filter, place of the step's)``."""
    return [
        np.array([choose(o.index(f), step) for o in orders for step in range(len(o))], np.int64) for f in FILTERS
    ]


def contracted(tensor: np.ndarray, vectors: list[np.ndarray]) -> np.ndarray:
    """(parts, 2, 2, 2, 2, 2) and a vector per axis and step -> (parts, steps)."""
    return np.einsum("pabcde,sa,sb,sc,sd,se->ps", tensor, *vectors, optimize="greedy")


def audited(counts: np.ndarray, orders: list[str]) -> dict[str, np.ndarray]:
    """From counts (parts, 3: all, good, toxic; 2, 2, 2, 2, 2) the numbers of each part, order and step."""
    kept = selectors(orders, lambda own, at: _PASS if own <= at else _ALL)
    removed = selectors(orders, lambda own, at: _PASS if own < at else _FAIL if own == at else _ALL)
    fails = selectors(orders, lambda own, at: _FAIL if own == at else _ALL)
    alone = selectors(orders, lambda own, at: _FAIL if own == at else _PASS)
    everyone, good, toxic = counts[:, 0], counts[:, 1], counts[:, 2]
    out = {"kept": contracted(everyone, kept), "removed": contracted(everyone, removed)}
    out["redundant"] = contracted(everyone, fails) - out["removed"]
    out["unique_fails"] = contracted(everyone, alone)
    out["good_lost"], out["toxic_lost"] = contracted(good, removed), contracted(toxic, removed)
    letters = np.array([FILTERS.index(f) for o in orders for f in o])
    totals = np.stack([out["removed"][:, letters == i].sum(axis=1) for i in range(len(FILTERS))], axis=1)
    out["shapley"] = totals[:, letters]
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of (part, filter_order, step) with the counts of :func:`audited`; all orders, zeros included."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    cells = F.collect_list(F.struct("mask", "good", "toxic", "n"))  # 128 at most
    parts = pattern_counts(docs, labels).groupBy("part").agg(cells.alias("cells"))

    def contract(batches):
        import pyarrow as pa

        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for at in range(0, len(rows), 64):
                some = rows[at : at + 64]
                counts = np.zeros((len(some), 3, 32), np.int64)
                for i, (_, cells) in enumerate(some):
                    for c in cells:
                        counts[i, :, c["mask"]] += np.array([1, c["good"], c["toxic"]]) * c["n"]
                # Bit 0 is the last axis of the reshaped array and filter A the first of the contraction.
                tensor = counts.reshape(len(some), 3, 2, 2, 2, 2, 2).transpose(0, 1, 6, 5, 4, 3, 2)
                found = audited(tensor, orders)
                n_rows = len(orders) * len(FILTERS)
                columns = {
                    "part": [p for p, _ in some for _ in range(n_rows)],
                    "filter_order": [o for o in orders for _ in FILTERS] * len(some),
                    "step": pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(some) * len(orders))),
                } | {n: pa.array(found[n].ravel()) for n in names}
                yield pa.RecordBatch.from_pydict(columns)

    schema = "part string, filter_order string, step int, " + ", ".join(f"{n} bigint" for n in names)
    return parts.mapInArrow(contract, schema)


ORACLE = r"""
with said as (
  select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels group by doc_id),
docs as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
masked as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    case when len(words) < 50 then 1 else 0 end
    + case when 100 * len(list_distinct(words)) < 65 * len(words) then 2 else 0 end
    + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) then 4 else 0 end
    + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end
    + case when docs.doc_id > min(docs.doc_id) over (partition by text) then 16 else 0 end as mask
  from docs left join said using (doc_id)),
counts as (
  select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from masked group by part, mask),
letters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as l(f, b)),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits
  from letters a, letters b, letters c, letters d, letters e
  where a.f <> b.f and a.f <> c.f and a.f <> d.f and a.f <> e.f and b.f <> c.f and b.f <> d.f and b.f <> e.f
    and c.f <> d.f and c.f <> e.f and d.f <> e.f),
steps as (
  select filter_order, step, bits[step] as own, coalesce(list_sum(bits[1:step - 1]), 0) as before
  from orders, (select unnest([1, 2, 3, 4, 5]) as step)),
found as (
  select part, filter_order, step, own,
    sum(n) filter (mask & cast(before + own as int) = 0) as kept,
    sum(n) filter (mask & cast(before as int) = 0 and mask & own <> 0) as removed,
    sum(n) filter (mask & own <> 0) as fails, sum(n) filter (mask = own) as alone,
    sum(good) filter (mask & cast(before as int) = 0 and mask & own <> 0) as good,
    sum(toxic) filter (mask & cast(before as int) = 0 and mask & own <> 0) as toxic
  from counts, steps group by part, filter_order, step, own)
select part, filter_order, cast(step as int) as step, cast(coalesce(kept, 0) as bigint) as kept,
  cast(coalesce(removed, 0) as bigint) as removed, cast(coalesce(fails, 0) - coalesce(removed, 0) as bigint) as redundant,
  cast(coalesce(alone, 0) as bigint) as unique_fails, cast(coalesce(good, 0) as bigint) as good_lost,
  cast(coalesce(toxic, 0) as bigint) as toxic_lost,
  cast(coalesce(sum(removed) over (partition by part, own), 0) as bigint) as shapley
from found
"""
