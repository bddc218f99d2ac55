"""Text quality by a vote of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logferry.llm.common import checkpointed, small

PER_LABEL, RANK, NEIGHBOURS, SHARPNESS, CUT = 2000, 48, 25, 30, 0.7  # PER_LABEL bounds the labelled sample
_KINDS, _RATIOS = 16, 24
TERMS = _KINDS**3 + _RATIOS


def _kinds() -> np.ndarray:
    """The kind of each byte; beyond those named, 15."""
    kinds = np.full(256, 15, np.uint16)
    for kind, own in enumerate((b" \t", b"\n\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", bytes(range(0xC0, 0x100)),
                                bytes(range(0x80, 0xC0)), b".", b",;", b"!?", b"#", b"|", b"*$%&<>", b"\"'()[]{}", b"-_/:=+")):
        kinds[list(own)] = kind
    return kinds


_KIND = _kinds()


def terms(text: str | None) -> np.ndarray:
    """Counts of the terms of a whole text: triples of kinds of bytes, how far it can be compressed."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(TERMS, np.float32)
    if data:
        k = _KIND[np.frombuffer(data, np.uint8)]
        if len(k) > 2:
            out[: _KINDS**3] = np.bincount((k[:-2] << 8) | (k[1:-1] << 4) | k[2:], minlength=_KINDS**3)
        if len(data) >= 100:  # shorter texts can't be compressed, whatever they say
            ratio = len(zlib.compress(data, 1)) / (len(data) + 8)
            out[_KINDS**3 + min(_RATIOS - 1, int(ratio * _RATIOS))] = 6
    return out


@dataclass
class Voters:
    """Labelled vectors and what takes a text to them; its size is bounded by the sample and the rank."""

    idf: np.ndarray
    axes: np.ndarray  # (terms, rank)
    vectors: np.ndarray  # (labelled, rank), unit length, in the order of doc_id
    labels: np.ndarray
    without_terms: float  # the score of a text that has no terms

    def vectors_of(self, counts: np.ndarray) -> np.ndarray:
        v = (np.log1p(counts) * self.idf) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The share of label 1 among the nearest labelled vectors, weighted by similarity; 0.5 without any.

        Of equally similar ones those with the smaller doc_id vote.
        """
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        counts = np.stack([terms(t) for t in texts])
        alike = self.vectors_of(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        least = np.partition(alike, len(self.labels) - k, axis=1)[:, [len(self.labels) - k]]
        over, tied = alike > least, alike == least
        chosen = over | (tied & (np.cumsum(tied, axis=1) <= k - over.sum(1, keepdims=True)))
        top = np.nonzero(chosen)[1].reshape(len(alike), k)
        weight = np.maximum(np.take_along_axis(alike, top, 1).astype(np.float64), 1e-6) ** SHARPNESS
        voted = np.clip((weight * self.labels[top]).sum(1) / weight.sum(1), 0, 1)
        return np.where(counts.any(1), voted, self.without_terms)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, rank: int = RANK) -> Voters:
    """Voters from about ``per_label`` documents of each label, chosen by a hash; only their terms are collected.

    The space is the truncated singular value decomposition of the weighted terms of the sample.
    """
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    place = (F.xxhash64(F.lit(3), "doc_id").cast("double") / 2.0**64) + 0.5
    share = sum((F.when(F.col("quality") == q, F.lit(min(1.0, per_label / n))).otherwise(0.0) for q, n in counts.items()), F.lit(0.0))
    chosen = small(checkpointed(known.where(place <= share)))  # bounded, so the texts stay where they are
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "quality")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            found = [terms(t.as_py()).astype(np.float32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.float64()), pa.array(found, pa.binary())], names=["doc_id", "quality", "terms"])

    rows = sorted(tuple(r) for r in sample.mapInArrow(count, "doc_id bigint, quality double, terms binary").toLocalIterator())
    if not rows:
        return Voters(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    x = np.stack([np.frombuffer(r[2], np.float32) for r in rows])
    labels = np.array([r[1] for r in rows])
    # A text without terms has no direction; it is judged as labelled ones without terms are, if there are any.
    bare = ~x.any(1)
    without_terms = float(labels[bare].mean()) if bare.any() else 0.0
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.1).astype(np.float32)
    x = np.log1p(x) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    rank = min(rank, *x.shape)
    # Randomised range finder with power steps, then an exact decomposition in the small range.
    q = np.linalg.qr(x @ np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 16, len(x)))).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)
    voters = Voters(idf, axes, np.zeros((0, rank), np.float32), labels, without_terms)
    voters.vectors = voters.vectors_of(np.stack([np.frombuffer(r[2], np.float32) for r in rows]))
    return voters


def score(docs: DataFrame, voters: Voters, cut: float = CUT) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs`` (doc_id, text): whole texts, in blocks of documents.

    NULL texts and those of less than three bytes have no terms; their score is the share of label 1 among
    labelled texts without terms, 0 if there are none. Without labelled documents every score is 0.5. Repeated rows are scored each.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a in range(0, batch.num_rows, 256):
                found = voters.scores([t.as_py() for t in texts.slice(a, 256)])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, 256), pa.array(found), pa.array((found >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, predicted int")
