"""Language by interpolated Kneser-Ney models of characters, held in sorted hash arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logferry.llm.common import chunks, mixed

ORDER, DISCOUNT, SLACK = 4, 0.75, 3.0
LENGTHS, FEWEST = (32, 128, 512), 20  # symbols at which classes of length begin; documents from which a class has its own limit
PER_LANGUAGE, MAX_LANGUAGES = 600, 1000  # the bound of the training sample: documents of each language, and languages
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Symbols:
    """Code points as symbols: lower-cased letters as they are, all else as one symbol (0)."""

    def __init__(self):
        self.table = np.full(0x110000, -1, np.int32)

    def of(self, points: np.ndarray) -> np.ndarray:
        out = self.table[points]
        if (out < 0).any():
            for p in np.unique(points[out < 0]):
                c = chr(p)
                low = c.lower()
                self.table[p] = (ord(low) if len(low) == 1 else p) if c.isalpha() else 0
            out = self.table[points]
        return out


_SYMBOLS = _Symbols()


def grams(texts: list[str], order: int = ORDER) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the grams of 1 to ``order`` symbols that end at each position, its text and its place there.

    A text is its letters with one symbol for each stretch of others, and one at its end. Grams that would
    reach over the start of their text are 0, which stands for none.
    """
    joined = "\n".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    symbols = _SYMBOLS.of(points)
    keep = symbols != 0
    keep[1:] |= (symbols[:-1] != 0) | (owner[1:] != owner[:-1])
    symbols, owner = symbols[keep].astype(np.uint64) + np.uint64(1), owner[keep]
    begin = np.searchsorted(owner, np.arange(len(texts)))
    place = np.arange(len(owner)) - begin[owner]
    out, h = [], np.zeros(len(symbols), np.uint64)
    for n in range(order):
        shifted = np.zeros(len(symbols), np.uint64)
        shifted[n:] = symbols[: len(symbols) - n]
        h = h + shifted * _BASE ** np.uint64(2 * n + 1)
        out.append(np.where(place >= n, mixed(h + np.uint64(n + 1)), np.uint64(0)))
    return out, owner, place


@dataclass
class Model:
    """Sorted gram hashes, and log-probabilities and log-backoffs of each in every language."""

    languages: list[str]
    keys: np.ndarray
    log_p: np.ndarray  # (keys, languages)
    log_backoff: np.ndarray
    unseen: np.ndarray  # log-probability of a symbol that a language has never seen
    limits: np.ndarray  # (classes of length, languages) largest cross-entropy that is not rejected
    slack: np.ndarray  # what is added to a limit that isn't a class's own, over the root of the number of symbols

    def find(self, grams_: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, grams_), len(self.keys) - 1)
        return np.where(self.keys[at] == grams_, at, -1)

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) nats per symbol, and the number of symbols."""
        by_order, owner, place = grams(texts)
        n = np.bincount(owner, minlength=len(texts))
        total = np.zeros((len(texts), len(self.languages)))
        todo, extra = np.arange(len(owner)), np.zeros((len(owner), len(self.languages)), np.float32)
        for order in range(len(by_order), 0, -1):
            at = self.find(by_order[order - 1][todo])
            hit = at >= 0
            extra[todo[hit]] += self.log_p[at[hit]]
            todo = todo[~hit]
            if order > 1 and todo.size:  # back off from the context, the gram that ends one symbol earlier
                context = self.find(np.where(place[todo] > 0, by_order[order - 2][todo - 1], np.uint64(0)))
                seen = context >= 0
                extra[todo[seen]] += self.log_backoff[context[seen]]
        extra[todo] += self.unseen
        for k in range(len(self.languages)):
            total[:, k] = np.bincount(owner, extra[:, k], len(texts))
        return -total / np.maximum(n, 1)[:, None], n

    def classify(self, texts: list[str | None]) -> list[tuple]:
        """(language or und, score, cross-entropy, rejected) of each text."""
        texts = [t or "" for t in texts]
        h, n = self.cross_entropy(texts)
        best = h.argmin(1)
        least = h[np.arange(len(texts)), best]
        score = 1 / np.exp(np.clip((least[:, None] - h) * np.minimum(n, 200)[:, None], -60, 0)).sum(1)
        lettered = [any(c.isalpha() for c in t) for t in texts]
        kind = np.searchsorted(LENGTHS, n, "right")
        limit = self.limits[kind, best] + self.slack[kind, best] / np.sqrt(np.maximum(n, 1))  # short texts scatter more
        return [
            (self.languages[b], float(s), float(e), bool(e > top)) if ok else ("und", 0.0, None, True)
            for b, s, e, top, ok in zip(best, score, least, limit, lettered)
        ]


def kneser_ney(languages: list[str], rows: list[tuple], discount: float = DISCOUNT) -> Model:
    """The model of ``rows`` (language index, order, gram, context, suffix, count).

    The probability of the highest order takes counts, those below the number of different symbols seen
    before a gram; each order gives ``discount`` of every gram to the order below. A gram that some
    language has seen is stored with the probability in every language, backed off where one hasn't.
    """
    size, top = len(languages), max((r[1] for r in rows), default=1)
    gram = np.array([r[2] for r in rows], np.int64).view(np.uint64)
    context = np.array([r[3] for r in rows], np.int64).view(np.uint64)
    suffix = np.array([r[4] for r in rows], np.int64).view(np.uint64)
    lang, order, count = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 5))
    keys, at = np.unique(gram, return_inverse=True)
    counts = np.zeros((len(keys), size))
    counts[at, lang] = count
    level = np.zeros(len(keys), np.int64)
    level[at] = order
    ctx, suf = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
    ctx[at], suf[at] = context, suffix
    to_suffix = np.where(level > 1, np.searchsorted(keys, suf), -1)
    to_context = np.where(level > 1, np.searchsorted(keys, ctx), -1)
    kinds = (counts > 0).astype(float)
    for n in range(top, 1, -1):  # below the highest order: in how many ways a gram is continued to the left
        own = level == n
        continued = np.zeros_like(counts)
        np.add.at(continued, to_suffix[own], kinds[own])
        counts[level == n - 1] = continued[level == n - 1]
        kinds = (counts > 0).astype(float)
    p, backoff = np.zeros_like(counts), np.ones_like(counts)
    first = level == 1
    symbols = first.sum() + 1
    whole, kinds1 = counts[first].sum(0), (counts[first] > 0).sum(0)
    spare = np.where(whole > 0, discount * kinds1 / np.maximum(whole, 1), 1.0)
    p[first] = np.maximum(counts[first] - discount, 0) / np.maximum(whole, 1) + spare / symbols
    for n in range(2, top + 1):
        own = np.flatnonzero(level == n)
        total, different = np.zeros_like(counts), np.zeros_like(counts)
        np.add.at(total, to_context[own], counts[own])
        np.add.at(different, to_context[own], (counts[own] > 0).astype(float))
        share = np.where(total > 0, discount * different / np.maximum(total, 1), 1.0)
        contexts = level == n - 1
        backoff[contexts] = share[contexts]
        up = to_context[own]
        p[own] = np.maximum(counts[own] - discount, 0) / np.maximum(total[up], 1) + share[up] * p[to_suffix[own]]
    return Model(
        languages, keys, np.log(p).astype(np.float32), np.log(backoff).astype(np.float32),
        np.log(spare / symbols).astype(np.float32), np.full((len(LENGTHS) + 1, size), np.inf),
        np.full((len(LENGTHS) + 1, size), SLACK),
    )


def _sample(docs: DataFrame, per_language: int, salt: int) -> tuple[DataFrame, list[str]]:
    """About ``per_language`` documents of each language, chosen by a hash of the id, all if there are fewer."""
    counts = docs.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(r[0] for r in counts)
    share = docs.sparkSession.createDataFrame(
        [(languages.index(r[0]), r[0], min(1.0, per_language / r[1])) for r in counts], "lang_no int, lang string, share double"
    )
    place = (F.xxhash64(F.lit(salt), "doc_id").cast("double") / 2.0**64) + 0.5
    return docs.join(F.broadcast(share), "lang").where(place <= F.col("share")).select("lang_no", "text"), languages


def train(
    docs: DataFrame, per_language: int = PER_LANGUAGE, order: int = ORDER, spreads: float = 3.0, margin: float = 0.5
) -> Model | None:
    """A model of documents with a language, None if there are none.

    It learns from at most about ``per_language`` documents of each language (a bounded sample, whole
    texts). Grams are counted in tasks and summed by Spark. The cross-entropies of all documents set the limits of
    rejection, one for each language and class of length: the median of the language's own documents, ``spreads``
    times the distance of their quartiles, and ``margin``, so that a few bad documents don't move it. A class of
    fewer than ``FEWEST`` documents has the limit of the whole language, and ``SLACK`` for its length.
    """
    docs = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    sample, languages = _sample(docs, per_language, 1)
    if not languages:
        return None

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            lang, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in chunks([len(t) for t in texts], 1 << 18):
                by_order, owner, place = grams(texts[a:b], order)
                who = lang[a:b][owner].astype(np.uint64)
                parts = []
                for n in range(order):
                    g = by_order[n]
                    zero = np.zeros(len(g), np.uint64)
                    ctx = np.concatenate([zero[:1], by_order[n - 1][:-1]]) if n else zero
                    rows = np.stack([who, zero + np.uint64(n + 1), g, ctx, by_order[n - 1] if n else zero])
                    rows = rows[:, place >= n]
                    _, at, times = np.unique(mixed(rows[2] + rows[0]), return_index=True, return_counts=True)
                    parts.append(np.concatenate([rows[:, at].view(np.int64), times[None].astype(np.int64)]))
                rows = np.concatenate(parts, 1)
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["lang", "n", "gram", "context", "suffix", "times"])

    schema = "lang bigint, n bigint, gram bigint, context bigint, suffix bigint, times bigint"
    counted = sample.mapInArrow(count, schema).groupBy("lang", "n", "gram", "context", "suffix").agg(F.sum("times"))
    model = kneser_ney(languages, [tuple(r) for r in counted.toLocalIterator()])

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in chunks([len(t.as_py()) for t in batch.column(1)], 1 << 18):
                h, n = model.cross_entropy(batch.column(1).slice(a, b - a).to_pylist())
                lang = batch.column(0).slice(a, b - a).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int64)), pa.array(h[np.arange(len(h)), lang]), pa.array(n)], names=["lang", "h", "n"])

    numbers = docs.sparkSession.createDataFrame(list(enumerate(languages)), "lang_no int, lang string")
    kind = sum((F.when(F.col("n") >= least, 1).otherwise(0) for least in LENGTHS), F.lit(0))
    measured = docs.join(F.broadcast(numbers), "lang").select("lang_no", "text").mapInArrow(measure, "lang bigint, h double, n bigint")
    quartiles = F.percentile_approx("h", [0.25, 0.5, 0.75], 10000)
    limits = measured.where("n > 1").rollup("lang", kind.alias("kind")).agg(quartiles.alias("q"), F.count("*").alias("n"))
    for lang, kind, (low, middle, high), n in sorted(limits.where("lang is not null").collect(), key=lambda r: r[1] is not None):
        limit = middle + spreads * (high - low) + margin
        if kind is None:
            model.limits[:, lang] = limit
        elif n >= FEWEST:
            model.limits[kind, lang], model.slack[kind, lang] = limit, 0.0
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected for every row of ``docs`` (doc_id, text).

    The language with the lowest cross-entropy per symbol of the whole text. ``rejected``: that is above the
    limit of the language, or there is no letter. NULL, empty and letterless texts are und, with score
    0 and no cross-entropy; so are all texts if there is no model. Ties go to the first language by name.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in chunks([len(t.as_py() or "") for t in texts], 1 << 18):
                part = texts.slice(a, b - a).to_pylist()
                found = model.classify(part) if model else [("und", 0.0, None, True)] * len(part)
                columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *columns], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, cross_entropy double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` whose text the model does not reject, with all their columns; all without a model.

    Rows are filtered where they are, nothing is shuffled.
    """
    if model is None:
        return docs
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in chunks([len(t.as_py() or "") for t in batch.column(at)], 1 << 18):
                part = batch.slice(a, b - a)
                rejected = [r[3] for r in model.classify(part.column(at).to_pylist())]
                yield part.filter(pa.array([not r for r in rejected]))

    return docs.mapInArrow(run, docs.schema)
