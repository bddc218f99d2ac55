"""op11 to op13 against brute force and SQL, odd rows included."""

import math
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import fixtures
import numpy as np
import pytest
from pyspark.sql import functions as F

from logferry.llm import filter_audit, hamming, importance, queries
from logferry.plans.registry import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def compared(spark, folder, name, sql):
    df = QUERIES[name](spark, folder)
    rel = fixtures.connection(folder).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=key)
    want = sorted((tuple(dict(zip(rel.columns, r))[c] for c in order) for r in rel.fetchall()), key=key)
    assert got == want
    return got


# --- op12 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("positions", [1, 3, 64])
def test_hashes_of_spans(positions):
    rng = np.random.default_rng(positions)
    data = rng.integers(0, 256, 20_000).astype(np.uint8)
    lengths = np.r_[0, 1, positions, positions + 1, 2 * positions, 0, 9000, rng.integers(0, 400, 200)]
    starts = rng.integers(0, 10_000, len(lengths))
    got = importance.SpanHashes(positions)(data, starts, lengths)
    assert got.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, lengths)]
    assert len(importance.SpanHashes()(data, starts[:0], lengths[:0])) == 0


@pytest.mark.parametrize("most", [1, 3])
def test_features_are_runs_of_words(most):
    texts = ["Hello World, 3rd! é中 b_c", "", "a", "  x y", "z" + "q" * 500 + " É", "end", "start", "..."]
    raw = [t.encode() for t in texts]
    offsets = np.r_[0, np.cumsum([len(t) for t in raw])]
    found, owners, n_words = importance.features(
        np.frombuffer(b"".join(raw), np.uint8), offsets, 1, most, 10_000, importance.SpanHashes()
    )
    want = []
    for i, t in enumerate(texts):
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        assert n_words[i] == len(words)
        want += [(i, zlib.crc32(" ".join(words[j : j + k]).encode()) % 10_000) for k in range(1, most + 1) for j in range(len(words) - k + 1)]
    assert sorted(zip(owners.tolist(), found.tolist())) == sorted(want)


def test_importance_by_sql(spark, folder, empty):
    rows = compared(spark, folder, "op12_importance", importance.ORACLE)
    assert any(r[-3] is not None for r in rows)  # columns by name: rank is third from the end
    assert QUERIES["op12_importance"](spark, empty).count() == 0


def test_importance_by_brute_force_with_longer_runs(spark):
    texts = [None, "", *[" ".join(f"w{(i * j) % 17}" for j in range(i)) for i in range(1, 60)]]
    docs = spark.createDataFrame([(None if i == 30 else i, t, "x", "y") for i, t in enumerate(texts)], "doc_id bigint, text string, word string, n string")
    target = spark.createDataFrame([(0, "w1 w2 w3 w1 w2"), (1, None)], "item_id bigint, text string")

    def grams(t):
        w = WORD.findall(t or "")
        return [zlib.crc32(" ".join(w[j : j + k]).encode()) % 50 for k in (1, 2) for j in range(len(w) - k + 1)]

    s, t = Counter(g for x in texts for g in grams(x)), Counter(grams("w1 w2 w3 w1 w2"))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 50) / ((s[b] + 1) * (sum(t.values()) + 50)))) for b in range(50)}
    got = {r.doc_id: r for r in importance.resampled(docs, target, 30, 5, 1, 2, 50).collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        r = got[None if i == 30 else i]
        assert (r.n_features, r.weight) == (len(grams(x)), sum(gain[g] for g in grams(x)))
    fit = sorted((r for r in got.values() if r.n_words >= 5), key=lambda r: (-r.score, -1 if r.doc_id is None else r.doc_id))
    assert [r.rank for r in fit] == [i + 1 if i < len(fit) * 30 // 100 else None for i in range(len(fit))]
    assert all(r.rank is None for r in got.values() if r.n_words < 5)


def test_importance_without_a_target(spark, folder):
    docs, none = queries.table(spark, folder, "documents"), spark.createDataFrame([], "item_id bigint, text string")
    rows = importance.resampled(docs, none).collect()
    assert len(rows) == len(fixtures.documents()) and all(r.weight <= 0 or r.n_features for r in rows)


# --- op13 --------------------------------------------------------------------------------------------


def brute_audit(rows):
    """One order after another, one filter after another, over lists of documents."""
    least = {}
    for d in rows:
        if d["id"] is not None:
            least[d["text"]] = min(d["id"], least.get(d["text"], d["id"]))
    for d in rows:
        words = [w for w in re.split("[ \t\n\v\f\r]+", d["text"]) if w]
        t = d["text"]
        d["fails"] = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d["id"] is not None and d["id"] > least[t],
        }
    out, shapley = [], Counter()
    for part in {d["part"] for d in rows}:
        own = [d for d in rows if d["part"] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d["fails"][f]]
                left = [d for d in left if not d["fails"][f]]
                fails = [d for d in own if d["fails"][f]]
                shapley[part, f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), len(fails) - len(gone),
                            sum(sum(d["fails"].values()) == 1 for d in fails), sum(d["good"] for d in gone), sum(d["toxic"] for d in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_by_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(f"{'W' if i % 3 else 'w'}{j % (20 + 9 * i)}" for j in range(30 + 7 * i)) + (" #" if i % 4 == 0 else "") for i in range(12)]
    rows = [(i if i % 11 else None, [None, "", " ", *base][rng.integers(15)], [None, "", "a", "b"][rng.integers(4)]) for i in range(400)]
    rows += rows[5:9]
    labels = [(i, [1, 0, None][i % 3], [0, 1][i % 2]) for i in range(0, 400, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, source string, mask string, digest string")
    said = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = filter_audit.audit(docs, said)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    want = brute_audit([
        {"id": i, "text": t or "", "part": s or "", "good": i in good, "toxic": i in toxic} for i, t, s in rows
    ])
    assert sorted(tuple(r) for r in found.collect()) == want


def test_audit_by_sql(spark, folder, empty):
    compared(spark, folder, "op13_filter_audit", filter_audit.ORACLE)
    assert QUERIES["op13_filter_audit"](spark, empty).count() == 0


# --- op11 --------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute_search(rows, step, k):
    own = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            own[i] = min(own.get(i, v), v)
    most = Counter(map(len, own.values())).most_common()
    d = min((-n, size) for size, n in most)[1] if most else 0
    own = {i: np.array(v, float) for i, v in own.items() if len(v) == d}
    out = {}
    for q in (i for i in own if i % step == 0):
        scores = [(-(own[q] @ v) / (np.linalg.norm(own[q]) * np.linalg.norm(v)), i) for i, v in own.items() if i != q]
        out[q] = sorted((round(s, 9), i) for s, i in scores)[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [(round(-s, 9), i) for _, i, s in sorted(v)] for q, v in out.items()}


def test_search_equals_brute_force_on_odd_rows(spark):
    """All codes are within the radius that so few rows need: the result is exact, ties and odd rows included."""
    rng = np.random.default_rng(3)
    draw = lambda: [float(np.float32(x)) for x in rng.standard_normal(12)]
    shared = draw()
    rows = [(i, shared if i % 3 == 0 else draw()) for i in range(300)]
    rows += [(400, None), (410, []), (420, [0.0] * 12), (430, [None, *draw()[1:]]), (440, [math.nan, *draw()[1:]])]
    rows += [(450, [math.inf, *draw()[1:]]), (460, draw()[:5]), (None, draw()), (470, [float(np.float32(x * 1e30)) for x in draw()]), (480, [float(np.float32(x * 1e-30)) for x in draw()])]
    rows += [rows[10], rows[3], (20, draw()), (20, draw())]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], VECTORS + ", shard string, kind string").repartition(5)
    assert found(hamming.search(df, F.col("vec_id") % 10 == 0, shard_rows=100, block_rows=7)) == brute_search(rows, 10, 5)


def test_search_with_few_or_no_rows(spark, empty):
    few = spark.createDataFrame([(0, [1.0, 2.0], 1), (7, [2.0, 1.0], 1)], VECTORS)
    assert found(hamming.search(few, F.col("vec_id") % 50 == 0)) == brute_search([(0, [1.0, 2.0]), (7, [2.0, 1.0])], 50, 5)
    assert hamming.search(few.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0
    assert hamming.search(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hamming.search(few.where("vec_id = 7"), F.col("vec_id") % 50 == 0).count() == 0


def test_every_code_within_the_radius_is_retrieved():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 1 << 63, (4000, 4), dtype=np.int64).astype(np.uint64)
    codes[::7] = codes[0] ^ (np.uint64(1) << rng.integers(0, 60, (len(codes[::7]), 4)).astype(np.uint64))
    index = hamming.MultiIndex(codes)
    for i, wanted in ((0, 1), (0, 50), (7, 2000), (5, 1), (5, 300), (9, 4000), (9, 9000)):
        d = np.bitwise_count(codes ^ codes[i]).sum(axis=1)
        radius = np.sort(d)[min(wanted, len(d)) - 1]
        assert sorted(index.within(codes[i], wanted)) == np.flatnonzero(d <= radius).tolist()


def test_recall_on_the_given_vectors(spark):
    """Against brute force; rows of the given table are independent of each other, the hardest case."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute_search(rows, 50, 5)
    got = found(hamming.search(df, F.col("vec_id") % 50 == 0, wanted=64))
    hit = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert got.keys() == want.keys() and hit >= 0.9 * 5 * len(want)
