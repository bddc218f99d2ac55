"""Operators that SQL can't express, against brute force, round trips and held-out accuracy."""

import itertools
import random
import time
import zlib

import fixtures
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from logferry.llm import decontaminate, language, near_dups, packing, passages, quality_vote, queries, urls
from logferry.llm.common import compare_texts, components, shingled, shingles, table, words_of
from logferry.llm.queries import URL_RULES, tokenizer_path

SF = "/root/testdata/sf0.001"


def run(spark, name, folder):
    return entry.queries()[name](spark, folder)


@pytest.mark.parametrize("name", ["op1_urls", "op3_quality_vote", "op5_language", "op6_passages", "op7_packing", "op8_near_duplicates", "pipeline"])
def test_empty_tables(spark, empty, name):
    assert run(spark, name, empty).collect() == []


# --- op1 ---------------------------------------------------------------------------------------------

URLS = [
    "https://a.net/x", "http://NET/", "https://x.net", "https://shop.example.net/en/1?q=/de/", "https://example.net/en", "ftp://example.com/de/",
    "https://a.b.example.com/de/x#y", "https://badexample.com/de/", "https://a.org/fr/", "https://a.org/fr", "https://A.ORG/FR/", None, "", "a.net/x",
    "https://", "https://casino-win.example.org/", "https://www.casino-win.example.org?x", "https://casino-win.example.org.uk/", "https://É.net/é/",
    "https://a.net:80/x", "https://example.net//en/", "x://a://b.net/", "https://a.net/x",
]


def judged(url, rules, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    within = lambda h: host == h or host.endswith("." + h)
    fits = [r for r in rules if within(r.split("/")[0]) and path.startswith(r[r.index("/"):])]
    rule = max(fits, key=len, default=None)
    block = rules[rule] == "block" if rule else any(map(within, listed))
    return host, path, rule, "block" if block else "allow"


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_urls(spark, limit):
    listed = ["casino-win.example.org", "spam.test"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = urls.judge(pages, urls.entries(spark, URL_RULES, listed), limit=limit, shards=3).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == sorted((i, *judged(u, URL_RULES, listed)) for i, u in enumerate(URLS))


def test_colliding_digests():
    array = urls.DigestArray(np.array([5, 5, -3]), [b"a", b"b", b"c"], np.zeros(3))
    probes = [b"a", b"b", b"x", b"c", b"c"]
    found = array.probe(np.array([5, 5, 5, -3, 9]), lambda i: probes[i])
    assert sorted((p, array.string(i)) for p, i in found) == [(0, b"a"), (1, b"b"), (3, b"c")]


# --- op3 and op5 -------------------------------------------------------------------------------------


def test_quality_vote(spark):
    rows = run(spark, "op3_quality_vote", SF).collect()
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert {r.doc_id: r.held_out for r in rows} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_vote_of_odd_texts(spark, folder):
    docs = table(spark, folder, "documents")
    labels = spark.createDataFrame([(5, 1, 0), (9, 1, 0), (18, 0, 0), (14, 0, 0), (None, 1, 0), (3, None, 0)], fixtures.SCHEMAS["labels"])
    rows = quality_vote.score(docs, quality_vote.fit(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


def test_language(spark):
    rows = run(spark, "op5_language", SF).collect()
    lang = {r.doc_id: (r.lang, len(r.text)) for r in table(spark, SF, "documents").collect()}
    held = [r for r in rows if r.held_out and lang[r.doc_id][1] > 20]
    assert np.mean([r.lang_pred == lang[r.doc_id][0] for r in held]) > 0.97
    assert not any(r.rejected for r in held)


def test_odd_languages(spark, folder):
    docs = table(spark, folder, "documents")
    model = language.train(table(spark, SF, "documents"))
    rows = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert {i for i in rows if rows[i].lang_pred == "und"} == {0, 1, 2, 3}
    junk = spark.createDataFrame([(1, "xqzkw jvbnq wxzzk qqpfj " * 30), (2, "Привет, как твои дела сегодня?" * 5)], "doc_id long, text string")
    assert all(r.rejected and r.lang_pred in model.languages for r in language.identify(junk, model).collect())
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and 0 not in {r.doc_id for r in kept.collect()}


def test_a_language_that_was_left_out_is_rejected(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("length(text) >= 200").select("doc_id", "lang", "text")
    bad = [(10**6 + i, lang, "xqzkw jvbnq wxzzk qqpfj " * 30) for i, lang in enumerate(["en", "en", "de", "es"])]  # mislabelled junk
    model = language.train(docs.where("lang <> 'fr'").union(spark.createDataFrame(bad, docs.schema)))
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.identify(docs, model).collect()
    assert np.mean([r.rejected for r in rows if lang[r.doc_id] == "fr"]) > 0.95
    assert np.mean([r.rejected for r in rows if lang[r.doc_id] in ("en", "de", "es")]) < 0.01


def test_scores_do_not_depend_on_neighbours(spark):
    model = language.train(table(spark, SF, "documents"))
    texts = [r.text for r in table(spark, SF, "documents").limit(20).collect()]
    together, _ = model.cross_entropy(texts)
    alone = np.concatenate([model.cross_entropy([t])[0] for t in texts])
    assert np.allclose(together, alone)


def test_probabilities_sum_to_one():
    text = "abracadabra abacab"
    by_order, _, place = language.grams([text], 2)
    rows = []
    for n in range(2):
        zero = np.zeros(len(place), np.uint64)
        context = np.concatenate([zero[:1], by_order[0][:-1]]) if n else zero
        g = np.stack([by_order[n], context, by_order[0] if n else zero])[:, place >= n].view(np.int64)
        for gram in {tuple(c) for c in g.T.tolist()}:
            rows.append((0, n + 1, *gram, int((g[0] == gram[0]).sum())))
    model = language.kneser_ney(["x"], rows)
    p = dict(zip(model.keys.view(np.int64).tolist(), np.exp(model.log_p[:, 0].astype(float))))
    backoff = dict(zip(model.keys.view(np.int64).tolist(), np.exp(model.log_backoff[:, 0].astype(float))))
    singles = [r for r in rows if r[1] == 1]
    assert sum(p[r[2]] for r in singles) + np.exp(model.unseen[0]) == pytest.approx(1, abs=1e-5)
    for c in singles:
        pairs = [r for r in rows if r[1] == 2 and r[3] == c[2]]
        rest = 1 - sum(p[r[4]] for r in pairs)
        if pairs:
            assert sum(p[r[2]] for r in pairs) + backoff[c[2]] * rest == pytest.approx(1, abs=1e-4)


# --- op6 ---------------------------------------------------------------------------------------------


def test_compact_windows_are_those_of_the_definition():
    r = np.random.default_rng(3)
    for n, width, top in [(40, 7, 1 << 62), (60, 10, 6 << 33), (5, 7, 99), (200, 3, 1 << 62)]:
        h = r.integers(0, top, n).astype(np.uint64)
        first, last = np.zeros(n, np.int64), np.full(n, n - 1)
        left, centre, right = passages.compact_windows(h, first, last, width)
        order = (h >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
        want = set()
        for i, j in itertools.combinations(range(n + 1), 2):
            if j - i >= width:
                want.add(i + int(order[i:j].argmin()))
        assert set(centre.tolist()) == want
        for a, c, b in zip(left, centre, right):
            assert order[a : b + 1].min() == order[c] and (a == 0 or order[a - 1] < order[c]) and (b == n - 1 or order[b + 1] < order[c])


def test_passages(spark, folder):
    rows = passages.near_duplicate_passages(table(spark, folder, "documents")).collect()
    pairs = {tuple(sorted((r.doc_id, r.other_doc_id))) for r in rows}
    assert pairs == {(5, 6), (5, 8), (5, 7), (6, 7), (7, 8), (9, 10)} - {(6, 7), (7, 8)} | {(5, 7)} | ({(6, 7), (7, 8)} & pairs)
    texts = {r.doc_id: words_of(r.text) for r in table(spark, folder, "documents").collect()}
    for r in rows:
        assert r.end_word - r.start_word >= 50 and r.similarity >= 0.8
        one, two = (set(shingles(texts[i][a:b]).tolist()) for i, a, b in ((r.doc_id, r.start_word, r.end_word), (r.other_doc_id, r.other_start, r.other_end)))
        assert len(one & two) / len(one | two) == pytest.approx(r.similarity)
    shared = next(r for r in rows if {r.doc_id, r.other_doc_id} == {9, 10})
    assert " ".join(texts[10][200:270]) in " ".join(texts[shared.doc_id][shared.start_word : shared.end_word])


def test_every_repeated_passage_is_found(spark):
    r = random.Random(5)
    line = fixtures.prose(25, 99)  # many documents share a line that is too short to count
    rows, planted = [], []
    for k in range(40):
        passage = fixtures.prose(r.randint(51, 80), 1000 + k)
        for side in range(2):
            i = 2 * k + side
            rows.append((i, " ".join([fixtures.prose(r.randint(0, 300), 2000 + i), line, passage, fixtures.prose(r.randint(0, 300), 3000 + i)])))
        planted.append((2 * k, 2 * k + 1))
    rows += [(100 + i, fixtures.prose(200, 5000 + i) + " " + line) for i in range(100)]
    found = passages.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {tuple(sorted((x.doc_id, x.other_doc_id))) for x in found} == set(planted)


def test_passages_that_are_not_near_the_first_of_their_signature_are_linked(spark):
    rows, planted = [], set()
    for k in range(30):
        part = fixtures.prose(42, 100 + k)  # too short to count, but with most of the smallest hashes of the passage
        passage = f"{fixtures.prose(6, 200 + k)} {part} {fixtures.prose(6, 300 + k)}"
        for i in range(8):
            middle = part if i < 5 else passage
            rows.append((8 * k + i, " ".join([fixtures.prose(60, 1000 + 20 * k + i), middle, fixtures.prose(60, 9000 + 20 * k + i)])))
        planted |= {(8 * k + 5, 8 * k + 6), (8 * k + 5, 8 * k + 7)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    found = passages.near_duplicate_passages(docs).collect()
    pairs = {(x.other_doc_id, x.doc_id) for x in found}
    joined = components_of(pairs)
    for a, b in planted:
        assert joined.get(a, a) == joined.get(b, b), (a, b)
    texts = {i: words_of(t) for i, t in rows}
    for x in found:
        one, two = (set(shingles(texts[i][a:b]).tolist()) for i, a, b in ((x.doc_id, x.start_word, x.end_word), (x.other_doc_id, x.other_start, x.other_end)))
        assert x.end_word - x.start_word >= 50 and len(one & two) / len(one | two) == pytest.approx(x.similarity) and x.similarity >= 0.8


def test_a_passage_does_not_depend_on_what_follows_it():
    w = fixtures.prose(100, 61).split()
    one = w[:51] + w[51:55] + w[55:62] + w[62:66] + w[66:73]
    two = list(one)
    for i in [25, *range(51, 55), *range(62, 66)]:  # runs of 21, 21, 3 and 3 shingles
        two[i] = f"other{i}"
    judge = passages._judge(50, 0.8)
    for end in (51, len(one)):
        found = judge(judge(None, " ".join(one[:end])), " ".join(two[:end]))
        assert [(r[0], r[1], r[2], r[3]) for r in found] == [(0, 51, 0, 51)] and found[0][4] == pytest.approx(42 / 52)


def test_signatures_of_two_documents_are_searched(spark):
    rows = []
    for k in range(12):  # 42 shingles of 46 are shared: 42 / 50
        part = fixtures.prose(46, 600 + k)
        rows += [(2 * k + i, f"{fixtures.prose(40, 700 + 2 * k + i)} {part} {fixtures.prose(40, 800 + 2 * k + i)}") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shared = passages.candidates(docs, 50, passages.HASHES).where("leader <> member").select("leader", "member").distinct()
    want = {(x.leader, x.member) for x in shared.collect() if x.leader // 2 == x.member // 2}
    found = passages.near_duplicate_passages(docs).collect()
    assert len(want) > 8 and {(x.other_doc_id, x.doc_id) for x in found} == want
    texts = {i: words_of(t) for i, t in rows}
    for x in found:
        one, two = (set(shingles(texts[i][a:b]).tolist()) for i, a, b in ((x.doc_id, x.start_word, x.end_word), (x.other_doc_id, x.other_start, x.other_end)))
        assert x.end_word - x.start_word >= 50 and len(one & two) / len(one | two) == pytest.approx(x.similarity) and x.similarity >= 0.8


def test_passages_at_the_threshold_share_a_signature():
    r, width, shared = np.random.default_rng(3), 46, 0
    for _ in range(400):
        one = r.integers(0, 1 << 62, width).astype(np.uint64)
        two = one.copy()
        two[20:25] = r.integers(0, 1 << 62, 5).astype(np.uint64)  # one word changed: 41 / 51
        key, text, _ = passages.signatures(np.concatenate([one, two]), [width, width], width, passages.HASHES)
        shared += bool(set(key[text == 0].tolist()) & set(key[text == 1].tolist()))
    assert shared >= 397


def test_every_place_of_a_signature_is_searched(spark):
    part = fixtures.prose(42, 900)  # stands twice in a document, with other words around it
    one, two = (f"{fixtures.prose(6, k)} {part} {fixtures.prose(6, k + 1)}" for k in (901, 903))
    texts = {0: one, 1: f"{one} {fixtures.prose(70, 905)} {two}", 2: two}
    docs = {i: f"{fixtures.prose(60, 910 + i)} {t} {fixtures.prose(60, 920 + i)}" for i, t in texts.items()}
    words = {i: t.split() for i, t in docs.items()}
    begin = part.split()[:5]
    at = {i: [k for k in range(len(w) - 4) if w[k : k + 5] == begin] for i, w in words.items()}
    assert [len(at[i]) for i in range(3)] == [1, 2, 1]
    data = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    shared = passages.candidates(data.repartition(3), 50, passages.HASHES).collect()
    assert any(len({x.at for x in shared if x.key == k and x.member == 1}) > 1 for k in {x.key for x in shared})

    shared = spark.createDataFrame([(7, 0, i, p) for i in at for p in at[i]], "key long, leader long, member long, at long")
    judge = passages._judge(50, 0.8)
    found = [(0, i, *row) for i in (1, 2) for row in judge(judge(None, docs[0]), docs[i])]
    found = spark.createDataFrame(found, f"leader long, member long, {passages._FOUND}")
    links = passages.missed_links(shared, found, data, 50, 0.8).collect()
    assert {(x.leader, x.member) for x in found.collect()} == {(0, 1)} and (1, 2) in {(x.leader, x.member) for x in links}


def test_places_with_equal_surroundings_are_one():
    r, width = np.random.default_rng(5), 46
    tokens = np.concatenate([r.integers(0, 1 << 62, 150), np.tile(r.integers(0, 1 << 62, 7), 900), r.integers(0, 1 << 62, 150)]).astype(np.uint64)
    of = passages._contexts(tokens, np.zeros(len(tokens), np.int64), np.full(len(tokens), len(tokens) - 1), width)(np.arange(len(tokens)))
    window = [(min(i, width - 1), tuple(tokens[max(0, i - width + 1) : i + width].tolist())) for i in range(len(tokens))]
    assert len(set(window)) == len(set(of.tolist())) == len(set(zip(window, of.tolist())))
    key, _, at = passages.signatures(tokens, [len(tokens)], width, passages.HASHES)
    assert len(key) < 1500 and not ((at > 300) & (at < 6200)).any()


def test_texts_that_repeat_themselves(spark):
    texts = [f"{fixtures.prose(60, 10 + i)} {words} {fixtures.prose(60, 50 + i)}" for i, words in enumerate(["x " * 3000, "x " * 2000, "a b c " * 900, "a b c " * 1500, "x " * 40])]
    found = passages.near_duplicate_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(x.other_doc_id, x.doc_id) for x in found} == {(0, 1), (2, 3)} and len(found) < 12
    kept = {(x.doc_id, x.start_word, x.end_word) for x in found}
    assert (1, 60, 2060) in kept and any(i == 3 and b - a >= 2700 for i, a, b in kept)


def test_a_stretch_that_repeats_itself_has_few_places_at_its_ends():
    r, width = np.random.default_rng(7), 46
    for period in (1, 2, 7):
        tokens = np.concatenate([r.integers(0, 1 << 62, 150), np.tile(r.integers(0, 1 << 62, period), 400), r.integers(0, 1 << 62, 150)]).astype(np.uint64)
        key, _, at = passages.signatures(tokens, [len(tokens)], width, passages.HASHES)
        inside = (at >= 150) & (at < 150 + 400 * period)
        assert np.unique(key[inside], return_counts=True)[1].max() <= 8
    for _ in range(300):  # a sequence that holds a place holds a kept one
        at = np.unique(r.integers(0, 80, r.integers(1, 40)))
        group, width = np.sort(r.integers(0, 2, len(at))), int(r.integers(2, 12))
        at = np.concatenate([at[group == g] for g in range(2)])
        kept = passages._thinned(group, at, width)
        for g, s in itertools.product(range(2), range(80)):
            near = (group == g) & (at >= s) & (at < s + width)
            assert near.any() == (near & kept).any()


def test_places_of_two_documents_are_decided_with_their_texts(spark):
    r = np.random.default_rng(11)
    a, b = (r.integers(0, 1 << 62, 300).astype(np.uint64) for _ in range(2))
    b[40:100] = a[200:260]  # not among the passages found
    state = (a, passages._index(a))
    low, high = np.searchsorted(state[1][0], b), np.searchsorted(state[1][0], b, "right")
    key = np.array([5, 5, 6, 6])
    packed = np.array([220 << 3 | 6, 60 << 3 | 7, 10 << 3 | 6, 150 << 3 | 7])  # the second key agrees only by chance
    links, classes = passages._decided(state, b, (low, high), [], key, packed, 46, 0.8)
    assert len(links) == 1 and links[0][0] - links[0][2] == 160 and links[0][4] == 1
    assert [tuple(int(v) for v in c) for c in zip(*classes)] == [(5, 0, 220, -1), (5, 1, 60, 220), (6, 0, 10, -1), (6, 1, 150, -1)]


def test_shingles_of_many_texts_are_those_of_each():
    r = random.Random(3)
    signs = [*"abcXYZ019.,-\u00e9\u00c9\u0130\u03a3\u4e2d\U0001f600 \t\n\x1c\x1f\x85\xa0\u2003\u3000\u200b", "  "]
    for _ in range(400):
        texts = [r.choice([None, "", " ", "".join(r.choices(signs, k=r.randint(0, 60)))]) for _ in range(r.randint(0, 6))]
        texts += ["x" * r.randint(1, 40) for _ in range(r.randint(0, 2))]  # words of all lengths
        want = [shingles(words_of(t)) for t in texts]
        items, counts = shingled(texts)
        assert counts.tolist() == [len(w) for w in want] and items.tolist() == [x for w in want for x in w.tolist()]


def test_windows_of_many_texts_are_those_of_each():
    r = np.random.default_rng(4)
    for _ in range(100):
        sizes, width = r.integers(1, 60, 5), int(r.integers(1, 30))
        h = r.integers(0, 1 << 62, sizes.sum()).astype(np.uint64)
        end = np.cumsum(sizes)
        text = np.repeat(np.arange(5), sizes)
        got = list(zip(*(x.tolist() for x in passages.compact_windows(h, (end - sizes)[text], end[text] - 1, width))))
        want = []
        for a, n in zip((end - sizes).tolist(), sizes.tolist()):
            alone = passages.compact_windows(h[a : a + n], np.zeros(n, np.int64), np.full(n, n - 1), width)
            want += [tuple(int(v) + a for v in w) for w in zip(*alone)]
        assert got == want


def test_passages_are_those_of_counting_sets():
    r = np.random.default_rng(8)
    seen = 0
    for _ in range(300):
        a = r.integers(0, r.choice([8, 40, 1 << 60]), 120).astype(np.uint64)
        b = np.concatenate([r.integers(0, 1 << 60, 20).astype(np.uint64), a[r.integers(0, 40) : r.integers(50, 120)]])
        b[r.integers(0, len(b), r.integers(0, 12))] = r.integers(0, 1 << 60)
        index = passages._index(a)
        low, high = np.searchsorted(index[0], b), np.searchsorted(index[0], b, "right")
        chain = np.array([x for x in passages._runs(a, index, b, low, high)])
        if not len(chain):
            continue
        chain = chain[np.concatenate([[True], np.diff(chain[:, 0]) > 0]).cumprod().astype(bool)]
        shared = passages._Shared(index, b, low, high)
        hopeful = shared.hopeful(chain, shared.stretch(chain), 10, 0.8)
        for first in range(len(chain)):
            stretch = shared.stretch(chain[first:])
            got, a0, b0 = shared.similarities(stretch), chain[first, 0], chain[first, 1]
            for k, (a1, b1) in enumerate(zip(stretch[1], stretch[2])):
                one, two = set(a[a0:a1].tolist()), set(b[b0:b1].tolist())
                assert got[k] == len(one & two) / len(one | two)
                if got[k] >= 0.8 and min(a1 - a0, b1 - b0) >= 10:
                    seen += 1
                    assert hopeful[first] >= first + k
            assert shared.similarity(stretch) == got[-1]
    assert seen > 100


def test_texts_without_repeats_have_the_same_passages_by_lengths_of_runs():
    r = np.random.default_rng(12)
    found = 0
    for _ in range(300):
        a, b = (r.integers(0, 1 << 60, 300).astype(np.uint64) for _ in range(2))
        for _ in range(r.integers(1, 6)):
            i, j, n = r.integers(0, 200), r.integers(0, 200), r.integers(5, 100)
            b[j : j + n] = a[i : i + n]
        for k in r.integers(0, 300, r.integers(0, 12)):
            b[k : k + 5] = r.integers(0, 1 << 60, len(b[k : k + 5]))
        b = b[np.sort(np.unique(b, return_index=True)[1])]
        index = passages._index(a)
        low, high = np.searchsorted(index[0], b), np.searchsorted(index[0], b, "right")
        runs = passages._runs(a, index, b, low, high)
        want = passages._matches(index, b, low, high, runs, 46, 0.8, 25)
        assert passages._plain_matches(index[1], low, high, 46, 0.8, 25) == want
        found += len(want)
    assert found > 100


def test_keys_are_sorted_with_their_places():
    r = np.random.default_rng(13)
    for _ in range(300):
        n = int(r.integers(0, 300))
        key = r.integers(0, int(r.choice([1, 3, 1 << 40, 1 << 62])), n).astype(np.uint64)
        for k in (key, key << np.uint64(1), r.integers(0, 3, n).astype(np.uint64) << np.uint64(62) | key % np.uint64(40)):
            assert passages._sorted(k).tolist() == np.argsort(k, kind="stable").tolist()


def test_places_that_cannot_be_near_are_not_compared():
    r = np.random.default_rng(9)
    width, own = 46, []
    part = r.integers(0, 1 << 62, 91).astype(np.uint64)
    for k in range(300):  # more than are looked up together
        items = part.copy()
        items[r.choice(91, r.integers(0, 70), replace=False)] = r.integers(0, 1 << 62)
        if k % 3:
            items = np.concatenate([items[45:], items[:45]])[: r.integers(60, 92)]
        own.append((k, 0, 45, 0, items, True))
    parts = [passages._Part(own, k, width, int) for k in range(0, 300, passages._PART)]
    sequences = [passages._Sequences(o[4], 45, width) for o in own]
    compared = near = 0
    together = parts[0].all_near(0.8)
    for k in range(0, 300, 7):
        open_ = [np.arange(p.begin, p.begin + len(p.docs)) != k for p in parts]
        items = own[k][4]
        some = {p.begin + o for p, x in zip(parts, open_) for o in p.near(items, passages._distinct(items, width), x, 0.8)}
        compared += len(some)
        for o in range(300):
            both = [set(items[i : i + width].tolist()) for i in sequences[k].starts], [set(own[o][4][j : j + width].tolist()) for j in sequences[o].starts]
            best = max(len(x & y) / len(x | y) for x in both[0][::5] for y in both[1][::5]) if o != k and o % 5 == 0 else 0
            match = passages._nearest(sequences[k], sequences[o], 0.8) if o != k else None
            assert best < 0.8 or match and match[2] >= best
            near += bool(match)
            assert not match or o in some
            assert not match or max(k, o) >= passages._PART or together[k, o]
    assert 0 < near <= compared < 300 * 43 // 4


def components_of(pairs):
    root = {}
    for a, b in pairs:
        x, y = root.setdefault(a, a), root.setdefault(b, b)
        root = {i: min(x, y) if v in (x, y) else v for i, v in root.items()}
    return root


def test_missed_links_meet_across_blocks(spark):
    passage = fixtures.prose(60, 77)
    texts = [" ".join([fixtures.prose(40, 10 + i), passage if i else fixtures.prose(60, 78), fixtures.prose(40, 50 + i)]) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shared = spark.createDataFrame([(7, 0, i, 45) for i in range(20)], "key long, leader long, member long, at long")
    for block in (3, 2048):
        none = spark.createDataFrame([], "leader long, member long, start_word long, end_word long")
        found = passages.missed_links(shared, none, docs, 50, 0.8, block).collect()
        joined = components_of((x.leader, x.member) for x in found)
        assert {joined[i] for i in range(1, 20)} == {1} and 0 not in joined
        assert all(x.similarity == 1 and x.end_word - x.start_word == 50 for x in found)


# --- op7 ---------------------------------------------------------------------------------------------


def test_ids_are_those_of_the_tokenizer():
    encode, r = packing.Encoder(tokenizer_path()), random.Random(1)
    texts = ["".join(r.choice([" ", "\n", "a", "é", "'s", "1", "\t", "!", "中", "\x1c", "\u2003", "<|endoftext|>"]) for _ in range(r.randrange(14))) for _ in range(5000)]
    want = [encode.whole(t) for t in texts]
    for encode.longest in (1000, 3):
        assert [encode(t) for t in texts] == want


def test_long_stretches_take_no_square_of_time():
    encode, start = packing.Encoder.of(tokenizer_path()), time.time()
    for text in ("x" * 200_000, "ab" * 100_000 + " end", "中" * 100_000, "a" + " " * 300_000 + "b", "a  b " * 50_000):
        assert encode(text) == encode.whole(text)
    assert time.time() - start < 60


def packed_right(rows, texts):
    encode = packing.Encoder.of(tokenizer_path())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts.items():
        data = encode(text or "") + np.array([1], "<u4").tobytes()
        pieces = sorted(set((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc_id]))
        assert sum(p[1] for p in pieces) == len(data) // 4 == pieces[0][3]
        for start, length, crc, _ in pieces:
            assert zlib.crc32(data[4 * start : 4 * (start + length)]) == crc
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *itertools.accumulate(r.length for r in own)][:-1]
        assert sum(r.length for r in own) <= 2048
    return sum(r.length for r in rows) / (2048 * len(by_sequence))


def test_packing(spark, folder):
    rows = run(spark, "op7_packing", SF).collect()
    assert packed_right(rows, {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}) > 0.97
    docs = table(spark, folder, "documents")
    odd = packing.pack(docs, tokenizer_path(), keep_ids=True).collect()
    packed_right(odd, {r.doc_id: r.text for r in docs.collect()})
    assert all(len(r.ids) == r.length for r in odd) and sum(r.doc_id == 0 for r in odd) == 2


def test_plan_places_every_piece():
    r = random.Random(2)
    for histogram in ({}, {256: 5}, {1: 1000}, {100: 7, 156: 9, 3: 2}, {r.randint(1, 256): r.randint(1, 500) for _ in range(150)}):
        used = {}
        for sizes, times in packing.plan(histogram, 256):
            assert sum(sizes) <= 256 and times > 0
            for s in sizes:
                used[s] = used.get(s, 0) + times
        assert used == histogram


def test_blocks_of_pieces_agree(spark):
    pieces = packing.token_pieces(table(spark, SF, "documents"), tokenizer_path())
    for size in (10, 1_000_000):
        rows = packing.packed(pieces, block_rows=size).collect()
        assert packed_right(rows, {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}) > 0.97


# --- op8 ---------------------------------------------------------------------------------------------


def jaccard(a, b):
    a, b = (set(shingles(words_of(t)).tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a and b else 0.0


def classes_by_force(texts):
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if jaccard(texts[a], texts[b]) >= 0.8:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_near_duplicates(spark, folder):
    docs = table(spark, folder, "documents")
    rows = near_dups.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: r.class_id for r in rows} == classes_by_force({r.doc_id: r.text for r in docs.collect()})
    assert all(r.is_kept == (r.doc_id == r.class_id) for r in rows)
    kept = near_dups.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in rows}) and kept.columns == docs.columns


def test_groups_of_near_copies(spark):
    r, texts = random.Random(4), {}
    for g in range(6):
        base = fixtures.prose(150, 7000 + g).split()
        for k in range(40):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 8])):
                own[r.randrange(len(own))] = fixtures.prose(1, r.random())
            texts[len(texts)] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dups.near_duplicates(docs).collect()}
    assert got == classes_by_force(texts)


def test_repeated_shingles_do_not_hide_near_copies(spark):
    texts = {}
    for k in range(20):
        base = fixtures.prose(250, 7300 + k)
        for side in range(2):  # 246 equal shingles, 20 others repeated 100 times
            texts[2 * k + side] = " ".join([base, *[fixtures.prose(20, 7400 + 2 * k + side)] * 100])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert all(jaccard(texts[2 * k], texts[2 * k + 1]) > 0.8 for k in range(20))
    got = {x.doc_id: x.class_id for x in near_dups.near_duplicates(docs).collect()}
    assert got == {i: i - i % 2 for i in texts}


def test_missed_links_are_complete(spark):
    r, texts = random.Random(5), {}
    for g in range(3):
        base = fixtures.prose(120, 7100 + g).split()
        for k in range(30):
            own = list(base)
            for _ in range(r.choice([1, 2, 3])):
                own[r.randrange(len(own))] = fixtures.prose(1, r.random())
            texts[len(texts)] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    prints = near_dups.fingerprints(docs).select(F.col("doc_id").alias("rep"), "keys", "sign", "size").cache()
    members = near_dups.buckets(prints, near_dups.BANDS)
    shared = members.alias("a").join(members.alias("b"), "key").where("a.id < b.id").select("a.id", "b.id").distinct().collect()
    signs = {x.rep: x.sign for x in prints.collect()}
    least = near_dups.least_agreement(0.8, near_dups.REGISTERS)
    want = {
        (a, b) for a, b in shared
        if sum(x == y for x, y in zip(signs[a], signs[b])) >= least and jaccard(texts[a], texts[b]) >= 0.8
    }

    def classes(links):
        roots = {x.node: x.root for x in components(links).collect()}
        return {i: roots.get(i, i) for i in texts}

    best = classes(spark.createDataFrame(sorted(want), "a long, b long"))
    for known in ([], sorted(want)[::7]):
        before = components(spark.createDataFrame(known, "a long, b long"))
        for block in (4, 4096):  # buckets cut into several blocks, and whole ones
            more = near_dups.missed_links(members, prints, before, docs, 0.8, near_dups.REGISTERS, block)
            assert {(b, a) for a, b in more.collect()} <= want - set(known)
            assert classes(more.union(before)) == best


def test_rows_without_id_stay(spark):
    text = fixtures.prose(50, 1)
    docs = spark.createDataFrame([(None, text), (1, text), (2, text), (None, None)], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.class_id or -1, r.is_kept) for r in near_dups.near_duplicates(docs).collect())
    assert rows == [(-1, -1, True), (-1, -1, True), (1, 1, True), (2, 1, False)]


def test_signatures_estimate_probability_jaccard():
    r = np.random.default_rng(1)
    items = r.integers(0, 1 << 63, 60).astype(np.uint64)
    one, two = r.uniform(1, 5, 60), r.uniform(1, 5, 60)
    one[:10] = 0
    two[50:] = 0
    want = sum(1 / sum(max(a / x, b / y) for a, b in zip(one, two)) for x, y in zip(one, two) if x and y)
    m, got = 4096, []
    parts = [(items[w > 0], w[w > 0]) for w in (one, two)]
    doc = np.repeat([0, 1], [len(p[0]) for p in parts])
    s = near_dups.prob_min_hash(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), doc, 2, m)
    got = (s[0] == s[1]).mean()
    assert abs(got - want) < 5 * (want * (1 - want) / m) ** 0.5


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 50), (70, 50), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 50: 50, 70: 50, 100: 50, 200: 200, 201: 200}


def test_frequent_leaders_are_dealt_out(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(100)], "doc_id long, text string")
    edges = spark.createDataFrame([(0, i) for i in range(1, 100)] + [(5, 7)], "leader long, member long")
    judge = lambda state, text: text if state is None else [(f"{state}-{text}",)]
    rows = compare_texts(edges, docs, judge, "pair string", per_task=10).collect()
    assert {(r.leader, r.member, r.pair) for r in rows} == {(0, i, f"0-{i}") for i in range(1, 100)} | {(5, 7, "5-7")}


# --- pipeline ----------------------------------------------------------------------------------------


def test_pipeline(spark, folder):
    import corpus_pipeline

    rows = run(spark, "pipeline", folder).collect()
    assert {r.doc_id for r in rows}.isdisjoint({0, 1, 2, 3, 6, 7, 8, 19, 20, 21}) and 5 in {r.doc_id for r in rows}
    docs = table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    clean = {r.doc_id for r in run(spark, "pipeline", SF).collect()}
    assert len(clean) > 150


# --- op3: odd texts, and the vote itself -------------------------------------------------------------


def test_texts_without_terms_and_the_exact_vote(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    voters = quality_vote.fit(docs.where(queries.fold(4) != 2), labels)
    low = voters.scores([None, "", " ", "a"])
    assert (low == voters.without_terms).all() and voters.without_terms < 0.5
    texts = [r.text for r in docs.limit(60).collect()]
    texts = [t for t in texts if len((t or "").encode()) > 2]
    for text, got in zip(texts, voters.scores(texts)):
        v = voters.vectors_of(quality_vote.terms(text)[None])[0]
        alike = [float(x) for x in voters.vectors @ v]
        near = sorted(range(len(alike)), key=lambda i: (-alike[i], i))[: quality_vote.NEIGHBOURS]
        weight = [max(alike[i], 1e-6) ** quality_vote.SHARPNESS for i in near]
        assert abs(got - sum(w * voters.labels[i] for w, i in zip(weight, near)) / sum(weight)) < 1e-4


def test_equally_similar_voters_are_taken_in_order():
    one = quality_vote.terms("some words here")
    axes = one[:, None] / np.linalg.norm(one)
    labels = np.array([1.0] * quality_vote.NEIGHBOURS + [0.0] * 10)
    voters = quality_vote.Voters(np.ones(len(one), np.float32), axes, np.ones((len(labels), 1)), labels, 0.25)
    assert voters.scores(["some words here", ""]).tolist() == [1.0, 0.25]
    voters.labels = labels[::-1]
    assert abs(voters.scores(["some words here"])[0] - 15 / 25) < 1e-9


# --- one doc_id with several texts -------------------------------------------------------------------


def shared_ids(spark):
    """Ids that stand for several texts, in every relation that two texts can have."""
    a, b, c, d = (fixtures.prose(80, 9100 + i) for i in range(4))
    near = a.split()
    near[5] = "changed"
    rows = [(1, a), (2, b), (2, a), (2, c), (3, c), (4, b), (5, d), (5, " ".join(d.split()[:-1])), (None, a), (6, None), (6, ""), (7, a), (7, " ".join(near)), (2, b)]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, text_key string"), (a, b, c, d)


def test_no_text_is_lost_where_ids_are_shared(spark):
    docs, (a, b, c, d) = shared_ids(spark)
    rows = near_dups.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    classes = {}
    for r in rows:
        classes.setdefault(r.doc_id, set()).add(r.class_id)
    assert classes == {1: {1}, 2: {1, 2}, 3: {2}, 4: {2}, 5: {5}, None: {None}, 6: {6}, 7: {1}}
    kept = near_dups.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    five = [x for x in got if x[0] == 5]
    assert len(five) == 1 and five[0][1] in (d, " ".join(d.split()[:-1]))
    assert [x for x in got if x[0] != 5] == sorted([(0, a), (1, a), (2, b), (2, c), (6, ""), (6, "")])


def test_contamination_is_of_the_row(spark):
    item = fixtures.prose(30, 9200)
    docs = spark.createDataFrame(
        [(1, "before " + item), (1, "clean words only"), (None, item), (None, "nothing"), (2, fixtures.prose(40, 9201)), (1, "x " + " ".join(item.split()[3:20]))],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(5, item), (6, " ".join(item.split()[:12]))], "item_id long, text string")
    rows = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontaminate.report(docs, bench).collect())
    assert rows == sorted([(1, 31, 30, 2), (1, 3, 0, 0), (0, 30, 30, 2), (0, 1, 0, 0), (2, 40, 0, 0), (1, 18, 17, 1)])
    left = decontaminate.without_hits(docs, bench)
    assert sorted(r.text for r in left.collect()) == sorted(["clean words only", "nothing", fixtures.prose(40, 9201)])
