"""Near-duplicate documents by ProbMinHash, banding and verification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logferry.llm.common import chunks, checkpointed, compare_texts, components, mixed, shingles, small, words_of

REGISTERS, BANDS = 64, 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


def prob_min_hash(items: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """Signatures (n_docs, m) of weighted sets; ``items`` with equal ``doc`` are the elements of one set.

    Every element is a Poisson process whose rate is its weight: its arrivals come at sums of exponential
    gaps, and each falls into a register drawn from the element's own hash. A register keeps the element
    that arrived first. An element stops as soon as its last arrival is later than the fullest register
    of its set, as nothing it brings can count any more. Two sets agree in a register with their
    probability Jaccard similarity.
    """
    first = np.full(n_docs * m, np.inf)
    who = np.zeros(n_docs * m, np.uint64)
    time, turn = np.zeros(len(items)), np.uint64(0)
    live = np.arange(len(items))
    with np.errstate(over="ignore"):
        while live.size:
            turn += np.uint64(1)
            u = mixed(items[live] + turn * _STEP)
            time[live] -= np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[live]
            slot = doc[live] * m + (u % np.uint64(m)).astype(np.int64)
            t = time[live]
            better = t < first[slot]
            slot, when, item = slot[better], t[better], items[live[better]]
            order = np.lexsort((item, when, slot))
            slot, when, item = slot[order], when[order], item[order]
            head = np.ones(len(slot), bool)
            head[1:] = slot[1:] != slot[:-1]
            first[slot[head]], who[slot[head]] = when[head], item[head]
            last = first.reshape(n_docs, m).max(1)
            live = live[t < last[doc[live]]]
    return who.reshape(n_docs, m)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One key per band, which also names the band."""
    n, m = signatures.shape
    rows = signatures.reshape(n, bands, m // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (n, bands)).copy()
    for i in range(m // bands):
        key = mixed(key ^ rows[:, :, i]) * _STEP
    return key.view(np.int64)


def fingerprints(docs: DataFrame, registers: int = REGISTERS, bands: int = BANDS) -> DataFrame:
    """doc_id, digest of the words, band keys, a byte of each register, number of shingles; no keys if there is no word.

    A shingle weighs 1, however often it stands in the text: so two texts agree in a register with the Jaccard
    similarity by which pairs are judged, and bands and cutoffs rest on that.
    """

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in chunks([len(t.as_py() or "") for t in texts], 1 << 19):
                words = [words_of(t.as_py()) for t in texts.slice(a, b - a)]
                sets = [np.unique(shingles(w)) for w in words]
                doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                items = np.concatenate(sets)
                signs = prob_min_hash(items, np.ones(len(items)), doc, len(sets), registers)
                digests = [xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "surrogatepass")) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(digests, pa.binary()),
                     pa.array([k if w else None for k, w in zip(band_keys(signs, bands), words)], pa.list_(pa.int64())),
                     pa.array([s.tobytes() for s in signs.astype(np.uint8)], pa.binary()), pa.array([len(s) for s in sets], pa.int64())],
                    names=["doc_id", "digest", "keys", "sign", "size"],
                )

    schema = "doc_id bigint, digest binary, keys array<bigint>, sign binary, size bigint"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _judge(threshold: float):
    def judge(state, text):
        mine = np.unique(shingles(words_of(text)))
        if state is None:
            return mine
        both = len(np.intersect1d(state, mine, assume_unique=True))
        similarity = both / max(1, len(state) + len(mine) - both)
        return [(similarity,)] if similarity >= threshold else []

    return judge


def text_key() -> Column:
    """What tells texts that share a doc_id apart."""
    return F.xxhash64("text")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, registers: int = REGISTERS, bands: int = BANDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, is_kept.

    Documents with the same words are one text. Texts that share a band key are candidates
    (:func:`candidates`, then :func:`missed_links` for those that these leave in different classes). They are
    linked if the Jaccard similarity of their five-word shingles, counted on the texts, is at least
    ``threshold``; a class is what links connect, named by its smallest doc_id, the one that is kept.

    NULL, empty and blank texts are never linked: each stays, as its own class. Repeated rows are copies.
    A row without doc_id stays and has no class. Rows that share a doc_id but not the text are texts of their own:
    they may be in different classes, and of those in the same one the first by a hash of the text is kept. Columns
    other than doc_id and text are not read.
    """
    rows, shared = _with_shared_ids(docs)
    if shared.isEmpty():
        return _by_id(docs, threshold, registers, bands)
    return _by_text(rows, shared, threshold, registers, bands).drop("text_key")


def _with_shared_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text and text_key of the rows, and the ids that have several texts."""
    rows = docs.select("doc_id", "text", text_key().alias("text_key"))
    texts = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b"))
    return rows, checkpointed(texts.where("a <> b").select("doc_id"))


def _by_text(rows: DataFrame, shared: DataFrame, threshold: float, registers: int, bands: int) -> DataFrame:
    # Texts of such an id go by an id of their own, and get the names of their classes back at the end.
    own = F.when(F.col("_shared"), F.xxhash64("doc_id", "text_key")).otherwise(F.col("doc_id"))
    rows = rows.join(small(shared.withColumn("_shared", F.lit(True))), "doc_id", "left")
    rows = rows.withColumn("id", own)
    found = _by_id(rows.select(F.col("id").alias("doc_id"), "text"), threshold, registers, bands)
    names = checkpointed(rows.select("id", "doc_id", "text_key").distinct())
    found = checkpointed(found.withColumnRenamed("doc_id", "id").join(names, ["id"], "left"))
    place = F.struct("doc_id", "text_key")
    first = found.where("doc_id is not null").groupBy("class_id").agg(F.min(place).alias("_first"))
    found = found.join(first, "class_id", "left")
    kept = F.col("doc_id").isNull() | place.eqNullSafe(F.col("_first"))
    return found.select("doc_id", F.col("_first.doc_id").alias("class_id"), kept.alias("is_kept"), "text_key")


def _by_id(docs: DataFrame, threshold: float, registers: int, bands: int) -> DataFrame:
    prints = checkpointed(fingerprints(docs, registers, bands))
    texts = prints.where("keys is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "keys", "sign", "size")).alias("r"))
    texts = checkpointed(texts.select("digest", F.col("r.doc_id").alias("rep"), "r.keys", "r.sign", "r.size"))
    members = buckets(texts, bands)
    roots = components(links(checkpointed(candidates(members, texts, threshold, registers)), docs, threshold))
    roots = components(missed_links(members, texts, roots, docs, threshold, registers).union(roots))
    classes = texts.select("digest", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    classes = checkpointed(classes.select("digest", F.coalesce("root", "rep").alias("class_id")))
    out = prints.select("doc_id", "digest", F.col("keys").isNotNull().alias("worded"))
    out = out.join(classes, "digest", "left")
    class_id = F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("doc_id"))
    is_kept = F.col("doc_id").isNull() | (F.col("doc_id") == class_id)
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), class_id).alias("class_id"), is_kept.alias("is_kept"))


def one_of_each(docs: DataFrame, threshold: float = 0.8, registers: int = REGISTERS, bands: int = BANDS) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, a repeated row once, and all rows without doc_id."""
    rows, shared = _with_shared_ids(docs)
    if shared.isEmpty():
        classes = checkpointed(_by_id(docs, threshold, registers, bands))
        counts = classes.where("doc_id is not null").agg(F.count("*"), F.countDistinct("doc_id")).first()
        kept = docs.join(classes.where(~F.col("is_kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
        if counts[0] > counts[1]:  # repeated rows
            kept = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
        return kept
    classes = checkpointed(_by_text(rows, shared, threshold, registers, bands))
    counts = classes.where("doc_id is not null").agg(F.count("*"), F.countDistinct("doc_id", "text_key")).first()
    dropped = classes.where(~F.col("is_kept")).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    keyed = docs.withColumn("__text", text_key())
    kept = keyed.join(dropped, (F.col("doc_id") == F.col("__id")) & (F.col("__text") == F.col("__key")), "left_anti")
    if counts[0] > counts[1]:  # repeated rows
        some = kept.where("doc_id is not null").dropDuplicates(["doc_id", "__text"])
        kept = some.unionByName(kept.where("doc_id is null"))
    return kept.select(docs.columns)


def links(edges: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs in ``edges`` whose texts are similar enough."""
    found = compare_texts(edges, docs, _judge(threshold), "similarity double")
    return found.select(F.greatest("leader", "member").alias("a"), F.least("leader", "member").alias("b"))


def least_agreement(threshold: float, registers: int) -> int:
    """Registers in which two texts agree if their similarity lies five standard deviations below ``threshold``."""
    return int(registers * threshold - 5 * (registers * threshold * (1 - threshold)) ** 0.5)


def buckets(texts: DataFrame, bands: int) -> DataFrame:
    """key, next, id, size: the texts of each band key that several have, with their key in the next band."""
    banded = texts.select(F.col("rep").alias("id"), "size", F.posexplode("keys").alias("pos", "key"), "keys")
    following = F.element_at("keys", F.pmod(F.col("pos") + 1, F.lit(bands)) + 1)
    banded = banded.select("id", "size", "key", following.alias("next"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return checkpointed(banded.join(shared, "key"))


def candidates(members: DataFrame, texts: DataFrame, threshold: float, registers: int) -> DataFrame:
    """Pairs (leader, member) of ``texts`` (rep, sign) to be verified first, at most a few per text and band.

    The texts of a bucket (a band key) are sorted by their key in the next band, so that those most alike
    stand together, and dealt by ranges of that order, however large a bucket is. A task cuts its rows
    into blocks. In a block every text is compared by signature with every other, and paired with the
    ``best`` that agree most among those before it; and with the leader of its bucket, the text that
    shares most buckets with others, which ties the blocks together. Pairs whose signatures agree so
    little that a similarity of ``threshold`` lies five standard deviations off are left out.
    """
    block, best = 1024, 3
    least = least_agreement(threshold, registers)
    signs = texts.select(F.col("rep").alias("id"), "sign")
    degree = members.groupBy("id").agg(F.sum("n").alias("degree")).join(signs, "id")
    members = checkpointed(members.drop("n").join(degree, "id"))
    lead = members.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"), "sign")).alias("l"))
    lead = lead.select("key", (-F.col("l.minus")).alias("leader"), F.col("l.sign").alias("leader_sign"))
    rows = checkpointed(members.join(lead, "key"))
    rows = rows.repartitionByRange("key", "next", "id").sortWithinPartitions("key", "next", "id")

    def pair(batches):
        import pyarrow as pa

        for batch in batches:
            key, degree, ids, leader = (batch.column(c).to_numpy() for c in ("key", "degree", "id", "leader"))
            sign, lead_sign = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, registers) for c in ("sign", "leader_sign")
            )
            star = (leader != ids) & ((sign == lead_sign).sum(1) >= least)
            pairs = [np.stack([leader[star], ids[star]])]
            borders = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            for begin, end in zip(borders, borders[1:]):
                for a in range(begin, end, block):
                    b = min(a + block, end)
                    if b - a < 2 or (b - a == 2 and star[a:b].any()):
                        continue
                    at = a + np.lexsort((ids[a:b], -degree[a:b]))
                    s, n = sign[at], b - a
                    alike = np.zeros((n, n), np.int16)
                    for r in range(registers):
                        alike += s[:, r, None] == s[None, :, r]
                    alike[np.triu_indices(n)] = 0
                    for _ in range(min(best, n - 1)):
                        top = alike.argmax(1)
                        good = alike[np.arange(n), top] >= least
                        pairs.append(np.stack([ids[at[top[good]]], ids[at[good]]]))
                        alike[np.arange(n), top] = 0
            pairs = np.concatenate(pairs, 1)
            pairs = np.unique(np.stack([pairs.min(0), pairs.max(0)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["low", "high"])

    pairs = rows.select("key", "next", "id", "degree", "sign", "leader", "leader_sign").mapInArrow(pair, "low bigint, high bigint").distinct()
    # The side with more pairs leads, as its text then travels once for many.
    often = checkpointed(degree.select("id", "degree"))
    for side in ("low", "high"):
        pairs = pairs.join(often.withColumnsRenamed({"id": side, "degree": f"{side}_degree"}), side)
    first = F.col("low_degree") >= F.col("high_degree")
    return pairs.select(
        F.when(first, F.col("low")).otherwise(F.col("high")).alias("leader"),
        F.when(first, F.col("high")).otherwise(F.col("low")).alias("member"),
    )


def shingle_sets(docs: DataFrame) -> DataFrame:
    """id and the sorted shingles of each text, as bytes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [np.unique(shingles(words_of(t.as_py()))).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "id bigint, items binary")


def missed_links(
    members: DataFrame, texts: DataFrame, roots: DataFrame, docs: DataFrame, threshold: float, registers: int,
    block: int = 4096, block_items: int = 4 << 20,
) -> DataFrame:
    """(a, b) between texts that share a bucket and are similar enough, but lie in different classes of ``roots``.

    In a bucket that holds several classes, the texts outside the largest class are compared with all its
    texts, so every pair of a bucket is linked, verified on its shingles, or ruled out by its signatures as
    in :func:`candidates`. The texts of a bucket are dealt by hash into blocks of about ``block`` texts and
    at most about ``block_items`` shingles; a task holds one block and reads what is compared with it as a
    stream. Pairs are verified where they meet, and a link comes out only if the task has none between the
    two classes yet.
    """
    least = least_agreement(threshold, registers)
    classed = members.select("key", "id", "size").join(roots.withColumnRenamed("node", "id"), "id", "left")
    classed = classed.select("key", "id", "size", F.coalesce("root", "id").alias("root"))
    sizes = classed.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size")).groupBy("key")
    sizes = sizes.agg(
        F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("classes"), F.max(F.struct("n", "root")).alias("top")
    ).where("classes > 1")
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("size") / block_items)).cast("int")
    sizes = checkpointed(sizes.select("key", F.col("top.root").alias("top"), blocks.alias("blocks")))
    opened = checkpointed(classed.join(sizes, "key").join(texts.select(F.col("rep").alias("id"), "sign"), "id"))
    sets = shingle_sets(docs.join(opened.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    columns = ["key", "salt", "asks", "id", "root", "sign"]
    held = opened.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("asks", F.lit(False)).select(columns)
    asked = opened.where("root <> top").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = held.union(asked.withColumn("asks", F.lit(True)).select(columns)).join(sets, "id").select(*columns, "items")
    rows = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "asks", "id")

    def verify(batches):
        import pyarrow as pa

        at, own, above = None, [], {}

        def find(root):
            while above.get(root, root) != root:
                root = above[root]
            return root

        for batch in batches:
            key, salt, ids, root = (batch.column(c).to_numpy() for c in ("key", "salt", "id", "root"))
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            sign = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint8).reshape(-1, registers)
            items = [np.frombuffer(x, np.uint64) for x in batch.column("items").to_pylist()]
            begins = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (asks[1:] != asks[:-1]), [True]])
            borders, found = np.flatnonzero(begins), []
            for a, b in zip(borders, borders[1:]):
                if at != (key[a], salt[a]):
                    at, own = (key[a], salt[a]), []
                if not asks[a]:
                    own.append((ids[a:b], root[a:b], sign[a:b], np.array([len(x) for x in items[a:b]]), items[a:b]))
                    continue
                if not own:  # no text of the bucket fell into this block
                    continue
                if len(own) > 1:
                    *arrays, lists = zip(*own)
                    own = [(*map(np.concatenate, arrays), [x for part in lists for x in part])]
                other, other_root, other_sign, other_size, other_items = own[0]
                for c in range(a, b):
                    mine = items[c]
                    alike = (other_sign == sign[c]).sum(1) >= least
                    fits = np.minimum(other_size, len(mine)) >= threshold * np.maximum(other_size, len(mine))
                    near = np.flatnonzero(alike & fits & (other_root != root[c]))
                    if not near.size:
                        continue
                    theirs = np.concatenate([other_items[j] for j in near])
                    shared = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                    both = np.add.reduceat(shared.astype(np.int64), np.cumsum(other_size[near]) - other_size[near])
                    similarity = both / (len(mine) + other_size[near] - both)
                    for j in near[similarity >= threshold]:
                        x, y = find(int(root[c])), find(int(other_root[j]))
                        if x != y:
                            above[x] = y
                            found.append((int(ids[c]), int(other[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([max(p) for p in found]), pa.array([min(p) for p in found])], names=["a", "b"])

    return rows.mapInArrow(verify, "a bigint, b bigint")
