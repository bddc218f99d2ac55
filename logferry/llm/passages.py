"""Near-duplicate passages by compact windows, joined across hashes and verified on the texts."""

from __future__ import annotations

import hashlib
import uuid
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logferry.llm.common import SHINGLE, checkpointed, chunks, mixed, shared_folder, shingled, shingles, small, words_of

MIN_WORDS, HASHES, THRESHOLD = 50, 14, 0.8  # seven bands of two: a pair at the threshold is missed with (1 - 0.8^2)^7 = 0.08 %
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_BUCKET = 250_000  # signature rows that a task holds at a time, about
_PART = 256  # places of a block that are looked up together
_LED = 16  # a key that more documents of one batch have is led there
_FOUND = "other_start bigint, other_end bigint, start_word bigint, end_word bigint, similarity double"


def _previous_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left, -1 if none: the left links of a Cartesian tree.

    All nodes follow the links of the nodes before them at once; the last few follow one after another.
    """
    ended = np.append(values, values.min(initial=0))  # where a link of -1 leads
    link = np.arange(-1, len(values) - 1)
    todo = np.flatnonzero(values[1:] < values[:-1]) + 1
    while todo.size > 64:
        above = link.take(link.take(todo))
        link[todo] = above
        todo = todo[ended.take(above) > values.take(todo)]
    for i in todo.tolist():
        value, above = values[i], link[i]
        while ended[above] > value:
            above = link[above]
        link[i] = above
    return link


def compact_windows(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, width: int):
    """Compact windows (left, centre, right) of at least ``width`` tokens, by centre.

    Every sequence that lies in [left, right] and holds the centre has its smallest hash there. They are the
    nodes of the Cartesian tree over the hashes whose subtree is at least ``width`` wide. Only positions
    that are the minimum of some ``width`` tokens can be such nodes, and the tree of these alone has the
    same borders, so it is built over them. ``first`` and ``last`` bound the text of each position.
    """
    n = len(hashes)
    if n < width:
        return (np.zeros(0, np.int64),) * 3
    order = (hashes & ~_LOW) | np.arange(n, dtype=np.uint64)  # ties: the leftmost is the smallest
    least, reach = order, 1  # the smallest of ``reach`` tokens from each on
    while 2 * reach <= width:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    least = np.minimum(least[: n - width + 1], least[width - reach :])
    begin = np.flatnonzero((least[1:] != least[:-1]) | (first[1 : n - width + 1] != first[: n - width])) + 1
    begin = np.concatenate([[0], begin])
    begin = begin[last[begin] >= begin + width - 1]
    values = least[begin]
    if not values.size:
        return (np.zeros(0, np.int64),) * 3
    values = values[np.concatenate([[True], values[1:] != values[:-1]])]
    centre = (values & _LOW).astype(np.int64)
    m, text = len(centre), first[centre]
    rank = np.empty(m, np.int64)
    rank[np.argsort(values)] = np.arange(m)
    ahead, behind = rank + text * m, rank + (2 * n - text) * m  # other texts before, or behind, are smaller, and end the links
    links = _previous_smaller(np.concatenate([ahead, behind[::-1]]))
    before, after = links[:m], 2 * m - 1 - links[m:][::-1]
    after[after >= m] = m
    left = np.where(before >= 0, centre[before] + 1, 0)
    right = np.where(after < len(centre), centre[np.minimum(after, len(centre) - 1)] - 1, n - 1)
    return np.maximum(left, first[centre]), centre, np.minimum(right, last[centre])


def _contexts(tokens: np.ndarray, first: np.ndarray, last: np.ndarray, width: int):
    """A function that gives a hash of all sequences of ``width`` tokens that hold a position, and of its place in them.

    Hashes are differences of one running sum over powers of an odd number, brought to the same power by its inverse.
    """
    base, inverse = _STEP, np.uint64(pow(int(_STEP), -1, 1 << 64))
    power, back = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(tokens), x)]), dtype=np.uint64) for x in (base, inverse))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(tokens * power[:-1], dtype=np.uint64)])

    def of(at: np.ndarray) -> np.ndarray:
        low, high = np.maximum(at - width + 1, first[at]), np.minimum(at + width - 1, last[at]) + 1
        place = mixed((at - low).astype(np.uint64) * np.uint64(2 * width) + (high - at).astype(np.uint64))
        return mixed((sums[high] - sums[low]) * back[low] ^ place)

    return of


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of the ranges that begin at ``begin`` and hold ``count`` numbers, one range after another."""
    return np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)


def _thinned(group: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Which of the places ``at``, sorted by group and place, are needed for each sequence of ``width`` that holds places of a
    group to hold one that is kept: the first, then the farthest that leaves no sequence between, if there is one."""
    kept = np.ones(len(at), bool)
    near = np.concatenate([[False], (group[1:] == group[:-1]) & (at[1:] - at[:-1] <= width), [False]])
    edge = np.diff(near.astype(np.int8))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        if b - a < 2:  # two places
            continue
        places = at[a : b + 1]
        kept[a : b + 1] = False
        after = np.searchsorted(places, places + width, "right") - 1
        k = 0
        while k < len(places) - 1:
            kept[a + k] = True
            k = int(after[k])
        kept[a + k] = True
    return kept


def signatures(tokens: np.ndarray, lengths: list[int], width: int, hashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, place) of the sequences of ``width`` tokens, one row for all that share a signature.

    Hashes are taken two at a time. The windows of the two are joined where the starts of ``width``
    tokens that they stand for overlap; the key is the pair of tokens with the smallest hashes there, and
    the place is that of the first of them in its text. Of the places of a key in a text that all the same tokens
    surround, as far as sequences of ``width`` that hold them reach, only one is kept: whatever is near one is near
    all of them. Of what is left, only those are kept that it takes for every sequence which holds a place to hold a kept one
    (:func:`_thinned`). So a stretch that repeats itself has few rows, however long it is, and also at its ends.
    """
    lengths = np.asarray(lengths)
    end = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    first, last = (end - lengths)[text], end[text] - 1
    keys, texts, places = [], [], []
    context = None
    for band in range(hashes // 2):
        sides = []
        for k in (2 * band, 2 * band + 1):
            seed = mixed(np.array([k + 1], np.uint64) * _STEP)[0]
            left, centre, right = compact_windows(mixed(tokens ^ seed), first, last, width)
            sides.append((np.maximum(left, centre - width + 1), centre))
        if not len(sides[0][0]):
            continue
        starts = np.sort(np.concatenate([sides[0][0], sides[1][0]]), kind="stable")
        starts = starts[np.diff(starts, prepend=-1) != 0]
        c1, c2 = (c[np.searchsorted(s, starts, "right") - 1] for s, c in sides)
        moved = np.ones(len(c1), bool)
        moved[1:] = (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
        c1, c2 = c1[moved], c2[moved]
        key = mixed(mixed(tokens[c1] + np.uint64(band + 1)) ^ tokens[c2])
        of_text = mixed(key ^ text[c1].astype(np.uint64) * _STEP)
        order = np.argsort(of_text, kind="stable")
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = of_text[order[1:]] != of_text[order[:-1]]
        again = order[~(new[1:] & new[:-1])]  # texts that have the key more than once
        if len(again):
            context = context or _contexts(tokens, first, last, width)
            alike = np.sort(np.unique(mixed(of_text[again] ^ context(c1[again])), return_index=True)[1])
            some = again[alike]
            some = some[np.lexsort((c1[some], of_text[some]))]
            one = np.ones(len(key), bool)
            one[again] = False
            one[some[_thinned(of_text[some], c1[some], width)]] = True
            key, c1 = key[one], c1[one]
        keys.append(key)
        texts.append(text[c1])
        places.append(c1 - first[c1])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(texts), np.concatenate(places)


def _sorted(key: np.ndarray) -> np.ndarray:
    """The order that a stable sort by ``key`` gives. Keys are sorted together with their places, as single numbers: the
    leading bits of a key beside the place, and keys that these bits don't tell apart again by themselves."""
    if len(key) < 2:
        return np.arange(len(key))
    shift = np.uint64((len(key) - 1).bit_length())
    spare = np.uint64(max(0, int(key.max()).bit_length() + int(shift) - 64))
    order = np.sort((key >> spare) << shift | np.arange(len(key), dtype=np.uint64))
    order = (order & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    if spare:
        lead = (key >> spare)[order]
        wrong = np.unique(lead[1:][key[order[1:]] < key[order[:-1]]])
        for a, b in zip(lead.searchsorted(wrong).tolist(), lead.searchsorted(wrong, "right").tolist()):
            order[a:b] = order[a:b][np.argsort(key[order[a:b]], kind="stable")]
    return order


def _leaders(key: np.ndarray) -> np.ndarray:
    """Of rows sorted by key: the index of the first row of each row's key."""
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))


def _planes(*columns: np.ndarray) -> bytes:
    """The bytes of numbers, the first ones of all numbers before the second ones, which Spark's shuffle compresses well."""
    return b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)


def _unplaned(data: bytes, *kinds) -> list[np.ndarray]:
    n, at, out = len(data) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in map(np.dtype, kinds):
        out.append(np.frombuffer(data, np.uint8, n * k.itemsize, at).reshape(k.itemsize, n).T.copy().view(k).ravel())
        at += n * k.itemsize
    return out


def _meetings(key, doc, at, many):
    """A record batch (leader, member, places) of rows sorted by key, doc and place; the first document of a key leads the others.

    ``places`` holds pairs of numbers: the key, and a place with three bits. Bit 0: it is one of the member, not of the
    leader. Bit 1: the key is met first here. Bit 2: more than two documents have the key, as ``many`` says for each row.
    """
    import pyarrow as pa

    first = _leaders(key)
    other = np.flatnonzero(doc != doc[first])
    if not len(other):
        return None
    new = np.ones(len(other), bool)  # a leader and a member meet in a key
    new[1:] = (key[other][1:] != key[other][:-1]) | (doc[other][1:] != doc[other][:-1])
    begin = other[new]
    lead = first[begin]
    once = np.ones(len(begin), bool)
    once[1:] = lead[1:] != lead[:-1]
    end = np.append(np.flatnonzero(new)[1:], len(other))
    own = np.flatnonzero((doc == doc[first]))
    of_lead = np.bincount(first[own], minlength=len(key))[lead]
    of_member = end - np.flatnonzero(new)
    rows = np.concatenate([_spread(lead, of_lead), other])
    edge = np.concatenate([np.repeat(np.arange(len(begin)), of_lead), np.repeat(np.arange(len(begin)), of_member)])
    member = np.repeat([0, 1], [of_lead.sum(), len(other)])
    packed = at[rows].astype(np.int64) << 3 | many[rows].astype(np.int64) << 2 | once[edge].astype(np.int64) << 1 | member
    order = np.lexsort((member, edge, doc[begin][edge], doc[lead][edge]))
    places = np.stack([key[rows].astype(np.int64), packed], 1)[order]
    leader, members = doc[lead][edge][order], doc[begin][edge][order]
    cut = np.flatnonzero(np.concatenate([[True], (leader[1:] != leader[:-1]) | (members[1:] != members[:-1])]))
    data = [places[a:b].tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(places)])]
    return pa.RecordBatch.from_arrays([pa.array(leader[cut]), pa.array(members[cut]), pa.array(data, pa.binary())], names=["leader", "member", "places"])


def meetings(docs: DataFrame, min_words: int, hashes: int, n_words: int) -> DataFrame:
    """leader, member, places: pairs of documents that share signatures, and where (:func:`_meetings`), perhaps in several rows.

    Signatures are dealt by key into buckets, more of them for more words (``n_words``, about); a task sends one
    row for its part of a bucket. In a bucket the first document of a key leads the others. A key that many documents
    of one batch have is led there by the first of them, and only that one is sent to the bucket. A leader is always
    the smaller doc_id.
    """
    width = min_words - SHINGLE + 1
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * partitions, n_words * 2 * hashes // ((width + 1) * _BUCKET))
    kinds = (np.uint32, np.int64, np.uint32)

    def sign(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            keys, owners, places = [], [], []
            for a, b in chunks(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 1 << 19):
                key, of, at = signatures(*shingled(texts.slice(a, b - a).to_pylist()), width, hashes)
                keys.append(((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)) << np.uint64(32) | key & _LOW)
                owners.append(ids[a + of])
                places.append(at)
            if not keys:
                continue
            key, doc, at = np.concatenate(keys), np.concatenate(owners), np.concatenate(places).astype(np.uint32)
            order = _sorted(key)
            key, doc, at = key[order], doc[order], at[order]
            first = _leaders(key)
            often = np.flatnonzero((np.bincount(first, minlength=len(key)) > _LED)[first])
            order = often[np.lexsort((at[often], doc[often], key[often]))]
            doc[often], at[often] = doc[order], at[order]
            fresh = np.zeros(len(key), bool)
            fresh[often] = (first[often] == often) | (doc[often] != doc[often - 1])
            led = np.flatnonzero((np.bincount(first, fresh, len(key)) > _LED)[first])
            if len(led):
                pairs = _meetings(key[led], doc[led], at[led], np.ones(len(led), bool))
                nothing = pa.nulls(len(pairs), pa.int32())
                yield pa.RecordBatch.from_arrays([nothing, *pairs.columns], names=["bucket", "leader", "member", "places"])
                sent = np.ones(len(key), bool)
                sent[led] = doc[led] == doc[first[led]]
                at[led] |= np.uint32(1 << 31)
                key, doc, at = key[sent], doc[sent], at[sent]
            bucket = (key >> np.uint64(32)).astype(np.int32)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(key) else np.zeros(0, int)
            low = (key & _LOW).astype(np.uint32)
            data = [_planes(low[a:b], doc[a:b], at[a:b]) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(key)])]
            nothing = pa.nulls(len(cut), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[cut]), nothing, nothing, pa.array(data, pa.binary())], names=["bucket", "leader", "member", "places"]
            )

    def met(bucket, data):
        key, doc, at = (np.concatenate(c) for c in zip(*(_unplaned(x, *kinds) for x in data)))
        order = np.argsort(key, kind="stable")
        key, doc, at = key[order], doc[order], at[order]
        first = _leaders(key)
        more = np.flatnonzero((np.bincount(first, minlength=len(key)) > 1)[first])
        key, doc, at = key[more], doc[more], at[more]
        order = np.lexsort((at & np.uint32(0x7FFFFFFF), doc, key))
        key, doc, at = key[order], doc[order], at[order]
        leads, at = at >> np.uint32(31), at & np.uint32(0x7FFFFFFF)
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
        key, doc, at, leads = key[once], doc[once], at[once], leads[once]
        first, fresh = _leaders(key), np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        many = (np.bincount(first, fresh + 2 * leads, len(key)) > 2)[first] if len(key) else np.zeros(0, bool)
        return _meetings(np.uint64(bucket) << np.uint64(32) | key.astype(np.uint64), doc, at, many) if len(key) else None

    def meet(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        now, data = None, []
        for batch in batches:
            led = batch.filter(pc.is_null(batch.column("bucket")))
            if len(led):
                yield led.select(["leader", "member", "places"])
            own = batch.filter(pc.is_valid(batch.column("bucket")))
            for bucket, part in zip(own.column("bucket").to_pylist(), own.column("places").to_pylist()):
                if bucket != now:
                    if data and (out := met(now, data)):
                        yield out
                    now, data = bucket, []
                data.append(part)
        if data and (out := met(now, data)):
            yield out

    rows = docs.select("doc_id", "text").mapInArrow(sign, "bucket int, leader bigint, member bigint, places binary")
    dealt = F.when(F.col("bucket").isNotNull(), F.xxhash64("bucket")).otherwise(F.xxhash64("leader", "member"))
    return rows.repartition(dealt).sortWithinPartitions("bucket").mapInArrow(meet, "leader bigint, member bigint, places binary")


def candidates(docs: DataFrame, min_words: int, hashes: int) -> DataFrame:
    """key, leader, member, at: the documents (member) that share a signature (key), and the places where it lies in them.

    A leader has rows of its own, led by itself, for its own places.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for leader, member, places in zip(*(c.to_pylist() for c in batch.columns)):
                key, packed = np.frombuffer(places, np.int64).reshape(-1, 2).T
                kept = packed & 3 != 0  # of a leader only with the first of its members
                who = np.where(packed & 1, member, leader)[kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (key[kept], np.full(len(who), leader), who, packed[kept] >> 3)], names=["key", "leader", "member", "at"]
                )

    words = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return meetings(docs, min_words, hashes, words // 6).mapInArrow(run, "key bigint, leader bigint, member bigint, at bigint")


# --- verification ------------------------------------------------------------------------------------


def _index(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items in order of their values, and their places."""
    order = np.argsort(a, kind="stable")
    return a[order], order


def _agreeing(a, i: int, b, j: int) -> int:
    """How many items from ``i`` and ``j`` on are equal."""
    most, done, step = min(len(a) - i, len(b) - j), 0, 64
    while done < most:
        step = min(step, most - done)
        differs = a[i + done : i + done + step] != b[j + done : j + done + step]
        if differs.any():
            return done + int(differs.argmax())
        done, step = done + step, 4 * step
    return done


def _runs(a: np.ndarray, index, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of equal shingles (start in a, start in b, length), the longest first choice at each place of b.

    ``low`` and ``high`` bound the places in ``index`` (:func:`_index` of a) that hold the item of each place of b.
    """
    runs, k = [], 0
    there = np.flatnonzero(high > low)
    while k < len(there):
        j = int(there[k])
        best, at = 0, 0
        for i in index[1][low[j] : high[j]].tolist():
            if best and (i + best >= len(a) or j + best >= len(b) or a[i + best] != b[j + best]):
                continue
            length = _agreeing(a, i, b, j)
            if length > best:
                best, at = length, i
        runs.append((at, j, best))
        k += best
    return runs


class _Shared:
    """Counts of the items of stretches of two texts, a and b, without sorting the items of each stretch again.

    ``index`` is :func:`_index` of a; ``low`` and ``high`` bound the places in it that hold the item of each place of b.
    """

    def __init__(self, index, b: np.ndarray, low: np.ndarray, high: np.ndarray):
        values, self.order = index
        self.low, self.high, self.size = low, high, len(values)
        self.before_a, self.after_a = _beside(values, self.order)
        if _repeats(b):
            self.before_b, self.after_b = _beside(*_index(b))
        else:
            self.before_b, self.after_b = np.full(len(b), -1), np.full(len(b), len(b))
        head = _leaders(values)
        self.rank = np.empty(len(values), np.int64)
        self.rank[self.order] = head
        self.places = head * (self.size + 1) + self.order  # sorted
        self.first = np.full(len(b), self.size)  # the first place in a of the item of each place of b
        here = np.flatnonzero(high > low)
        self.first[here] = self.order[low[here]]

    def there(self, a0: int, b0: int, b1: int) -> np.ndarray:
        """Of the items of b[b0:b1], their first places in a from ``a0`` on, or the length of a."""
        at = self.first[b0:b1].copy()
        early = np.flatnonzero(at < a0)
        if len(early):
            low, high = self.low[b0:b1][early], self.high[b0:b1][early]
            next_ = np.searchsorted(self.places, low * (self.size + 1) + a0)
            at[early] = np.where(next_ < high, self.order[np.minimum(next_, self.size - 1)], self.size)
        return at

    def stretch(self, chain: np.ndarray):
        """What the passages from the first run of ``chain`` on share: the ends of its runs in a and b, where items are new
        in them, and the places in a of those of b (:meth:`there`)."""
        (a0, b0, _), end_a, end_b = chain[0].tolist(), np.maximum.accumulate(chain[:, 0] + chain[:, 2]), chain[:, 1] + chain[:, 2]
        a1, b1 = int(end_a[-1]), int(end_b[-1])
        return (a0, a1, b0, b1), end_a, end_b, self.before_a[a0:a1] < a0, self.before_b[b0:b1] < b0, self.there(a0, b0, b1)

    def similarity(self, stretch) -> float:
        """Jaccard similarity of the passage from the first to the last run."""
        (_, a1, _, _), _, _, new_a, new_b, at = stretch
        both = np.count_nonzero(new_b & (at < a1))
        return float(both / (np.count_nonzero(new_a) + np.count_nonzero(new_b) - both))

    def similarities(self, stretch) -> np.ndarray:
        """Jaccard similarity of the passages from the first run to each run."""
        (a0, a1, b0, _), end_a, end_b, new_a, new_b, at = stretch
        count_a, count_b = new_a.cumsum()[end_a - a0 - 1], new_b.cumsum()[end_b - b0 - 1]
        y = np.flatnonzero(new_b & (at < a1))
        runs, in_ = np.arange(len(end_a)), []
        for end, begin in ((end_a, a0), (end_b, b0)):
            size = end.copy()
            size[1:] -= end[:-1]
            size[0] -= begin
            in_.append(np.repeat(runs, size))  # the first run that ends behind each place
        both = np.bincount(np.maximum(in_[0][at[y] - a0], in_[1][y]), minlength=len(runs)).cumsum()
        return both / (count_a + count_b - both)

    def hopeful(self, chain: np.ndarray, stretch, least: int, threshold: float) -> dict[int, int]:
        """Which runs of ``chain`` a passage may begin with, and the last run with which it may end then: no others can be
        similar enough.

        Shingles that stand once in a text and not in the other count against a passage wherever it holds them.
        """
        (a0, a1, b0, b1), end_a, end_b, new_a, new_b, at = stretch
        common_b = at < a1
        met = np.zeros(self.size, bool)
        met[self.low[b0:b1][common_b]] = True
        common_a = met[self.rank[a0:a1]]
        alone_a = ~common_a & new_a & (self.after_a[a0:a1] >= a1)
        alone_b = ~common_b & new_b & (self.after_b[b0:b1] >= b1)
        begin_a, begin_b = chain[:, 0], chain[:, 1]

        def between(flag, begin, end, offset):
            sums = np.concatenate([[0], flag.cumsum()])
            return sums[end - offset][None, :] - sums[np.maximum(begin - offset, 0)][:, None]

        most = np.minimum(between(common_a, begin_a, end_a, a0), between(common_b, begin_b, end_b, b0))
        of_b = np.maximum(between(alone_b, begin_b, end_b, b0), 0)
        wide = (end_b[None, :] - begin_b[:, None] >= least) & (end_a[None, :] - begin_a[:, None] >= least)

        def possible(end):
            against = np.maximum(between(alone_a, begin_a, end, a0), 0) + of_b
            return wide & (most >= (threshold - 1e-9) * (most + against))

        pairs = possible(end_a)
        begins = np.flatnonzero(pairs.any(1))
        if len(begins):
            own = begin_a + chain[:, 2]
            pairs = pairs if (own == end_a).all() else possible(own)  # a passage ends there at least
        return {k: int(np.flatnonzero(pairs[k])[-1]) for k in begins.tolist()}


def _repeats(items: np.ndarray) -> bool:
    """Whether an item comes twice."""
    values = np.sort(items)
    return bool((values[1:] == values[:-1]).any())


def _beside(values: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The previous and the next place of each item, -1 and the length if none, of sorted items and their places."""
    before, after = np.full(len(order), -1), np.full(len(order), len(order))
    again = np.flatnonzero(values[1:] == values[:-1])
    before[order[again + 1]] = order[again]
    after[order[again]] = order[again + 1]
    return before, after


def _matches(index, b, low, high, runs, least: int, threshold: float, slack: int):
    """Passages of at least ``least`` shingles that chains of runs cover closely enough.

    All passages that begin with one run of a chain and end with another are tried. The longest that is similar enough
    is taken, and then those in what lies before and after it.
    """
    chains, chain = [], []
    for run in runs:
        if chain:
            i, j, n = chain[-1]
            gap_a, gap_b = run[0] - i - n, run[1] - j - n
            if not (-SHINGLE <= gap_a <= slack and 0 <= gap_b <= slack):
                chains.append(chain)
                chain = []
        chain.append(run)
    todo = [np.array(c) for c in [*chains, chain] if c and c[-1][1] + c[-1][2] - c[0][1] >= least]
    found, shared = [], None
    while todo:
        chain = todo.pop()
        if (chain[:, 0] + chain[:, 2]).max() - chain[0, 0] < least or chain[-1, 1] + chain[-1, 2] - chain[0, 1] < least:
            continue
        shared = shared or _Shared(index, b, low, high)
        stretch = shared.stretch(chain)
        similarity = shared.similarity(stretch)
        if similarity >= threshold:  # all of it
            found.append((*stretch[0], similarity))
            continue
        best = None
        for first, last in shared.hopeful(chain, stretch, least, threshold).items():
            a0, b0, _ = chain[first].tolist()
            if chain[last, 1] + chain[last, 2] - b0 < (max(least, best[0] + 1) if best else least):
                continue
            if first or last + 1 < len(chain):
                stretch = shared.stretch(chain[first : last + 1])
            similarity, a1, b1 = shared.similarities(stretch), *stretch[1:3]
            good = np.flatnonzero((similarity >= threshold) & (np.minimum(a1 - a0, b1 - b0) >= least))
            if good.size and (best is None or b1[good[-1]] - b0 > best[0]):
                last = good[-1]
                best = (b1[last] - b0, first, first + int(last), (a0, int(a1[last]), b0, int(b1[last]), float(similarity[last])))
        if best:
            _, first, last, passage = best
            found.append(passage)
            todo += [part for part in (chain[:first], chain[last + 1 :]) if len(part)]
    return found


def _plain_matches(order, low, high, least: int, threshold: float, slack: int):
    """What :func:`_matches` finds, if no item comes twice in a text: all that two passages share are the runs between their
    ends, so lengths of runs give the similarity of each passage."""
    there = np.flatnonzero(high > low)
    at = order[low[there]]
    new = np.ones(len(there), bool)
    new[1:] = (there[1:] - there[:-1] != 1) | (at[1:] - at[:-1] != 1)
    new = new.nonzero()[0]
    i, j = at[new], there[new]
    size = np.append(new[1:], len(there)) - new
    end_a, end_b = i + size, j + size
    gap_a, gap_b = i[1:] - end_a[:-1], j[1:] - end_b[:-1]
    cut = ((gap_a < -SHINGLE) | (gap_a > slack) | (gap_b > slack)).nonzero()[0] + 1
    todo = list(zip([0, *cut.tolist()], [*cut.tolist(), len(i)]))
    found = []
    before = np.concatenate([[0], size.cumsum()])
    while todo:
        first, last = todo.pop()
        last -= 1
        if last < first:
            continue
        a0, a1, b0, b1 = int(i[first]), int(end_a[last]), int(j[first]), int(end_b[last])
        if min(a1 - a0, b1 - b0) < least:
            continue
        both = int(before[last + 1] - before[first])
        if both / (a1 - a0 + b1 - b0 - both) >= threshold:  # all of it
            found.append((a0, a1, b0, b1, both / (a1 - a0 + b1 - b0 - both)))
            continue
        if last == first:
            continue
        some = slice(first, last + 1)
        both = before[first + 1 : last + 2][None, :] - before[some][:, None]
        wide_a, wide_b = end_a[some][None, :] - i[some][:, None], end_b[some][None, :] - j[some][:, None]
        good = (np.minimum(wide_a, wide_b) >= least) & (both >= (threshold - 1e-9) * (wide_a + wide_b - both))
        x, y = good.nonzero()
        similarity = both[x, y] / (wide_a[x, y] + wide_b[x, y] - both[x, y])
        x, y, similarity = (v[similarity >= threshold] for v in (x, y, similarity))
        if len(x):
            k = int(np.lexsort((x, -wide_b[x, y]))[0])  # the longest, of these the first
            x, y, similarity = int(x[k]) + first, int(y[k]) + first, float(similarity[k])
            found.append((int(i[x]), int(end_a[y]), int(j[x]), int(end_b[y]), similarity))
            todo += [(first, x), (y + 1, last + 1)]
    return found


def _judge(min_words: int, threshold: float):
    """``judge(None, text)`` makes the state of a leader; with it ``judge`` returns the passages that a member's text shares."""
    least = min_words - SHINGLE + 1

    def judge(state, text):
        mine = shingles(words_of(text))
        if state is None:
            return mine, _index(mine)
        more = SHINGLE - 1
        return [(a0, a1 + more, b0, b1 + more, s) for a0, a1, b0, b1, s in _compared(state, mine, least, threshold)[0]]

    return judge


def _compared(state, b: np.ndarray, least: int, threshold: float):
    """Passages (:func:`_matches`) of a leader's and a member's shingles, and the bounds of the member's in the leader's index."""
    a, index = state
    low = index[0].searchsorted(b)
    high = low.copy()
    inside = (low < len(a)).nonzero()[0]
    inside = inside[index[0][low[inside]] == b[inside]]
    high[inside] = index[0].searchsorted(b[inside], "right")
    if len(inside) == 0:
        return [], (low, high)
    slack = (least + SHINGLE - 1) // 2
    if not (index[0][1:] == index[0][:-1]).any() and not _repeats(b):
        return _plain_matches(index[1], low, high, least, threshold, slack), (low, high)
    return _matches(index, b, low, high, _runs(a, index, b, low, high), least, threshold, slack), (low, high)


class _Sequences:
    """The sequences of ``width`` items that hold place ``at``: their starts, the distinct items, which of these each
    sequence has (a column per start), how many, and the fewest that one has."""

    def __init__(self, items: np.ndarray, at: int, width: int):
        self.starts, self.width = np.arange(max(0, at - width + 1), min(at, len(items) - width) + 1), width
        values, self.places = _index(items)
        self.new = np.concatenate([[True], values[1:] != values[:-1]])
        self.distinct = values[self.new]
        self.fewest = width if len(self.distinct) == len(items) else self.count.min(initial=width)

    def most(self, which: np.ndarray) -> int:
        """At most so many of the distinct items ``which`` are in one sequence."""
        if len(self.distinct) < len(self.new):
            return len(which)
        at = np.sort(self.places[which])
        return int((at.searchsorted(self.starts + self.width) - at.searchsorted(self.starts)).max())

    @cached_property
    def has(self) -> np.ndarray:
        has = (self.places[:, None] >= self.starts) & (self.places[:, None] < self.starts + self.width)
        if len(self.distinct) < len(self.new):
            has = np.logical_or.reduceat(has, np.flatnonzero(self.new), axis=0)
        return has.astype(np.float32)

    @cached_property
    def count(self) -> np.ndarray:
        return self.has.sum(0)


def _nearest(one: _Sequences, two: _Sequences, threshold: float):
    """Starts of the two most similar of the sequences of two places, and their Jaccard similarity; None if it
    is below ``threshold``."""
    j = np.minimum(np.searchsorted(two.distinct, one.distinct), len(two.distinct) - 1)
    i = (two.distinct[j] == one.distinct).nonzero()[0]
    j = j[i]
    needed = threshold / (1 + threshold) * (one.fewest + two.fewest) - 1e-9  # common to a sequence of each
    if len(i) < needed or one.most(i) < needed or two.most(j) < needed:
        return None
    both = one.has[i].T @ two.has[j]
    similarity = both.astype(np.float64) / (one.count[:, None] + two.count[None, :] - both)
    x, y = np.unravel_index(similarity.argmax(), similarity.shape)
    return (int(one.starts[x]), int(two.starts[y]), float(similarity[x, y])) if similarity[x, y] >= threshold else None


def _distinct(items: np.ndarray, width: int) -> np.ndarray:
    """How many different items each sequence of ``width`` has."""
    if not _repeats(items):
        return np.full(max(0, len(items) - width + 1), width)
    order = np.argsort(items, kind="stable")
    before = np.full(len(items), -1)
    again = np.flatnonzero(items[order[1:]] == items[order[:-1]])
    before[order[again + 1]] = order[again]
    n, at = len(items) - width + 1, np.arange(len(items))
    begin, end = np.maximum(before + 1, at - width + 1), np.minimum(at, n - 1) + 1  # the sequences in which an item is new
    some = begin < end
    change = np.bincount(begin[some], minlength=n + 1)[: n + 1] - np.bincount(end[some], minlength=n + 1)[: n + 1]
    return change.cumsum()[:n]


def _hopeful_places(common: np.ndarray, distinct: np.ndarray, width: int, threshold: float) -> np.ndarray:
    """Which places lie in a sequence of ``width`` that the other text can be near to: enough of its items are ``common``."""
    sums = np.concatenate([[0], common.cumsum()])
    good = sums[width:] - sums[:-width] >= threshold * distinct - 1e-9
    sums = np.concatenate([[0], good.cumsum()])
    at = np.arange(len(common))
    return sums[np.minimum(at, len(good) - 1) + 1] > sums[np.minimum(np.maximum(at - width + 1, 0), len(good))]


def _decided(state, b, bounds, found: list, key, packed, width: int, threshold: float):
    """What the shared places of a leader and a member (``key``, ``packed``, see :func:`_meetings`) say of two documents.

    Returns passages of ``width`` shingles around places that the passages ``found`` don't cover, and the class of each
    place of a key that more documents have: (key, is the member's, place, place of the leader or -1).
    A place of the member belongs to the place of the leader that lies opposite it in a passage that covers both.
    """
    a, (values, order) = state
    links, classes = [], []
    at, member = packed >> 3, packed & 1 == 1
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(key))))
    here = np.where(member, len(b), len(a))
    kept = (at + width >= 0) & (at < here)  # rows may share a doc_id
    key, packed, at, member, group = (x[kept] for x in (key, packed, at, member, group))
    theirs, mine = np.flatnonzero(~member), np.flatnonzero(member)
    count = np.bincount(group[theirs], minlength=len(cut))
    start = np.concatenate([[0], count.cumsum()])
    x = theirs[_spread(start[group[mine]], count[group[mine]])]
    y = np.repeat(mine, count[group[mine]])
    p, q = at[x], at[y]
    far = np.iinfo(np.int64).max
    off = np.full(len(p), far)
    for a0, a1, b0, b1, _ in found:
        inside = (a0 <= p) & (p < a1) & (b0 <= q) & (q < b1)
        off[inside] = np.minimum(off[inside], np.abs(p - a0 - q + b0)[inside])
    opposite = np.full(len(key), -1)
    covered = np.flatnonzero(off < far)
    covered = covered[np.lexsort((p[covered], off[covered]))[::-1]]
    opposite[y[covered]] = p[covered]  # the nearest comes last
    open_ = np.flatnonzero(off == far)
    if len(open_) and min(len(a), len(b)) >= width:
        low, high = bounds
        common = high > low
        bound = np.bincount(low[common], minlength=len(a) + 1) - np.bincount(high[common], minlength=len(a) + 1)
        back = np.zeros(len(a), bool)
        back[order[bound.cumsum()[: len(a)] > 0]] = True
        good = _hopeful_places(back, _distinct(a, width), width, threshold)
        open_ = open_[good[p[open_]]]
        if len(open_):
            open_ = open_[_hopeful_places(common, _distinct(b, width), width, threshold)[q[open_]]]
        near_a, near_b, last, above = {}, {}, None, {}

        def find(node):
            while node in above:
                node = above[node]
            return node

        def around(items, place, known):
            if place not in known:
                begin = max(0, place - width + 1)
                known[place] = (begin, _Sequences(items[begin : place + width], place - begin, width))
            return known[place]

        for k in open_.tolist():
            i, j, g = int(p[k]), int(q[k]), int(group[y[k]])
            if g != last:
                last, above = g, {(1, int(at[z])): (0, int(opposite[z])) for z in mine[group[mine] == g] if opposite[z] >= 0}
            one, two = find((0, i)), find((1, j))
            if one == two:
                continue
            match = any(a0 <= i < a1 and b0 <= j < b1 for a0, a1, b0, b1, alike in links if alike == 1)
            if not match:
                (from_a, there), (from_b, here) = around(a, i, near_a), around(b, j, near_b)
                match = _nearest(there, here, threshold)
                if not match:
                    continue
                a0, b0 = from_a + match[0], from_b + match[1]
                links.append((a0, a0 + width, b0, b0 + width, match[2]))
            above[two] = one
            if opposite[y[k]] < 0:
                opposite[y[k]] = i
    shown = np.flatnonzero((packed & 4 != 0) & (packed & 3 != 0))
    return list(dict.fromkeys(links)), (key[shown], member[shown], at[shown], opposite[shown])


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a table in the shared folder, of which only the columns used are read again."""
    path = f"{shared_folder(df.sparkSession)}/passages-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _needed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the documents ``ids`` (doc_id)."""
    return docs.select("doc_id", "text").join(small(written(ids.distinct())), "doc_id", "left_semi")


_CLASSES = "key bigint, doc_id bigint, at bigint, root_doc bigint, root_at bigint"


def compared(pairs: DataFrame, docs: DataFrame, min_words: int, threshold: float) -> DataFrame:
    """Passages that leaders and members share, and the classes of their places, of ``pairs`` (leader, member, places: a list of
    those of :func:`meetings`).

    Both texts come by joins, so the members of a frequent leader can be split. Rows without key are passages, the
    others say to which place (root_doc, root_at) the place of a signature belongs: to itself if none other is near.
    """
    width = min_words - SHINGLE + 1
    more = SHINGLE - 1
    schema = f"leader bigint, member bigint, {_FOUND}, {_CLASSES}"

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        known, state = None, None
        kinds = pa.schema([(c.split()[0], pa.float64() if c.endswith("double") else pa.int64()) for c in schema.split(", ")])

        for batch in batches:
            passages, classes = [], []
            leaders, members, texts, lead_texts = batch["leader"].to_pylist(), batch["member"].to_pylist(), batch["text"], batch["lead_text"]
            for begin, end in chunks(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 1 << 19):
                rows, new = range(begin, end), []
                for row in rows:  # the leaders that come new
                    text = lead_texts[row].as_py()
                    if known != (leaders[row], text):
                        known = (leaders[row], text)
                        new.append((row, text))
                items, counts = shingled([*texts.slice(begin, end - begin).to_pylist(), *(text for _, text in new)])
                parts = np.split(items, np.cumsum(counts)[:-1])
                new = {row: parts[len(rows) + k] for k, (row, _) in enumerate(new)}
                for row, b in zip(rows, parts):
                    leader, member, places = leaders[row], members[row], batch["places"][row].as_py()
                    if row in new:
                        state = (new[row], _index(new[row]))
                    found, bounds = _compared(state, b, width, threshold)
                    if places:
                        key, packed = np.frombuffer(b"".join(places), np.int64).reshape(-1, 2).T
                        links, (key, is_member, at, opposite) = _decided(state, b, bounds, found, key, packed, width, threshold)
                        found = found + [x for x in links if not any(f[0] <= x[0] and x[1] <= f[1] and f[2] <= x[2] and x[3] <= f[3] for f in found)]
                        if len(key):
                            who = np.where(is_member, member, leader)
                            apart = opposite < 0
                            classes.append((key, who, at, np.where(apart, who, leader), np.where(apart, at, opposite)))
                    passages += [(leader, member, a0, a1 + more, b0, b1 + more, s) for a0, a1, b0, b1, s in found]
            if passages:
                columns = [pa.array(c) for c in zip(*passages)] + [pa.nulls(len(passages), pa.int64())] * 5
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)
            if classes:
                columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*classes)]
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays([pa.nulls(n, f.type) for f in list(kinds)[:7]] + columns, schema=kinds)

    ids = pairs.select(F.col("leader").alias("doc_id")).union(pairs.select(F.col("member").alias("doc_id")))
    texts = _needed(docs, ids)
    rows = pairs.join(texts.withColumnRenamed("doc_id", "member"), "member")
    rows = rows.join(texts.withColumnsRenamed({"doc_id": "leader", "text": "lead_text"}), "leader")
    return written(rows.select("leader", "member", "places", "text", "lead_text").mapInArrow(run, schema))


def surroundings(places: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """doc_id, at, begin, items: the shingles of all sequences of ``width`` that hold the places (doc_id, at)."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            texts = batch.column(1)
            for a, b in chunks(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 1 << 19):
                items, counts = shingled(texts.slice(a, b - a).to_pylist())
                ends = np.cumsum(counts)
                ats = batch.column(2).slice(a, b - a)
                of = np.repeat(np.arange(b - a), pc.list_value_length(ats).to_numpy(zero_copy_only=False))
                at = ats.flatten().to_numpy()
                begin = np.maximum(at - width + 1, 0)
                low = np.minimum((ends - counts)[of] + begin, ends[of])
                high = np.minimum((ends - counts)[of] + at + width, ends[of])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(a, b - a).take(pa.array(of)), "at": at, "begin": begin,
                    "items": pa.array([items[i:j].tobytes() for i, j in zip(low.tolist(), high.tolist())], pa.binary()),
                })

    rows = _needed(docs, places.select("doc_id")).join(places.groupBy("doc_id").agg(F.collect_set("at").alias("ats")), "doc_id")
    return rows.select("doc_id", "text", "ats").mapInArrow(run, "doc_id bigint, at bigint, begin bigint, items binary")


class _Part:
    """Places of a block, up to ``_PART`` of them, by their shingles: which place has which, and the other way round."""

    def __init__(self, own: list, begin: int, width: int, find):
        rows = own[begin : begin + _PART]
        self.begin, self.width, self.sequences = begin, width, [None] * len(rows)
        self.docs, self.outside = np.array([r[0] for r in rows]), np.array([r[5] for r in rows])
        self.labels = np.array([find(r[1]) for r in rows])  # their classes by now
        sizes = np.array([len(r[4]) for r in rows])
        owner = np.repeat(np.arange(len(rows)), sizes)
        self.values, which = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True)
        none = len(self.values)
        self.kind = np.min_scalar_type(2 * width)
        self.has = np.zeros((none + 1, len(rows)), self.kind)
        self.has[which, owner] = 1
        self.which = np.full((len(rows), 2 * width - 1), none)
        self.which[owner, _spread(np.zeros(len(rows), np.int64), sizes)] = which
        self.fewest = np.full(len(rows), width)  # distinct shingles that a sequence of each has
        for k in np.flatnonzero(self.has.sum(0) < sizes).tolist():
            self.fewest[k] = _distinct(rows[k][4], width).min()

    def all_near(self, threshold: float) -> np.ndarray:
        """Which places may be near to which, as :meth:`near` rules out the others, for all at once."""
        n, length = self.which.shape
        most = np.zeros((n, n), self.kind)  # of the shingles of a place, a row each, what a sequence has in common with another
        step = max(1, (1 << 20) // (n * length))
        for k in range(0, n, step):
            sums = self.has[self.which[k : k + step]]
            np.cumsum(sums, axis=1, dtype=self.kind, out=sums)
            sums[:, self.width :] -= sums[:, : -self.width].copy()
            most[k : k + step] = sums[:, self.width - 1 :].max(1)
        share, one, two = threshold / (1 + threshold), self.fewest[:, None], self.fewest[None, :]
        return np.minimum(most, most.T) >= np.maximum(threshold * np.maximum(one, two), share * (one + two)) - 1e-9

    def near(self, items: np.ndarray, distinct: np.ndarray, open_: np.ndarray, threshold: float) -> list[int]:
        """Which of the places ``open_`` may be near to the place with the shingles ``items``: enough of both are common."""
        share = threshold / (1 + threshold)  # of two sequences, a similarity of threshold needs this share of both together
        width, none = self.width, len(self.values)
        at = np.minimum(np.searchsorted(self.values, items), none - 1)
        at[self.values[at] != items] = none
        fewest = int(distinct.min())
        has = self.has[at]
        some = (open_ & (has.sum(0, dtype=self.kind) >= threshold * fewest - 1e-9)).nonzero()[0]
        if not len(some):
            return []
        sums = np.zeros((len(items) + 1, len(some)), self.kind)
        np.cumsum(has[:, some], axis=0, dtype=self.kind, out=sums[1:])
        needed = np.maximum(threshold * distinct[:, None], share * (distinct[:, None] + self.fewest[some])) - 1e-9
        some = some[(sums[width:] - sums[:-width] >= needed).any(0)]
        if not len(some):
            return []
        common = np.zeros(none + 1, self.kind)
        common[at] = 1
        common[none] = 0
        sums = np.zeros((2 * width, len(some)), self.kind)
        np.cumsum(common[self.which[some]].T, axis=0, dtype=self.kind, out=sums[1:])
        needed = np.maximum(threshold * self.fewest[some], share * (self.fewest[some] + fewest)) - 1e-9
        return some[(sums[width:] - sums[:-width]).max(0) >= needed].tolist()


def missed_links(
    shared: DataFrame, found: DataFrame, docs: DataFrame, min_words: int, threshold: float, block: int = 2048
) -> DataFrame:
    """Passages of ``min_words`` words around a shared signature whose documents ``found`` doesn't connect there.

    ``shared`` has the rows of :func:`candidates`, ``found`` the passages verified between leaders and members.
    A document may hold a signature at several places. Each is taken by itself: it belongs to the place of the leader
    that lies opposite it in a passage that covers both, and is a class of its own if there is none.
    Then :func:`search_classes` compares the classes.
    """
    sides = ["start_word", "end_word", "other_start", "other_end"]
    sides = [F.col(c) if c in found.columns else F.lit(None).cast("bigint").alias(c) for c in sides]
    spans = found.groupBy("leader", "member").agg(F.collect_list(F.struct(*sides)).alias("spans"))
    leading = shared.where("leader = member").groupBy("key", "leader").agg(F.collect_set("at").alias("lead_ats"))
    placed = shared.join(spans, ["leader", "member"], "left").join(small(checkpointed(leading)), ["key", "leader"])
    covering = F.filter("spans", lambda s: (s.start_word <= F.col("at")) & (F.col("at") + SHINGLE <= s.end_word))

    def opposite(s):
        inside = F.filter("lead_ats", lambda p: (s.other_start <= p) & (p + SHINGLE <= s.other_end))
        return F.transform(inside, lambda p: F.struct(F.abs(p - s.other_start - F.col("at") + s.start_word).alias("off"), p.alias("at")))

    nearest = F.array_min(F.flatten(F.transform(covering, opposite)))
    placed = placed.select("key", "leader", F.col("member").alias("doc_id"), "at", nearest.alias("nearest"))
    met = (F.col("leader") != F.col("doc_id")) & F.col("nearest").isNotNull()
    placed = placed.select(
        "key", "doc_id", "at",
        F.when(met, F.col("leader")).otherwise(F.col("doc_id")).alias("root_doc"), F.when(met, F.col("nearest.at")).otherwise(F.col("at")).alias("root_at"),
    )
    return search_classes(placed, docs, min_words, threshold, block)


def search_classes(placed: DataFrame, docs: DataFrame, min_words: int, threshold: float, block: int = 2048) -> DataFrame:
    """Passages of ``min_words`` words that connect places of a signature in different classes.

    ``placed`` has key, doc_id, at and the place (root_doc, root_at) that this one belongs to, perhaps itself.
    In a signature with several classes, all places outside the largest class are compared with all its
    places, so each pair is linked or ruled out. Places are dealt by hash into blocks of about
    ``block``; a task holds one block and reads what is compared with it as a stream. Only the shingles
    around the places are read, and a link comes out only if the task has none between the two classes yet.
    """
    width = min_words - SHINGLE + 1
    own = F.struct("doc_id", "at")
    root = F.struct(F.col("root_doc").alias("doc_id"), F.col("root_at").alias("at"))
    placed = written(placed.groupBy("key", "doc_id", "at").agg(F.min(root).alias("root")))
    open_ = placed.groupBy("key").agg(F.countDistinct("root").alias("n")).where("n > 1").select("key")
    placed = written(placed.join(small(written(open_)), "key"))
    above = placed.select("key", own.alias("root"), F.col("root").alias("top"))  # a leader may be led itself
    placed = placed.join(above, ["key", "root"]).select("key", "doc_id", "at", F.col("top").alias("root"))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
    sizes = sizes.agg(F.sum("n").alias("n"), F.count("*").alias("classes"), F.max(F.struct("n", "root")).alias("top"))
    sizes = sizes.where("classes > 1").select("key", F.col("top.root").alias("top"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = written(placed.join(small(written(sizes)), "key"))
    placed = placed.withColumn("outside", F.col("root") != F.col("top")).withColumn("root", F.concat_ws(":", "root.doc_id", "root.at"))
    columns = ["key", "salt", "asks", "outside", "doc_id", "root", "at"]
    whole = F.col("blocks") == 1  # such a signature is compared within its block
    held = placed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.col("blocks")).cast("int")).withColumn("asks", F.lit(False))
    held = held.withColumn("outside", F.col("outside") & whole)
    asked = placed.where(F.col("outside") & ~whole).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = held.select(columns).union(asked.withColumn("asks", F.lit(True)).select(columns))
    near = surroundings(placed.select("doc_id", "at").distinct(), docs, width)
    rows = rows.join(near, ["doc_id", "at"]).select(*columns, "begin", "items")
    rows = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "asks", "doc_id", "at")
    names = [c.split()[0] for c in f"leader bigint, member bigint, {_FOUND}".split(", ")]

    def verify(batches):
        import pyarrow as pa

        group, own, index, above, roots, links = None, [], None, {}, {}, []

        def find(root):
            while root in above:
                up = above[root]
                above[root] = up = above.get(up, up)
                root = up
            return root

        def ask(doc, root, place, begin, items, since, near=None):
            """Compare a place with those of the block from ``since`` on, and with those before if they don't ask themselves;
            of a block of one part only with those that ``near`` names, if given."""
            if len(items) < width:
                return
            mine, here, distinct = find(root), None, None
            for part in index:
                open_ = (part.labels != mine) & (part.docs != doc)
                if since is not None:
                    open_[: max(0, since + 1 - part.begin)] &= ~part.outside[: max(0, since + 1 - part.begin)]
                if not open_.any():
                    continue
                if near is not None:
                    some = (open_ & near).nonzero()[0].tolist()
                else:
                    distinct = _distinct(items, width) if distinct is None else distinct
                    some = part.near(items, distinct, open_, threshold)
                for o in some:
                    if part.labels[o] == mine:
                        continue
                    here = here or _Sequences(items, place, width)
                    other, _, other_place, other_begin, other_items, _ = own[part.begin + o]
                    if part.sequences[o] is None:
                        part.sequences[o] = _Sequences(other_items, other_place, width)
                    match = _nearest(here, part.sequences[o], threshold)
                    if match:
                        above[mine] = new = int(part.labels[o])
                        for each in index:
                            each.labels[each.labels == mine] = new
                        mine = new
                        i, j = begin + match[0], other_begin + match[1]
                        one, two = sorted([(doc, i), (other, j)])
                        links.append((one[0], two[0], one[1], one[1] + min_words, two[1], two[1] + min_words, match[2]))

        def indexed():
            return [_Part(own, k, width, find) for k in range(0, len(own), _PART)]

        def ask_each_other():
            nonlocal index
            asking = [k for k, o in enumerate(own) if o[5]]
            if asking:
                index = indexed()
                together = len(index) == 1 and len(own) <= 8 * len(asking)
                near = index[0].all_near(threshold) if together else [None] * len(own)
                for k in asking:
                    ask(*own[k][:5], k, near[k])

        def found():
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*links)], names=names)

        for batch in batches:
            links = []
            for key, salt, asks, outside, doc, root, at, begin, items in zip(*(c.to_pylist() for c in batch.columns)):
                if group != (key, salt):
                    ask_each_other()
                    group, own, index, above, roots = (key, salt), [], None, {}, {}
                items = np.frombuffer(items, np.uint64)
                root = roots.setdefault(root, len(roots))
                if not asks:
                    if len(items) >= width:
                        own.append((doc, root, at - begin, begin, items, outside))
                elif own:
                    index = index or indexed()
                    ask(doc, root, at - begin, begin, items, None)
            if links:
                yield found()
        links = []
        ask_each_other()
        if links:
            yield found()

    return rows.mapInArrow(verify, f"leader bigint, member bigint, {_FOUND}")


def near_duplicate_passages(
    docs: DataFrame, min_words: int = MIN_WORDS, hashes: int = HASHES, threshold: float = THRESHOLD
) -> DataFrame:
    """Passages of at least ``min_words`` words that documents share, of ``docs`` (doc_id, text).

    Returns doc_id, start_word, end_word, other_doc_id, other_start, other_end, similarity: words
    [start, end) of the document, counted from 0 between white space, are near the other's words: the
    Jaccard similarity of their five-word shingles is at least ``threshold``. Documents that share a
    signature are compared with the first of them, and those that aren't near it there with all the others
    (:func:`missed_links`); two passages that a chain of listed ones connects needn't be listed as a pair.
    ``other_doc_id`` is the smaller document, and the smallest of its text. A copy of a whole text of
    ``min_words`` words or more is a passage of it (similarity 1), and every copy of a text has the passages
    of that text.

    NULL, empty and shorter texts have none, nor have rows without doc_id. Repeated rows are copies of
    themselves and add no rows. Repeats within one document aren't reported, and a passage that lies in another
    one of the same two documents isn't either, so a text that repeats itself has few rows. Only doc_id and text are read.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")

    def read(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            words = pa.array([len(t.split()) for t in texts], pa.int64())
            digests = pa.array([hashlib.md5(t.encode()).digest() for t in texts], pa.binary())
            all_ = pa.RecordBatch.from_arrays([batch.column(0), digests, words], names=["doc_id", "digest", "n_words"])
            yield all_.filter(pc.greater_equal(words, min_words))

    ids = written(docs.mapInArrow(read, "doc_id bigint, digest binary, n_words bigint").distinct())
    texts = written(ids.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    ids = written(ids.join(texts, "digest").select("doc_id", "rep", "n_words"))

    copies = ids.groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("rep")).alias("copy")).where("copy").select("doc_id")
    docs = docs.join(small(written(copies)), "doc_id", "left_anti")

    n_words = ids.where("doc_id = rep").agg(F.sum("n_words")).first()[0] or 0
    pairs = meetings(docs, min_words, hashes, n_words).groupBy("leader", "member").agg(F.collect_list("places").alias("places"))
    pairs = written(pairs)
    judged = compared(pairs, docs, min_words, threshold)
    columns = ["leader", "member", *(c.split()[0] for c in _FOUND.split(", "))]
    found = judged.where("key is null").select(columns).distinct()
    classes = judged.where("key is not null").select([c.split()[0] for c in _CLASSES.split(", ")])
    links = written(search_classes(classes, docs, min_words, threshold).distinct())
    unread = links.select("leader", "member").distinct().join(pairs, ["leader", "member"], "left_anti")
    unread = written(unread.withColumn("places", F.lit(None).cast("array<binary>")))
    late = compared(unread, docs, min_words, threshold).select(columns).distinct()
    found = found.unionByName(late)
    spans = found.join(links.select("leader", "member").distinct(), ["leader", "member"], "left_semi").groupBy("leader", "member")
    spans = spans.agg(F.collect_list(F.struct("other_start", "other_end", "start_word", "end_word")).alias("spans"))
    covered = F.exists("spans", lambda s: F.col("start_word").between(s.start_word, s.end_word) & F.col("end_word").between(s.start_word, s.end_word)
        & F.col("other_start").between(s.other_start, s.other_end) & F.col("other_end").between(s.other_start, s.other_end))
    links = links.join(spans, ["leader", "member"], "left").where(~F.coalesce(covered, F.lit(False))).drop("spans")
    found = found.unionByName(links)
    columns = ["doc_id", "start_word", "end_word", "other_doc_id", "other_start", "other_end", "similarity"]
    of_texts = found.withColumnsRenamed({"leader": "other_doc_id", "member": "rep"}).join(ids.select("doc_id", "rep"), "rep")
    zero, whole = F.lit(0).cast("bigint"), F.col("n_words")
    copies = ids.where("doc_id <> rep").select(
        "doc_id", zero.alias("start_word"), whole.alias("end_word"), F.col("rep").alias("other_doc_id"),
        zero.alias("other_start"), whole.alias("other_end"), F.lit(1.0).alias("similarity"),
    )
    return of_texts.select(columns).unionByName(copies)
