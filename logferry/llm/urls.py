"""URL verdicts from a sorted array of string digests."""

from __future__ import annotations

import os
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logferry.llm.common import SMALL_BYTES, inlined

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HITS = "array<struct<rule:boolean,chars:int,host_chars:int,block:boolean,entry:string>>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to /, ? or # or the end, A-Z lower-cased. Path: up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def entries(spark: SparkSession, rules: dict[str, str], blocked_hosts: list[str]) -> DataFrame:
    """Rules (``host/path`` to allow or block) and listed hosts as rows: entry, rule, block."""
    rows = [(k, True, v == "block") for k, v in rules.items()] + [(h, False, True) for h in blocked_hosts]
    return spark.createDataFrame(rows, "entry string, rule boolean, block boolean")


class DigestArray:
    """Strings by their 64-bit digests: one file with the sorted digests, the strings and a flag byte each.

    The file is memory-mapped and unlinked at once, so that its pages are shared and nothing stays behind.
    """

    def __init__(self, digests: np.ndarray, strings: list[bytes], flags: np.ndarray):
        order = np.argsort(digests, kind="stable")
        ends = np.cumsum([0] + [len(strings[i]) for i in order], dtype=np.int64)
        self.n = len(order)
        descriptor, path = tempfile.mkstemp(prefix="digests-")
        with os.fdopen(descriptor, "wb") as f:
            f.write(digests[order].astype(np.int64).tobytes() + ends.tobytes() + flags[order].astype(np.uint8).tobytes())
            f.writelines(strings[i] for i in order)
        data = np.memmap(path, np.uint8, "r") if self.n else np.zeros(8, np.uint8)
        os.unlink(path)
        cut = np.cumsum([8 * self.n, 8 * (self.n + 1), self.n])
        self.digests, self.ends = data[: cut[0]].view(np.int64), data[cut[0] : cut[1]].view(np.int64)
        self.flags, self.text = data[cut[1] : cut[2]], data[cut[2] :]

    def string(self, i: int) -> bytes:
        return self.text[self.ends[i] : self.ends[i + 1]].tobytes()

    def probe(self, digests: np.ndarray, string) -> list[tuple[int, int]]:
        """(probe, entry) pairs: all probes by binary search at once, hits confirmed by ``string(probe)``."""
        found: list[tuple[int, int]] = []
        at = np.searchsorted(self.digests, digests) if self.n else np.full(len(digests), self.n)
        live = np.arange(len(digests))
        while live.size:  # more than one turn only where entries share a digest
            live = live[at[live] < self.n]
            live = live[self.digests[at[live]] == digests[live]]
            found += [(int(p), int(at[p])) for p in live if self.string(at[p]) == string(p)]
            at[live] += 1
        return found


def _hit(array: DigestArray, i: int) -> dict:
    entry, flag = array.string(i).decode(), int(array.flags[i])
    host = entry.partition("/")[0]
    return {"rule": bool(flag & 1), "chars": len(entry), "host_chars": len(host), "block": bool(flag & 2), "entry": entry}


def _array_of(columns) -> DigestArray:
    digest, entry, flag = columns
    return DigestArray(np.asarray(digest, np.int64), [e.encode() for e in entry], np.asarray(flag, np.uint8))


def probes(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, keys, digests: every string of ``listed`` that could fit the url.

    Those are the host or what follows one of its dots, joined with a start of the path that is as long as the
    path of some entry.
    """
    lengths = listed.select(F.length(F.regexp_extract("entry", "/.*$", 0)).alias("n")).distinct()
    lengths = sorted(r.n for r in lengths.collect())  # at most as many as a url has characters
    host, path = host_and_path(F.col("url"))
    pages = inlined(pages.select("page_id", "url"), host=host, path=path)
    pages = inlined(pages, labels=F.split("host", r"\."), chars=F.length("path"))
    ends = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    pages = inlined(pages, ends=ends)
    starts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.col("chars"))
    pages = inlined(pages, starts=F.transform(starts, lambda n: F.substring(F.col("path"), F.lit(1), n)))
    keys = F.flatten(F.transform("ends", lambda h: F.transform("starts", lambda p: F.concat(h, p))))
    pages = inlined(pages.select("page_id", "host", "path", "ends", "starts"), keys=keys)
    return pages.select("page_id", "host", "path", "keys", F.transform("keys", lambda k: F.xxhash64(k)).alias("digests"))


def matched(pages: DataFrame, listed: DataFrame, limit: int = SMALL_BYTES, shards: int = 64, per_task: int = 1 << 20) -> DataFrame:
    """page_id, host, path, hits: the entries of ``listed`` that fit each url.

    If the entries measure at most ``limit`` bytes, every task maps the whole array and nothing is shuffled.
    Otherwise entries and keys are dealt by digest over ``shards`` arrays, each repeated for as many
    groups of ``per_task`` keys as there are, so that no key makes a task larger.
    """
    listed = listed.select(
        F.xxhash64("entry").alias("digest"), "entry", (F.col("rule").cast("int") + 2 * F.col("block").cast("int")).alias("flag")
    ).distinct()
    urls = probes(pages, listed)
    size = listed.agg(F.sum(F.octet_length("entry") + 64)).first()[0] or 0
    schema = f"page_id bigint, host string, path string, hits {HITS}"
    if size <= limit:
        rows = [tuple(r) for r in listed.select("digest", "entry", "flag").collect()]
        columns = pages.sparkSession.sparkContext.broadcast(list(zip(*rows)) or [(), (), ()])

        def run(batches):
            import pyarrow as pa

            array = _array_of(columns.value)
            for batch in batches:
                keys, digests = batch.column("keys"), batch.column("digests")
                owner = np.repeat(np.arange(batch.num_rows), np.diff(keys.offsets.to_numpy()))
                flat, strings = digests.flatten().to_numpy(), keys.flatten()
                hits: list[list] = [[] for _ in range(batch.num_rows)]
                for p, i in array.probe(flat, lambda p: strings[p].as_py().encode()):
                    hits[owner[p]].append(_hit(array, i))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("page_id", "host", "path")), pa.array(hits, pa.list_(_HIT(pa)))], names=["page_id", "host", "path", "hits"]
                )

        return urls.mapInArrow(run, schema)

    urls = urls.withColumn("row", F.monotonically_increasing_id())
    flat = urls.select("row", "page_id", "host", "path", F.explode(F.arrays_zip("keys", "digests")).alias("k"))
    flat = flat.select("row", "page_id", "host", "path", F.col("k.keys").alias("entry"), F.col("k.digests").alias("digest"))
    salts = max(1, flat.count() // (shards * per_task) + 1)
    shard = F.pmod(F.col("digest"), F.lit(shards)).alias("shard")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("row", "bigint"), ("page_id", "bigint"), ("host", "string"), ("path", "string"))]
    own = listed.select(shard, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), *none, "entry", "digest", "flag")
    asked = flat.select(
        shard, F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"), "row", "page_id", "host", "path", "entry", "digest", F.lit(None).cast("int").alias("flag")
    )
    dealt = own.unionByName(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("flag").isNull())

    def run_sharded(batches):
        import pyarrow as pa

        at, kept, array = None, [], None
        for batch in batches:
            found = []
            rows = batch.to_pylist()
            for r in rows:
                group = (r["shard"], r["salt"])
                if group != at:
                    at, kept, array = group, [], None
                if r["flag"] is not None:
                    kept.append((r["digest"], r["entry"], r["flag"]))
                    continue
                array = array or _array_of(list(zip(*kept)) or [(), (), ()])
                for _, i in array.probe(np.array([r["digest"]]), lambda _: r["entry"].encode()):
                    found.append((r["row"], r["page_id"], r["host"], r["path"], _hit(array, i)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), _HIT(pa)))],
                names=["row", "page_id", "host", "path", "hit"],
            )

    element = HITS[len("array<") : -1]
    hits = dealt.mapInArrow(run_sharded, f"row bigint, page_id bigint, host string, path string, hit {element}")
    hits = hits.groupBy("row", "page_id", "host", "path").agg(F.collect_list("hit").alias("hits"))
    keyed = ["row", "page_id", "host", "path"]
    nothing = urls.select(*keyed, F.array().cast(HITS).alias("hits"))
    both = nothing.unionByName(hits).groupBy(*keyed).agg(F.flatten(F.collect_list("hits")).alias("hits"))
    return both.drop("row")


def _HIT(pa):
    return pa.struct([("rule", pa.bool_()), ("chars", pa.int32()), ("host_chars", pa.int32()), ("block", pa.bool_()), ("entry", pa.string())])


def judge(pages: DataFrame, listed: DataFrame, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, listed_host for every row of ``pages`` (page_id, url).

    The longest rule that fits decides; of equally long ones the one with the longer host, then block.
    Without a rule a url is blocked if its host, or a host above it, is listed, and allowed otherwise.

    NULL urls and those without ``://`` have an empty host and path and are allowed unless a rule fits.
    Repeated rows are judged each. Columns other than page_id and url are not read.
    """
    found = matched(pages, listed, **options)
    best = F.array_max(F.filter("hits", lambda h: h["rule"]))
    on_list = F.array_max(F.filter("hits", lambda h: ~h["rule"]))
    found = inlined(found.select("page_id", "host", "path", "hits"), best=best, on_list=on_list)
    block = F.coalesce(F.col("best.block"), F.col("on_list").isNotNull())
    return found.select(
        "page_id", "host", "path", F.col("best.entry").alias("rule"),
        F.when(block, "block").otherwise("allow").alias("verdict"), F.col("on_list.entry").alias("listed_host"),
    )
