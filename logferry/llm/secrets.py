"""Secrets by a ledger of contents: every content is scanned once for every version of a rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logferry.functions.arrays import with_prefix_sums
from logferry.llm.common import checkpointed, inlined, small


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


# The base kinds in their order, then public forms of credentials.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
SPAN = "struct<start:bigint,rank:int,kind:string,stop:bigint>"


def blob_id(text: Column) -> Column:
    """The content's address; NULL is the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def unseen(docs: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """blob, text and the rules (kind, version) still to be scanned, one row per content that has any.

    The ledger meets the addresses alone; text is read again for those that are left, and moves only if they are more
    than can be broadcast. Copies within a task become one row before the shuffle.
    """
    rows = docs.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    every = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        return rows.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", every)
    done = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))
    todo = F.when(F.col("done").isNull(), every).otherwise(F.array_except(every, "done"))
    left = rows.select("blob").distinct().join(done, "blob", "left").select("blob", todo.alias("todo"))
    left = small(checkpointed(left.where(F.size("todo") > 0)))
    return rows.join(left, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blob, kind, version, spans of the matches in each blob (blob, text, todo); no row without a match.

    The pieces between the matches of a pattern give the places: a match starts after all pieces and
    matches before it. Offsets count code points.
    """

    def lengths(found: Column) -> Column:
        return F.transform(found, lambda x: F.char_length(x).cast("bigint"))

    text = F.col("text")
    each = []
    for rank, r in enumerate(rules):
        pattern = F.lit(r.pattern)
        matches = lengths(F.regexp_extract_all(text, pattern, F.lit(0)))
        found = F.struct(
            F.lit(rank).alias("rank"), F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"),
            matches.alias("matches"), lengths(F.split(text, r.pattern, -1)).alias("pieces"),
            (lengths(F.regexp_extract_all(text, pattern, F.lit(r.group))) if r.group else F.array().cast("array<bigint>")).alias("values"),
        )
        wanted = F.array_contains("todo", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")))
        each.append(F.when(wanted & text.rlike(r.pattern), found))
    rows = blobs.select("blob", F.explode_outer(F.array_compact(F.array(*each))).alias("f")).where("f is not null").select("blob", "f.*")
    rows = rows.withColumn("steps", F.zip_with("matches", F.slice("pieces", F.lit(1), F.size("matches")), lambda m, p: m + p))
    rows = with_prefix_sums(rows, "steps", "ends")
    zipped = F.arrays_zip(F.col("ends"), F.col("matches"), F.when(F.size("values") > 0, F.col("values")).otherwise(F.col("matches")).alias("tested"))
    spans = F.transform(
        F.filter(zipped, lambda x: x["tested"] >= F.col("least")),
        lambda x: F.struct((x["ends"] - x["matches"]).alias("start"), F.col("rank"), F.col("kind"), x["ends"].alias("stop")),
    )
    return rows.select("blob", "kind", "version", spans.alias("spans")).where(F.size("spans") > 0)


def update(docs: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger) after the contents of ``docs`` (text), one row for every version of every path.

    ``ledger`` holds the pairs (blob, kind, version) scanned before, ``findings`` what they gave. Only unseen
    pairs are scanned; both tables return with theirs added, to be kept for the next run. A rule whose
    pattern changes takes a new version.
    """
    todo = unseen(docs, ledger, rules)
    found = checkpointed(scan(todo, rules))
    pairs = todo.select("blob", F.explode("todo").alias("p")).select("blob", "p.kind", "p.version")
    return (
        found if findings is None else findings.unionByName(found),
        pairs if ledger is None else ledger.unionByName(pairs),
    )


def deliveries(docs: DataFrame, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger) of ``docs`` (doc_id, text) that arrive twice: first about half of them, dealt by the
    CRC-32 of doc_id, then all, old and new.

    The tables that the first delivery leaves are written, and the second one scans only what they don't list.
    """
    first = docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0)
    findings, ledger = update(first, rules=rules)
    return update(docs, checkpointed(ledger), findings, rules)


def per_path(docs: DataFrame, findings: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of the base kinds, base_sha256, spans, n_secrets.

    Findings of the rules' present versions are joined to all paths that have the content. NULL and empty
    texts have none: their spans are empty. Repeated rows each get their findings. Columns of ``docs``
    other than doc_id and text are not read.
    """
    now = F.lit(False)
    for r in rules:
        now = now | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    own = findings.where(now).groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("s"))
    paths = docs.select("doc_id", blob_id(F.col("text")).alias("blob")).join(checkpointed(own), "blob", "left")
    paths = paths.withColumn("s", F.coalesce("s", F.array().cast(f"array<{SPAN}>")))

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("s", lambda x: x["kind"].isin(*BASE))
    return paths.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("s")).alias("spans"),
        F.size("s").cast("bigint").alias("n_secrets"),
    )


def redacted(docs: DataFrame, findings: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its findings replaced by ``mark``, and n_chars, if there, counted anew.

    Overlapping spans become one mark. Texts without findings, NULL and empty ones stay as they are, and
    so do all other columns.
    """
    own = checkpointed(findings.groupBy(F.col("blob").alias("__llm_blob")).agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("__llm_spans")))
    rows = docs.withColumn("__llm_own", blob_id(F.col("text"))).join(own, F.col("__llm_own") == F.col("__llm_blob"), "left")
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.array().cast("array<string>").alias("out"), zero.alias("at"))

    def step(s, x):
        clear = x["start"] >= s["at"]
        before = F.substring(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        out = F.when(clear, F.concat(s["out"], F.array(before, F.lit(mark)))).otherwise(s["out"])
        return F.struct(out.alias("out"), F.greatest(s["at"], x["stop"]).alias("at"))

    done = F.aggregate("__llm_spans", start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(F.col("text"), (s["at"] + 1).cast("int"))))
    rows = inlined(rows, __llm_text=F.when(F.col("__llm_spans").isNotNull(), done))
    new = F.col("__llm_text")
    changed = {"text": F.coalesce(new, F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.char_length(new).cast("bigint"), F.col("n_chars").cast("bigint"))
    types = dict(docs.dtypes)
    return rows.select(*[changed[c].cast(types[c]).alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


_SQL = "\n".join(
    f"""{'select' if i == 0 else 'union all select'} r, {i} as rank, '{r.kind}' as kind, {r.least} as least,
  regexp_extract_all(text, '{{0}}', 0) as m, string_split_regex(text, '{{0}}') as p, regexp_extract_all(text, '{{0}}', {r.group}) as g from d""".replace(
        "{0}", r.pattern.replace("'", "''")
    )
    for i, r in enumerate(RULES)
)
# The same rows in DuckDB.
ORACLE = f"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
f as ({_SQL}),
e as (select r, rank, kind, least, m, p, g, unnest(generate_series(1, len(m))) as i from f where len(m) > 0),
s as (
  select r, rank, kind, length(m[i]) as n,
    list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as start
  from e where length(g[i]) >= least),
t as (select *, kind || ':' || cast(start as bigint) || ':' || cast(start + n as bigint) as w from s),
a as (
  select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(w, ',' order by start, rank) filter (rank < 3) as base, string_agg(w, ',' order by start, rank) as spans, count(*) as n_secrets
  from t group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_secrets, 0) as n_secrets
from d left join a on d.r = a.r"""
