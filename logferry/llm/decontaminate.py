"""Benchmark passages in documents by a positional index of the benchmark's terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logferry.llm.common import checkpointed, inlined, small

WINDOW, SLOP = 10, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; NULL has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """item_id, phrase, terms: runs of ``width`` words of each item; a shorter one is one run, no word none."""
    items = inlined(benchmark.select("item_id", "text").distinct(), w=words(F.col("text"))).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))).alias("at")
    terms = F.slice("w", F.col("at"), F.lit(width))
    return items.select("item_id", "w", at).select("item_id", F.array_join(terms, " ").alias("phrase"), terms.alias("terms")).distinct()


def rarest(phrases: DataFrame, docs: DataFrame) -> DataFrame:
    """phrase, size, and term and place of its two rarest terms, by their counts in all documents.

    Phrases with a term that no document has are left out. A phrase of one word has no second term.
    """
    terms = small(checkpointed(phrases.select(F.explode("terms").alias("term")).distinct()))
    corpus = inlined(docs.select("text"), w=words(F.col("text"))).select(F.explode("w").alias("term"))
    counts = small(checkpointed(corpus.join(terms, "term").groupBy("term").agg(F.count("*").alias("n"))))
    placed = phrases.select("phrase", F.posexplode("terms").alias("place", "term")).join(counts, "term", "left")
    ranked = F.sort_array(F.collect_list(F.struct("n", "place", "term")))
    per = placed.groupBy("phrase").agg(ranked.alias("r"), F.count("*").alias("size"), F.count("n").alias("known"))
    per = per.where("size = known")
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    return per.select(
        "phrase", F.col("size").cast("int").alias("size"), first["term"].alias("term1"), first["place"].alias("place1"),
        second["term"].alias("term2"), second["place"].alias("place2"),
    )


def row_id() -> Column:
    """What tells rows apart: the id and the text. Rows that share it are equal in all that is found here."""
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: term, rid, pos (from 0) of every occurrence of ``terms`` in the documents."""
    rows = inlined(docs.select(row_id().alias("rid"), "text"), w=words(F.col("text")))
    return rows.select("rid", F.posexplode("w").alias("pos", "term")).join(small(terms), "term").select("term", "rid", "pos")


def aligned(index: DataFrame, anchors: DataFrame, slop: int = SLOP) -> DataFrame:
    """rid, phrase, size, start: where the lists of a phrase's two rarest terms meet.

    Each list is shifted by the place of its term in the phrase; the shifted positions may differ by ``slop``.
    Only positions in the same or neighbouring stretches of ``slop`` + 1 words meet.
    """
    first = index.join(small(anchors), index.term == F.col("term1")).select(
        "rid", "phrase", "size", "term2", (F.col("pos") - F.col("place1")).alias("start"), "place2"
    )
    stretch = lambda at: F.floor(at / (slop + 1))
    second = index.select(F.col("term").alias("term2"), "rid", F.col("pos").alias("pos2"), stretch(F.col("pos")).alias("stretch"))
    own = stretch(F.col("start") + F.col("place2"))
    pairs = first.where("term2 is not null").withColumn("stretch", F.explode(F.sequence(own - 1, own + 1)))
    meet = F.abs(F.col("pos2") - F.col("place2") - F.col("start")) <= slop
    return (
        pairs.join(second, ["term2", "rid", "stretch"]).where(meet).select("rid", "phrase", "size", "start")
        .union(first.where("term2 is null").select("rid", "phrase", "size", "start")).distinct()
    )


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """Documents with their matches, and the items of each phrase.

    First: doc_id, rid, n_words, exact and near, arrays of (phrase, start, size). Exact: the phrase stands there.
    Near: all its terms stand within its size and ``slop`` words on either side, but not as the phrase.
    Candidates from the index are checked on the words of the whole text.
    """
    spans = checkpointed(windows(benchmark, width))
    phrases = spans.select("phrase", "terms").distinct()
    anchors = checkpointed(rarest(phrases, docs))
    terms = checkpointed(anchors.select(F.explode(F.array("term1", "term2")).alias("term")).where("term is not null").distinct())
    index = checkpointed(postings(docs, terms))
    found = aligned(index, anchors, slop).groupBy("rid").agg(F.collect_list(F.struct("phrase", "start", "size")).alias("c"))
    found = small(checkpointed(found))
    rows = inlined(docs.select("doc_id", "text", row_id().alias("rid")).join(found, "rid", "left"), w=words(F.col("text")), c2=F.col("c"))

    def from_(x, back: int, more: int) -> Column:
        begin = F.greatest(x["start"] + 1 - back, F.lit(1))
        return F.slice("w", begin, F.greatest(F.least(x["start"] + x["size"] + more, F.size("w")) - begin + 1, F.lit(0)))

    exact = F.filter("c2", lambda x: (x["start"] >= 0) & (F.array_join(from_(x, 0, 0), " ") == x["phrase"]))
    rows = inlined(rows.select("doc_id", "rid", F.size("w").cast("bigint").alias("n_words"), "w", "c2"), exact=exact)
    near = F.filter(
        F.array_except("c2", "exact"), lambda x: F.size(F.array_except(F.split(x["phrase"], " "), from_(x, slop, slop))) == 0
    )
    return rows.select("doc_id", "rid", "n_words", F.when(F.size("exact") > 0, F.col("exact")).alias("exact"), F.when(F.size("c2") > 0, near).alias("near")), spans


def report(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    A word is hit if it lies in any occurrence of a run of ``width`` words of an item. ``n_near`` counts
    phrases that only a proximity match has found in the document.

    NULL, empty and wordless texts have no words and no hits; such items have no phrases; items of equal
    text are all counted. Every row is judged by its own text, also where rows share a doc_id or have none. An empty
    benchmark hits nothing. Columns other than doc_id and text, item_id and text are not read.
    """
    return _judged(docs, benchmark, width, slop).drop("rid")


def without_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no run of words of an item occurs, with all their columns."""
    hit = _judged(docs, benchmark, WINDOW, SLOP).where("contaminated").select("rid").distinct()
    return docs.withColumn("__rid", row_id()).join(small(hit.withColumnRenamed("rid", "__rid")), "__rid", "left_anti").select(docs.columns)


def _judged(docs: DataFrame, benchmark: DataFrame, width: int, slop: int) -> DataFrame:
    rows, spans = matches(docs, benchmark, width, slop)
    places = F.flatten(F.transform("exact", lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1)))
    phrases = F.array_distinct(F.transform("exact", lambda x: x["phrase"]))
    near = F.array_except(F.transform("near", lambda x: x["phrase"]), F.coalesce(phrases, F.array().cast("array<string>")))
    rows = checkpointed(rows.select(
        "doc_id", "rid", "n_words", F.coalesce(F.size(F.array_distinct(places)), F.lit(0)).cast("bigint").alias("n_hit"), phrases.alias("phrases"),
        F.when(F.col("near").isNotNull(), F.size(F.array_distinct(near))).otherwise(0).cast("bigint").alias("n_near"),
    ))
    hit = rows.where("phrases is not null").select("rid", F.explode_outer("phrases").alias("phrase")).distinct()
    items = hit.join(small(spans.select("phrase", F.col("item_id").cast("string").alias("item"))), "phrase").select("rid", "item").distinct()
    items = items.groupBy("rid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = rows.join(small(checkpointed(items)), "rid", "left")
    hits = F.col("phrases").isNotNull()
    return out.select(
        "doc_id", "n_words", F.when(hits, F.col("n_hit")).otherwise(F.lit(0)).cast("bigint").alias("n_hit"),
        F.when(hits, F.size("items")).otherwise(0).cast("bigint").alias("n_items"),
        F.sha2(F.when(hits, F.array_join("items", ",")).otherwise(""), 256).alias("items_sha256"), hits.alias("contaminated"), "n_near", "rid",
    )


# The same rows in DuckDB.
_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(_UPPER, _LOWER)
ORACLE = f"""with d as (select row_number() over () as r, doc_id, {_SQL_WORDS} as w from documents),
b as (select item_id, {_SQL_WORDS} as w from benchmark),
p as (
  select distinct item_id, array_to_string(w[pos:pos + {WINDOW - 1}], ' ') as phrase, least(len(w), {WINDOW}) as size
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) as pos from b where len(w) > 0)),
sizes as (select distinct size from p),
runs as (
  select r, pos, size, array_to_string(w[pos:pos + size - 1], ' ') as phrase
  from (select r, w, size, unnest(generate_series(1, len(w) - size + 1)) as pos from d, sizes where len(w) >= size)),
hit as (select r, pos, runs.size, item_id from runs join p on p.phrase = runs.phrase and p.size = runs.size),
words_hit as (select r, count(distinct pos + i) as n from (select distinct r, pos, size from hit), range({WINDOW}) t(i) where i < size group by r),
items as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct r, cast(item_id as varchar) as item from hit) group by r),
terms as (select phrase, size, unnest(t) as term, generate_subscripts(t, 1) - 1 as place
  from (select distinct phrase, size, string_split(phrase, ' ') as t from p)),
posted as (select r, term, pos from (select r, unnest(w) as term, generate_subscripts(w, 1) - 1 as pos from d)
  where term in (select term from terms)),
counts as (select term, count(*) as n from posted group by term),
ranked as (
  select phrase, size, term, place, row_number() over (partition by phrase order by n, place) as rarity,
    count(*) over (partition by phrase) = size as known
  from terms join counts using (term)),
anchors as (
  select a.phrase, a.size, a.term as term1, a.place as place1, b.term as term2, b.place as place2
  from ranked a join ranked b on a.phrase = b.phrase and b.rarity = 2 where a.rarity = 1 and a.known),
met as (
  select distinct x.r, phrase, size, x.pos - place1 as start
  from anchors join posted x on x.term = term1 join posted y on y.r = x.r and y.term = term2
  where abs(y.pos - place2 - x.pos + place1) <= {SLOP}),
said as (select distinct runs.r, runs.phrase from runs join p on p.phrase = runs.phrase and p.size = runs.size),
near as (
  select met.r, count(distinct met.phrase) as n_near
  from met join d on d.r = met.r left join said on said.r = met.r and said.phrase = met.phrase
  where said.r is null and list_has_all(w[greatest(start + 1 - {SLOP}, 1):least(start + size + {SLOP}, len(w))], string_split(met.phrase, ' '))
  group by met.r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, n is not null as contaminated, coalesce(n_near, 0) as n_near
from d left join words_hit on d.r = words_hit.r left join items on d.r = items.r left join near on d.r = near.r"""
