"""Quality rules whose thresholds follow the documents of each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logferry.llm.common import checkpointed, inlined, small

SPACES, SYMBOLS = r"[\x20\x09-\x0D]+", r"[^#*$%&|<>]+"
WINDOW, MIN_WORDS, MAX_REPEATED = 5, 10, 20
MIN_GROUP, REACH = 100, 6
# Measures of a document: the least spread its threshold allows for, and whether small values fail too.
MEASURES = {"symbols": (10, False), "dup_lines": (50, False), "repeated": (50, False), "word_length": (50, True)}


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text; NULL counts as no word.

    Repeated windows are found by sorting the window hashes of a text, and only of texts that have any.
    """
    df = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.char_length(F.regexp_replace("text", SYMBOLS, "")).cast("bigint")
    df = inlined(df.select("doc_id", "lang", "source", "text"), lines=lines, words=F.array_remove(F.split("text", SPACES), ""), n_symbols=symbols)
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"))
    df = df.withColumn("n_lines", F.size("lines").cast("bigint"))
    df = df.withColumn("word_chars", F.char_length(F.array_join("words", "")).cast("bigint"))
    df = inlined(df.drop("text", "lines"), h=F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    n = F.size("h")
    shifted = [F.slice("h", i + 1, F.greatest(n - i, F.lit(0))).alias(f"h{i}") for i in range(WINDOW)]
    windows = F.transform(F.slice(F.arrays_zip(*shifted), F.lit(1), F.greatest(n - WINDOW + 1, F.lit(0))), lambda w: F.xxhash64(w))
    df = inlined(df.withColumn("n_words", n.cast("bigint")), w=windows).drop("h")
    placed = F.sort_array(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = inlined(df, s=F.when(F.size(F.array_distinct("w")) < F.size("w"), placed)).drop("w")
    h, size, none = F.col("s.h"), F.size("s"), F.array(F.lit(None).cast("bigint"))
    beside = F.arrays_zip(
        F.col("s.i").alias("i"), h.alias("h"),
        F.concat(none, F.slice(h, F.lit(1), size - 1)).alias("p"), F.concat(F.slice(h, F.lit(2), size - 1), none).alias("q"),
    )
    again = F.transform(F.filter(beside, lambda x: (x["h"] == x["p"]) | (x["h"] == x["q"])), lambda x: x["i"])
    df = inlined(df, at=F.when(F.col("s").isNotNull(), F.sort_array(again))).drop("s")
    after = F.concat(F.slice("at", F.lit(2), F.size("at") - 1), F.array(F.element_at("at", -1) + WINDOW))
    covered = F.aggregate(F.zip_with("at", after, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda x, y: x + y)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("at")


def measured(counts: DataFrame) -> DataFrame:
    """Add the measures, as whole numbers: per mille, and hundredths of characters; NULL where there is no word."""

    def share(a: str, b: str, by: int) -> Column:
        return F.expr(f"case when {b} > 0 then ({by} * {a}) div {b} end")

    return counts.withColumns({
        "symbols": share("n_symbols", "word_chars", 1000), "dup_lines": share("n_dup_lines", "n_lines", 1000),
        "repeated": share("n_repeat_words", "n_words", 1000), "word_length": share("word_chars", "n_words", 100),
    })


def sketched(values: DataFrame) -> DataFrame:
    """Quantile sketches (lang, source, measure, bucket, n) of the measures.

    A bucket holds the values that agree in their first six binary digits, so a quantile is off by a
    thirty-second at most. Sketches of any parts of the data merge by adding their counts.
    """
    long = values.select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES
    ])).alias("x")).select("lang", "source", "x.measure", "x.v").where("v is not null")
    cut = F.greatest(F.char_length(F.bin("v")) - 6, F.lit(0)).cast("int")
    bucket = F.expr("shiftleft(shiftright(v, cut), cut)")
    return long.withColumn("cut", cut).groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketches: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """lang, source, and for every measure the lowest and highest value that passes.

    The tenth and fiftieth percentile come from the sketch of the language and source; with fewer than
    ``min_group`` documents from the merged sketch of the language, then of all. Values pass up to
    ``REACH`` times the distance of the two (or the least spread) beyond the median.
    """
    levels = (["lang", "source"], ["lang"], [])
    found = sketches.select("lang", "source").distinct()
    for no, keys in enumerate(levels):
        merged = sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        per = merged.groupBy(*keys, "measure").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("total"))

        def quantile(percent: int) -> Column:  # the first bucket at which the running count reaches its share
            state = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("at"))
            wanted = F.expr(f"({percent} * total + 99) div 100")

            def step(s, x):
                seen = s["seen"] + x["n"]
                return F.struct(seen.alias("seen"), F.coalesce(s["at"], F.when(seen >= wanted, x["bucket"])).alias("at"))

            return F.aggregate("b", state, step)["at"]

        per = per.withColumns({"q10": quantile(10), "q50": quantile(50)})
        floor = F.coalesce(*[F.when(F.col("measure") == m, F.lit(f)) for m, (f, _) in MEASURES.items()])
        reach = F.greatest(F.col("q50") - F.col("q10"), floor) * REACH
        per = per.select(*keys, "measure", "total", (F.col("q50") - reach).alias("lo"), (F.col("q50") + reach).alias("hi"))
        wide = per.groupBy(*keys).agg(
            F.max("total").alias("total"),
            *[F.max(F.when(F.col("measure") == m, F.struct("lo", "hi"))).alias(f"{m}_{no}") for m in MEASURES],
        )
        if no < 2:
            wide = wide.where(F.col("total") >= min_group)
        wide = wide.drop("total")
        renamed = wide.withColumnsRenamed({k: f"_{k}" for k in keys})
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        found = found.join(renamed, on, "left").drop(*[f"_{k}" for k in keys]) if on else found.join(F.broadcast(wide), how="left")  # one row
    return found.select("lang", "source", *[F.coalesce(*[F.col(f"{m}_{no}") for no in range(3)]).alias(f"_{m}") for m in MEASURES])


def judged(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): its counts, base_failed, kept, and failed rules.

    A text fails the base rules with fewer than ten words or if more than a fifth of its words lie in
    repeated five-word windows. Otherwise it is kept if each measure lies within the fences of its
    language and source.

    NULL, empty and blank texts have no words and fail the base rules; they don't count in the sketches. NULL
    languages or sources are groups of their own. Repeated rows are judged each. Other columns are not read.
    """
    values = checkpointed(measured(counted(docs)))
    limits = small(checkpointed(fences(sketched(values), min_group)).withColumnsRenamed({"lang": "_lang", "source": "_source"}))
    own = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    joined = values.join(limits, own, "left")
    broken = [
        F.when((F.col(m) > F.col(f"_{m}.hi")) | (F.lit(low) & (F.col(m) < F.col(f"_{m}.lo"))), F.lit(m)) for m, (_, low) in MEASURES.items()
    ]
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    failed = F.array_join(F.array_compact(F.array(*broken)), ",")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & (failed == "")).alias("kept"), failed.alias("failed_rules"),
    )


# The same rows in DuckDB.
ORACLE = f"""with d as (
  select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text from documents),
parts as (
  select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
spans as (select r, i, array_to_string(words[i:i+4], ' ') as w
  from (select r, words, unnest(generate_series(1, len(words) - 4)) as i from parts where len(words) >= 5)),
again as (select r, i from (select *, count(*) over (partition by r, w) as c from spans) where c > 1),
repeated as (select r, count(distinct i + j) as n from again, range(5) t(j) group by r),
counts as (
  select p.r, doc_id, lang, source, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(len(lines) as bigint) as n_lines,
    cast(coalesce(n, 0) as bigint) as n_repeat_words
  from parts p left join repeated q on p.r = q.r),
m as (
  select *, case when word_chars > 0 then 1000 * n_symbols // word_chars end as symbols,
    case when n_lines > 0 then 1000 * n_dup_lines // n_lines end as dup_lines,
    case when n_words > 0 then 1000 * n_repeat_words // n_words end as repeated,
    case when n_words > 0 then 100 * word_chars // n_words end as word_length from counts),
v as (select r, lang, source, measure, v, greatest(length(bin(v)) - 6, 0) as c
  from (unpivot (select r, lang, source, symbols, dup_lines, repeated, word_length from m)
        on symbols, dup_lines, repeated, word_length into name measure value v)),
b as (select *, (v >> c) << c as bucket from v),
q as (select lvl, case when lvl < 2 then lang end as lang, case when lvl < 1 then source end as source, measure, bucket, count(*) as n
  from b, range(3) t(lvl) group by all),
cum as (select *, sum(n) over (partition by lvl, lang, source, measure order by bucket) as seen,
    sum(n) over (partition by lvl, lang, source, measure) as total from q),
f as (
  select lvl, lang, source, measure, max(total) as total,
    min(bucket) filter (seen >= (10 * total + 99) // 100) as q10, min(bucket) filter (seen >= (50 * total + 99) // 100) as q50
  from cum group by lvl, lang, source, measure),
l as (select *, {REACH} * greatest(q50 - q10, case measure {' '.join(f"when '{k}' then {v[0]}" for k, v in MEASURES.items())} end) as reach from f),
size as (select lvl, lang, source, max(total) as total from l group by all),
pick as (
  select b.r, b.measure, b.v, arg_min(l.q50 - l.reach, l.lvl) as lo, arg_min(l.q50 + l.reach, l.lvl) as hi
  from b join l on l.measure = b.measure and (l.lvl = 2 or (l.lang is not distinct from b.lang and (l.lvl = 1 or l.source is not distinct from b.source)))
  join size s on s.lvl = l.lvl and s.lang is not distinct from l.lang and s.source is not distinct from l.source
  where l.lvl = 2 or s.total >= {MIN_GROUP} group by b.r, b.measure, b.v),
bad as (select r, array_to_string(list_filter(['symbols', 'dup_lines', 'repeated', 'word_length'], lambda x: list_contains(list(measure), x)), ',') as rules
  from pick where v > hi or (measure = 'word_length' and v < lo) group by r),
base as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and rules is null as kept, coalesce(rules, '') as failed_rules
from base left join bad on base.r = bad.r"""
