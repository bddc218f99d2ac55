"""Conversations without quotations, in the order of replies."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logferry.llm.common import checkpointed, inlined

QUOTED = r"^(?:[ \t]{0,3}>)+[ \t]?"
_INTRO = r"^(On|Am|Le|El)\b.*(wrote|schrieb|écrit|escribió) ?:[ \t]*$"


def normalised(text: Column) -> Column:
    """Letters and digits in lower case with single spaces between, NULL if there are none."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain != "", plain)


def messages(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, lines (level and content), body: what the message says itself.

    The level of a line is the number of its quotation signs. Lines that only introduce a quotation are no
    part of the body, nor are blank lines around it.
    """
    rows = inlined(turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")), split=F.split("text", "\r?\n"))

    def parsed(line):
        signs = F.regexp_extract(line, QUOTED, 0)
        level = F.char_length(F.regexp_replace(signs, "[^>]", ""))
        return F.struct(level.alias("level"), F.substr(line, F.char_length(signs) + 1).alias("content"))

    rows = inlined(rows.drop("text"), lines=F.transform("split", parsed)).drop("split")
    own = F.filter("lines", lambda x: (x["level"] == 0) & ~x["content"].rlike(_INTRO))
    body = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["content"]), "\n"), r"^\s+|\s+$", "")
    return inlined(rows, body=body)


def passages(rows: DataFrame) -> DataFrame:
    """conv_id, turn, level, run, parts: runs of lines of one level, as digests of the whole and of each line.

    The windows hold the quoted lines of one message.
    """
    quoted = rows.where(F.exists("lines", lambda x: x["level"] > 0)).withColumn("copy", F.monotonically_increasing_id())
    lines = checkpointed(quoted.select("conv_id", "turn", "copy", F.posexplode("lines").alias("no", "x")).select("conv_id", "turn", "copy", "no", "x.*").where("level > 0"))
    same = Window.partitionBy("copy", "level").orderBy("no")
    lines = lines.withColumn("run", F.col("no") - F.row_number().over(same))
    runs = lines.groupBy("conv_id", "turn", "copy", "level", "run").agg(F.sort_array(F.collect_list(F.struct("no", "content"))).alias("l"))
    content = F.transform("l", lambda x: x["content"])
    each = F.array_distinct(F.array_compact(F.transform(content, lambda x: F.md5(normalised(x)))))
    return runs.select("conv_id", "turn", "copy", "level", "run", F.md5(normalised(F.array_join(content, "\n"))).alias("whole"), each.alias("each")).where("whole is not null")


def links(rows: DataFrame) -> DataFrame:
    """conv_id, turn, copy, level, run, origin: the turn that each quoted passage comes from, NULL if none is found.

    What a message says itself is hashed as a whole, by paragraph and by line. The original of a passage is
    the first message of the conversation, before the quoting one, that says it; failing that, the
    message that first said most of its lines, the earliest of equals.
    """
    quoted = checkpointed(passages(rows))
    units = F.array_distinct(F.concat(F.array("body"), F.split("body", r"\n\s*\n"), F.split("body", "\n")))
    said = rows.select("conv_id", "turn", F.explode_outer(units).alias("unit")).select("conv_id", "turn", F.md5(normalised(F.col("unit"))).alias("hash"))
    said = said.where("hash is not null").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    parts = F.concat(F.array(F.struct(F.col("whole").alias("hash"), F.lit(True).alias("is_whole"))),
                     F.transform("each", lambda h: F.struct(h.alias("hash"), F.lit(False).alias("is_whole"))))
    asked = quoted.select("conv_id", "turn", "copy", "level", "run", F.explode(parts).alias("p")).select("conv_id", "turn", "copy", "level", "run", "p.*")
    found = asked.join(said, ["conv_id", "hash"]).where("origin < turn")
    key = ["conv_id", "turn", "copy", "level", "run"]
    votes = found.groupBy(*key, "origin").agg(F.max("is_whole").alias("is_whole"), F.sum(F.when(F.col("is_whole"), 0).otherwise(1)).alias("n"))
    best = votes.groupBy(*key).agg(F.max(F.struct("is_whole", "n", F.bitwise_not("origin").alias("minus"))).alias("b"))
    return quoted.select(*key).join(best.select(*key, F.bitwise_not("b.minus").alias("origin")), key, "left")


def reply_paths(parents: DataFrame) -> DataFrame:
    """conv_id, turn, path: the turns from the first message of a thread to this one, for those with a parent.

    Paths double their length with each round, so a thread of n replies takes log2(n) rounds.
    """
    paths = checkpointed(parents.select("conv_id", "turn", F.array("turn").alias("path"), F.col("parent_turn").alias("up")))
    while not paths.where("up is not null").isEmpty():
        above = paths.select("conv_id", F.col("turn").alias("up"), F.col("path").alias("before"), F.col("up").alias("next"))
        joined = paths.join(above, ["conv_id", "up"], "left")
        before = F.when(F.col("up").isNull(), F.array().cast("array<bigint>")).otherwise(F.coalesce("before", F.array("up")))
        paths = checkpointed(joined.select("conv_id", "turn", F.concat(before, "path").alias("path"), F.col("next").alias("up")))
    return paths.select("conv_id", "turn", "path")


def _sortable(turn: Column) -> Column:
    """Text that sorts like the number, of any size and sign: ten digits, or a mark and nineteen."""
    raised = (turn.cast("decimal(20,0)") + F.lit(Decimal(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")
    return (
        F.when(turn < 0, F.concat(F.lit("-"), F.lpad(raised, 19, "0")))
        .when(turn >= 10**10, F.concat(F.lit("a"), F.lpad(turn.cast("string"), 19, "0")))
        .otherwise(F.lpad(turn.cast("string"), 10, "0"))
    )


def reply_ordered(turns: DataFrame) -> DataFrame:
    """One row per row of ``turns`` (conv_id, turn, role, text), without quotations and with its place.

    Returns conv_id, turn, role, body, formatted, parent_turn, depth, thread_turn, reply_path, n_quotes,
    n_linked, max_level. The parent is the origin of the outermost quoted passage that has one, the latest
    of several. Rows of a conversation sorted by reply_path stand in the order of replies: every message
    after the one it answers, and before what comes later in the thread above.

    NULL and empty texts have an empty body. A NULL role is formatted as unknown, messages without conv_id or
    turn are never linked. Messages of one turn share their parent, the latest of theirs; repeated rows
    are returned each. A passage said in several messages belongs to the first. Columns other than the
    four are not read.
    """
    rows = messages(turns)
    found = checkpointed(links(rows))
    level = F.min(F.when(F.col("origin").isNotNull(), F.col("level")))
    outer = found.groupBy("conv_id", "turn").agg(level.alias("outer"))
    parents = found.join(outer, ["conv_id", "turn"]).where("origin is not null and level = outer")
    parents = checkpointed(parents.groupBy("conv_id", "turn").agg(F.max("origin").alias("parent_turn")))
    paths = checkpointed(reply_paths(parents).join(parents, ["conv_id", "turn"]))
    # The two counts are of the row itself; a passage's origin is the same in all rows of a turn.
    per_turn = found.groupBy("conv_id", "turn", "copy").agg(F.count("*").alias("q"), F.count("origin").alias("l")).groupBy("conv_id", "turn").agg(
        F.max("q").alias("n_quotes"), F.max("l").alias("n_linked"))
    out = rows.join(per_turn, ["conv_id", "turn"], "left").join(paths, ["conv_id", "turn"], "left")
    path = F.coalesce("path", F.array("turn"))
    return out.select(
        "conv_id", "turn", "role", "body",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("body"), F.lit("\n")).alias("formatted"),
        "parent_turn", (F.size(path) - 1).cast("bigint").alias("depth"), F.get(path, F.lit(0)).alias("thread_turn"),
        F.array_join(F.transform(path, _sortable), "/").alias("reply_path"),
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.array_max(F.transform("lines", lambda x: x["level"])).cast("bigint").alias("max_level"),
    )


def _norm(x: str) -> str:
    return f"nullif(trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '')"


# The same rows in DuckDB.
ORACLE = f"""with recursive m as (
  select row_number() over () as r, conv_id, turn, role, string_split_regex(coalesce(text, ''), '\\r?\\n') as lines from conversations),
l as (select r, conv_id, turn, generate_subscripts(lines, 1) as no, unnest(lines) as line from m),
s as (
  select r, conv_id, turn, no, length(regexp_replace(signs, '[^>]', '', 'g')) as level, substr(line, length(signs) + 1) as content
  from (select *, regexp_extract(line, '{QUOTED}') as signs from l)),
b as (
  select m.r, m.conv_id, m.turn, m.role, max(s.level) as max_level,
    regexp_replace(coalesce(string_agg(content, chr(10) order by no) filter (level = 0 and not regexp_matches(content, '{_INTRO}')), ''),
      '^\\s+|\\s+$', '', 'g') as body
  from m join s on s.r = m.r group by all),
runs as (select *, no - row_number() over (partition by r, level order by no) as run from s where level > 0),
passage as (
  select r, conv_id, turn, level, run, {_norm("string_agg(content, chr(10) order by no)")} as whole, list_distinct(list({_norm("content")})) as each
  from runs group by r, conv_id, turn, level, run having whole is not null),
units as (
  select conv_id, turn, {_norm("unnest(list_concat([body], string_split_regex(body, chr(10) || '\\s*' || chr(10)), string_split(body, chr(10))))")} as hash from b),
said as (select conv_id, hash, min(turn) as origin from units where hash is not null group by all),
asked as (
  select r, conv_id, turn, level, run, whole as hash, true as is_whole from passage
  union all select r, conv_id, turn, level, run, unnest(each), false from passage),
votes as (
  select r, conv_id, turn, level, run, origin, bool_or(is_whole) as w, count(*) filter (not is_whole) as n
  from asked join said using (conv_id, hash) where origin < turn group by all),
linked as (
  select r, conv_id, turn, level, run, first(origin order by w desc, n desc, origin) as origin from votes group by all),
quoted as (select p.r, p.conv_id, p.turn, p.level, origin from passage p left join linked k on (k.r, k.level, k.run) = (p.r, p.level, p.run)),
parents as (
  select conv_id, turn, max(origin) as parent_turn from quoted q
  where origin is not null and level = (select min(level) from quoted x where x.origin is not null and x.conv_id = q.conv_id and x.turn = q.turn) group by all),
up as (
  select conv_id, turn, [turn] as path, parent_turn as up from parents
  union all select up.conv_id, up.turn, list_prepend(up.up, up.path), p.parent_turn
  from up left join parents p on p.conv_id = up.conv_id and p.turn = up.up where up.up is not null),
paths as (select conv_id, turn, path from up where up is null),
counts as (
  select conv_id, turn, max(q) as n_quotes, max(k) as n_linked
  from (select r, conv_id, turn, count(*) as q, count(origin) as k from quoted group by all) group by all),
o as (
  select b.*, parent_turn, coalesce(path, [b.turn]) as path, n_quotes, n_linked
  from b left join parents p on p.conv_id = b.conv_id and p.turn = b.turn left join paths t on t.conv_id = b.conv_id and t.turn = b.turn
  left join counts c on c.conv_id = b.conv_id and c.turn = b.turn)
select conv_id, turn, role, body, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || body || chr(10) as formatted, parent_turn,
  cast(len(path) - 1 as bigint) as depth, path[1] as thread_turn,
  coalesce(array_to_string(list_transform(path, lambda x: case when x < 0 then '-' || lpad(cast(cast(x as hugeint) + 9223372036854775808 as varchar), 19, '0')
    when x >= 10000000000 then 'a' || lpad(cast(x as varchar), 19, '0') else lpad(cast(x as varchar), 10, '0') end), '/'), '') as reply_path,
  coalesce(n_quotes, 0) as n_quotes, coalesce(n_linked, 0) as n_linked, cast(max_level as bigint) as max_level
from o"""
