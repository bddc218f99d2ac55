"""Operators that SQL can express, on tables with odd cases, and what their queries don't reach."""

import random

import fixtures
import pytest
from check_oracle import sorted_rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from logferry.llm import decontaminate, quotes, secrets
from logferry.llm.common import table

NATIVE = ["op2_quality_rules", "op4_secrets", "op9_decontaminate", "op10_quotes"]


def agree(spark, folder, name):
    df = entry.queries()[name](spark, folder)
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), plan
    got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    rel = fixtures.connection(folder).sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == sorted_rows(rel.columns, rel.fetchall())
    return got


@pytest.mark.parametrize("name", NATIVE)
def test_odd_cases(spark, folder, name):
    assert agree(spark, folder, name)


@pytest.mark.parametrize("name", NATIVE)
def test_empty_tables(spark, empty, name):
    assert agree(spark, empty, name) == []


def test_groups_have_their_own_fences(spark, tmp_path):
    marks = "".join(f" ##{i}##" for i in range(25))
    rows = [(i, fixtures.prose(60, i) + (marks if i % 2 else ""), "en", "marked" if i % 2 else "plain", 0) for i in range(400)]
    rows.append((1000, fixtures.prose(60, 1) + marks, "en", "plain", 0))
    folder = fixtures.write(spark, tmp_path / "t", documents=rows)
    agree(spark, folder, "op2_quality_rules")
    kept = {r.doc_id: r.kept for r in entry.queries()["op2_quality_rules"](spark, folder).collect()}
    assert kept[1] and not kept[1000] and sum(kept.values()) >= 395


def test_only_unseen_pairs_are_scanned(spark, folder):
    docs = table(spark, folder, "documents")
    first, rest = docs.where("doc_id < 16"), docs.where("doc_id >= 14")
    found, ledger = secrets.update(first)
    blobs = {bytes(r.blob) for r in ledger.select("blob").distinct().collect()}
    todo = secrets.unseen(rest, ledger).collect()
    assert todo and not blobs & {bytes(r.blob) for r in todo}
    both, grown = secrets.update(rest, ledger, found)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(secrets.per_path(docs, both)) == rows(secrets.per_path(docs, secrets.update(docs)[0]))
    assert grown.count() == grown.distinct().count()
    newer = [secrets.Rule("hex", 2, "[0-9a-f]{40,}") if r.kind == "hex" else r for r in secrets.RULES]
    again = secrets.unseen(docs, grown, newer).collect()
    assert again and all([t.kind for t in r.todo] == ["hex"] for r in again)


def test_redaction_replaces_spans_and_keeps_columns(spark, folder):
    docs = table(spark, folder, "documents")
    out = secrets.redacted(docs, secrets.update(docs)[0])
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    before, after = ({(r.doc_id): r.text for r in df.collect()} for df in (docs, out))
    assert after[15] == 'password = "hunter2hunter2" token=passwd = abcdefghijk'.replace('password = "hunter2hunter2', "[SECRET]")
    assert after[16] == '[SECRET] é [SECRET] api_key: "aé"'
    changed = {i for i in before if before[i] != after[i]}
    assert changed == {15, 16, 17}
    assert all(r.n_chars == len(r.text) for r in out.where("doc_id in (15, 16, 17)").collect())


def test_the_second_delivery_scans_what_is_new(spark, folder, monkeypatch):
    docs = table(spark, folder, "documents")
    blob = secrets.blob_id(F.col("text")).alias("blob")
    old = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0
    scanned, scan = [], secrets.scan
    monkeypatch.setattr(secrets, "scan", lambda todo, rules: (scanned.append({bytes(x.blob) for x in todo.select("blob").collect()}), scan(todo, rules))[1])
    findings, ledger = secrets.deliveries(docs)
    first = {bytes(x.blob) for x in docs.where(old).select(blob).collect()}
    every = {bytes(x.blob) for x in docs.select(blob).collect()}
    assert scanned == [first, every - first] and first and every - first
    assert ledger.count() == ledger.distinct().count() == len(every) * len(secrets.RULES)
    rows = lambda found: sorted(map(str, secrets.per_path(docs, found).collect()))
    assert rows(findings) == rows(secrets.update(docs)[0])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta x gamma delta"), (2, "alpha beta gamma delta"), (3, "delta gamma far far far far alpha beta")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.report(docs, bench).collect()}
    assert (rows[1].n_near, rows[1].contaminated) == (1, False)
    assert (rows[2].n_near, rows[2].contaminated, rows[2].n_hit) == (0, True, 4)
    assert (rows[3].n_near, rows[3].contaminated) == (0, False)


def test_proximity_is_that_of_the_sql(spark):
    import duckdb

    r = random.Random(12)
    items = [" ".join(f"{c}{r.randrange(40)}" for _ in range(r.choice([1, 4, 10, 13]))) for c in "abcdefgh"]
    texts = []
    for _ in range(60):
        w = r.choice(items).split()
        if r.random() < 0.5:
            r.shuffle(w)
        for _ in range(r.randrange(4)):
            w.insert(r.randrange(len(w) + 1), "between")
        texts.append(" ".join(["before"] * r.randrange(5) + w + ["after"] * r.randrange(5)))
    documents = [(i // 2 if i % 3 else None, t) for i, t in enumerate([*texts, None, "", texts[0]])]
    benchmark = list(enumerate([*items, None, items[0]]))
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", documents), ("benchmark", "item_id", benchmark)):
        con.execute(f"create table {name} ({key} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", rows)
    want = con.sql(decontaminate.ORACLE).fetchall()
    found = decontaminate.report(
        spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(benchmark, "item_id long, text string")
    )
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in found.collect())
    assert sum(x[6] > 0 for x in want) > 5


def test_only_close_positions_meet(spark):
    r = random.Random(8)
    places = {t: sorted(r.sample(range(300), 60)) for t in "ab"}
    index = spark.createDataFrame([(t, 1, p) for t in places for p in places[t]], "term string, rid long, pos int")
    anchors = spark.createDataFrame([("x", 10, "a", 7, "b", 2)], "phrase string, size int, term1 string, place1 int, term2 string, place2 int")
    found = decontaminate.aligned(index, anchors)
    assert {x.start for x in found.collect()} == {a - 7 for a in places["a"] if any(abs(b - 2 - a + 7) <= 3 for b in places["b"])}
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "term2" in line]
    assert joins and all("stretch" in line for line in joins)


def test_replies(spark, folder):
    rows = {(r.conv_id, r.turn): r for r in quotes.reply_ordered(table(spark, folder, "conversations")).where("body <> 'same turn'").collect()}
    assert rows[1, 1].parent_turn == 0 and rows[1, 1].body == "Use open()."
    assert rows[1, 2].parent_turn == 1 and rows[1, 2].depth == 2 and rows[1, 2].max_level == 2 and rows[1, 2].body == "It fails."
    assert rows[1, 4].parent_turn == 2 and rows[1, 4].body == "Why?" and rows[1, 4].n_quotes == 3 and rows[1, 4].n_linked == 2
    assert rows[3, 8].parent_turn == 7
    order = sorted((r.reply_path, r.turn) for k, r in rows.items() if k[0] == 1)
    assert [t for _, t in order] == [0, 1, 2, 4, 5, 3]


def test_long_threads(spark):
    parents = spark.createDataFrame([(1, i, i - 1) for i in range(1, 40)], "conv_id long, turn long, parent_turn long")
    assert {r.turn: r.path for r in quotes.reply_paths(parents).collect()} == {i: list(range(i + 1)) for i in range(1, 40)}


def test_paths_sort_for_turns_of_any_size(spark, tmp_path):
    turns = [-(2**63), -5, -1, 0, 3, 10**10 - 1, 10**10, 10**11, 10**11 + 5, 2**63 - 1]
    rows = [(1, t, "user", f"said number {i}") for i, t in enumerate(turns)]
    rows += [(2, t, "user", f"message {i}" if i == 0 else f"> message {i - 1}\nmessage {i}") for i, t in enumerate(turns)]
    found = agree(spark, fixtures.write(spark, tmp_path, conversations=rows), "op10_quotes")
    got = quotes.reply_ordered(table(spark, str(tmp_path), "conversations")).collect()
    assert len(found) == len(got) == len(rows)
    for conv in (1, 2):
        assert [r.turn for r in sorted((r for r in got if r.conv_id == conv), key=lambda r: r.reply_path)] == turns
