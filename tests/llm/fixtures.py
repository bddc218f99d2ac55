"""Small tables with the cases that every operator must handle."""

import random

import duckdb
from pyspark.sql import types as T

EXTRA = "w string, keys int, digest string, score double, __x string"  # names that the operators use inside


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "ther", "ou", "est", "ing", "re", "ti", "ly"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def documents():
    shared, base = prose(70, 1), prose(300, 2)
    near = base.split()
    near[10], near[200] = "changed", "again"
    texts = [
        None, "", "   \n ", "!!! ???", "one two three", base, base, " ".join(near), base,  # copies and a near copy
        prose(120, 3) + " " + shared + " " + prose(90, 4), prose(200, 5) + " " + shared, prose(60, 6),
        "x " * 30_000, prose(20_000, 7), "a line that is here again and again\n" * 40,
        'password = "hunter2hunter2" token=passwd = abcdefghijk', "AKIA" + "A1" * 8 + " é " + "0f" * 20 + ' api_key: "aé"',
        "token=secret=abcdefgh token: x secret:abcdefgh" + " token = " + "f" * 40, prose(30, 8) + " ### $$$ %%% " * 20,
        "Benchmark words one two three four five six seven eight nine ten eleven, and more of them",
        "ONE two-three four; five six seven eight nine ten eleven", "tiny item here", "naïve Élan 中文 words",
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 2 if i % 5 else 2], len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[11], rows[0]]  # repeated rows


def benchmark():
    texts = ["words one two three four five six seven eight nine ten eleven", None, "", "tiny item", "tiny item", "中文", prose(40, 9), "the absent phrase here"]
    return [(i, t) for i, t in enumerate(texts)]


def conversations():
    return [
        (1, 0, "user", "Hello there.\nHow do I read a file?\n\nThanks"),
        (1, 1, "assistant", "> How do I read a file?\n\nUse open()."),
        (1, 2, "user", "On Monday someone wrote:\n> > How do I read a file?\n>\n> Use open().\n\nIt fails."),
        (1, 3, "user", "> Hello there.\n> How do I read a FILE?\nMe too"),
        (1, 4, "assistant", ">> Use  open()\n> It fails.\nWhy?\n> never said"),
        (1, 4, None, "same turn"), (1, 5, "user", "> same turn\nok"), (1, 5, "user", "> same turn\nok"),
        (2, 0, "user", None), (2, 1, "user", ""), (2, 2, "user", ">\n> \n"), (None, 1, "user", "> x"), (3, None, "user", "y"),
        (3, 7, "user", "\n".join(f"line {i}" for i in range(3000))), (3, 8, "user", "> line 17\n> line 18\nyes"),
    ]


SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
}
ROWS = {"documents": documents, "benchmark": benchmark, "conversations": conversations}


def write(spark, folder, empty=False, extra=True, **rows):
    """Write the tables below ``folder``; the documents also have columns with clashing names."""
    for name, schema in SCHEMAS.items():
        own = [] if empty else rows.get(name, ROWS.get(name, list)())
        df = spark.createDataFrame(own, T._parse_datatype_string(schema))
        if extra and name == "documents":
            df = df.selectExpr("*", "'w' as w", "1 as keys", "text as digest", "0.5 as score", "'x' as c", "'x' as leader")
        df.coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def connection(folder):
    con = duckdb.connect()
    for name in SCHEMAS:
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    return con
