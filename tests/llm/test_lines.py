"""Line deduplication against SQL and against brute force."""

from __future__ import annotations

from collections import defaultdict

import duckdb

from tidemark.llm import lines, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, docs string, last long, n_lines int"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "d", 5, 1) for i, t in rows], SCHEMA)


def brute(rows):
    def rank(i):
        return -(1 << 63) if i is None else i

    holders = defaultdict(set)
    for k, (_, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            holders[line.strip(BLANKS).translate(UPPER)].add(k)
    out = []
    for i, t in rows:
        split = (t or "").split("\n")
        kept = []
        for line in split:
            key = line.strip(BLANKS).translate(UPPER)
            at = holders[key]
            if len(key) < 20 or len(at) < 3 or rank(i) == max(rank(rows[k][0]) for k in at):
                kept.append(line)
        out.append((i, len(split), len(split) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in lines.drop_repeated_lines(df).collect()), key=str)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    want = con.execute(queries.ORACLE["op4_line_dedup"])
    names = [c[0] for c in want.description]
    rows = queries.QUERIES["op4_line_dedup"](spark, SMALL).select(*names).collect()
    assert {tuple(r) for r in rows} == set(want.fetchall())


def test_edges(spark):
    line = "This line is long enough to count"
    rows = [
        (1, f"{line}\nown text of one\n{line.upper()}"),
        (2, f"  {line}\t\r\nshort\nshort"),
        (3, f"\x0b{line.lower()}\x0c"),
        (4, None),
        (5, ""),
        (6, "\n\n"),
        (7, "ééééééééééééééééééé\nöööööööööööööööööööö"),
        (8, "ééééééééééééééééééé\nöööööööööööööööööööö"),
        (9, "ééééééééééééééééééé\nöööööööööööööööööööö \nöööööööööööööööööööö"),
        (None, f"{line}\nx"),
        (3, f"{line} \nrepeated id"),
        (10, "y" * 3_000_000 + "\nz"),
        (11, "z\n" + "y" * 3_000_000),
        (12, "y" * 3_000_000),
    ]
    assert got(frame(spark, rows)) == brute(rows)
    assert got(frame(spark, [])) == []
    nulls = [(None, line)] * 3
    assert got(frame(spark, nulls)) == brute(nulls)


def test_shards_agree_with_one(spark, monkeypatch):
    rows = [(i, "\n".join(f"line number {(i * k) % 37} of the common stock" for k in range(9))) for i in range(60)]
    one = got(frame(spark, rows))
    monkeypatch.setattr(lines, "SHARD_KEYS", 5)
    assert got(frame(spark, rows)) == one == brute(rows)
