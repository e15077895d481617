from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import assemble
from tidemark.operators.sizing import Sizing

COLUMNS = [("id", 20, True), ("name", 25, False), ("price", 23, False), ("in_stock", 16, False)]
NAMES = [c.split()[0] for c in "slot msg_seq tag xid relation_id commit_lsn commit_ts_us schema table rel_columns new_tuple old_tuple captured_ts_us".split()]


class Stream:
    """Builds tokenised messages."""

    def __init__(self, slot="s"):
        self.rows, self.slot = [], slot

    def add(self, tag, **values):
        self.rows.append({"slot": self.slot, "msg_seq": len(self.rows) + 1, "tag": tag, **values})
        return self

    def begin(self, xid=42):
        return self.add("B", xid=xid)

    def relation(self, columns=None, rel=1):
        return self.add("R", relation_id=rel, schema="public", table="products", rel_columns=columns or COLUMNS)

    def row(self, tag, cells, rel=1):
        return self.add(tag, relation_id=rel, **{"old_tuple" if tag == "D" else "new_tuple": cells})

    def commit(self, lsn=32, ts=200):
        return self.add("C", commit_lsn=lsn, commit_ts_us=ts)

    def frame(self, spark):
        return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in self.rows], assemble.MESSAGE_SCHEMA)


def t(text):
    return ("t", text, None)


NULL, KEPT = ("n", None, None), ("u", None, None)
ROW = [t("7"), t("lamp"), t("100"), t("t")]


def events(spark, stream, **options):
    return assemble.assemble_transactions(stream.frame(spark), "catalog", **options).orderBy("slot", "msg_seq").collect()


def errors(spark, stream):
    return {r["msg_seq"]: r["error"] for r in assemble.message_errors(stream.frame(spark)).collect()}


def test_insert_update_delete(spark):
    s = Stream().relation().begin().row("I", ROW).row("U", [t("7"), KEPT, t("5"), t("f")])
    s.row("D", [t("7"), NULL, NULL, NULL]).commit(lsn=0x1_0000_0020, ts=200)
    got = events(spark, s)
    assert [e["op"] for e in got] == ["c", "u", "d"]
    assert [e["seq"] for e in got] == [0, 1, 2]
    assert {e["commit_lsn"] for e in got} == {"1/20"}
    assert {e["commit_ts_us"] for e in got} == {946_684_800_000_200}
    assert got[0]["after"] == {"id": "7", "name": "lamp", "price": "100", "in_stock": "true"}
    assert got[1]["after"] == {"id": "7", "price": "5", "in_stock": "false"}
    assert got[2]["after"] is None and got[2]["before"] == {"id": "7", "name": None, "price": None, "in_stock": None}
    assert all(e["pk"] == {"id": "7"} for e in got)
    assert got[0]["source"].asDict() == {"db": "catalog", "schema": "public", "table": "products"}
    want = hashlib.sha256(b"catalog|public|products|1/20|42|0").hexdigest()
    assert got[0]["event_id"] == want and len(want) == 64


def test_nothing_comes_out_before_the_commit(spark):
    assert events(spark, Stream().relation().begin().row("I", ROW)) == []


def test_new_begin_discards_an_unfinished_transaction(spark):
    s = Stream().relation().begin(1).row("I", ROW).begin(2).row("I", [t("8"), *ROW[1:]]).commit()
    got = events(spark, s)
    assert [(e["pk"]["id"], e["xid"], e["seq"]) for e in got] == [("8", 2, 0)]


@pytest.mark.parametrize("tag", ["T", "Y", "O"])
def test_ignored_tags(spark, tag):
    s = Stream().relation().begin().add(tag).row("I", ROW).add(tag).commit()
    assert len(events(spark, s)) == 1 and errors(spark, s) == {}


def test_message_errors(spark):
    s = Stream().relation().begin()
    s.add("Z").add("").row("I", ROW, rel=99).add("I", relation_id=1).add("U", relation_id=1).add("D", relation_id=1)
    s.row("I", ROW[:3]).row("I", [("x", "1", None), *ROW[1:]]).row("I", [t("seven"), *ROW[1:]]).commit()
    s.row("I", ROW)
    assert errors(spark, s) == {
        3: "unsupported message type", 4: "empty message", 5: "unknown relation id",
        6: "insert message has no new tuple", 7: "update message has no new tuple",
        8: "delete message has no old/key tuple", 9: "tuple and relation differ in columns",
        10: "unknown tuple data kind", 11: "invalid integer text", 13: "no open transaction",
    }
    assert events(spark, s) == []


def test_nulls_and_binary(spark):
    s = Stream().relation().begin().row("I", [t("7"), ("b", None, bytearray(b"\xde\xad")), NULL, NULL]).commit()
    assert events(spark, s)[0]["after"] == {"id": "7", "name": "dead", "price": None, "in_stock": None}


def test_later_relation_replaces_the_earlier(spark):
    s = Stream().relation().begin().row("I", ROW).commit(lsn=16)
    s.relation([("id", 20, True), ("note", 25, False)]).begin().row("I", [t("8"), t("x")]).commit(lsn=32)
    assert [e["after"] for e in events(spark, s)][1] == {"id": "8", "note": "x"}


def test_bad_row_does_not_shift_identities(spark):
    good = Stream().relation().begin().row("I", ROW).row("I", ROW).row("I", ROW).commit()
    bad = Stream().relation().begin().row("I", ROW).row("I", ROW[:2]).row("I", ROW).commit()
    first, second = events(spark, good), events(spark, bad)
    assert [e["event_id"] for e in second] == [first[0]["event_id"], first[2]["event_id"]]


def test_key_column_left_out_of_the_row_is_not_in_pk(spark):
    s = Stream().relation().begin().row("U", [KEPT, t("n"), t("1"), t("t")]).commit()
    assert events(spark, s)[0]["pk"] == {}


def run(stream):
    """Message by message."""
    relations, xid, pending, out = {}, None, [], []
    for m in stream.rows:
        if m["tag"] == "B":
            xid, pending = m["xid"], []
        elif m["tag"] == "R":
            relations[m["relation_id"]] = m["rel_columns"]
        elif m["tag"] == "C":
            out += [(m["commit_lsn"], xid, i, seq, width) for i, (seq, width) in enumerate(pending)]
            xid, pending = None, []
        else:
            pending.append((m["msg_seq"], len(relations[m["relation_id"]])))
    return out


@pytest.mark.parametrize("rows_per_chunk", [10_000, 12])
def test_random_streams_equal_the_message_loop(spark, rows_per_chunk):
    rng = random.Random(rows_per_chunk)
    frames, want = None, {}
    for slot in ("a", "b"):
        s = Stream(slot).relation()
        width, lsn = 4, 16
        for _ in range(40):
            if rng.random() < 0.2:
                width = rng.choice([2, 4])
                s.relation(COLUMNS[:width])
            s.begin(rng.randrange(1000))
            # One transaction is much larger than the rest.
            for _ in range(60 if lsn == 160 else rng.randrange(4)):
                s.row(rng.choice("IU"), ROW[:width])
            if rng.random() < 0.8:
                s.commit(lsn=lsn)
            lsn += 16
        want[slot] = run(s)
        frames = s.frame(spark) if frames is None else frames.unionByName(s.frame(spark))
    got = assemble.assemble_transactions(frames, "db", size=Sizing(rows_per_chunk=rows_per_chunk)).collect()
    for slot in ("a", "b"):
        rows = sorted((r for r in got if r["slot"] == slot), key=lambda r: r["msg_seq"])
        assert [(r["lsn"], r["xid"], r["seq"], r["msg_seq"], len(r["after"])) for r in rows] == want[slot]


def test_take_until_stops_at_a_commit_boundary(spark):
    df = spark.createDataFrame([(16, 0), (16, 1), (32, 0), (48, 0), (48, 1)], "lsn bigint, seq int")
    for n, want in ((1, 2), (2, 2), (3, 3), (4, 5), (9, 5)):
        assert assemble.take_until(df, n, size=Sizing(rows_per_chunk=2)).count() == want


def test_signed_xid(spark):
    got = spark.range(1).select(
        assemble.signed_xid(F.lit(7).cast("bigint")), assemble.signed_xid(F.lit(2**31).cast("bigint"))
    ).first()
    assert list(got) == [7, -(2**31)]


def test_long_logs_are_read_once(spark, tmp_path):
    """In the form for long logs the plan reads the log for its tuples and the kept numbers, no more."""
    from tidemark.plans import inputs

    path = str(tmp_path / "messages")
    inputs.messages(spark, "/root/testdata/sf0.001").write.parquet(path)
    log = spark.read.parquet(path)
    size = Sizing(rows_per_chunk=200)
    for made in (assemble.assemble_transactions(log, "db", size=size), assemble.message_errors(log, size=size)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= 6
        assert sum("messages" in x for x in plan.splitlines() if "FileScan" in x) <= 2
    short = assemble.assemble_transactions(log, "db", size=Sizing(at_most=10_000)).collect()
    long = assemble.assemble_transactions(log, "db", size=size).collect()
    assert sorted(map(str, short)) == sorted(map(str, long))
