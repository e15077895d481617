"""Messages and their tuples are made and decoded once, by methods that the JVM translates."""

from __future__ import annotations

import re

from conftest import SMALL
from pyspark.sql import functions as F

from tidemark.functions.values import decode_row, key_map
from tidemark.operators import assemble
from tidemark.plans import inputs, pipeline

# The JVM leaves larger methods to its interpreter.
TRANSLATED = 8000


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_messages_compile_to_methods_of_moderate_size(spark):
    """F8: made in one projection with the messages, the tuples gave a method of 9508 bytes."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the code of all stages is shown
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        shown = inputs.messages(spark, SMALL)._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", shown)]
    assert sizes and max(sizes) < TRANSLATED


def test_key_entries_by_the_key_columns(spark):
    """F8: a key column that was not sent has no entry, one sent as null has a null entry."""
    columns = "array<struct<name:string,type_oid:int,is_key:boolean>>"
    cells = "array<struct<kind:string,text:string,bin:binary>>"
    specs = [("id", 20, True), ("b", 25, False), ("c", 25, True), ("d", 17, None)]
    row = lambda *kinds: [(k, "07" if i == 0 else "x", bytearray(b"\xab\x0f") if k == "b" else None) for i, k in enumerate(kinds)]
    data = [(0, specs, row("t", "t", "t", "b")), (1, specs, row("t", "u", "n", "n")), (2, specs, row("u", "t", "u", None)), (3, specs, None), (4, None, row("t"))]
    df = spark.createDataFrame(data, f"i int, columns {columns}, cells {cells}").withColumn("row", decode_row(F.col("columns"), F.col("cells")))
    got = {r["i"]: (r["row"], r["pk"]) for r in df.select("i", "row", key_map(F.col("columns"), F.col("row")).alias("pk")).collect()}
    assert got[0] == ({"id": "7", "b": "x", "c": "x", "d": "ab0f"}, {"id": "7", "c": "x"})
    assert got[1] == ({"id": "7", "c": None, "d": None}, {"id": "7", "c": None})
    assert got[2] == ({"b": "x"}, {})
    assert got[3] == (None, None) and got[4] == (None, None)


def test_rows_nobody_looks_at_are_not_decoded(spark, tmp_path):
    """complaints and identities need no decoded row."""
    path = str(tmp_path / "messages")
    inputs.messages(spark, SMALL).write.parquet(path)
    log = spark.read.parquet(path)
    events = assemble.assemble_transactions(log, "db", size=pipeline.LONG_LOG)
    assert "map_from_entries" not in _plan(assemble.message_errors(log, size=pipeline.LONG_LOG))
    assert "map_from_entries" not in _plan(events.select("event_id", "op", "commit_lsn", "xid", "seq"))
    assert "map_from_entries" in _plan(events)
