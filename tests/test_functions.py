from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tidemark.functions import (
    commit_to_publish_ms,
    decode_value,
    event_id,
    long_to_lsn,
    lsn_diff,
    lsn_to_long,
    micros_to_iso,
    pg_micros_to_unix,
    queue_latency_ms,
)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_lsn_round_trip_and_numeric_order(spark):
    texts = ["0/0", "0/20", "0/FFFFFFC0", "1/0", "1/40", "1/100", "16/B374D848", "7FFFFFFF/FFFFFFFF", "FFFFFFFF/FFFFFFFF"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", lsn_to_long("t").alias("n")).withColumn("back", long_to_lsn("n")).collect()
    assert all(r["t"] == r["back"] for r in rows)
    numbers = [r["n"] for r in rows]
    assert numbers[:8] == sorted(numbers[:8])
    assert numbers[6] == (0x16 << 32) | 0xB374D848


def test_unreadable_lsn_is_null(spark):
    df = spark.createDataFrame([("x",), ("1/",), ("1/G",), (None,)], "t string")
    assert [r[0] for r in df.select(lsn_to_long("t")).collect()] == [None] * 4


def test_lsn_diff(spark):
    assert one(spark, lsn_diff(F.lit("1/0"), F.lit("0/FFFFFFC0")))[0] == 64


def test_event_id_is_deterministic(spark):
    def parts(xid):
        return [F.lit("catalog"), F.lit("public"), F.lit("products"), F.lit("0/20"), xid, F.lit(0)]

    got = one(spark, event_id(*parts(F.lit(42))), event_id(*parts(F.lit(42))), event_id(*parts(F.lit(None))))
    assert got[0] == got[1] == hashlib.sha256(b"catalog|public|products|0/20|42|0").hexdigest()
    assert got[2] == hashlib.sha256(b"catalog|public|products|0/20|None|0").hexdigest()


def test_decode_value(spark):
    def value(kind, oid, text, raw=None):
        return decode_value(F.lit(kind), F.lit(oid), F.lit(text), F.lit(raw).cast("binary"))

    got = one(
        spark, value("t", 20, "042"), value("t", 21, "-3"), value("t", 23, "5"), value("t", 16, "t"),
        value("t", 16, "f"), value("t", 16, "yes"), value("t", 25, "042"), value("n", 25, None),
        value("b", 25, None, bytearray(b"\xde\xad")), value("t", 20, "x"),
    )
    assert list(got) == ["42", "-3", "5", "true", "false", "false", "042", None, "dead", None]


def test_latencies(spark):
    big = lambda v: F.lit(v).cast("bigint")
    got = one(
        spark,
        queue_latency_ms(big(2_000), big(500)), queue_latency_ms(big(500), big(2_000)), queue_latency_ms(big(9), big(None)),
        commit_to_publish_ms(big(5_500), big(2_000)), commit_to_publish_ms(big(0), big(2_000)),
        commit_to_publish_ms(big(None), big(2_000)), pg_micros_to_unix(big(0)),
    )
    assert list(got) == [1.5, 0.0, 0.0, 3.5, None, None, 946_684_800_000_000]


def test_micros_to_iso_ignores_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = one(spark, micros_to_iso(F.lit(1_704_067_207_179_575)), micros_to_iso(F.lit(1_704_067_207_000_000)))
        assert list(got) == ["2024-01-01T00:00:07.179575+00:00", "2024-01-01T00:00:07+00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
