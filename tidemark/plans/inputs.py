"""A change log, its markers and its tokenised messages derived from the ``events`` table.

Deterministic integer rules only, so that any SQL engine derives the same rows. Every rule
runs over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.identity import event_id
from tidemark.functions.lsn import long_to_lsn
from tidemark.functions.presence import sparse
from tidemark.operators.sizing import Sizing
from tidemark.sources.changelog import read_source_snapshot

DB, SCHEMA, TABLE = "catalog", "public", "accounts"
FIELDS = ["value", "props", "event_type"]
LSN_BASE = 4_294_967_296
PROBE_PERIOD_US = 120_000
SLO_US = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def size(spark: SparkSession, sf_dir: str, per_event: int = 2) -> Sizing:
    """An upper bound on derived rows from the row counts in the Parquet footers.

    An event gives at most two deliveries; other derivations state their own factor.
    """
    return Sizing(at_most=per_event * table(spark, sf_dir, "events").count())


def wall_micros(ts: str) -> Column:
    """Microseconds of a zone-less timestamp, whatever the session time zone."""
    return F.expr(f"unix_micros(from_utc_timestamp(cast({ts} as timestamp), current_timezone()))")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each committed change once, in flat envelope form with sparse fields."""
    raw = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    op = F.when(kind == "signup", "c").when(kind == "error", "d").otherwise("u")
    xid = F.expr("event_id div 3")
    base = raw.select(
        F.col("event_id").alias("event_no"),
        F.col("user_id").alias("key"),
        op.alias("op"),
        xid.alias("xid"),
        F.pmod("event_id", F.lit(3)).cast("int").alias("seq"),
        (F.lit(LSN_BASE) + (xid - 100) * 64).alias("lsn"),
        wall_micros("ts").alias("ts_us"),
        sparse(F.col("value"), kind.isin("signup", "click", "purchase", "view")).alias("value"),
        sparse(F.col("props"), kind.isin("signup", "click")).alias("props"),
        sparse(kind, kind.isin("signup", "purchase")).alias("event_type"),
    )
    # Three consecutive rows make a transaction, so this window has no large group.
    stamped = base.withColumn("commit_ts_us", F.max("ts_us").over(Window.partitionBy("xid")))
    return stamped.drop("ts_us")


def with_identity(log: DataFrame) -> DataFrame:
    parts = [F.lit(DB), F.lit(SCHEMA), F.lit(TABLE), long_to_lsn("lsn"), F.col("xid"), F.col("seq")]
    return log.withColumn("event_id", event_id(*parts))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits as delivered: out of order, with every 17th event delivered a second time."""
    rows = with_identity(commits(spark, sf_dir))
    number = F.col("event_no")
    again = F.when(number % 17 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sent = rows.withColumn("redelivery", F.explode(again))
    pos = number + (number % 13) * 37 + F.col("redelivery") * 500
    arrival = (pos * 1_000_003 + number) * 2 + F.col("redelivery")
    return sent.withColumn("arrival", arrival)


def marker_times(events: DataFrame) -> DataFrame:
    """When each commit's marker became readable; some never do."""
    number = F.col("event_no")
    slow = F.when(number % 50 == 0, F.lit(1500)).otherwise(F.lit(0))
    at = F.col("commit_ts_us") + 1000 * (120 + (number * 7919) % 950 + slow)
    lost = (number % 97 == 0) & (number >= 388)
    return events.withColumn("marker_ts_us", F.when(~lost, at))


def marker_table(events: DataFrame) -> DataFrame:
    """Markers as stored: only those that were written."""
    timed = marker_times(events).filter(F.col("marker_ts_us").isNotNull())
    return timed.select("event_id", "lsn", "marker_ts_us")


# ---- tokenised replication messages -------------------------------------------------

RELATION_ID, UNKNOWN_RELATION = 16_384, 99


def _cell(kind: Column, text: Column, binary: Column | None = None) -> Column:
    raw = F.lit(None).cast("binary") if binary is None else binary
    return F.struct(kind.alias("kind"), text.cast("string").alias("text"), raw.alias("bin"))


def _cells(version_two: Column) -> tuple[Column, Column]:
    """(new tuple, key tuple) of a change, as wide as its relation."""
    number = F.col("event_no")
    t, u, n = F.lit("t"), F.lit("u"), F.lit("n")
    null = F.lit(None).cast("string")
    value_kind = F.when(number % 401 == 0, F.lit("x")).when(F.col("value").isNotNull(), t).otherwise(u)
    props_kind = F.when(F.col("props").isNull(), u).when(number % 19 == 0, n).otherwise(t)
    as_bytes = (number % 23 == 0) & F.col("event_type").isNotNull()
    type_kind = F.when(as_bytes, F.lit("b")).when(F.col("event_type").isNotNull(), t).otherwise(u)
    identity = _cell(t, F.col("key"))
    new = [
        identity,
        _cell(value_kind, F.col("value.v")),
        _cell(props_kind, F.when(props_kind == "t", F.col("props.v"))),
        _cell(type_kind, F.when(~as_bytes, F.col("event_type.v")), F.when(as_bytes, F.col("event_type.v").cast("binary"))),
    ]
    big = _cell(t, F.when(F.coalesce(F.col("value.v"), F.lit(0.0)) > 50, "t").otherwise("f"))
    extra = _cell(t, F.lit("surplus"))
    wide = F.when(version_two, F.array(*new, big)).otherwise(F.array(*new))
    new_tuple = F.when(number % 307 == 0, F.concat(wide, F.array(extra))).otherwise(wide)
    nulls = [_cell(n, null)] * 3
    key_tuple = F.when(version_two, F.array(identity, *nulls, _cell(n, null))).otherwise(F.array(identity, *nulls))
    return new_tuple, key_tuple


def _columns(version_two: Column) -> Column:
    def spec(name: str, oid: int, key: bool = False) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(oid).alias("type_oid"), F.lit(key).alias("is_key"))

    base = [spec("id", 20, True), spec("value", 701), spec("props", 25), spec("event_type", 25)]
    return F.when(version_two, F.array(*base, spec("big", 16))).otherwise(F.array(*base))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transaction as begin, optional relation, rows, noise and commit; some never commit."""
    rows = commits(spark, sf_dir)
    number, xid, seq = F.col("event_no"), F.col("xid"), F.col("seq")
    two = xid >= 150
    new_tuple, key_tuple = _cells(two)
    relation = F.when(number % 211 == 0, F.lit(UNKNOWN_RELATION)).otherwise(F.lit(RELATION_ID)).cast("bigint")

    def token(offset: Column | int, tag: Column | str, when: Column) -> Column:
        place = offset if isinstance(offset, Column) else F.lit(offset)
        name = tag if isinstance(tag, Column) else F.lit(tag)
        return F.when(when, F.struct((xid * 8 + place).alias("msg_seq"), name.alias("tag")))

    first = seq == 0
    row_tag = F.when(F.col("op") == "c", "I").when(F.col("op") == "u", "U").otherwise("D")
    tokens = F.array_compact(
        F.array(
            token(0, "B", first),
            token(1, "R", first & (xid % 50 == 0)),
            token(seq + 2, row_tag, F.lit(True)),
            token(5, F.when(xid % 2 == 0, "").otherwise("Z"), first & (xid % 113 == 5)),
            token(6, "T", first & (xid % 29 == 0)),
            token(7, "C", first & (xid % 41 != 40)),
        )
    )
    # An event's tuples are made beside its tokens, before they are told apart: tuples and messages in
    # one projection compile to a method that is too large for the JVM to translate.
    made = rows.select(
        "xid", "lsn", "commit_ts_us", tokens.alias("tokens"), relation.alias("relation"),
        F.when(F.col("op") != "d", new_tuple).alias("new"), F.when(F.col("op") == "d", key_tuple).alias("old"),
    )
    out = made.withColumn("m", F.explode("tokens"))
    tag = F.col("m.tag")
    is_row = tag.isin("I", "U", "D")
    return out.select(
        F.lit("indexer").alias("slot"),
        F.col("m.msg_seq").alias("msg_seq"),
        tag.alias("tag"),
        F.when(tag == "B", xid).alias("xid"),
        F.when(tag == "R", F.lit(RELATION_ID).cast("bigint")).when(is_row, F.col("relation")).alias("relation_id"),
        F.when(tag == "C", F.col("lsn")).alias("commit_lsn"),
        F.when(tag == "C", F.col("commit_ts_us") - 946_684_800_000_000).alias("commit_ts_us"),
        F.when(tag == "R", SCHEMA).alias("schema"),
        F.when(tag == "R", TABLE).alias("table"),
        F.when(tag == "R", _columns(two)).alias("rel_columns"),
        F.when(tag.isin("I", "U"), F.col("new")).alias("new_tuple"),
        F.when(tag == "D", F.col("old")).alias("old_tuple"),
        F.when(is_row, F.col("commit_ts_us")).alias("captured_ts_us"),
    )


# ---- deliveries, log lines and order changes ------------------------------------------


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts per message: up to six failures, some with a success in between."""
    rows = commits(spark, sf_dir).select("event_no", "op", "commit_ts_us")
    number = F.col("event_no")
    failing = F.when(F.col("op") == "d", number % 7).otherwise(number % 3)
    healed = number % 5 == 0
    tries = F.when(healed, F.lit(7)).otherwise(F.least(failing + 1, F.lit(5)))
    tried = rows.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), tries.cast("bigint"))))
    ok = F.when(healed, F.col("i") == 2).otherwise(F.col("i") > failing)
    return tried.select(
        number.alias("message_id"),
        (F.col("commit_ts_us") + F.col("i") * 1_000_000).alias("attempt_ts_us"),
        ok.alias("ok"),
        F.concat(F.lit('{"no":'), number, F.lit("}")).alias("event"),
        F.when(number % 2 == 0, "decode: unreadable").otherwise("invalid event").alias("error"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service log text of every delivery; some lines are plain text, some broken JSON."""
    log = change_log(spark, sf_dir)
    number = F.col("event_no")
    name = F.when(number % 4 == 0, "staleness_sample").when(number % 9 == 0, "VIOLATION").otherwise("indexer_event")
    body = F.concat(
        F.lit('{"event":"'), name, F.lit('","document_id":"'), F.col("key"), F.lit('","commit_lsn":"'),
        long_to_lsn("lsn"), F.lit('","auth":"'),
        F.when(number % 13 == 0, "Bearer ops-token-1f9a77").otherwise("none"), F.lit('"}'),
    )
    line = (
        F.when(number % 11 == 3, F.concat(F.lit("svc-1 | worker started, pass=redis-pass-2024 no "), number))
        .when(number % 11 == 5, F.concat(F.lit("svc-1 | "), F.substring(body, 1, 40)))
        .when(number % 11 == 7, F.concat(F.lit("svc-2 | "), body, F.lit(" trailing")))
        .otherwise(F.concat(F.lit("svc-1 | "), body))
    )
    return log.select(F.col("arrival").alias("line_no"), line.alias("line"))


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes to orders: each line item updates, or on return deletes, its order."""
    items = table(spark, sf_dir, "lineitem")
    gone = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") >= 4)
    return items.select(
        F.col("l_orderkey").alias("key"),
        F.when(gone, "d").otherwise("u").alias("op"),
        (F.lit(LSN_BASE) + F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("lsn"),
        ((F.col("l_partkey") * 100_000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("bigint")).alias("seq"),
        sparse(F.col("l_linestatus"), ~gone).alias("status"),
        sparse(F.col("l_extendedprice"), ~gone & (F.col("l_linestatus") == "F")).alias("price"),
    )


def order_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_source_snapshot(spark, f"{sf_dir.rstrip('/')}/orders.parquet").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")
    )


def log_slices(log: DataFrame, slices: int) -> list[DataFrame]:
    """The log cut into ranges of delivery position."""
    lo, hi = log.agg(F.min("arrival"), F.max("arrival")).first()
    edges = [lo + (hi + 1 - lo) * i // slices for i in range(slices + 1)]
    return [
        log.filter((F.col("arrival") >= a) & (F.col("arrival") < b)) for a, b in zip(edges, edges[1:])
    ]
