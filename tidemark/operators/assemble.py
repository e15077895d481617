"""Transaction assembly: tokenised replication messages to committed change events.

A message row has ``slot, msg_seq, tag, xid, relation_id, commit_lsn, commit_ts_us, schema,
table, rel_columns, new_tuple, old_tuple, captured_ts_us``. Everything positional is a
running aggregate along ``msg_seq`` in chunked form (``prefix.running``), so neither one
huge slot nor one huge transaction ends up in a single task. Positions are worked out on
narrow rows; the tuples join at the end, on the unique (slot, msg_seq), and so cross the
network once.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identity import event_id
from tidemark.functions.lsn import long_to_lsn, pg_micros_to_unix
from tidemark.functions.values import KNOWN_KINDS, bad_integer, decode_row, key_map
from tidemark.operators.once import with_once
from tidemark.operators.prefix import running
from tidemark.operators.sizing import DEFAULT, Sizing
from tidemark.session import materialized

# Message tags.
BEGIN, COMMIT, RELATION = "B", "C", "R"
ROW_TAGS = ("I", "U", "D")
IGNORED_TAGS = ("O", "Y", "T")
ALL_TAGS = (BEGIN, COMMIT, RELATION, *ROW_TAGS, *IGNORED_TAGS)

# Complaints that dead letters of undecodable rows carry.
NO_INSERT_TUPLE = "insert message has no new tuple"
NO_UPDATE_TUPLE = "update message has no new tuple"
NO_DELETE_TUPLE = "delete message has no old/key tuple"
UNKNOWN_KIND = "unknown tuple data kind"

CELL = "struct<kind:string,text:string,bin:binary>"
MESSAGE_SCHEMA = (
    "slot string, msg_seq bigint, tag string, xid bigint, relation_id bigint, commit_lsn bigint, "
    "commit_ts_us bigint, schema string, table string, "
    "rel_columns array<struct<name:string,type_oid:int,is_key:boolean>>, "
    f"new_tuple array<{CELL}>, old_tuple array<{CELL}>, captured_ts_us bigint"
)


def _is_row() -> Column:
    return F.col("tag").isin(*ROW_TAGS)


def number_transactions(messages: DataFrame, *, size: Sizing = DEFAULT) -> DataFrame:
    """Add ``txn`` (running count of begins per slot), ``row_no`` (running count of row messages) and
    ``closed`` (position of the newest commit so far): one pass with several outputs."""
    return running(
        messages,
        ["slot"],
        "msg_seq",
        {
            "txn": ("sum", (F.col("tag") == BEGIN).cast("bigint")),
            "row_no": ("sum", _is_row().cast("bigint")),
            "opened": ("max", F.when(F.col("tag") == BEGIN, F.col("msg_seq"))),
            "closed": ("max", F.when(F.col("tag") == COMMIT, F.col("msg_seq"))),
        },
        size=size,
    )


def positions(messages: DataFrame, *, size: Sizing = DEFAULT) -> DataFrame:
    """The narrow log with its numbers: slot, msg_seq, tag, relation_id, xid, commit_lsn, commit_ts_us,
    txn, row_no, opened, closed.

    The log is read once for this. Where it is long the result is written, so that the passes that
    follow read narrow numbers and not the log.
    """
    slim = messages.select("slot", "msg_seq", "tag", "relation_id", "xid", "commit_lsn", "commit_ts_us")
    rows = size.rows(slim)
    if rows <= size.rows_per_chunk:
        return number_transactions(slim, size=replace(size, at_most=rows))
    slim = materialized(slim, "slim-log")
    return materialized(number_transactions(slim, size=replace(size, at_most=rows)), "positions")


def transaction_table(numbered: DataFrame) -> DataFrame:
    """One row per transaction: its xid, where its rows start, and its first commit message."""
    begin = F.when(F.col("tag") == BEGIN, F.struct("xid", "row_no"))
    commit_at = F.when(F.col("tag") == COMMIT, F.col("msg_seq"))
    commit = F.struct("commit_lsn", "commit_ts_us")
    return (
        numbered.filter(F.col("txn") > 0)
        .groupBy("slot", "txn")
        .agg(
            F.max(begin).alias("b"), F.min(commit_at).alias("commit_seq"), F.min_by(commit, commit_at).alias("c")
        )
        .select(
            "slot", "txn", F.col("b.xid").alias("txn_xid"), F.col("b.row_no").alias("rows_before"),
            "commit_seq", F.col("c.commit_lsn").alias("lsn"),
            pg_micros_to_unix("c.commit_ts_us").alias("committed_us"),
        )
    )


def announcements(messages: DataFrame, *, size: Sizing = DEFAULT) -> DataFrame:
    """Row messages with ``announced``: the newest relation message of their id before them."""
    related = messages.filter(F.col("tag").isin(RELATION, *ROW_TAGS) & F.col("relation_id").isNotNull())
    rows = size.rows(related)
    latest = running(
        related,
        ["slot", "relation_id"],
        "msg_seq",
        {"announced": ("max", F.when(F.col("tag") == RELATION, F.col("msg_seq")))},
        size=replace(size, at_most=rows),
    ).filter(_is_row())
    return latest if rows <= size.rows_per_chunk else materialized(latest, "announced")


def with_payload(placed: DataFrame, messages: DataFrame) -> DataFrame:
    """Placed rows with their tuples and ``rel``, their relation's definition (null if unknown).

    Definitions are few as a rule; whether they are broadcast is left to their size at run time.
    """
    payload = messages.filter(_is_row()).select("slot", "msg_seq", "new_tuple", "old_tuple", "captured_ts_us")
    definitions = messages.filter(F.col("tag") == RELATION).select(
        "slot",
        F.col("msg_seq").alias("announced"),
        F.struct("msg_seq", "schema", "table", "rel_columns").alias("rel"),
    )
    return placed.join(payload, ["slot", "msg_seq"]).join(definitions, ["slot", "announced"], "left")


def resolve_relation(messages: DataFrame, *, size: Sizing = DEFAULT) -> DataFrame:
    """Row messages, tuples included, with the definition of their relation that held then."""
    slim = messages.select("slot", "msg_seq", "tag", "relation_id")
    rows = size.rows(slim)
    slim = slim if rows <= size.rows_per_chunk else materialized(slim, "slim-log")
    return with_payload(announcements(slim, size=replace(size, at_most=rows)), messages)


def _tuple() -> Column:
    return F.when(F.col("tag") == "D", F.col("old_tuple")).otherwise(F.col("new_tuple"))


def _row_error() -> Column:
    cells, columns = _tuple(), F.col("rel.rel_columns")
    unknown_kind = F.exists(cells, lambda c: ~F.coalesce(c["kind"].isin(*KNOWN_KINDS), F.lit(False)))
    bad_number = F.exists(
        F.zip_with(cells, columns, lambda c, spec: bad_integer(c, spec)), lambda b: F.coalesce(b, F.lit(False))
    )
    return (
        F.when(F.col("rel").isNull(), "unknown relation id")
        .when((F.col("tag") == "I") & cells.isNull(), NO_INSERT_TUPLE)
        .when((F.col("tag") == "U") & cells.isNull(), NO_UPDATE_TUPLE)
        .when((F.col("tag") == "D") & cells.isNull(), NO_DELETE_TUPLE)
        .when(F.size(cells) != F.size(columns), "tuple and relation differ in columns")
        .when(
            (F.col("tag") == "U") & F.col("old_tuple").isNotNull() & (F.size("old_tuple") != F.size(columns)),
            "tuple and relation differ in columns",
        )
        .when(unknown_kind, UNKNOWN_KIND)
        .when(bad_number, "invalid integer text")
    )


def decode_tuples(resolved: DataFrame) -> DataFrame:
    """Add ``error`` (null when fine) and ``row``, the decoded fields by name.

    ``row`` is a plain column, so that nothing is decoded for a caller that does not look at it.
    """
    checked = with_once(resolved, "error", _row_error())
    decoded = decode_row(F.col("rel.rel_columns"), _tuple())
    return checked.withColumn("row", F.when(F.col("error").isNull(), decoded))


def message_errors(messages: DataFrame, *, size: Sizing = DEFAULT) -> DataFrame:
    """Messages that cannot be decoded: (slot, msg_seq, tag, error)."""
    tag = F.col("tag")
    framing = F.when(tag.isNull() | (tag == ""), "empty message").when(
        ~tag.isin(*ALL_TAGS), "unsupported message type"
    )
    lost = F.when(_is_row() & F.col("relation_id").isNull(), "unknown relation id")
    numbered = positions(messages, size=size)
    outer = numbered.withColumn("error", F.coalesce(framing, lost)).filter(F.col("error").isNotNull())
    columns = ["slot", "msg_seq", "tag", "error"]
    placed = announcements(numbered.select("slot", "msg_seq", "tag", "relation_id"), size=size)
    bad_rows = decode_tuples(with_payload(placed, messages)).filter(F.col("error").isNotNull())
    # A row before any begin, or after the commit of the latest one, belongs to nothing.
    over = (F.col("txn") == 0) | F.coalesce(F.col("closed") > F.col("opened"), F.lit(False))
    strays = numbered.filter(_is_row() & over).withColumn("error", F.lit("no open transaction"))
    # Framing is checked first, then the row's relation and tuples, then its transaction.
    checks = [c.select(*columns, F.lit(k).alias("rank")) for k, c in enumerate((outer, bad_rows, strays))]
    found = checks[0].unionByName(checks[1]).unionByName(checks[2])
    return found.groupBy("slot", "msg_seq", "tag").agg(F.min_by("error", "rank").alias("error"))


def assemble_transactions(
    messages: DataFrame, db: str, *, signed_xids: bool = False, emit_key_change_delete: bool = False,
    size: Sizing = DEFAULT,
) -> DataFrame:
    """Committed change events in envelope form.

    ``signed_xids`` reads transaction ids as signed 32-bit numbers, also in identities.
    ``emit_key_change_delete`` adds a deletion of the old key to every update that sent an old tuple
    with another key; it has the update's ``seq`` and an identity of its own. Without it the
    document of the old key stays, as the old tuple is read and then left out.

    Rows count only between a begin and its commit; a new begin discards an unfinished
    transaction. ``seq`` is the row's 0-based place in its transaction, undecodable rows
    included, so identities stay the same once such a row is repaired.
    """
    numbered = positions(messages, size=size)
    txns = transaction_table(numbered).filter(F.col("commit_seq").isNotNull())
    if signed_xids:
        txns = txns.withColumn("txn_xid", signed_xid(F.col("txn_xid")))
    rows = announcements(numbered.select("slot", "msg_seq", "tag", "relation_id", "txn", "row_no"), size=size)
    committed = rows.join(txns, ["slot", "txn"]).filter(F.col("msg_seq") < F.col("commit_seq"))
    placed = decode_tuples(with_payload(committed, messages)).filter(F.col("error").isNull())
    seq = (F.col("row_no") - F.col("rows_before") - 1).cast("int")
    lsn_text = long_to_lsn("lsn")
    identity = [F.lit(db), F.col("rel.schema"), F.col("rel.table"), lsn_text, F.col("txn_xid"), seq]
    named = event_id(*identity)
    if emit_key_change_delete:
        placed = placed.withColumn("old", F.when(F.col("tag") == "U", decode_row(F.col("rel.rel_columns"), F.col("old_tuple"))))
        keys = [F.map_entries(key_map(F.col("rel.rel_columns"), F.col(c))) for c in ("old", "row")]
        moved = F.coalesce(keys[0] != keys[1], F.lit(False))
        # The update itself, and before it the deletion under the old key.
        placed = placed.withColumn("gone", F.explode(F.when(moved, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
        placed = placed.withColumns({"row": F.when(F.col("gone"), F.col("old")).otherwise(F.col("row")), "tag": F.when(F.col("gone"), "D").otherwise(F.col("tag"))})
        old_key = event_id(*identity[:-1], F.concat(seq.cast("string"), F.lit("|old key")))
        named = F.when(F.col("gone"), old_key).otherwise(named)
    op = F.when(F.col("tag") == "I", "c").when(F.col("tag") == "U", "u").otherwise("d")
    return placed.select(
        named.alias("event_id"),
        op.alias("op"),
        F.struct(
            F.lit(db).alias("db"), F.col("rel.schema").alias("schema"), F.col("rel.table").alias("table")
        ).alias("source"),
        key_map(F.col("rel.rel_columns"), F.col("row")).alias("pk"),
        F.when(F.col("tag") != "D", F.col("row")).alias("after"),
        F.when(F.col("tag") == "D", F.col("row")).alias("before"),
        lsn_text.alias("commit_lsn"),
        "lsn",
        F.col("committed_us").alias("commit_ts_us"),
        F.col("txn_xid").alias("xid"),
        seq.alias("seq"),
        "captured_ts_us",
        "slot",
        "msg_seq",
    )


def signed_xid(xid: Column) -> Column:
    """The xid as a signed 32-bit number, for identities that must equal those of signed readers."""
    return F.when(xid >= 2**31, xid - 2**32).otherwise(xid)


def take_until(events: DataFrame, n: int, *, size: Sizing = DEFAULT) -> DataFrame:
    """Whole commits until at least ``n`` events are taken, in commit order.

    Counts per commit are combined map-side; the cut-off position comes back as a scalar
    and filters the events without a join.
    """
    per_commit = events.groupBy("lsn").agg(F.count("*").alias("__n"))
    upto = running(per_commit, [], "lsn", {"__before": ("sum", F.col("__n"))}, inclusive=False, size=size)
    taken = F.coalesce(F.col("__before"), F.lit(0)) < n
    last = upto.agg(F.max(F.when(taken, F.col("lsn")))).scalar()
    return events.filter(F.col("lsn") <= last)
