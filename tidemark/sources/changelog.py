"""Reading and writing the change log, and the other inputs of the engine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lsn import long_to_lsn, lsn_to_long
from tidemark.functions.presence import sparse_from_map
from tidemark.operators.assemble import MESSAGE_SCHEMA
from tidemark.operators.once import with_once

ENVELOPE = (
    "struct<event_id:string,op:string,source:struct<db:string,schema:string,table:string>,"
    "pk:map<string,string>,after:map<string,string>,before:map<string,string>,commit_lsn:string,"
    "commit_ts_us:bigint,xid:bigint,seq:int,captured_ts_us:bigint,published_ts_us:bigint>"
)
LOG_SCHEMA = "message_id string, arrival bigint, event string"


def with_json_object(df: DataFrame, text: Column, data_type: str, out: str) -> DataFrame:
    """Add ``out``: ``text`` parsed strictly, null unless it is exactly one JSON object.

    The bracketed form makes anything after the object an error, which a plain
    ``from_json`` would overlook.
    """
    listed = F.from_json(
        F.concat(F.lit("["), text, F.lit("]")), f"array<{data_type}>", {"allowSingleQuotes": "false"}
    )
    parsed = with_once(df, "__listed", listed)
    alone = (F.size("__listed") == 1) & F.rtrim(text).endswith("}")
    return parsed.withColumn(out, F.when(alone, F.col("__listed")[0])).drop("__listed")


def parse_events(log: DataFrame) -> DataFrame:
    """Add ``e``, the envelope; null where the delivery is not readable."""
    return with_json_object(log, F.col("event"), ENVELOPE, "e")


def read_change_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return parse_events(spark.read.schema(LOG_SCHEMA).format(fmt).load(path))


def stream_change_log(
    spark: SparkSession, path: str, fmt: str = "parquet", *, files_per_trigger: int | None = None
) -> DataFrame:
    """The log as a stream from its first entry; the checkpoint is the consumer's position.

    A trigger takes all files that have landed. With ``files_per_trigger`` it may take a part of
    what one writer landed; that is right only where each file ends before the next begins.
    """
    reader = spark.readStream.schema(LOG_SCHEMA).format(fmt)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_events(reader.load(path))


def stream_change_log_kafka(
    spark: SparkSession, servers: str, topic: str, *, offsets_per_trigger: int = 100_000
) -> DataFrame:
    """The same from a Kafka topic; needs Spark's Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", offsets_per_trigger)
        .load()
    )
    entries = raw.select(
        F.concat_ws("-", "partition", "offset").alias("message_id"),
        # One topic partition carries one key's changes, so this keeps their order. It is unique
        # for 4096 partitions; more are refused, as two entries would share a place.
        F.when(F.col("partition") < 4096, F.col("offset") * 4096 + F.col("partition"))
        .otherwise(F.raise_error(F.lit("more than 4096 topic partitions")).cast("bigint"))
        .alias("arrival"),
        F.col("value").cast("string").alias("event"),
    )
    return parse_events(entries)


def _entry(name: str, field: Column) -> Column:
    """``"name":value`` of a sent field, null where it is absent."""
    wrapped = F.to_json(F.struct(field.getField("v").alias("v")), {"ignoreNullFields": "false"})
    # ``wrapped`` is ``{"v":...}``: the value sits between its fifth and its last character.
    value = wrapped.substr(F.lit(6), F.length(wrapped) - 6)
    return F.when(field.isNotNull(), F.concat(F.lit(f'"{name}":'), value))


def envelope_json(published_us: Column, fields: Sequence[str] = (), key: str = "key") -> Column:
    """JSON envelope of flat change rows; absent fields get no entry, null ones a null."""
    identity = F.concat(F.lit('"id":'), F.col(key).cast("string"))
    sent = F.concat_ws(",", identity, *[_entry(f, F.col(f)) for f in fields])
    after = F.when(F.col("op") != "d", F.concat(F.lit(',"after":{'), sent, F.lit("}")))
    head = F.to_json(
        F.struct(
            "event_id", "op", long_to_lsn("lsn").alias("commit_lsn"), "commit_ts_us", "xid", "seq",
            published_us.alias("published_ts_us"),
        )
    )
    opened = head.substr(F.lit(1), F.length(head) - 1)
    return F.concat(
        opened, F.lit(',"pk":{'), identity, F.lit("}"), F.coalesce(after, F.lit("")), F.lit("}")
    )


def write_change_log(
    log: DataFrame, path: str, fmt: str = "parquet", *, mode: str = "append", by_day: bool = False
) -> None:
    """Append deliveries (message_id, arrival, event JSON), optionally one folder per commit day."""
    out = log.select(
        F.col("message_id").cast("string").alias("message_id"),
        "arrival",
        "event",
        *(["day"] if by_day else []),
    )
    writer = out.write.mode(mode).format(fmt)
    (writer.partitionBy("day") if by_day else writer).save(path)


def flatten_events(
    parsed: DataFrame, fields: Mapping[str, str], more: Sequence[Column | str] = (), *, key_type: str = "bigint"
) -> DataFrame:
    """Parsed deliveries in the flat form the resolver works on (typed sparse fields).

    Keys are of any type; one that ``key_type`` cannot hold is null, see ``invalid_reason``.
    """
    e = F.col("e")
    return parsed.select(
        "message_id",
        "arrival",
        e["event_id"].alias("event_id"),
        e["op"].alias("op"),
        e["pk"]["id"].try_cast(key_type).alias("key"),
        lsn_to_long(e["commit_lsn"]).alias("lsn"),
        F.coalesce(e["seq"], F.lit(0)).alias("seq"),
        e["xid"].alias("xid"),
        e["commit_ts_us"].alias("commit_ts_us"),
        e["published_ts_us"].alias("published_ts_us"),
        *[sparse_from_map(e["after"], f, t).alias(f) for f, t in fields.items()],
        *more,
    )


def read_replication_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE_SCHEMA).parquet(path)


def read_source_snapshot(
    spark: SparkSession, path: str | None = None, *, jdbc: Mapping[str, str] | None = None
) -> DataFrame:
    """Authoritative rows from Parquet, or over JDBC split by a numeric partition column.

    ``jdbc`` takes Spark's options (url, dbtable, partitionColumn, lowerBound, upperBound,
    numPartitions); the database driver must be on the class path.
    """
    if (path is None) == (jdbc is None):
        raise ValueError("give either a path or jdbc options")
    if path is not None:
        return spark.read.parquet(path)
    return spark.read.format("jdbc").options(**jdbc).load()


def write_dead_letters(dead: DataFrame, path: str, columns: Sequence[str]) -> None:
    dead.select(*columns).write.mode("append").parquet(path)


def lookup(table: DataFrame, column: str, value: object) -> DataFrame:
    """Point read; the equality reaches the Parquet scan. No rows when there is none."""
    return table.filter(F.col(column) == F.lit(value))
