"""Version resolution: which changes win, and what each document looks like afterwards."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lsn import long_to_lsn
from tidemark.operators.prefix import running
from tidemark.operators.sizing import DEFAULT, Sizing

APPLIED, SUPERSEDED = "applied", "superseded"
TIES = ("first", "last")
INSERT_MODES = ("replace", "merge")


def _version(tie: str) -> Column:
    if tie not in TIES:
        raise ValueError(f"tie must be one of {TIES}")
    return F.col("lsn") if tie == "first" else F.struct("lsn", "seq")


def classify_events(
    log: DataFrame,
    keys: Sequence[str] = ("key",),
    *,
    seed: DataFrame | None = None,
    tie: str = "first",
    order: str = "arrival",
    size: Sizing = DEFAULT,
) -> DataFrame:
    """Add ``result``: superseded iff the change is not newer than all earlier arrivals.

    The stored version of a key is always the maximum over everything that arrived before,
    so a running maximum replaces a change-by-change loop. ``tie='first'`` compares commit
    positions only, so of several changes to a key in one transaction the first arrival
    wins; ``tie='last'`` also compares ``seq``. ``seed`` holds the stored documents'
    (keys, ``_lsn``, and ``_seq`` for ``tie='last'``).
    """
    version = _version(tie)
    seen = running(
        log,
        keys,
        order,
        {"__seen": ("max", version)},
        inclusive=False,
        size=size,
    )
    if seed is not None:
        stored = F.col("_lsn") if tie == "first" else F.struct(F.col("_lsn").alias("lsn"), F.col("_seq").alias("seq"))
        held = seed.select(*keys, stored.alias("__held"))
        seen = seen.join(held, list(keys), "left")
        seen = seen.withColumn("__seen", F.greatest("__seen", "__held")).drop("__held")
    late = F.coalesce(version <= F.col("__seen"), F.lit(False))
    return seen.withColumn("result", F.when(late, SUPERSEDED).otherwise(APPLIED)).drop("__seen")


def _reset(insert_mode: str) -> Column:
    if insert_mode not in INSERT_MODES:
        raise ValueError(f"insert_mode must be one of {INSERT_MODES}")
    return F.col("op").isin("d", "c") if insert_mode == "replace" else F.col("op") == "d"


def fold_documents(
    changes: DataFrame,
    keys: Sequence[str] = ("key",),
    fields: Sequence[str] = (),
    *,
    insert_mode: str = "replace",
    touched: Column | None = None,
) -> DataFrame:
    """One document per key from changes that are to take effect, in version order.

    A single aggregation combined map-side: for each field the newest change that sent it,
    for each key the newest reset (a delete, and an insert under ``insert_mode='replace'``).
    A field survives iff it was sent at or after that reset. No window and no join, so a
    key holding a third of the log costs no more than any other. With ``touched`` only keys
    with a change for which it holds come back.
    """
    version = F.struct("lsn", "seq")
    newest = F.max_by(F.struct("op", "lsn", "seq"), version).alias("__newest")
    reset = F.max(F.when(_reset(insert_mode), version)).alias("__reset")
    sent = [
        F.max_by(F.struct(version.alias("at"), F.col(f).alias("f")), F.when(F.col(f).isNotNull(), version)).alias(f)
        for f in fields
    ]
    if touched is None:
        folded = changes.groupBy(*keys).agg(newest, reset, *sent)
    else:
        marked = F.bool_or(touched).alias("__touched")
        folded = changes.groupBy(*keys).agg(newest, reset, *sent, marked).filter("__touched")
    survives = [
        F.when(
            F.col("__reset").isNull() | (F.col(f"{f}.at") >= F.col("__reset")), F.col(f"{f}.f")
        ).alias(f)
        for f in fields
    ]
    return folded.select(
        *keys,
        *survives,
        F.col("__newest.lsn").alias("_lsn"),
        F.col("__newest.seq").alias("_seq"),
        (F.col("__newest.op") == "d").alias("_deleted"),
    )


def fold_documents_map(
    changes: DataFrame,
    keys: Sequence[str] = ("key",),
    fields: str = "after",
    *,
    insert_mode: str = "replace",
) -> DataFrame:
    """The same for an unknown schema: ``fields`` is a ``MAP<STRING, STRING>`` of sent fields."""
    version = F.struct("lsn", "seq")
    heads = changes.groupBy(*keys).agg(
        F.max_by(F.struct("op", "lsn", "seq"), version).alias("__newest"),
        F.max(F.when(_reset(insert_mode), version)).alias("__reset"),
    )
    entries = changes.select(*keys, version.alias("at"), F.explode(fields).alias("name", "value"))
    latest = entries.groupBy(*keys, "name").agg(
        F.max("at").alias("at"), F.max_by(F.struct("value"), "at").alias("held")
    )
    kept = (
        latest.join(heads.select(*keys, "__reset"), list(keys), "left")
        .filter(F.col("__reset").isNull() | (F.col("at") >= F.col("__reset")))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("name", "held.value"))).alias("fields"))
    )
    return heads.join(kept, list(keys), "left").select(
        *keys,
        F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"),
        F.col("__newest.lsn").alias("_lsn"),
        F.col("__newest.seq").alias("_seq"),
        (F.col("__newest.op") == "d").alias("_deleted"),
    )


def latest_per_key(log: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """The newest version of every key, whole row."""
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("lsn", "seq")).alias("__row")
    return log.groupBy(*keys).agg(newest).select(*keys, "__row.*")


def dedupe_events(log: DataFrame) -> DataFrame:
    """The first delivery of every event."""
    rest = [c for c in log.columns if c != "event_id"]
    first = F.min_by(F.struct(*rest), F.col("arrival")).alias("__row")
    return log.groupBy("event_id").agg(first).select("event_id", "__row.*")


def duplicate_keys(log: DataFrame, by: Sequence[str], keys: Sequence[str] = ("key",)) -> DataFrame:
    """Keys that occur more than once within a group such as a batch or a transaction."""
    counted = log.groupBy(*by, *keys).agg(F.count("*").alias("changes"))
    return counted.filter(F.col("changes") > 1)


def live_documents(documents: DataFrame) -> DataFrame:
    return documents.filter(~F.col("_deleted"))


def materialize(
    log: DataFrame,
    keys: Sequence[str] = ("key",),
    fields: Sequence[str] = (),
    *,
    order: str = "arrival",
    tie: str = "first",
    insert_mode: str = "replace",
    size: Sizing = DEFAULT,
) -> DataFrame:
    """Documents from a whole log.

    ``order='arrival'`` gives what an online consumer ends with: a change that arrives
    after a newer one is lost whole. ``order='commit'`` folds every change by version, so
    the outcome does not depend on delivery order.
    """
    if order == "commit":
        return fold_documents(log, keys, fields, insert_mode=insert_mode)
    if order != "arrival":
        raise ValueError("order must be 'arrival' or 'commit'")
    judged = classify_events(log, keys, tie=tie, size=size)
    applied = judged.filter(F.col("result") == APPLIED)
    return fold_documents(applied, keys, fields, insert_mode=insert_mode)


def documents_as_changes(documents: DataFrame) -> DataFrame:
    """Stored documents restated as one change per key, ready to be folded with newer ones."""
    return documents.withColumns(
        {
            "op": F.when(F.col("_deleted"), "d").otherwise("c"),
            "lsn": F.col("_lsn"),
            "seq": F.col("_seq"),
        }
    ).drop("_lsn", "_seq", "_deleted")


def incremental_apply(
    snapshot: DataFrame,
    batch: DataFrame,
    keys: Sequence[str] = ("key",),
    fields: Sequence[str] = (),
    *,
    tie: str = "first",
    insert_mode: str = "replace",
    size: Sizing = DEFAULT,
    judge: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """One batch on top of stored documents: (changed documents, classified batch).

    Only keys with an applied change come back, so the caller appends a delta instead of
    rewriting the snapshot. Stored rows are semi-joined to the batch's keys first. ``judge``
    keeps the classified batch for both results, such as by caching it.
    """
    touched = batch.select(*keys).distinct()
    stored = snapshot.join(touched, list(keys), "left_semi")
    judged = classify_events(
        batch, keys, seed=stored, tie=tie, size=size
    )
    judged = judged if judge is None else judge(judged)
    applied = judged.filter(F.col("result") == APPLIED)
    columns = [*keys, "op", "lsn", "seq", *fields]
    base = documents_as_changes(stored).select(*columns, F.lit(False).alias("__new"))
    fresh = applied.select(*columns, F.lit(True).alias("__new"))
    changed = fold_documents(
        base.unionByName(fresh), keys, fields, insert_mode=insert_mode, touched=F.col("__new")
    )
    return changed, judged


def merge_documents(snapshot: DataFrame, changed: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """The snapshot with changed documents put in place of, or added to, the stored ones."""
    kept = snapshot.join(changed.select(*keys), list(keys), "left_anti")
    return kept.unionByName(changed)


def apply_projection(log: DataFrame, key: str = "key", fields: Sequence[str] = ()) -> DataFrame:
    """The document each change writes on its own: deletes keep only identity and version."""
    gone = F.col("op") == "d"
    return log.select(
        F.col(key),
        *[F.when(~gone, F.col(f)).alias(f) for f in fields],
        long_to_lsn("lsn").alias("_lsn"),
        gone.alias("_deleted"),
    )
