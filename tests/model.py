"""One-change-at-a-time models of the semantics, for small logs in tests only."""

from __future__ import annotations

import random


def random_log(seed: int, keys: int = 4, size: int = 120, hot: float = 0.4) -> list[dict]:
    """Distinct versions delivered out of order; one key holds a large share of the log."""
    rng = random.Random(seed)
    log = []
    for i in range(size):
        key = 0 if rng.random() < hot else rng.randrange(1, keys)
        op = rng.choice("cuuud")
        log.append(
            {
                "event_id": f"e{i}", "key": key, "op": op, "lsn": (i // 2 + 1) * 16, "seq": i % 2,
                "a": None if op == "d" or rng.random() < 0.4 else (rng.choice([None, rng.randrange(9)]),),
                "b": None if op == "d" or rng.random() < 0.6 else (rng.randrange(9),),
                "commit_ts_us": 1_000_000 * (i // 2),
            }
        )
    again = [dict(r) for r in log if rng.random() < 0.2]
    delivered = log + again
    delivered.sort(key=lambda r: r["lsn"] + rng.randrange(0, 400))
    for position, row in enumerate(delivered):
        row["arrival"] = position * 7 + 3
    return delivered


def apply_log(log: list[dict], tie: str = "first", insert_mode: str = "replace", stored: dict | None = None):
    """(documents, results by arrival) of applying changes in arrival order."""
    docs = {k: dict(v) for k, v in (stored or {}).items()}
    results = {}
    for row in sorted(log, key=lambda r: r["arrival"]):
        current = docs.get(row["key"])
        version = (row["lsn"], row["seq"])
        if current is not None:
            late = row["lsn"] <= current["v"][0] if tie == "first" else version <= current["v"]
            if late:
                results[row["arrival"]] = "superseded"
                continue
        results[row["arrival"]] = "applied"
        if row["op"] == "d":
            docs[row["key"]] = {"v": version, "deleted": True}
            continue
        fresh = {} if row["op"] == "c" and insert_mode == "replace" else {
            k: x for k, x in (current or {}).items() if k in ("a", "b")
        }
        for f in ("a", "b"):
            if row[f] is not None:
                fresh[f] = row[f][0]
        docs[row["key"]] = {**fresh, "v": version, "deleted": False}
    return docs, results


LOG_SCHEMA = (
    "event_id string, key bigint, op string, lsn bigint, seq int, a struct<v:bigint>, b struct<v:bigint>, "
    "commit_ts_us bigint, arrival bigint"
)


def frame(spark, log: list[dict]):
    names = ["event_id", "key", "op", "lsn", "seq", "a", "b", "commit_ts_us", "arrival"]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in log], LOG_SCHEMA)


def as_docs(documents) -> dict:
    out = {}
    for r in documents.collect():
        doc = {"v": (r["_lsn"], r["_seq"]), "deleted": r["_deleted"]}
        for f in ("a", "b"):
            if r[f] is not None:
                doc[f] = r[f]["v"]
        out[r["key"]] = doc
    return out


def watch(events: list[dict], probes: list[int], slo: int, guard: bool = True) -> dict:
    """Run every probe over every open event, as an online monitor would."""
    seen = {}
    for e in events:
        state = {"visible": None, "violation": None, "rejected": None}
        for now in sorted(probes):
            if now < e["observed_ts_us"]:
                continue
            age = now - e["commit_ts_us"]
            if guard and (age < -60_000_000 or age > 86_400_000_000):
                state["rejected"] = now
                break
            if e["marker_ts_us"] is not None and e["marker_ts_us"] <= now and e["marker_lsn"] == e["lsn"]:
                state["visible"] = now
                break
            if age > slo and state["violation"] is None:
                state["violation"] = now
        seen[e["event_id"]] = state
    return seen
