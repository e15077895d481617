"""Structured log lines: extraction, filters, excerpts and masking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.changelog import with_json_object

# Words that make a setting's name sensitive, and the shortest masked value.
SENSITIVE_WORDS = ("PASSWORD", "MASTER_KEY", "SECRET", "TOKEN", "API_KEY")
MIN_SECRET_LENGTH = 8
MASK = "[REDACTED]"


def read_json_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.read.text(path).withColumnRenamed("value", "line"))


def parse_log_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``record`` (a map) from the first ``{`` on; lines without readable JSON are left out."""
    at = F.instr(F.col(line), F.lit("{"))
    text = F.when(at > 0, F.col(line).substr(at, F.length(line)))
    parsed = with_json_object(lines, text, "map<string,string>", "record")
    return parsed.filter(F.col("record").isNotNull())


def log_records(
    records: DataFrame, event: str, *, match: Mapping[str, str] | None = None
) -> DataFrame:
    """Records of one event name whose fields equal the given texts."""
    wanted = F.col("record")["event"] == event
    for name, value in (match or {}).items():
        wanted = wanted & (F.col("record")[name] == str(value))
    return records.filter(wanted)


def log_excerpt(lines: DataFrame, needles: Sequence[str], order: str, limit: int = 500, line: str = "line") -> DataFrame:
    """The first ``limit`` lines that contain any needle: an excerpt is bounded by design."""
    hit = reduce(lambda a, b: a | b, [F.col(line).contains(n) for n in needles])
    return lines.filter(hit).orderBy(order).limit(limit)


def secret_values(settings: Mapping[str, str]) -> list[str]:
    return [
        value
        for name, value in settings.items()
        if any(word in name for word in SENSITIVE_WORDS) and len(value) >= MIN_SECRET_LENGTH
    ]


def _masked(text: Column, secrets: Sequence[str]) -> Column:
    return reduce(lambda t, s: F.replace(t, F.lit(s), F.lit(MASK)), secrets, text)


def mask_secrets(df: DataFrame, column: str, settings: Mapping[str, str]) -> DataFrame:
    """Whole texts with every known secret value replaced."""
    return df.withColumn(column, _masked(F.col(column), secret_values(settings)))


def leaked_secrets(df: DataFrame, column: str, settings: Mapping[str, str]) -> DataFrame:
    """Rows that still hold a known secret; must be empty before anything is published."""
    secrets = secret_values(settings)
    if not secrets:
        return df.filter(F.lit(False))
    return df.filter(reduce(lambda a, b: a | b, [F.col(column).contains(s) for s in secrets]))
