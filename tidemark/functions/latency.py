"""Latency arithmetic. Times stay integer microseconds until the last step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_ms(micros: Column) -> Column:
    """Microseconds as milliseconds; three decimals by construction, so no rounding."""
    return micros / F.lit(1000.0)


def age_ms(now_us: Column, commit_ts_us: Column) -> Column:
    return to_ms(now_us - commit_ts_us)


def queue_latency_ms(dequeue_us: Column, published_us: Column) -> Column:
    waited = dequeue_us - F.coalesce(published_us, dequeue_us)
    return to_ms(F.greatest(F.lit(0).cast("bigint"), waited))


def commit_to_publish_ms(published_us: Column, commit_ts_us: Column) -> Column:
    """Null when the publish time is missing or zero."""
    return to_ms(F.nullif(published_us, F.lit(0).cast("bigint")) - commit_ts_us)


def micros_to_iso(micros: Column) -> Column:
    """ISO text in UTC; the fraction is dropped when it is zero.

    Built from whole seconds plus the microsecond rest, so the session time zone has no say.
    """
    seconds = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (micros / F.lit(1_000_000)).cast("decimal(18,6)")
    )
    whole = F.date_format(seconds, "yyyy-MM-dd'T'HH:mm:ss")
    rest = F.pmod(micros, F.lit(1_000_000))
    fraction = F.when(rest == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))
    )
    return F.concat(whole, fraction, F.lit("+00:00"))
