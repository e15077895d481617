"""Commit positions: 64-bit integers for ordering, ``HI/LO`` hex text for display.

Only the integer is ever compared; the text form does not sort.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: microseconds from 1970-01-01 to 2000-01-01.
PG_EPOCH_US = 946_684_800_000_000


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _hex_half(text: Column, part: int) -> Column:
    return F.conv(F.split_part(text, F.lit("/"), F.lit(part)), 16, 10).cast("bigint")


def lsn_to_long(lsn: Column | str) -> Column:
    """The position as a number; null for text that is not ``HI/LO`` in hex."""
    text = _column(lsn)
    number = F.shiftleft(_hex_half(text, 1), 32).bitwiseOR(_hex_half(text, 2))
    return F.when(text.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"), number)


def long_to_lsn(position: Column | str) -> Column:
    number = _column(position).cast("bigint")
    low = number.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return F.concat(F.hex(F.shiftrightunsigned(number, 32)), F.lit("/"), F.hex(low))


def lsn_diff(ahead: Column | str, behind: Column | str) -> Column:
    """Bytes of log between two positions given in text form."""
    return lsn_to_long(ahead) - lsn_to_long(behind)


def pg_micros_to_unix(micros: Column | str) -> Column:
    return _column(micros) + F.lit(PG_EPOCH_US)
