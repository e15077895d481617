"""Absent versus null.

A sparse field ``f`` of type T travels as ``STRUCT<v: T>``: the struct is null when the
field is absent from the change, and ``STRUCT(null)`` when the field is there with a null.
Ordinary null-skipping aggregates then pick "the last value that was sent".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(value: Column) -> Column:
    return F.struct(value.alias("v"))


def absent(data_type: str) -> Column:
    return F.lit(None).cast(f"struct<v:{data_type}>")


def sparse(value: Column, sent: Column) -> Column:
    return F.when(sent, present(value))


def sparse_from_map(fields: Column, name: str, data_type: str = "string") -> Column:
    """A presence struct from a map whose key set says which fields were sent."""
    sent = F.coalesce(F.map_contains_key(fields, F.lit(name)), F.lit(False))
    return F.when(sent, present(fields.getItem(name).try_cast(data_type)))


def unreadable(fields: Column, name: str, data_type: str = "string") -> Column:
    """Whether a field was sent with a value that its type cannot hold."""
    text = fields.getItem(name)
    return F.coalesce(text.isNotNull() & text.try_cast(data_type).isNull(), F.lit(False))


def is_present(field: Column) -> Column:
    return field.isNotNull()


def value_of(field: Column) -> Column:
    return field.getField("v")
