"""Decoding of tokenised tuple values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.presence import sparse_from_map

# PostgreSQL type OIDs with a decoding of their own.
INTEGER_OIDS = (20, 21, 23)
BOOLEAN_OID = 16

# Tuple data kinds.
KIND_TEXT, KIND_BINARY, KIND_NULL, KIND_UNCHANGED = "t", "b", "n", "u"
KNOWN_KINDS = (KIND_TEXT, KIND_BINARY, KIND_NULL, KIND_UNCHANGED)


def decode_value(kind: Column, oid: Column, text: Column, binary: Column) -> Column:
    """Canonical text of one value: integers normalised, booleans spelled out, bytes as hex."""
    integer = F.trim(text).try_cast("bigint").cast("string")
    boolean = F.when(text == "t", F.lit("true")).otherwise(F.lit("false"))
    decoded = (
        F.when(oid.isin(*INTEGER_OIDS), integer).when(oid == BOOLEAN_OID, boolean).otherwise(text)
    )
    return F.when(kind == KIND_TEXT, decoded).when(kind == KIND_BINARY, F.translate(F.hex(binary), "ABCDEF", "abcdef"))


def bad_integer(cell: Column, column: Column) -> Column:
    is_integer = column.getField("type_oid").isin(*INTEGER_OIDS)
    unreadable = F.trim(cell.getField("text")).try_cast("bigint").isNull()
    return (cell.getField("kind") == KIND_TEXT) & is_integer & unreadable



def decode_row(columns: Column, cells: Column) -> Column:
    """``MAP<name, text>`` of the fields that were sent; unchanged fields have no entry."""
    sent = F.zip_with(
        columns,
        cells,
        lambda spec, cell: F.when(
            cell.getField("kind") != KIND_UNCHANGED,
            F.struct(
                spec.getField("name").alias("name"),
                decode_value(
                    cell.getField("kind"),
                    spec.getField("type_oid"),
                    cell.getField("text"),
                    cell.getField("bin"),
                ).alias("value"),
            ),
        ),
    )
    return F.map_from_entries(F.array_compact(sent))


def typed_row(row: Column, types: Mapping[str, str]) -> Column:
    """The decoded fields as a struct of presence structs in their own types.

    A field that was not sent is null, one sent as null holds null. A text that its type cannot hold
    reads as null; ``unreadable`` tells such values apart.
    """
    return F.struct(*[sparse_from_map(row, name, data_type).alias(name) for name, data_type in types.items()])


def key_map(columns: Column, row: Column) -> Column:
    """The entries of ``row`` that belong to key columns."""
    mine = F.filter(columns, lambda c: c.getField("is_key") & F.map_contains_key(row, c.getField("name")))
    entries = F.transform(mine, lambda c: F.struct(c.getField("name"), row[c.getField("name")]))
    return F.when(row.isNotNull(), F.map_from_entries(entries))
