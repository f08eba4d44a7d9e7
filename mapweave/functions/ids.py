"""Stable name-based identifiers (UUID version 5) from built-in functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: namespace of table and column ids.
SOURCE_NAMESPACE = uuid.UUID("9a216e98-08b3-46c8-b07d-79f06ee97a02")


def uuid5(name: Column, namespace: uuid.UUID = SOURCE_NAMESPACE) -> Column:
    """UUIDv5 of a name: SHA-1 of namespace and name with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
                    F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
                    F.substring(digest, 21, 12))


def table_id(sha256: Column, sheet: Column, cell_range: Column, header_row: Column, names: Column) -> Column:
    """Id of a discovered table: content, place and normalised headers; not the file name."""
    blank = F.lit("")
    return uuid5(F.concat_ws("|", sha256, F.coalesce(sheet, blank), F.coalesce(cell_range, blank),
                             header_row.cast("string"), F.array_join(names, ",")))


def column_id(table: Column, index: Column, name: Column) -> Column:
    """Id of a column by its table, zero-based place and normalised name."""
    return uuid5(F.concat_ws("|", table, index.cast("string"), name))
