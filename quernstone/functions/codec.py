"""Binary keys whose unsigned byte order is the order of the values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of each integer type.
WIDTHS = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}


def encode_int(value: Column, kind: str = "bigint") -> Column:
    """Big-endian bytes with the sign bit flipped."""
    digits = 2 * WIDTHS[kind]
    flipped = F.hex(value.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)) if kind == "bigint" else F.lit(1 << (4 * digits - 1)).cast("bigint")))
    return F.unhex(F.substring(F.lpad(flipped, 16, "0"), 17 - digits, digits))


def decode_int(data: Column, kind: str = "bigint") -> Column:
    digits = 2 * WIDTHS[kind]
    unsigned = F.conv(F.hex(data), 16, -10).cast("bigint")
    return unsigned.bitwiseXOR(F.lit(-(1 << 63))) if kind == "bigint" else (unsigned - F.lit(1 << (4 * digits - 1))).cast(kind)


def encode_string(value: Column) -> Column:
    return F.encode(value, "UTF-8")


def decode_string(data: Column) -> Column:
    return F.decode(data, "UTF-8")


def encode_ints(value: Column, kind: str = "bigint") -> Column:
    """The concatenated codes of an array of integers."""
    return F.aggregate(F.transform(value, lambda x: encode_int(x, kind)), F.unhex(F.lit("")), lambda a, b: F.concat(a, b))


def decode_ints(data: Column, kind: str = "bigint") -> Column:
    """The integers of concatenated codes."""
    width = WIDTHS[kind]
    places = F.sequence(F.lit(0), F.greatest(F.floor(F.octet_length(data) / width).cast("int") - 1, F.lit(0)))
    read = F.transform(places, lambda i: decode_int(F.substring(data, i * width + 1, F.lit(width)), kind))
    return F.when(F.octet_length(data) > 0, read).otherwise(F.array().cast(f"array<{kind}>"))
