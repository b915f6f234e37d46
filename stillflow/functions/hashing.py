"""64-bit perceptual hashes as hex text or signed integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_to_long(text: Column) -> Column:
    """The signed integer with the bits of up to 16 hex digits."""
    return F.conv(text, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hashes (signed integers) differ."""
    return F.bit_count(a.bitwiseXOR(b))
