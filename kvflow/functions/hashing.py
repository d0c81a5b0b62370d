"""Hash functions: 32-bit FNV-1a for output layouts that must be reproducible, SHA-256 for exact duplicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a, 32 bits.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
FNV_MASK = 4294967295


def fnv1a32(key: Column) -> Column:
    """FNV-1a of the UTF-8 bytes of key, as BIGINT from 0 to 2**32 - 1. Null stays null."""
    # Read as Latin-1, each byte is one character, whose number is the byte.
    signs = F.split(F.decode(F.encode(key, "UTF-8"), "ISO-8859-1"), "")
    signs = F.when(key == "", F.array().cast("array<string>")).otherwise(signs)
    return F.aggregate(
        signs,
        F.lit(FNV_OFFSET).cast("bigint"),
        lambda state, sign: (state.bitwiseXOR(F.ascii(sign).cast("bigint")) * F.lit(FNV_PRIME).cast("bigint")).bitwiseAND(F.lit(FNV_MASK).cast("bigint")),
    )


def fnv1a32_bytes(data: bytes) -> int:
    """The same of bytes, for drivers and tests."""
    state = FNV_OFFSET
    for b in data:
        state = (state ^ b) * FNV_PRIME & FNV_MASK
    return state


def reduce_id(key: Column, n: int) -> Column:
    """Output partition of key among n, as INT, the type that repartitionById takes."""
    return (fnv1a32(key) % n).cast("int")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)
