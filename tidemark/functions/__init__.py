"""Column functions of the storage layer."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def byte_size(c: Column) -> Column:
    """Bytes of a string or binary; other types count as their text."""
    return F.octet_length(c.cast("string") if not isinstance(c, str) else F.col(c).cast("string"))


def bloom_bits(n: int | Column, p: float = 0.05):
    """Bits of a Bloom filter for ``n`` keys at error rate ``p``: ``ceil(-n ln p / ln(2)^2)``."""
    if isinstance(n, int):
        return math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return F.ceil(-n * F.lit(math.log(p)) / F.lit(math.log(2) ** 2))


def bloom_hashes(p: float = 0.05) -> int:
    """Hash functions of the filter: ``ceil(-log2 p)``."""
    return math.ceil(-math.log2(p))


def bloom_positions(key: Column, bits: int, hashes: int) -> Column:
    """Bit positions of a key by double hashing ``h1 + i h2 mod bits``, as an array."""
    h1, h2 = F.xxhash64(key), F.xxhash64(F.lit(1), key)
    return F.transform(
        F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(F.pmod(h1, F.lit(bits)) + i * F.pmod(h2, F.lit(bits)), F.lit(bits))
    )


def bloom_build(keys: DataFrame, column: str = "key", p: float = 0.05, n: int | None = None) -> tuple[DataFrame, int, int]:
    """The set bits of a filter over ``keys`` as a relation ``(word, mask)``, its bits and hashes.

    Words of 60 bits are combined by ``bit_or``, map-side first, so the shuffle carries no key.
    """
    n = keys.count() if n is None else n
    bits, hashes = max(1, bloom_bits(n, p)), bloom_hashes(p)
    spots = keys.select(F.explode(bloom_positions(F.col(column), bits, hashes)).alias("at"))
    words = spots.groupBy(F.floor(F.col("at") / 60).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(60)).cast("int"))).alias("mask")
    )
    return words, bits, hashes


def bloom_probe(keys: DataFrame, words: DataFrame, bits: int, hashes: int, column: str = "key") -> DataFrame:
    """``keys`` with ``maybe``: false only for keys that the filter was not built over."""
    spots = keys.select(column).distinct().withColumn("at", F.explode(bloom_positions(F.col(column), bits, hashes)))
    hit = F.coalesce(F.call_function("shiftright", F.col("mask"), F.pmod("at", F.lit(60)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    judged = (
        spots.withColumn("word", F.floor(F.col("at") / 60))
        .join(words, "word", "left")
        .groupBy(column)
        .agg(F.bool_and(hit).alias("maybe"))
    )
    return keys.join(judged, column)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings."""
    n = F.least(F.char_length(a), F.char_length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.array_max(same)


def prefix_groups(rows: DataFrame, column: str = "key", interval: int = 16) -> DataFrame:
    """Restart groups of sorted keys: ``grp, n, shared, plain, packed`` (bytes before and after).

    In sorted order the prefix that a group shares is that of its first and last key.
    """
    from tidemark.operators.order import running_total

    numbered = running_total(rows.select(column), column, F.lit(1), "before")
    grouped = numbered.groupBy(F.floor(F.col("before") / interval).alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"), F.sum(F.char_length(column)).alias("plain")
    )
    shared = common_prefix(F.col("lo"), F.col("hi")).cast("long")
    return grouped.select(
        "grp", "n", shared.alias("shared"), "plain", (F.col("plain") - (F.col("n") - 1) * shared).alias("packed")
    )


def checksum(c: Column) -> Column:
    """CRC-32 of a value's bytes."""
    return F.crc32(c.cast("binary"))
