"""Bit vectors held as BINARY or as four BIGINT words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the key scheme: bit b of the key of table t is descriptor bit (t * 41 + b * 11) mod 256.
TABLE_STRIDE, BIT_STRIDE, TABLES, KEY_BITS = 41, 11, 6, 24


def words(vector: Column, count: int = 4) -> Column:
    """A BINARY of 8 * count bytes as an array of big-endian BIGINT words, on the JVM side."""
    return F.array(
        *[
            F.conv(F.hex(F.substring(vector, 8 * i + 1, 8)), 16, -10).cast("bigint")
            for i in range(count)
        ]
    )


def hamming(a: Column, b: Column, count: int = 4) -> Column:
    """Number of differing bits of two word arrays."""
    total = F.lit(0)
    for i in range(count):
        total = total + F.bit_count(a[i].bitwiseXOR(b[i]))
    return total


def descriptor_bit(word_array: Column, bit: int) -> Column:
    """Bit `bit` of the vector, counted from the lowest bit of its first byte."""
    byte, low = divmod(bit, 8)
    return F.getbit(word_array[byte // 8], F.lit((7 - byte % 8) * 8 + low))


def bucket_key(word_array: Column, table: int, key_bits: int = KEY_BITS) -> Column:
    """The LSH key of one table: a BIGINT of `key_bits` sampled descriptor bits."""
    key = F.lit(0).cast("bigint")
    for b in range(key_bits):
        bit = descriptor_bit(word_array, (table * TABLE_STRIDE + b * BIT_STRIDE) % 256)
        key = key.bitwiseOR(F.shiftleft(bit.cast("bigint"), b))
    return key


def set_bits(mask: Column) -> Column:
    """Positions of the set bits of a BINARY mask, lowest bit of each byte first."""
    bytes_ = F.transform(
        F.sequence(F.lit(1), F.octet_length(mask)), lambda i: F.conv(F.hex(F.substring(mask, i, F.lit(1))), 16, 10).cast("int")
    )
    return F.flatten(
        F.transform(
            bytes_,
            lambda v, i: F.filter(
                F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when(F.getbit(v, k) == 1, i * 8 + k)), lambda x: x.isNotNull()
            ),
        )
    )


def pack_bits(flags: Column) -> Column:
    """A hex string of the mask whose bits, lowest first in each byte, are the array of booleans `flags`."""
    size = F.ceil(F.size(flags) / 8).cast("int")
    powers = F.array(*[F.lit(1 << k) for k in range(8)])
    one = lambda i: F.aggregate(
        F.sequence(F.lit(0), F.lit(7)),
        F.lit(0),
        lambda s, k: s + F.when(F.coalesce(F.get(flags, i * 8 + k), F.lit(False)), F.element_at(powers, k + 1)).otherwise(0),
    )
    return F.when(F.size(flags) == 0, F.lit("")).otherwise(
        F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.lpad(F.hex(one(i)), 2, "0")), "")
    )


def inlier_masks(positions: DataFrame, key: str, position: str) -> DataFrame:
    """(key, part, inliers, mask): the distinct positions of a key as hex masks of whole bytes, cut off after the last set
    bit; bit i of part p stands for position 32768 p + i."""
    span = 32_768
    part = F.floor(F.col(position) / span).alias("part")
    masks = positions.groupBy(key, part).agg(
        F.count(F.lit(1)).alias("inliers"), F.hex(F.bitmap_construct_agg(F.col(position) % span)).alias("mask")
    )
    return masks.withColumn("mask", F.regexp_replace("mask", "(00)+$", ""))
