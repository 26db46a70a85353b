"""Bitmaps of fixed size: a first filter in front of an exact join.

A bitmap of ``1 << bits`` bits is all that reaches the driver, whatever the
number of rows.  A full bitmap only filters less; the join that follows
decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 22


def bitmap_of(df: DataFrame, hashed: Column, bits: int = BITS) -> np.ndarray:
    """Words of 64 bits with the bit of every (well mixed) 64-bit hash set; at most ``1 << bits - 6`` of them are collected."""
    return bitmaps_of(df, hashed, F.lit(True), bits)[0][0]


def bitmaps_of(df: DataFrame, hashed: Column, flag: Column, bits: int = BITS) -> tuple[tuple[np.ndarray, int], ...]:
    """Bitmap and number of the rows with the flag, and of those without, in one pass."""
    rows = df.select(_slot(hashed, bits).alias("slot"), flag.alias("flag")).where("slot is not null")
    bit, sides = F.expr("shiftleft(1L, cast(slot & 63 as int))"), []
    for name, on in (("a", F.col("flag")), ("b", ~F.col("flag"))):
        sides += [F.bit_or(F.when(on, bit).otherwise(0)).alias(name), F.sum(on.cast("long")).alias(f"n_{name}")]
    words = rows.groupBy(F.shiftright("slot", 6).alias("word")).agg(*sides).toArrow()
    at, out = words["word"].to_numpy(), []
    for name in ("a", "b"):
        bitmap = np.zeros(1 << (bits - 6), dtype=np.uint64)
        bitmap[at] = words[name].to_numpy().view(np.uint64)
        out.append((bitmap, int(words[f"n_{name}"].to_numpy().sum())))
    return tuple(out)


def _slot(hashed: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - bits)


def split_by_bitmap(df: DataFrame, hashed: Column, other: DataFrame, other_hash: Column, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose hash no row of ``other`` has, and all others, so that only these need a join; wide rows that go nowhere are not dealt."""
    bit = F.expr("shiftleft(1L, cast(_slot & 63 as int))")
    words = other.select(_slot(other_hash, bits).alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    marked = df.withColumn("_slot", _slot(hashed, bits)).withColumn("_word", F.shiftright("_slot", 6))
    marked = marked.join(F.broadcast(words), "_word", "left").withColumn("_on", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False)))
    return marked.where(~F.col("_on")).select(*df.columns), marked.where("_on").select(*df.columns)


def contains(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each unsigned 64-bit hash is set."""
    bits = (len(bitmap) * 64).bit_length() - 1
    slot = hashes >> np.uint64(64 - bits)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
