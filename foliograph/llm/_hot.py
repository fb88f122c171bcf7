"""Joins by a key of which one may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one in so many of all rows; there are fewer such keys than this, so their rows may be broadcast.
HOT = 1000
#: Words of 64 bits that a bitmap of keys has at most; that many rows are the most that in_bitmap() broadcasts.
BITMAP_WORDS = 1 << 20


def by_key(rows: DataFrame, keys: DataFrame, on: Sequence[str], size: str, total: int) -> DataFrame:
    """rows joined to keys, which has one row for each value of `on` and their number of rows in `size`, without that column.

    Hot keys meet their rows by a broadcast of fewer than HOT rows; all others by a shuffle in which no key is hot.
    Null keys match none.
    """
    hot = (F.col(size) * HOT > total) if total else F.lit(False)
    few = F.broadcast(keys.where(hot).drop(size))
    rest = rows.join(F.broadcast(keys.where(hot).select(*on)), [*on], "left_anti")
    return rows.join(few, [*on]).unionByName(rest.join(keys.where(~hot).drop(size), [*on]))


def _slot(on: Sequence[str], words: int):
    return F.pmod(F.xxhash64(*on), F.lit(64 * words))


def in_bitmap(rows: DataFrame, keys: DataFrame, on: Sequence[str], n_keys: int) -> DataFrame:
    """The rows whose key may be among keys: all that are, and a few others.

    The keys' hashes set bits of a bitmap, eight a key while it has fewer than BITMAP_WORDS words; it is broadcast, so
    rows don't move. Larger key sets fill the bitmap, and more other rows are let through.
    """
    words = 1 << 6
    while words < BITMAP_WORDS and words * 8 < n_keys:
        words *= 2
    word, bit = "__bitmap_word", "__bitmap_bit"
    slot = _slot(on, words)
    at, mask = F.shiftright(slot, 6), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    bits = keys.groupBy(at.alias(word)).agg(F.bit_or(mask).alias(bit))
    return rows.withColumn(word, at).join(F.broadcast(bits), word).where(F.col(bit).bitwiseAND(mask) != 0).drop(word, bit)
