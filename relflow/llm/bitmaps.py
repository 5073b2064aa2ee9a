"""Bitmaps of bounded size that tell which rows may have one of some keys, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap that tells wanted texts: so many for each of them, and no fewer or more than these (8 KB, 32 MB).
BITS_PER_KEY, FEWEST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28


def might_be(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """``df`` with a column ``name`` that is true where ``key`` is a ``key`` of ``keys``, and seldom elsewhere.

    Keys are marked in a bitmap of BITS_PER_KEY bits each, of MOST_BITS at the most,
    which is broadcast; with many more keys it is true for all, which costs time only.
    """
    n = keys.count() * BITS_PER_KEY
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << max(n - 1, 1).bit_length()))
    place = lambda k: F.pmod(k, F.lit(bits)) + 1
    bucket, at = (lambda p, f=f: F.call_function(f, p) for f in ("bitmap_bucket_number", "bitmap_bit_position"))
    marks = keys.groupBy(bucket(place(F.col("key"))).alias("__bucket")).agg(F.call_function("bitmap_construct_agg", at(place(F.col("key")))).alias("__bits"))
    out = df.withColumn("__place", place(key)).withColumn("__bucket", bucket(F.col("__place"))).join(F.broadcast(marks), "__bucket", "left")
    p = at(F.col("__place"))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.shiftright(byte, 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (p % 8 + 1).cast("int"))) != 0
    return out.withColumn(name, F.coalesce(bit, F.lit(False))).drop("__place", "__bucket", "__bits")
