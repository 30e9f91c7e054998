"""A broadcast bitmap of hashed keys: picks the rows that a later join or scan needs, so that the other rows' texts are never shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The bitmap has 2**MOST_BITS bits at most (32 MB), and MARGIN bits for each key unless that would be more.
MOST_BITS, MARGIN = 28, 16


def marked(df: DataFrame, keys: list[str], wanted: DataFrame, count: int) -> DataFrame:
    """``df`` with a boolean ``_marked``: true for every row whose keys are in ``wanted`` (``count`` rows with the same key columns), and for a
    few others; where the keys are too many for a bitmap to tell, true for all rows."""
    bits = max(20, (MARGIN * count - 1).bit_length())
    if bits > MOST_BITS + 3:
        return df.withColumn("_marked", F.lit(True))
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << min(bits, MOST_BITS))) + 1
    maps = wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_map"))
    placed = df.withColumn("_bucket", F.bitmap_bucket_number(place)).withColumn("_bit", F.bitmap_bit_position(place))
    byte = F.conv(F.hex(F.substring("_map", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = placed.join(F.broadcast(maps), "_bucket", "left").withColumn("_byte", F.coalesce(byte, F.lit(0)))
    return joined.withColumn("_marked", F.expr("shiftright(_byte, cast(_bit % 8 as int)) & 1 = 1")).select(*df.columns, "_marked")
