"""Joins with a table of one row per key that stay even when one key holds much of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more than this share of the rows is hot.
HOT_SHARE = 4096


def join_counted(rows: DataFrame, sums: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``sums``: one row per key, ``count`` being the key's rows. ``count`` is dropped.

    Keys with more than total / HOT_SHARE rows come by broadcast; if ``rows`` has at most c * total rows there are fewer than
    c * HOT_SHARE such keys. The other keys are shuffled, and none of them is large; rows that have found their key already are
    spread evenly in the same shuffle, so ``rows`` is evaluated once.
    """
    values = [c for c in sums.columns if c not in (key, count)]
    hot = F.col(count) * HOT_SHARE > F.lit(total)
    many = sums.where(hot).select(key, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    few = sums.where(~hot).select(key, F.lit(0).alias("_spread"), F.lit(True).alias("_cold"), *[F.col(c).alias(f"_cold_{c}") for c in values])
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 16)).cast("int") + 1).otherwise(F.lit(0))
    met = rows.join(F.broadcast(many), key, "left").withColumn("_spread", spread).join(few, [key, "_spread"], "left")
    found = met.where(F.col("_hot") | F.col("_cold"))
    return found.select(*rows.columns, *[F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in values])
