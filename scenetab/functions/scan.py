"""Ordered scans in two levels: inside chunks of the order key, then over one row per chunk.

A plain window over a key puts all rows of a hot key into one task. Cutting by ``order div chunk`` bounds every
task, and the second level only sees a row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def with_chunk(df: DataFrame, order: str, chunk: int = CHUNK) -> DataFrame:
    return df.withColumn("_c", F.floor(F.col(order) / F.lit(chunk)).cast("bigint"))


def running(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, kind: str = "sum", chunk: int = CHUNK, total: str | None = None
) -> DataFrame:
    """Exclusive running sum or product of ``value`` (the first row gets 0 or 1), and with ``total`` also that of the whole key."""
    unit = F.lit(0.0 if kind == "sum" else 1.0)
    agg = F.sum if kind == "sum" else F.product
    src = with_chunk(df, order, chunk).withColumn("_v", value)
    part = [*keys, "_c"]
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        src.groupBy(*part).agg(agg("_v").alias("_t"))
        .select(*part, F.coalesce(agg("_t").over(before), unit).alias("_in"), *([agg("_t").over(Window.partitionBy(*keys)).alias(total)] if total else []))
    )
    inside = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(agg("_v").over(inside), unit)
    joined = src.join(carry, part)
    before_row = F.col("_in") + local if kind == "sum" else F.col("_in") * local
    return joined.withColumn(out, before_row).drop("_c", "_v", "_in")


def carry(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, forward: bool = True,
    inclusive: bool = True, chunk: int = CHUNK,
) -> DataFrame:
    """Last non-null ``value`` at or before each row (``forward``), or first at or after it."""
    src = with_chunk(df, order, chunk).withColumn("_v", value)
    part = [*keys, "_c"]
    direction = (lambda c: F.col(c).asc()) if forward else (lambda c: F.col(c).desc())
    seen = F.col("_v").isNotNull()
    pick = F.max_by if forward else F.min_by
    before = Window.partitionBy(*keys).orderBy(direction("_c")).rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        src.groupBy(*part)
        .agg(pick(F.when(seen, F.col("_v")), F.when(seen, F.col(order))).alias("_e"))
        .select(*part, F.last("_e", ignorenulls=True).over(before).alias("_in"))
    )
    inside = (
        Window.partitionBy(*part).orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = F.last("_v", ignorenulls=True).over(inside)
    return src.join(ends, part).withColumn(out, F.coalesce(local, F.col("_in"))).drop("_c", "_v", "_in")


def carry_both(
    df: DataFrame, keys: list[str], order: str, value: Column, prev: str, nxt: str, inclusive: bool = True, chunk: int = CHUNK
) -> DataFrame:
    """``carry`` in both directions with one join: the last value at (``inclusive``) or before, and the first after."""
    src = with_chunk(df, order, chunk).withColumn("_v", value)
    part = [*keys, "_c"]
    at = F.when(F.col("_v").isNotNull(), F.col(order))
    chunks = Window.partitionBy(*keys).orderBy("_c")
    ends = (
        src.groupBy(*part)
        .agg(F.max_by("_v", at).alias("_l"), F.min_by("_v", at).alias("_f"))
        .select(
            *part,
            F.last("_l", ignorenulls=True).over(chunks.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
            F.first("_f", ignorenulls=True).over(chunks.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
        )
    )
    rows = Window.partitionBy(*part).orderBy(order)
    up = F.last("_v", ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    down = F.first("_v", ignorenulls=True).over(rows.rowsBetween(1, Window.unboundedFollowing))
    out = src.join(ends, part).withColumns({prev: F.coalesce(up, F.col("_before")), nxt: F.coalesce(down, F.col("_after"))})
    return out.drop("_c", "_v", "_before", "_after")
