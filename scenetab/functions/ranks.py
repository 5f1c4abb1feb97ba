"""Exact ranks and order statistics without one task ever sorting a whole group.

Rows are cut into value ranges at approximate quantiles, so ranges are balanced whatever the groups look like; a value
heavy enough to be a cut point gets a range of its own, which is cut again by the tie column. The cut points only steer
the balance: ranks are exact because range counts are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetab.functions.session import broadcast_if_small

# Rows meant for one range, and the bounds of how many ranges there are.
RANGE_ROWS, FEWEST, MOST = 1_000_000, 64, 4096


def _ranges(df: DataFrame) -> int:
    """Enough ranges that each holds about RANGE_ROWS rows; beyond MOST of them ranges grow, but slowly."""
    return min(MOST, max(FEWEST, -(-df.count() // RANGE_ROWS)))


def _cuts(df: DataFrame, cols: list[str], ranges: int) -> list[list[float]]:
    probs = [i / ranges for i in range(1, ranges)]
    found = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).approxQuantile(cols, probs, 0.25 / ranges)
    return [sorted(set(q)) for q in found]


def _range_of(v: Column, cuts: list[float]) -> Column:
    """2k for values between cuts, 2k+1 for values equal to cut k, as a balanced tree of comparisons."""

    def build(lo: int, hi: int) -> Column:
        if lo >= hi:
            return F.lit(2 * lo)
        mid = (lo + hi) // 2
        c = F.lit(cuts[mid])
        return F.when(v < c, build(lo, mid)).when(v == c, F.lit(2 * mid + 1)).otherwise(build(mid + 1, hi))

    return build(0, len(cuts))


def exact_rank(
    df: DataFrame, group: list[str], order: str, tie: str, out: str = "rank", ranges: int | None = None, descending: bool = False
) -> DataFrame:
    """0-based rank of each row in its group by (order, tie). ``tie`` must be unique within a group."""
    key = F.col(order).cast("double")
    src = df.withColumn("_o", -key if descending else key)
    cuts, tie_cuts = _cuts(src, ["_o", tie], ranges or _ranges(df))
    b1 = F.coalesce(_range_of(F.col("_o"), cuts), F.lit(-1))
    b2 = F.when(F.col("_b1") % 2 != 0, _range_of(F.col(tie).cast("double"), tie_cuts)).otherwise(F.lit(0))
    src = src.withColumn("_b1", b1).withColumn("_b2", b2)
    keys = [*group, "_b1", "_b2"]
    before = Window.partitionBy(*group).orderBy("_b1", "_b2").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        src.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    inside = Window.partitionBy(*keys).orderBy("_o", tie)
    return (
        src.join(offsets, keys)
        .withColumn(out, (F.col("_off") + F.row_number().over(inside) - 1).cast("bigint"))
        .drop("_o", "_b1", "_b2", "_off")
    )


def pick_at(
    df: DataFrame, group: list[str], value: str, picks: dict[str, Column], ranges: int | None = None
) -> DataFrame:
    """One row per group with the ascending order's elements at given 0-based positions.

    ``picks`` maps an output name to a position expression over the column ``n`` (rows in the group). Only the ranges
    holding a wanted position are shuffled and sorted.
    """
    src = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    (cuts,) = _cuts(src, ["_v"], ranges or _ranges(src))
    src = src.withColumn("_b", _range_of(F.col("_v"), cuts))
    whole = Window.partitionBy(*group)
    counts = (
        src.groupBy(*group, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("n", F.sum("_n").over(whole))
        .withColumn("_hi", F.sum("_n").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
    )
    want = F.array(*[F.struct(F.lit(k).alias("name"), p.cast("bigint").alias("at")) for k, p in picks.items()])
    targets = (
        counts.withColumn("_p", F.explode(want))
        .where((F.col("_p.at") >= F.col("_lo")) & (F.col("_p.at") < F.col("_hi")))
        .select(*group, "_b", "n", F.col("_p.name").alias("_name"), (F.col("_p.at") - F.col("_lo")).alias("_k"))
    )
    targets = broadcast_if_small(targets)
    keys = [*group, "_b"]
    hit = src.join(targets.select(*keys).distinct(), keys, "left_semi").groupBy(*keys, "_v").agg(
        F.count(F.lit(1)).alias("_c")
    )
    run = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumn("_end", F.sum("_c").over(run))
    got = hit.join(targets, keys).where((F.col("_k") < F.col("_end")) & (F.col("_k") >= F.col("_end") - F.col("_c")))
    return got.groupBy(*group).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in picks]
    )


def fraction_index(frac: float) -> Column:
    """Position min(n-1, floor(frac*n)): the selection rule used throughout, unlike SQL's percentile_disc."""
    return F.least(F.col("n") - 1, F.floor(F.lit(frac) * F.col("n")).cast("bigint"))


def take_smallest(df: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    """The n rows smallest by (value, tie), for any n: a threshold filter instead of one task merging n rows.

    Only the threshold (one number) visits the driver.
    """
    found = pick_at(df, [], value, {"thr": F.lit(n - 1)}).first() if n > 0 else None
    if n <= 0:
        return df.limit(0)
    if found is None or found["thr"] is None:
        return df
    thr, v = F.lit(found["thr"]), F.col(value).cast("double")
    below, ties = df.where(v < thr), df.where(v == thr)
    left = n - below.count()
    # ties are cut the same way by the tie column; only rows that agree in both as doubles are left to a sort
    last = pick_at(ties, [], tie, {"thr": F.lit(left - 1)}).first()
    if last is None or last["thr"] is None:
        return below.unionByName(ties.limit(left))
    edge, t = F.lit(last["thr"]), F.col(tie).cast("double")
    before = ties.where(t < edge)
    return below.unionByName(before).unionByName(ties.where(t == edge).orderBy(tie).limit(left - before.count()))
