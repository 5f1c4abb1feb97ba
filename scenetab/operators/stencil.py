"""Neighbourhood operations on pixel tables with one shuffle however many operations follow.

``tiled`` copies each pixel into the tiles whose margin reaches it and shuffles once by (keys, tile). All later windows
are partitioned by (keys, tile, row) or (keys, tile, column), which that shuffle already satisfies, so erosions, blurs
and medians chain with local sorts only. A task holds tiles, never a whole frame. ``untiled`` drops the margins.

The mirrored border (``size`` given) is copied in as rows. A mirrored picture stays mirrored under symmetric
operations, so the border stays right along the chain, and copies never change a minimum or maximum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 128
# rows of one task: a chain of windows sorts them again and again, and each of its sorts has memory of its own
ROWS_PER_TASK = 1 << 18


def dealt(df: DataFrame, rows: float, *by: str) -> DataFrame:
    """``df``, which has about ``rows`` rows where they are sorted, shuffled by the columns ``by`` to tasks of some ROWS_PER_TASK rows."""
    tasks = math.ceil(rows / ROWS_PER_TASK)
    if tasks <= 1:
        return df.repartition(*by)
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *by)


def copies(halo: int, size: tuple[int, int] | None, tile: int) -> float:
    """How many rows ``tiled`` makes of one, on the average."""
    out = 1.0
    for n in size or (None, None):
        if n is None:
            out *= 1 + 2 * halo / tile
        else:
            out *= sum(min(n - 1 + halo, at + tile - 1 + halo) - (at - halo) + 1 for at in range(0, n, tile)) / n
    return out


def _mirrored(name: str, size: int, halo: int) -> Column:
    """Positions in [-halo, size-1+halo] that show pixel ``name`` under the mirrored (101) border."""
    c = F.col(name)
    if size == 1:
        return F.sequence(F.lit(-halo).cast("bigint"), F.lit(halo).cast("bigint"))
    period = 2 * (size - 1)
    reach = halo // period + 1
    both = [p for k in range(-reach, reach + 1) for p in (c + F.lit(period * k), F.lit(period * k) - c)]
    inside = F.filter(F.array_distinct(F.array(*both)), lambda p: (p >= -halo) & (p <= size - 1 + halo))
    far = (c > halo) & (c < size - 1 - halo)
    return F.when(far, F.array(c)).otherwise(inside)


def _tiles_of(name: str, tile: int, halo: int) -> Column:
    lo = F.floor((F.col(name) - halo) / F.lit(tile)).cast("bigint")
    hi = F.floor((F.col(name) + halo) / F.lit(tile)).cast("bigint")
    return F.sequence(lo, hi)


def tiled(df: DataFrame, keys: list[str], halo: int, size: tuple[int, int] | None = None, tile: int = TILE, rows: float | None = None) -> DataFrame:
    """``size`` is (height, width); without it pixels outside the frame are simply absent.

    With ``rows``, the number of rows of ``df``, there are as many tasks as that takes, otherwise as many as the session's shuffles have.
    """
    out = df.withColumns({"y": F.col("y").cast("bigint"), "x": F.col("x").cast("bigint")})
    if size is not None and halo > 0:
        out = out.withColumn("y", F.explode(_mirrored("y", size[0], halo)))
        out = out.withColumn("x", F.explode(_mirrored("x", size[1], halo)))
    out = out.withColumn("ty", F.explode(_tiles_of("y", tile, halo))).withColumn("tx", F.explode(_tiles_of("x", tile, halo)))
    if size is not None:
        top = lambda n: (n - 1) // tile
        out = out.where(F.col("ty").between(0, top(size[0])) & F.col("tx").between(0, top(size[1])))
    return dealt(out, (rows or 0) * copies(halo, size, tile), *keys, "ty", "tx")


def untiled(df: DataFrame, size: tuple[int, int] | None = None, tile: int = TILE) -> DataFrame:
    home = (F.floor(F.col("y") / tile) == F.col("ty")) & (F.floor(F.col("x") / tile) == F.col("tx"))
    if size is not None:
        home = home & F.col("y").between(0, size[0] - 1) & F.col("x").between(0, size[1] - 1)
    return df.where(home).drop("ty", "tx")


def _axes(keys: list[str]):
    row = Window.partitionBy(*keys, "ty", "tx", "y").orderBy("x")
    col = Window.partitionBy(*keys, "ty", "tx", "x").orderBy("y")
    return row, col


def _both(df: DataFrame, keys: list[str], cols: list[str], fn) -> DataFrame:
    row, col = _axes(keys)
    out = df.withColumns({c: fn(F.col(c), row) for c in cols})
    return out.withColumns({c: fn(F.col(c), col) for c in cols})


def erode(df: DataFrame, keys: list[str], cols: list[str], k: int) -> DataFrame:
    """Minimum over the (2k+1)-square; what k rounds of a 3x3 erosion give."""
    return _both(df, keys, cols, lambda c, w: F.min(c).over(w.rangeBetween(-k, k)))


def dilate(df: DataFrame, keys: list[str], cols: list[str], k: int) -> DataFrame:
    return _both(df, keys, cols, lambda c, w: F.max(c).over(w.rangeBetween(-k, k)))


def erode_dilate(df: DataFrame, keys: list[str], low: str, high: str, k: int) -> DataFrame:
    """``erode`` of one column and ``dilate`` of another one, with the sorts of one of them."""
    out = df
    for w in (w.rangeBetween(-k, k) for w in _axes(keys)):
        out = out.withColumns({low: F.min(low).over(w), high: F.max(high).over(w)})
    return out


def box_sum(df: DataFrame, keys: list[str], cols: list[str], k: int) -> DataFrame:
    return _both(df, keys, cols, lambda c, w: F.sum(c).over(w.rangeBetween(-k, k)))


def gaussian_weights(size: int, sigma: float) -> list[float]:
    mid = (size - 1) / 2.0
    raw = [math.exp(-((i - mid) ** 2) / (2.0 * sigma * sigma)) for i in range(size)]
    return [r / sum(raw) for r in raw]


def blur(df: DataFrame, keys: list[str], cols: list[str], size: int, sigma: float) -> DataFrame:
    """Separable Gaussian; needs a margin of size // 2 that is really there (see ``tiled``)."""
    weights = gaussian_weights(size, sigma)
    half = size // 2

    def taps(c: Column, w) -> Column:
        total = c * F.lit(weights[half])
        for i in range(1, half + 1):
            total = total + (F.lag(c, i).over(w) + F.lead(c, i).over(w)) * F.lit(weights[half + i])
        return total

    return _both(df, keys, cols, taps)


def median3(df: DataFrame, keys: list[str], cols: list[str], size: tuple[int, int]) -> DataFrame:
    """3x3 median with the border pixel repeated."""
    row, col = _axes(keys)
    h, w = size

    def shifted(c: Column, axis: str, last: int, win) -> tuple[Column, Column]:
        pos = F.col(axis)
        before = F.when(pos == 0, c).otherwise(F.coalesce(F.lag(c, 1).over(win), c))
        after = F.when(pos == last, c).otherwise(F.coalesce(F.lead(c, 1).over(win), c))
        return before, after

    out = df
    trio = {}
    for c in cols:
        before, after = shifted(F.col(c), "x", w - 1, row)
        trio[f"_3{c}"] = F.array(before, F.col(c), after)
    out = out.withColumns(trio)
    nine = {}
    for c in cols:
        before, after = shifted(F.col(f"_3{c}"), "y", h - 1, col)
        nine[c] = F.get(F.array_sort(F.concat(before, F.col(f"_3{c}"), after)), 4)
    return out.withColumns(nine).drop(*trio)


def shrink(df: DataFrame, keys: list[str], cols: list[str], factor: int) -> DataFrame:
    """Mean of factor x factor blocks."""
    at = {a: F.floor(F.col(a) / F.lit(factor)).cast("bigint") for a in ("y", "x")}
    return df.withColumns(at).groupBy(*keys, "y", "x").agg(*[F.avg(c).alias(c) for c in cols])


def enlarge(df: DataFrame, keys: list[str], cols: list[str], factor: int, size: tuple[int, int], tile: int = TILE, rows: float | None = None) -> DataFrame:
    """Linear enlargement with pixel centres aligned. ``size`` is the size before, ``rows`` as in ``tiled``.

    Every pixel learns its right, lower and diagonal neighbour from two window passes and then emits the
    output pixels between them, so nothing is aggregated afterwards.
    """
    h, w = size
    ext = df.select(*keys, "y", "x", *cols)
    # one repeated pixel on each side: positions -1 .. size
    for a, n in (("y", h), ("x", w)):
        c = F.col(a).cast("bigint")
        parts = [F.array(c), F.when(c == 0, F.array(c - 1)).otherwise(F.array().cast("array<bigint>")),
                 F.when(c == n - 1, F.array(c + 1)).otherwise(F.array().cast("array<bigint>"))]
        ext = ext.withColumn(a, F.explode(F.concat(*parts)))
    ext = tiled(ext, keys, 1, None, tile, rows)
    row, col = _axes(keys)
    ext = ext.withColumns({f"_r{c}": F.lead(c, 1).over(row) for c in cols})
    ext = ext.withColumns({f"_{p}{c}": F.lead(s, 1).over(col) for c in cols for p, s in (("b", c), ("d", f"_r{c}"))})
    home = (F.floor(F.col("y") / tile) == F.col("ty")) & (F.floor(F.col("x") / tile) == F.col("tx"))
    ext = ext.where(home & F.col("y").between(-1, h - 1) & F.col("x").between(-1, w - 1)).drop("ty", "tx")

    def outputs(a: str, n: int) -> Column:
        # output p sits at (p + 0.5) / f - 0.5; those with floor equal to this position
        first = F.col(a) * factor + factor // 2
        span = F.sequence(first.cast("bigint"), (first + factor - 1).cast("bigint"))
        return F.filter(span, lambda p: (p >= 0) & (p < n * factor))

    ext = ext.withColumn("_oy", F.explode(outputs("y", h))).withColumn("_ox", F.explode(outputs("x", w)))
    fy = (F.col("_oy") + 0.5) / F.lit(float(factor)) - 0.5 - F.col("y")
    fx = (F.col("_ox") + 0.5) / F.lit(float(factor)) - 0.5 - F.col("x")
    ext = ext.withColumns({"_fy": fy, "_fx": fx})

    def mix(c: str) -> Column:
        top = F.col(c) * (1 - F.col("_fx")) + F.col(f"_r{c}") * F.col("_fx")
        low = F.col(f"_b{c}") * (1 - F.col("_fx")) + F.col(f"_d{c}") * F.col("_fx")
        return top * (1 - F.col("_fy")) + low * F.col("_fy")

    return ext.select(*keys, F.col("_oy").alias("y"), F.col("_ox").alias("x"), *[mix(c).alias(c) for c in cols])
