"""Smoothed series: exponential averages of any length without gathering a series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetab.functions.ranks import exact_rank

# keep to this power of e is still a number, and its square is nothing beside 1
REACH = 300
# rows of a chunk at most, whatever the weight
CHUNK = 4096


def linear_recurrence(df: DataFrame, key: str, pos: str, add: Column, keep: float, rows: int, out: str, chunk: int = CHUNK) -> DataFrame:
    """x = keep * x + add per key, by position from 0; nothing comes before position 0.

    A chunk of at most ``chunk`` positions is a segment that multiplies what comes in by keep^length and adds its own end. Inside,
    the recurrence is a running sum of add / keep^m scaled back, so a chunk is shorter where those powers would overflow. The
    ends of the chunks obey the same recurrence with keep^length, over a table ``chunk`` times as short, until ``rows`` rows
    are one chunk or the multiplier is nothing beside 1. So no task holds more than a chunk, for any ``keep`` and any length.
    """
    size = max(2, min(chunk, int(REACH / -math.log(keep)))) if keep > math.exp(-REACH / 2) else 1
    chunk_no, place, x = f"{pos}_c", f"{pos}_m", f"{pos}_x"
    src = df.withColumns({chunk_no: F.floor(F.col(pos) / size).cast("bigint"), place: (F.col(pos) % size).cast("double"), x: add})
    upto = Window.partitionBy(key, chunk_no).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    src = src.withColumn(x, F.sum(F.col(x) * F.pow(F.lit(keep), -F.col(place))).over(upto) * F.pow(F.lit(keep), F.col(place)))
    if rows <= size:
        return src.withColumn(out, F.col(x)).drop(chunk_no, place, x)
    full = keep**size
    ends = src.groupBy(key, chunk_no).agg(F.max_by(x, pos).alias("_end"))
    if full < 1e-19:
        # what lies further back than the chunk before the last is below one unit in the last place
        older = ends.select(key, (F.col(chunk_no) + 1).alias(chunk_no), F.col("_end").alias("_older"))
        ends = ends.join(older, [key, chunk_no], "left").withColumn("_whole", F.col("_end") + full * F.coalesce("_older", F.lit(0.0)))
    else:
        ends = linear_recurrence(ends, key, chunk_no, F.col("_end"), full, -(-rows // size), "_whole", chunk)
    back = ends.select(key, (F.col(chunk_no) + 1).alias(chunk_no), F.col("_whole").alias("_in"))
    whole = F.col(x) + F.coalesce("_in", F.lit(0.0)) * F.pow(F.lit(keep), F.col(place) + 1.0)
    return src.join(back, [key, chunk_no], "left").withColumn(out, whole).drop(chunk_no, place, x, "_in")


def moving_average(df: DataFrame, key: str, order: str, value: str, keep: float, chunk: int = CHUNK, start: DataFrame | None = None) -> DataFrame:
    """x0 = v0, then x = keep * x + (1 - keep) * v, per series in order, as ``smooth``.

    With ``start`` (key, smooth) a series that has a row there goes on from it.
    """
    if not 0 < keep < 1:
        raise ValueError("keep must lie between 0 and 1")
    src = exact_rank(df, [key], order, order, out="_pos")
    v = F.col(value)
    add = F.when(F.col("_pos") == 0, v).otherwise((1.0 - keep) * v)
    if start is not None:
        # only the first row of a series needs it
        first = start.select(key, F.lit(0).cast("bigint").alias("_pos"), F.col("smooth").alias("_start"))
        src = src.join(first, [key, "_pos"], "left")
        add = F.when(F.col("_start").isNotNull(), keep * F.col("_start") + (1.0 - keep) * v).otherwise(add)
    out = linear_recurrence(src, key, "_pos", add, keep, df.count(), "smooth", chunk)
    return out.drop("_pos", "_start")


def with_log10(df: DataFrame) -> DataFrame:
    return df.withColumn("log_smooth", F.log10("smooth"))


def brightness_ratio(frame_means: DataFrame, video: str = "video") -> DataFrame:
    """Correction per frame that makes its mean follow 0.95 of the corrected mean before it."""
    out = moving_average(frame_means, video, "frame_idx", "brightness", 0.95)
    return out.withColumn("ratio", F.try_divide("smooth", "brightness"))
