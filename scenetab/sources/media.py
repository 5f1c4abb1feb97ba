"""File catalogues and image files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: known extensions
IMAGE_EXT = ("png", "jpg", "jpeg", "bmp", "tiff", "tif", "webp", "heic", "heif")
VIDEO_EXT = ("mp4", "mov", "mkv", "avi", "webm")
FRAME_PATTERN = r"^ldi3_([0-9]{6})\.(png|jpg)"


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """File names and sizes of a folder, without reading contents."""
    df = spark.read.format("binaryFile").load(glob).select("path", "length", "modificationTime")
    return df.withColumn("filename", F.element_at(F.split("path", "/"), -1))


def frame_numbers(files: DataFrame, pattern: str = FRAME_PATTERN) -> DataFrame:
    hit = files.where(F.col("filename").rlike(pattern))
    return hit.withColumn("frame_idx", F.regexp_extract("filename", pattern, 1).cast("bigint"))


def catalog_frames(files: DataFrame, pattern: str = FRAME_PATTERN, group: list[str] | None = None) -> DataFrame:
    """Count, first and last frame number per group, and whether the frames are usable."""
    group = group or []
    out = frame_numbers(files, pattern).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_files"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame")
    )
    status = F.when(F.col("n_files") == 0, F.lit("none")).when(F.col("first_frame") != 0, F.lit("no frame 0"))
    status = status.when(F.col("n_files") - 1 == F.col("last_frame") - F.col("first_frame"), F.lit("ok")).otherwise(F.lit("gap"))
    return out.withColumn("status", status)


def missing_frames(files: DataFrame, pattern: str = FRAME_PATTERN) -> DataFrame:
    """Frame numbers below the last one that no file has: each file looks at the next number present."""
    have = frame_numbers(files, pattern).select("frame_idx").distinct()
    last = have.agg(F.max("frame_idx")).first()[0]
    if last is None:
        return have
    return files.sparkSession.range(0, last + 1).withColumnRenamed("id", "frame_idx").join(have, "frame_idx", "left_anti")


def classify_media(files: DataFrame) -> DataFrame:
    """Kind by lower-cased last extension; frame count, rate and duration of videos.

    Optional columns nb_frames, duration, fps_num, fps_den come from a prober.
    """
    ext = F.lower(F.element_at(F.split("filename", r"\."), -1))
    out = files.withColumn("ext", ext)
    kind = F.when(F.col("ext").isin(*IMAGE_EXT), F.lit("image")).when(F.col("ext").isin(*VIDEO_EXT), F.lit("video")).otherwise(F.lit("other"))
    out = out.withColumn("kind", kind)
    if "nb_frames" not in files.columns:
        return out
    known = (F.coalesce("fps_num", F.lit(0)) > 0) & (F.coalesce("fps_den", F.lit(0)) > 0)
    out = out.withColumn("fps", F.when(known, F.try_divide(F.col("fps_num").cast("double"), F.col("fps_den"))).otherwise(F.lit(30.0)))
    guess = F.when(F.col("duration") > 0, F.floor(F.col("duration") * F.col("fps") + 0.5))
    out = out.withColumn("frames", F.when(F.col("nb_frames") > 0, F.col("nb_frames")).otherwise(guess).cast("bigint"))
    return out.withColumn("seconds", F.when(F.col("frames") > 0, F.col("frames") / F.col("fps")).otherwise(F.lit(-1.0)))


def time_to_frame(seconds, rate):
    """Frame shown at a media time."""
    return F.floor(F.lit(0.5) + seconds * rate).cast("bigint")


def read_image_pixels(spark: SparkSession, glob: str, rows_per_batch: int = 64) -> DataFrame:
    """Pixels of image files as fractions (path, y, x, b, g, r, a); images without alpha are opaque.

    A file that can't be decoded is an error, as is one that isn't 8 bits deep.
    """
    img = spark.read.format("image").option("dropInvalid", False).load(glob).select("image.*")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.height <= 0:
                    raise ValueError(f"{row.origin} is no image that can be decoded")
                if len(row.data) != row.height * row.width * row.nChannels:
                    raise ValueError(f"{row.origin} is not 8 bits deep")
                px = np.frombuffer(row.data, "u1").reshape(row.height, row.width, row.nChannels).astype("f8") / 255.0
                for top in range(0, row.height, rows_per_batch):
                    band = px[top : top + rows_per_batch]
                    yy, xx = np.mgrid[top : top + len(band), 0 : row.width]
                    b, g, r = (band[..., min(c, row.nChannels - 1)].ravel() for c in range(3))
                    a = band[..., 3].ravel() if row.nChannels == 4 else np.ones(b.size)
                    yield pd.DataFrame({"path": row.origin, "y": yy.ravel(), "x": xx.ravel(), "b": b, "g": g, "r": r, "a": a})

    return img.mapInPandas(split, "path string, y bigint, x bigint, b double, g double, r double, a double")
