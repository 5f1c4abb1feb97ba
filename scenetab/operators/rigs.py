"""Pairing rows with the cameras of their scene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetab.functions import geom
from scenetab.functions.columns import settle
from scenetab.functions.session import BROADCAST_ROWS

CAMS_PER_ROW = 64


def rig_table(cams: DataFrame, scene: str = "scene_id") -> tuple[DataFrame, bool]:
    """Cameras packed into arrays of at most 64 per row, and whether each scene fits one row.

    Cameras are numbered inside their scene, so rows are full and bounded whatever the number of cameras and however their
    indices are strewn over the scenes.
    """
    cols = ["cam_idx", *[c for c in cams.columns if c not in (scene, "cam_idx")]]
    packed = (
        cams.withColumn("_chunk", F.floor((F.row_number().over(Window.partitionBy(scene).orderBy("cam_idx")) - 1) / F.lit(CAMS_PER_ROW)))
        .groupBy(scene, "_chunk")
        .agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("rig"))
        .drop("_chunk")
    )
    rows, scenes = packed.agg(F.count(F.lit(1)), F.countDistinct(scene)).first()
    return (F.broadcast(packed) if rows * CAMS_PER_ROW <= BROADCAST_ROWS else packed), rows == scenes


def per_camera(df: DataFrame, cams: DataFrame, scene: str = "scene_id") -> DataFrame:
    """One row per (row, camera of its scene); camera fields in struct ``cam``."""
    rig, _ = rig_table(cams, scene)
    return df.join(rig, scene).withColumn("cam", F.explode("rig")).drop("rig")


def over_rig(
    df: DataFrame, cams: DataFrame, value: Column, combine, scene: str = "scene_id"
) -> DataFrame:
    """Add ``value``, an expression over the array column ``rig``, without one row per camera.

    Only when a scene spans several packed rows are the partial values combined with an aggregate. It groups by whole rows
    that were counted before, on the same columns, so repeated rows stay repeated in either case and the second
    aggregate needs no shuffle of its own behind a broadcast. Rows whose scene has no camera keep a null value.
    """
    rig, single = rig_table(cams, scene)
    rows = df if single else df.groupBy(*df.columns).agg(F.count(F.lit(1)).cast("int").alias("_times"))
    part = settle(rows.join(rig, scene, "left").withColumn("value", value).drop("rig"), ["value"])
    if single:
        return part
    whole = part.groupBy(*df.columns, "_times").agg(combine(F.col("value")).alias("value"))
    return whole.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).select(*df.columns, "value")


def in_cam(c: Column, x: str = "x", y: str = "y", z: str = "z") -> tuple[Column, Column, Column]:
    return geom.to_cam(geom.field(c), F.col(x), F.col(y), F.col(z))
