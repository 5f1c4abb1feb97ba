"""Warp tables: where each output pixel reads from, for ten mappings; applying and composing them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetab.functions import geom
from scenetab.functions.columns import settle
from scenetab.operators.points import bilinear_corners, rectified_ray, sample_bilinear

OUTSIDE, OUTSIDE_VR = (-123.0, -456.0), (-1.0, -1.0)
FUDGE = 1.1


def ftheta_camera(size: int) -> dict[str, float]:
    """An ideal f-theta lens of a square picture."""
    return {"radius_at_90": size / 2.0, "cx": size / 2.0, "cy": size / 2.0, "k1": 0.0, "tilt": 0.0, "width": size, "height": size}


def _fixed(values: dict[str, float]) -> geom.Getter:
    return lambda name: F.lit(values[name])


def camera_grid(cams: DataFrame, width: int, height: int) -> DataFrame:
    """One row per camera and output pixel."""
    rows = cams.withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(height - 1).cast("bigint"))))
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint"))))


def _scaled(cam: geom.Getter, scale: float) -> geom.Getter:
    return lambda n: cam(n) * F.lit(scale) if n == "radius_at_90" else cam(n)


def _fisheye_ray(df: DataFrame, cam: geom.Getter) -> DataFrame:
    """Add the fisheye ray of (x, y), whichever model the camera row names."""
    as_fisheye = lambda n: F.lit("equiangular") if n == "cam_model" else cam(n)
    return geom.with_ray(df, as_fisheye, F.col("x").cast("double"), F.col("y").cast("double"), ("_fa", "_fb", "_fz"), ())


def _fisheye_pixel(df: DataFrame, cam: geom.Getter, xyz: tuple[str, str, str]) -> DataFrame:
    as_fisheye = lambda n: F.lit("equiangular") if n == "cam_model" else cam(n)
    return geom.with_pixel(df, as_fisheye, xyz)


def _through_pose(df: DataFrame, ray: tuple[Column, Column, Column]) -> DataFrame:
    """Pixel of a world ray in the row's fisheye camera."""
    out = df.withColumns(dict(zip(("_wx", "_wy", "_wz"), ray)))
    xc, yc, zc = geom.to_cam(geom.flat(), F.col("_wx"), F.col("_wy"), F.col("_wz"))
    out = settle(out.withColumns({"xc": xc, "yc": yc, "zc": zc}), ["xc", "yc", "zc"])
    return _fisheye_pixel(out, geom.flat(), ("xc", "yc", "zc")).drop("_wx", "_wy", "_wz", "xc", "yc", "zc")


def _x() -> Column:
    return F.col("x").cast("double")


def _y() -> Column:
    return F.col("y").cast("double")


def _fisheye_to_rectified(g: DataFrame, w: int, h: int, **_) -> DataFrame:
    return _through_pose(g, rectified_ray(_x(), _y(), w, h))


def _rectified_to_fisheye(g: DataFrame, w: int, h: int, rect_width: int, rect_height: int, scale: float = 1.0, **_) -> DataFrame:
    cam = _scaled(geom.flat(), scale)
    g = _fisheye_ray(g, cam)
    px, py, pz = geom.to_world(geom.flat(), F.col("_fa"), F.col("_fb"), F.col("_fz"))
    g = g.withColumns({"_px": px, "_py": py, "_pz": pz})
    psi = F.atan2(F.col("_px"), geom.norm(F.col("_pz"), F.col("_py")))
    beta = F.atan2(F.col("_pz"), F.col("_py"))
    far = geom.norm(_x() - cam("cx"), _y() - cam("cy")) > cam("radius_at_90") * FUDGE
    u = F.when(far, F.lit(OUTSIDE[0])).otherwise(psi * rect_width / F.lit(math.pi) + rect_width / 2.0)
    v = F.when(far, F.lit(OUTSIDE[1])).otherwise(beta * rect_height / F.lit(math.pi))
    return g.withColumns({"u": u, "v": v})


def _fisheye_to_fisheye(g: DataFrame, w: int, h: int, dest: dict, scale: float = 1.0, **_) -> DataFrame:
    cam = _scaled(_fixed(dest), scale)
    g = _through_pose(_fisheye_ray(g, cam), (F.col("_fa"), F.col("_fb"), F.col("_fz")))
    far = geom.norm(_x() - cam("cx"), _y() - cam("cy")) > cam("radius_at_90") * FUDGE
    return g.withColumns({c: F.when(far, F.lit(o)).otherwise(F.col(c)) for c, o in zip("uv", OUTSIDE)})


def _fisheye_to_inflated(g: DataFrame, w: int, h: int, dest: dict, exponent: float = 3.0, **_) -> DataFrame:
    return _through_pose(g, geom.ray_inflated(_fixed(dest), _x(), _y(), exponent))


def _fisheye_to_equirect(full: bool):
    def build(g: DataFrame, w: int, h: int, **_) -> DataFrame:
        turn, start = (-2.0 * math.pi, -math.pi / 2) if full else (-math.pi, math.pi)
        lon = F.lit(turn) * _x() / float(w) + F.lit(start)
        lat = F.lit(math.pi) * (_y() / float(h) - 0.5)
        return _through_pose(g, (F.cos(lat) * F.cos(lon), -F.sin(lat), F.cos(lat) * F.sin(lon)))

    return build


def _vr180_to_ftheta(g: DataFrame, w: int, h: int, eqr_size: int, scale: float = 1.0, **_) -> DataFrame:
    g = _fisheye_ray(g, _scaled(_fixed(ftheta_camera(w)), scale))
    dx, dy = F.col("x") - w // 2, F.col("y") - w // 2
    rmax = scale * w / 2.0
    far = dx * dx + dy * dy > rmax * rmax
    a, b, c = F.col("_fz"), F.col("_fa"), -F.col("_fb")
    u = 0.5 + F.atan2(b, a) / F.lit(math.pi)
    v = 0.5 + F.atan2(c, geom.norm(a, b)) / F.lit(math.pi)
    return g.withColumns({n: F.when(far, F.lit(o)).otherwise(e * float(eqr_size)) for n, e, o in zip("uv", (u, v), OUTSIDE_VR)})


def _fisheye_to_pinhole(g: DataFrame, w: int, h: int, focal_multiplier: float = 0.5, **_) -> DataFrame:
    f = focal_multiplier * w
    g = g.withColumns({"_p": (_x() - w // 2) / f, "_q": -(_y() - h // 2) / f})
    n = geom.norm(F.col("_p"), F.col("_q"), F.lit(1.0))
    g = g.withColumns({"_fa": F.col("_p") / n, "_fb": F.col("_q") / n, "_fz": 1.0 / n})
    return _fisheye_pixel(g, geom.flat(), ("_fa", "_fb", "_fz"))


def _primary_to_ldi(g: DataFrame, w: int, h: int, dest: dict, **_) -> DataFrame:
    g = g.withColumns(dict(zip(("_fa", "_fb", "_fz"), geom.ray_inflated(_fixed(dest), _x(), _y()))))
    return _fisheye_pixel(g, geom.flat(), ("_fa", "_fb", "_fz"))


def _pinhole_radial(g: DataFrame, w: int, h: int, focal_multiplier: float = 1.0, **_) -> DataFrame:
    """Older rectification: k1 and k2 act on the angle."""
    g = g.withColumns({"_p": (_x() - w // 2) / (F.col("fx") * focal_multiplier), "_q": (_y() - h // 2) / (F.col("fy") * focal_multiplier)})
    r = geom.norm(F.col("_p"), F.col("_q"))
    g = g.withColumn("_r", r).withColumn("_t", F.atan2(F.col("_r"), F.lit(1.0)))
    t2 = F.col("_t") * F.col("_t")
    k = F.when(F.col("_r") == 0, F.lit(1.0)).otherwise(geom.div(F.col("_t"), F.col("_r"))) * (1.0 + t2 * (F.col("k1") + t2 * F.col("k2")))
    return g.withColumns({"u": F.col("_p") * k * F.col("fx") + F.col("cx"), "v": F.col("_q") * k * F.col("fy") + F.col("cy")})


KINDS: dict[str, Callable[..., DataFrame]] = {
    "fisheye_to_rectified": _fisheye_to_rectified,
    "rectified_to_fisheye": _rectified_to_fisheye,
    "fisheye_to_fisheye": _fisheye_to_fisheye,
    "fisheye_to_inflated": _fisheye_to_inflated,
    "fisheye_to_equirect180": _fisheye_to_equirect(False),
    "fisheye_to_equirect360": _fisheye_to_equirect(True),
    "vr180_to_ftheta": _vr180_to_ftheta,
    "fisheye_to_pinhole": _fisheye_to_pinhole,
    "primary_to_ldi": _primary_to_ldi,
    "pinhole_radial": _pinhole_radial,
}


def build_warp(cams: DataFrame, kind: str, width: int, height: int, keys: tuple[str, ...] = ("cam_idx",), **opts) -> DataFrame:
    """(keys, y, x, u, v): where output pixel (y, x) reads, for every camera of the table."""
    out = KINDS[kind](camera_grid(cams, width, height), width, height, **opts)
    return out.select(*keys, "y", "x", "u", "v")


def apply_warp(pixels: DataFrame, warp: DataFrame, image: str, values: list[str], mode: str = "linear") -> DataFrame:
    """Gather through a warp keyed by ``image``; reads outside the picture give 0."""
    keys = [image, "y", "x"]
    if mode == "nearest":
        at = warp.select(*keys, F.floor(F.col("v") + 0.5).alias("_y"), F.floor(F.col("u") + 0.5).alias("_x"))
        src = pixels.select(image, F.col("y").alias("_y"), F.col("x").alias("_x"), *values)
        return at.join(src, [image, "_y", "_x"], "left").select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in values])
    corners = warp.select(*keys, F.explode(bilinear_corners(F.col("u"), F.col("v"))).alias("_k"))
    corners = corners.select(*keys, F.col("_k.y").alias("_y"), F.col("_k.x").alias("_x"), F.col("_k.w").alias("_w"))
    src = pixels.select(image, F.col("y").alias("_y"), F.col("x").alias("_x"), *values)
    hit = corners.join(src, [image, "_y", "_x"], "left")
    return hit.groupBy(*keys).agg(*[F.coalesce(F.sum(F.col("_w") * F.col(c)), F.lit(0.0)).alias(c) for c in values])


def compose_warps(first: DataFrame, second: DataFrame, image: str, width: int, height: int) -> DataFrame:
    """Read the second warp's u, v at the first, borders repeated: one warp instead of two passes over the frames."""
    q = first.select(image, F.col("y").alias("_oy"), F.col("x").alias("_ox"), "u", "v")
    values = second.withColumnsRenamed({"u": "u2", "v": "v2"})
    out = sample_bilinear(q, values, [image, "_oy", "_ox"], image, ["u2", "v2"], F.lit(width), F.lit(height))
    return out.withColumnsRenamed({"_oy": "y", "_ox": "x", "u2": "u", "v2": "v"})


def stereo_error(flow: DataFrame, width: int, height: int, bias: float = 0.0, image: str = "frame_idx") -> DataFrame:
    """Clamped disparities of both eyes and their error from vertical flow and left-right consistency.

    ``flow`` has right and left flow (rfx, rfy, lfx, lfy) per pixel.
    """
    keys = [image, "y", "x"]
    d = flow.select(
        *keys, F.greatest(F.lit(0.0), F.col("rfx") + bias).alias("r_disp"), F.greatest(F.lit(0.0), -F.col("lfx") + bias).alias("l_disp"),
        (F.abs("rfy") * (30.0 / height)).alias("_rv"), (F.abs("lfy") * (30.0 / height)).alias("_lv"),
    )
    at = lambda e: d.select(*keys, e.alias("u"), F.col("y").cast("double").alias("v"))
    seen_r = apply_warp(d, at(F.col("x") + F.col("r_disp")), image, ["l_disp"]).withColumnRenamed("l_disp", "_r")
    seen_l = apply_warp(d, at(F.col("x") - F.col("l_disp")), image, ["r_disp"]).withColumnRenamed("r_disp", "_l")
    j = d.join(seen_r, keys).join(seen_l, keys)
    err = lambda v, a, b: geom.clamp(F.col(v) + F.abs(F.col(a) - F.col(b)) * (100.0 / width), 0.0, 1.0)
    return j.select(*keys, "r_disp", "l_disp", err("_rv", "_r", "r_disp").alias("r_error"), err("_lv", "_l", "l_disp").alias("l_error"))
