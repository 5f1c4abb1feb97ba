"""Point clouds and cameras: projection, lifting, colouring, filtering, neighbour spacing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenetab.functions import geom
from scenetab.functions.columns import settle
from scenetab.functions.hashing import hash01
from scenetab.functions.ranks import exact_rank, take_smallest
from scenetab.functions.session import broadcast_if_small, cut_lineage
from scenetab.operators.rigs import CAMS_PER_ROW, in_cam, over_rig, per_camera

CAM_FIELDS = ["cam_idx", "width", "height"]


def sample_points(points: DataFrame, fraction: float, seed: int, key: str = "point_id") -> DataFrame:
    """Bernoulli sample; a fraction of 1 keeps everything."""
    return points.where(hash01(key, seed) <= fraction)


def sample_exact(points: DataFrame, n: int, seed: int, key: str = "point_id") -> DataFrame:
    """Exactly n rows without replacement, or all when there are no more than n."""
    return take_smallest(points.withColumn("_draw", hash01(key, seed)), "_draw", key, n).drop("_draw")


def split_exact(ids: DataFrame, n: int, m: int, seed: int, key: str = "point_id") -> DataFrame:
    """Random split into two sets of exactly n and m rows; an error unless n + m rows exist."""
    total = ids.count()
    if n + m != total:
        raise ValueError(f"split sizes {n} + {m} do not add up to {total} rows")
    drawn = ids.withColumn("_draw", hash01(key, seed))
    first = take_smallest(drawn, "_draw", key, n).select(key, F.lit("first").alias("part"))
    return ids.join(first, key, "left").withColumn("part", F.coalesce("part", F.lit("second")))


def clamp_to_ball(points: DataFrame, radius: float = geom.Z_FAR) -> DataFrame:
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    n = geom.norm(x, y, z)
    k = F.when(n > radius, geom.div(F.lit(radius), n)).otherwise(F.lit(1.0))
    return points.withColumns({"x": x * k, "y": y * k, "z": z * k})


def _cell(c: Column, side: float) -> Column:
    return F.floor(c / F.lit(side)).cast("bigint")


def _around(side: float, cols: tuple[Column, ...], names: tuple[str, ...], reach: int = 1):
    """Explode helpers: the cell of each coordinate and its neighbours up to ``reach``."""
    offs = F.array(*[F.lit(i).cast("bigint") for i in range(-reach, reach + 1)])


    def cells(c: Column) -> Column:
        return F.transform(offs, lambda o: _cell(c, side) + o)

    return {n: cells(c) for n, c in zip(names, cols)}


def drop_near_cameras(
    points: DataFrame, cams: DataFrame, z_near: float = geom.Z_NEAR, scene: str = "scene_id"
) -> DataFrame:
    """Remove points closer than ``z_near`` to any camera of their scene: an anti equi join on grid cells."""
    cells = ("_gx", "_gy", "_gz")
    px, py, pz = geom.position(geom.flat())
    near = cams.select(F.col(scene), px.alias("_px"), py.alias("_py"), pz.alias("_pz"))
    around = _around(z_near, (F.col("_px"), F.col("_py"), F.col("_pz")), cells)
    for name, arr in around.items():
        near = near.withColumn(name, F.explode(arr))
    near = broadcast_if_small(near)
    src = points.withColumns({n: _cell(F.col(c), z_near) for n, c in zip(cells, "xyz")})
    a, b = src.alias("a"), near.alias("b")
    dist = geom.norm(*[F.col(f"a.{c}") - F.col(f"b._p{c}") for c in "xyz"])
    cond = (F.col(f"a.{scene}") == F.col(f"b.{scene}")) & (dist < z_near)
    for n in cells:
        cond = cond & (F.col(f"a.{n}") == F.col(f"b.{n}"))
    return a.join(b, cond, "left_anti").drop(*cells)


def project_points(points: DataFrame, cams: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Every point in every camera of its scene: camera-space xc, yc, zc and pixel u, v."""
    pairs = per_camera(points, cams, scene)
    xc, yc, zc = in_cam(F.col("cam"))
    pairs = settle(pairs.withColumns({"xc": xc, "yc": yc, "zc": zc}), ["xc", "yc", "zc"])
    pairs = geom.with_pixel(pairs, geom.field(F.col("cam")))
    return pairs.select("*", *[F.col(f"cam.{c}").alias(c) for c in CAM_FIELDS]).drop("cam")


def in_image(u: Column, v: Column, width: Column, height: Column, border: int = 1) -> Column:
    return (u >= 0) & (v >= 0) & (u < width - border) & (v < height - border)


def _rig_pixels() -> Column:
    return geom.rig_pixels(F.col("rig"), F.col("x"), F.col("y"), F.col("z"))


def visibility_count(points: DataFrame, cams: DataFrame, key: list[str], scene: str = "scene_id") -> DataFrame:
    """In how many cameras of its scene each point lies (not behind, truncated pixel inside the image)."""

    def sees(c: Column) -> Column:
        z, u, v, w, h = (c.getField(n) for n in "zuvwh")
        return (z >= 0) & (u >= 0) & (v >= 0) & (u < w) & (v < h)

    value = F.size(F.filter(_rig_pixels(), sees))
    out = over_rig(points, cams, F.coalesce(value, F.lit(0)), F.sum, scene)
    return out.withColumnRenamed("value", "visible_in").withColumn("visible_in", F.col("visible_in").cast("bigint"))


# cameras of a scene in the first round and at most in one round, and positions that meet them in one group
FIRST_CAMS, MOST_CAMS, GROUP = 1 << 10, 1 << 16, 1 << 14
_SEEN_BY = [*geom.POSE, "width", "height", "fx", "fy", "cx", "cy"]


def _watched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Positions of ``left`` that no camera of ``right`` has too near; ``wide`` is set for those that one sees."""
    at = [left[c].to_numpy("f8") for c in "xyz"]
    wide, rest = left["wide"].to_numpy(bool, copy=True), np.arange(len(left))
    cams = {c: right[f"_{c}"].to_numpy("f8") for c in _SEEN_BY}

    def turned(i: int, cam: dict, rows: np.ndarray) -> np.ndarray:
        x, y, z = (v[rows, None] for v in at)
        return cam[f"r{i}0"] * x + cam[f"r{i}1"] * y + cam[f"r{i}2"] * z + cam[f"t{i}"]

    with np.errstate(all="ignore"):
        for lo in range(0, len(right), CAMS_PER_ROW):
            cam = {c: v[lo : lo + CAMS_PER_ROW] for c, v in cams.items()}
            z = turned(2, cam, rest)
            free = ~((z > 0) & (z < 0.01)).any(axis=1)
            rest, z = rest[free], z[free]
            new = ~wide[rest]
            if new.any():
                rows, z = rest[new], z[new]
                u = turned(0, cam, rows) / z * cam["fx"] + cam["cx"]
                v = -turned(1, cam, rows) / z * cam["fy"] + cam["cy"]
                w, h = cam["width"], cam["height"]
                wide[rows] = ((z > geom.Z_NEAR) & (u >= -w) & (u < w * 2.0) & (v >= -h) & (v < h * 2.0)).any(axis=1)
            if not len(rest):
                break
    return left.assign(wide=wide).iloc[rest]


def _visible_positions(splats: DataFrame, cams: DataFrame, scene: str) -> DataFrame:
    """Distinct (scene, x, y, z) that are visible, for scenes of many cameras.

    Cameras are tried in rounds of growing number, and a position goes on only while none has it too near. In a round, positions
    of a scene are dealt to groups of some ``GROUP``, each of which meets the round's cameras of its scene.
    """
    order = F.row_number().over(Window.partitionBy(scene).orderBy("cam_idx")) - 1
    rig = cut_lineage(cams.where(F.col(scene).isNotNull()).select(scene, *[F.col(c).cast("double").alias(f"_{c}") for c in _SEEN_BY], order.alias("_n")))
    have = rig.groupBy(scene).agg(F.count(F.lit(1)).alias("_cams"))
    top = have.agg(F.max("_cams")).first()[0] or 0
    # a position with a missing coordinate or camera is never visible
    pos = splats.select(scene, "x", "y", "z").where(" AND ".join(f"{c} IS NOT NULL" for c in "xyz")).distinct()
    pos = cut_lineage(pos.join(broadcast_if_small(have), scene).withColumn("wide", F.lit(False)))
    seen, lo, width = pos.limit(0), 0, FIRST_CAMS
    while lo < top:
        groups = broadcast_if_small(pos.groupBy(scene).agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("_parts")))
        dealt = pos.join(groups, scene).withColumn("_part", F.pmod(F.xxhash64("x", "y", "z"), F.col("_parts")).cast("int")).drop("_parts")
        some = rig.where(F.col("_n").between(lo, lo + width - 1)).join(groups, scene)
        some = some.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        out = T.StructType([f for f in dealt.schema if f.name != "_part"])
        met = dealt.groupBy(scene, "_part").cogroup(some.groupBy(scene, "_part"))
        left = cut_lineage(met.applyInPandas(lambda a, b: _watched(a, b).drop(columns="_part"), out))
        lo, width = lo + width, min(width * 4, MOST_CAMS)
        seen = seen.unionByName(left.where("wide").where(F.col("_cams") <= lo))
        pos = left.where(F.col("_cams") > lo)
        if lo < top and pos.isEmpty():
            break
    return seen.select(scene, "x", "y", "z")


def visible_to_any(splats: DataFrame, cams: DataFrame, key: list[str], scene: str = "scene_id") -> DataFrame:
    """Splat rule: some rectilinear camera sees it within one image size of margin, none has it nearer than 0.01.

    Scenes of at most 64 cameras are answered on the packed array. Otherwise cameras are tried in rounds, since the rows times the
    cameras of a large scene are too many: most positions are settled by the first cameras that have them too near.
    """
    if (cams.groupBy(scene).count().agg(F.max("count")).first()[0] or 0) > CAMS_PER_ROW:
        found = _visible_positions(splats, cams, scene).withColumn("visible", F.lit(True)).hint("merge")
        out = splats.join(found, [scene, "x", "y", "z"], "left")
        return out.select(*splats.columns, F.coalesce("visible", F.lit(False)).alias("visible"))

    def wide(c: Column) -> Column:
        xc, yc, zc = in_cam(c)
        u, v = geom.PROJECTORS["rectilinear"](geom.field(c), xc, yc, zc)
        w, h = c.getField("width"), c.getField("height")
        return (zc > geom.Z_NEAR) & (u >= -w) & (u < w * 2.0) & (v >= -h) & (v < h * 2.0)

    def close(c: Column) -> Column:
        z = in_cam(c)[2]
        return (z > 0) & (z < 0.01)

    both = F.struct(
        F.coalesce(F.exists("rig", wide), F.lit(False)).alias("w"),
        F.coalesce(F.exists("rig", close), F.lit(False)).alias("c"),
    )
    merge = lambda c: F.struct(F.bool_or(c.getField("w")).alias("w"), F.bool_or(c.getField("c")).alias("c"))
    out = over_rig(splats, cams, both, merge, scene)
    return out.withColumn("visible", F.col("value.w") & ~F.col("value.c")).drop("value")


def points_per_camera(points: DataFrame, cams: DataFrame) -> DataFrame:
    """Points inside each image and their mean depth."""
    seen = project_points(points, cams).where(
        (F.col("zc") >= geom.Z_NEAR) & in_image(F.col("u"), F.col("v"), F.col("width"), F.col("height"))
    )
    return seen.groupBy("cam_idx").agg(F.count(F.lit(1)).alias("n_points"), F.avg("zc").alias("mean_depth"))


def bilinear_corners(u: Column, v: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """Array of (y, x, w): the corners with a weight, clamped to the border where a size is given."""
    x0, y0 = F.floor(u), F.floor(v)
    fx, fy = u - x0, v - y0
    corners = F.array(
        *[
            F.struct(
                (y0 + j).cast("bigint").alias("y"),
                (x0 + i).cast("bigint").alias("x"),
                ((fx if i else 1.0 - fx) * (fy if j else 1.0 - fy)).alias("w"),
            )
            for j in (0, 1)
            for i in (0, 1)
        ]
    )
    used = F.filter(corners, lambda c: c.getField("w") > 0)
    if width is None:
        return used
    hold = lambda c, n: F.greatest(F.least(c, n.cast("bigint") - 1), F.lit(0).cast("bigint"))
    return F.transform(
        used,
        lambda c: F.struct(
            hold(c.getField("y"), height).alias("y"), hold(c.getField("x"), width).alias("x"), c.getField("w").alias("w")
        ),
    )


def sample_bilinear(
    queries: DataFrame, pixels: DataFrame, key: list[str], image: str, values: list[str],
    width: Column, height: Column, u: str = "u", v: str = "v",
) -> DataFrame:
    """Interpolated pixel values at (u, v) per query; corners beyond the border repeat the border pixel.

    Each query becomes at most four rows of (image, y, x), joined once and summed back by ``key``.
    """
    corners = queries.select(
        *key, image, F.explode(bilinear_corners(F.col(u), F.col(v), width, height)).alias("_k")
    ).select(*key, image, F.col("_k.y").alias("y"), F.col("_k.x").alias("x"), F.col("_k.w").alias("_w"))
    hit = corners.join(pixels.select(image, "y", "x", *values), [image, "y", "x"])
    return hit.groupBy(*key).agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in values])


def color_points(points: DataFrame, cams: DataFrame, pixels: DataFrame, key: list[str], scene: str = "scene_id") -> DataFrame:
    """Colour from the first camera by index that sees the point; points no camera sees are dropped.

    ``pixels`` is keyed by ``cam_idx`` and holds b, g, r.
    """

    def view(c: Column) -> Column:
        z, u, v, w, h = (c.getField(n) for n in "zuvwh")
        hit = (z >= geom.Z_NEAR) & in_image(u, v, w, h)
        return F.when(
            hit, F.struct(c.getField("cam_idx").alias("cam_idx"), u.alias("u"), v.alias("v"), w.alias("w"), h.alias("h"))
        )

    first = F.get(F.filter(F.transform(_rig_pixels(), view), lambda s: s.isNotNull()), 0)
    seen = over_rig(points, cams, first, F.min, scene).where(F.col("value").isNotNull())
    where = seen.select(*key, "value.*")
    colors = sample_bilinear(where, pixels, key, "cam_idx", ["b", "g", "r"], F.col("w"), F.col("h"))
    return points.drop("r", "g", "b").join(colors, key)


def unproject(obs: DataFrame, cams: DataFrame, depth: str = "depth", cam_key: list[str] | None = None) -> DataFrame:
    """Pixel (u, v) with camera-space z ``depth`` to a world point."""
    joined = obs.join(broadcast_if_small(cams), cam_key or ["cam_idx"])
    cam = geom.flat()
    joined = geom.with_ray(joined, cam, F.col("u"), F.col("v"))
    d = F.col(depth)
    wx, wy, wz = geom.to_world(
        cam, geom.div(F.col("_rx") * d, F.col("_rz")), geom.div(F.col("_ry") * d, F.col("_rz")), d
    )
    keep = [*obs.columns]
    return joined.select(*keep, wx.alias("x"), wy.alias("y"), wz.alias("z"))


def lift_tracks(obs: DataFrame, cams: DataFrame, radius: float = geom.Z_FAR) -> DataFrame:
    """First guess of a track's point: its first observation by image index, lifted by its depth, far points clamped."""
    first = obs.groupBy("track_id").agg(F.min_by(F.struct("cam_idx", "u", "v", "depth"), "cam_idx").alias("o"))
    lifted = unproject(first.select("track_id", "o.*"), cams)
    return clamp_to_ball(lifted, radius)


# neighbour spacing: fixed values of the rule
SPACING_LO, SPACING_HI = 0.003, 0.1
SPACING_RADII = (0.005, 0.03, 0.08, 0.3)
DENSE_CELL = 0.0025
# a cell with more than this share of all candidates is cut into parts
SPLIT = 256


def split_cells(cand: DataFrame, probe: DataFrame, cells: list[str], key: str, total: int, narrow: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``cells`` with one more key ``_part``, so that no key holds more than some total / SPLIT candidates.

    Candidates of a large cell are dealt to its parts, searching rows are copied to each. Only cells with searching rows are kept, unless
    ``narrow`` is off, which spares the shuffles that find them. There are fewer than SPLIT large cells, so they are broadcast. The
    sides are to be joined with the hint ``merge``: Spark guesses the size of exploded rows far too small.
    """
    if narrow:
        cand = cand.join(probe.select(*cells).distinct().hint("merge"), cells, "left_semi")
    sizes = cand.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * SPLIT > F.lit(total))
    large = F.broadcast(cut_lineage(sizes.select(*cells, F.ceil(F.col("_n") * SPLIT / F.lit(max(total, 1))).cast("int").alias("_parts"))))
    parts = F.coalesce("_parts", F.lit(1))
    cand = cand.join(large, cells, "left").withColumn("_part", F.pmod(F.xxhash64(key), parts).cast("int")).drop("_parts")
    return cand, probe.join(large, cells, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")


def knn_spacing(points: DataFrame, scope: list[str], key: str = "point_id") -> DataFrame:
    """(d1 + d2) / 3 over the two nearest other points of the same scope, clamped to [0.003, 0.1]; exact.

    The clamp makes two short cuts exact. Three points in a cell of side 0.0025 are all at the lower bound, so dense
    clumps and piles of copies are settled by a count. And a neighbour beyond 0.3 puts the result at the upper bound.
    What is left is searched with growing radii; a point goes on to the next radius only while fewer than two others
    are near, so each cell holds few searching points and the join grows with the cloud, not with its square. Cells are two
    radii wide, so a search touches eight of them at most. A cell that holds much of the cloud, such as a clump beside a stray, is
    searched in parts, and the two nearest of each part are merged. No side is broadcast but the few large cells.
    """
    cells = ("_gx", "_gy", "_gz")
    xyz = tuple(F.col(c) for c in "xyz")
    fine = [_cell(c, DENSE_CELL).alias(n) for c, n in zip(xyz, cells)]
    pos = points.select(*scope, key, "x", "y", "z")
    counts = pos.select(*scope, *fine).groupBy(*scope, *cells).agg(F.count(F.lit(1)).alias("_n"))
    crowded = counts.where(F.col("_n") >= 3).select(*scope, *cells).hint("merge")
    located = pos.withColumns({n: _cell(c, DENSE_CELL) for c, n in zip(xyz, cells)})
    done = located.join(crowded, [*scope, *cells], "left_semi").select(*scope, key, F.lit(SPACING_LO).alias("spacing"))
    todo = cut_lineage(located.join(crowded, [*scope, *cells], "left_anti").drop(*cells))
    total = pos.count()
    for radius in SPACING_RADII:
        probe, side = todo, 2 * radius
        for name, c in zip(cells, xyz):
            # a little more than the radius, as the ends are rounded
            probe = probe.withColumn(name, F.explode(F.sequence(_cell(c - radius * 1.001, side), _cell(c + radius * 1.001, side))))
        probe = probe.select(*scope, *cells, F.col(key).alias("_q"), *[c.alias(f"_q{n}") for c, n in zip(xyz, "xyz")])
        cand = pos.withColumns({n: _cell(c, side) for c, n in zip(xyz, cells)})
        d = geom.norm(*[F.col(c) - F.col(f"_q{c}") for c in "xyz"])
        cand, probe = split_cells(cand, probe, [*scope, *cells], key, total, narrow=False)
        near = (
            cand.join(probe.hint("merge"), [*scope, *cells, "_part"])
            .where(F.col(key) != F.col("_q"))
            .select(*scope, "_q", key, d.alias("_d"))
            .where(F.col("_d") <= radius)
        )
        # at most two rows of a point leave each part, as the limit is applied before the shuffle too
        w = Window.partitionBy(*scope, "_q").orderBy("_d", key)
        two = near.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
        sums = two.groupBy(*scope, "_q").agg(F.sum("_d").alias("_s"), F.count(F.lit(1)).alias("_n")).where("_n = 2")
        found = sums.select(
            *scope, F.col("_q").alias(key), geom.clamp(F.col("_s") / 3.0, SPACING_LO, SPACING_HI).alias("spacing")
        )
        tried = todo.join(found.hint("merge"), [*scope, key], "left")
        if radius == SPACING_RADII[-1]:
            return done.unionByName(tried.select(*scope, key, F.coalesce("spacing", F.lit(SPACING_HI)).alias("spacing")))
        tried = cut_lineage(tried)
        done = done.unionByName(tried.where("spacing IS NOT NULL").select(*scope, key, "spacing"))
        todo = tried.where("spacing IS NULL").drop("spacing")
        if todo.isEmpty():
            break
    return done


def rectified_ray(x: Column, y: Column, width: float, height: float) -> tuple[Column, Column, Column]:
    ax = F.lit(math.pi) * (x - width / 2.0) / F.lit(float(width))
    ay = F.lit(-math.pi) * (y - height / 2.0) / F.lit(float(height))
    return F.sin(ax), F.cos(ax) * F.sin(ay), F.cos(ax) * F.cos(ay)


def depth_to_points(pixels: DataFrame, size: int) -> DataFrame:
    """Opaque pixels of a rectified inverse-depth map as points, colours BGR to RGB."""
    rx, ry, rz = rectified_ray(F.col("x"), F.col("y"), size, size)
    inv = F.col("invd")
    return pixels.where(F.col("a") > 0.99).select(
        "frame_idx", F.col("y").alias("row"), F.col("x").alias("col"),
        geom.div(rx, inv).alias("px"), geom.div(ry, inv).alias("py"), geom.div(rz, inv).alias("pz"),
        F.col("r"), F.col("g"), F.col("b"),
    )


def sort_far_first(points: DataFrame, group: list[str], eye: tuple[float, float, float] = (0.0, 0.0, 0.0), key: str = "point_id") -> DataFrame:
    """Rank by descending distance from the eye inside each group, ties by id."""
    dist = geom.norm(*[F.col(c) - F.lit(e) for c, e in zip("xyz", eye)])
    return exact_rank(points.withColumn("dist", dist), group, "dist", key, out="draw_order", descending=True)


def append_points(a: DataFrame, b: DataFrame, key: str = "point_id") -> DataFrame:
    """Bag union; the ids of b continue after the largest id of a."""
    base = a.agg(F.coalesce(F.max(key), F.lit(-1)).alias("m")).first()["m"] + 1
    return a.unionByName(b.withColumn(key, F.col(key) + F.lit(base)))


def dense_points(samples: DataFrame, delta: float = 0.01, threshold: float = 0.02) -> DataFrame:
    """Field samples dense enough to be points; the opacity becomes alpha and colours turn from BGR to RGB."""
    alpha = F.lit(1.0) - F.exp(-F.col("sigma") * F.lit(delta))
    return samples.withColumn("alpha", alpha).where(F.col("alpha") > threshold).withColumns(
        {"r": F.col("b"), "b": F.col("r")}
    )


def epipolar_points(cams: DataFrame, u: float, v: float, step: float = 0.05, reach: float = 10.0, scene: str = "scene_id") -> DataFrame:
    """March along the first camera's ray through a pixel and project each step into the scene's other cameras."""
    first = cams.groupBy(scene).agg(F.min_by(F.struct(*cams.columns), "cam_idx").alias("c0"))
    cam0 = geom.field(F.col("c0"))
    ox, oy, oz = geom.position(cam0)
    wx, wy, wz = geom.rotate_to_world(cam0, F.col("_rx"), F.col("_ry"), F.col("_rz"))
    steps = int(round(reach / step))
    march = (
        geom.with_ray(first, cam0, F.lit(u), F.lit(v))
        .select(scene, F.col("c0.cam_idx").alias("from_cam"), ox.alias("ox"), oy.alias("oy"), oz.alias("oz"),
                wx.alias("dx"), wy.alias("dy"), wz.alias("dz"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    )
    t = F.col("step") * F.lit(step)
    march = march.select(scene, "from_cam", "step", *[(F.col(f"o{c}") + F.col(f"d{c}") * t).alias(c) for c in "xyz"])
    return project_points(march, cams, scene).where(F.col("cam_idx") != F.col("from_cam"))
