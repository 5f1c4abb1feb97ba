"""Queries over point clouds and cameras."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenetab.operators import points as P
from scenetab.plans import sqltext as S
from scenetab.plans.registry import Tables, query, rnd, rounded


def small_cams(t: Tables) -> DataFrame:
    """The rig with 20 x 20 images."""
    return t.cams.withColumns(
        {
            "width": F.lit(20), "height": F.lit(20), "fx": F.lit(12.0), "fy": F.lit(12.0),
            "cx": F.lit(10.0), "cy": F.lit(10.0), "radius_at_90": F.lit(9.0),
        }
    )


def cam_pixels(t: Tables) -> DataFrame:
    """Frames as the images of the cameras with the same index."""
    return t.pixels.withColumnRenamed("frame_idx", "cam_idx")


@query("points_per_camera", "points cams", f"""WITH {S.project('points')}
SELECT cam_idx, count(*) AS n_points, {rnd('mean_depth=avg(zc)')} FROM pj
WHERE zc >= 0.01 AND u >= 0 AND v >= 0 AND u < width - 1 AND v < height - 1 GROUP BY cam_idx""")
def _(t):
    return rounded(P.points_per_camera(t.points, t.cams))


@query("project_points", "points cams", f"""WITH {S.project('points')}
SELECT point_id, cam_idx, {rnd('zc; u; v', 4)} FROM pj""")
def _(t):
    return rounded(P.project_points(t.points, t.cams).select("point_id", "cam_idx", "zc", "u", "v"), 4)


@query("sample_points", "points", f"SELECT point_id, {rnd('x')} FROM points WHERE {S.h('point_id', 41)} <= 0.25")
def _(t):
    return rounded(P.sample_points(t.points, 0.25, 41).select("point_id", "x"))


@query("sample_exact", "points", f"SELECT point_id, {rnd('x')} FROM points ORDER BY {S.h('point_id', 42)}, point_id LIMIT 700")
def _(t):
    return rounded(P.sample_exact(t.points, 700, 42).select("point_id", "x"))


@query("split_exact", "points", f"""SELECT point_id, CASE WHEN row_number() OVER (ORDER BY {S.h('point_id', 43)}, point_id) <= 900
THEN 'first' ELSE 'second' END AS part FROM points""")
def _(t):
    pts = t.points.select("point_id")
    return P.split_exact(pts, 900, pts.count() - 900, 43)


@query("clamp_to_ball", "points", f"""WITH n AS (SELECT *, sqrt(x*x + y*y + z*z) AS n FROM points)
SELECT point_id, {rnd('x=CASE WHEN n > 3 THEN x * 3 / n ELSE x END; y=CASE WHEN n > 3 THEN y * 3 / n ELSE y END; z=CASE WHEN n > 3 THEN z * 3 / n ELSE z END')} FROM n""")
def _(t):
    return rounded(P.clamp_to_ball(t.points, 3.0).select("point_id", "x", "y", "z"))


@query("drop_near_cameras", "points views", f"""WITH v AS (SELECT *, -(r00*t0 + r10*t1 + r20*t2) AS px, -(r01*t0 + r11*t1 + r21*t2) AS py,
-(r02*t0 + r12*t1 + r22*t2) AS pz FROM views)
SELECT point_id, {rnd('x')} FROM points p WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.scene_id = p.scene_id
AND sqrt((p.x-v.px)**2 + (p.y-v.py)**2 + (p.z-v.pz)**2) < 0.25)""")
def _(t):
    return rounded(P.drop_near_cameras(t.points, t.views, 0.25).select("point_id", "x"))


@query("visibility_count", "points cams", f"""WITH {S.project('points')}
SELECT point_id, CAST(count(*) FILTER (WHERE zc >= 0 AND u >= 0 AND v >= 0 AND u < width AND v < height) AS BIGINT) AS visible_in
FROM pj GROUP BY point_id""")
def _(t):
    return P.visibility_count(t.points, t.cams, ["point_id"]).select("point_id", "visible_in")


@query("visible_to_any", "splats views", f"""WITH {S.project('splats', 'views')},
w AS (SELECT frame_idx, splat_idx, zc, fx*xc/zc + cx AS u, -fy*yc/zc + cy AS v, width, height FROM pj)
SELECT frame_idx, splat_idx, coalesce(bool_or(zc > 0.01 AND u >= -width AND u < 2*width AND v >= -height AND v < 2*height), false)
AND NOT bool_or(zc > 0 AND zc < 0.01) AS visible FROM w GROUP BY frame_idx, splat_idx""")
def _(t):
    return P.visible_to_any(t.splats, t.views, ["frame_idx", "splat_idx"]).select("frame_idx", "splat_idx", "visible")


@query("sample_bilinear", "points pixels", f"""WITH q AS (SELECT point_id, CAST(floor(point_id / 400) AS BIGINT) AS frame_idx, 5*x + 10 AS u, 6*y + 10 AS v FROM points),
{S.bilinear('q', 'point_id', 'frame_idx', 'pixels', ['b', 'g', 'r'], '20', '20')}
SELECT point_id, {rnd('b; g; r')} FROM bl""")
def _(t):
    q = t.points.select(
        "point_id", F.floor(F.col("point_id") / 400).cast("bigint").alias("frame_idx"), (5 * F.col("x") + 10).alias("u"), (6 * F.col("y") + 10).alias("v")
    )
    return rounded(P.sample_bilinear(q, t.pixels, ["point_id"], "frame_idx", ["b", "g", "r"], F.lit(20), F.lit(20)))


# a scene is five frames with a camera each, and the points whose ids are those of the frames' pixels
_SHOTS = f"""{S.SMALL}, shots AS (SELECT s.* REPLACE (f.frame_idx AS cam_idx, f.frame_idx // 5 AS scene_id) FROM (SELECT DISTINCT frame_idx FROM pixels) f JOIN small s ON s.cam_idx = f.frame_idx % 25),
shot_points AS (SELECT * REPLACE (point_id // 2000 AS scene_id) FROM points)"""


def _shots(t: Tables) -> tuple[DataFrame, DataFrame]:
    frames = t.pixels.select(F.col("frame_idx").alias("_f")).distinct()
    cams = frames.join(F.broadcast(small_cams(t)), F.col("_f") % 25 == F.col("cam_idx"))  # 25 rows
    cams = cams.withColumns({"cam_idx": F.col("_f"), "scene_id": F.floor(F.col("_f") / 5)}).drop("_f")
    return cams, t.points.withColumn("scene_id", F.floor(F.col("point_id") / 2000))


@query("color_points", "points cams pixels", f"""WITH {_SHOTS}, {S.project('shot_points', 'shots')},
f AS (SELECT point_id, cam_idx AS frame_idx, u, v FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY cam_idx) AS rn
FROM pj WHERE zc >= 0.01 AND u >= 0 AND v >= 0 AND u < width - 1 AND v < height - 1) q WHERE rn = 1),
{S.bilinear('f', 'point_id', 'frame_idx', 'pixels', ['b', 'g', 'r'], '20', '20')}
SELECT point_id, {rnd('x; r; g; b')} FROM bl JOIN (SELECT point_id, x FROM points) p USING (point_id)""")
def _(t):
    cams, points = _shots(t)
    out = P.color_points(points, cams, cam_pixels(t), ["point_id"])
    return rounded(out.select("point_id", "x", "r", "g", "b"))


_UNPROJ = f"""WITH o AS (SELECT o.track_id, o.img_idx, o.x AS u, o.y AS v, 1 + 20 * o.mono AS depth, c.* FROM obs o JOIN cams c ON c.cam_idx = o.img_idx),
{S.rays('o')},
w AS (SELECT *, rx*depth/rz - t0 AS ax, ry*depth/rz - t1 AS ay, depth - t2 AS az FROM ry),
un AS (SELECT track_id, img_idx AS cam_idx, r00*ax + r10*ay + r20*az AS x, r01*ax + r11*ay + r21*az AS y, r02*ax + r12*ay + r22*az AS z FROM w)"""


def _obs_depth(t: Tables) -> DataFrame:
    return t.obs.select(
        "track_id", F.col("img_idx").alias("cam_idx"), F.col("x").alias("u"), F.col("y").alias("v"),
        (1 + 20 * F.col("mono")).alias("depth"),
    )


@query("unproject", "obs cams", f"{_UNPROJ} SELECT track_id, cam_idx, {rnd('x; y; z', 4)} FROM un")
def _(t):
    return rounded(P.unproject(_obs_depth(t), t.cams).select("track_id", "cam_idx", "x", "y", "z"), 4)


@query("lift_tracks", "obs cams", f"""{_UNPROJ}, f AS (SELECT *, sqrt(x*x+y*y+z*z) AS n, row_number() OVER (PARTITION BY track_id ORDER BY cam_idx) AS rn FROM un)
SELECT track_id, {rnd('x=CASE WHEN n > 15 THEN x*15/n ELSE x END; y=CASE WHEN n > 15 THEN y*15/n ELSE y END; z=CASE WHEN n > 15 THEN z*15/n ELSE z END', 4)} FROM f WHERE rn = 1""")
def _(t):
    return rounded(P.lift_tracks(_obs_depth(t), t.cams, 15.0).select("track_id", "x", "y", "z"), 4)


@query("knn_spacing", "points", f"""WITH d AS (SELECT a.cloud_id, a.point_id, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d
FROM points a JOIN points b ON a.cloud_id = b.cloud_id AND a.point_id <> b.point_id AND abs(a.x - b.x) <= 0.31 AND abs(a.y - b.y) <= 0.31),
r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d) AS rn FROM d),
s AS (SELECT point_id, sum(d) / 3 AS m FROM r WHERE rn <= 2 GROUP BY point_id HAVING count(*) = 2)
SELECT p.cloud_id, p.point_id, {rnd('spacing=least(greatest(coalesce(m, 0.1), 0.003), 0.1)')} FROM points p LEFT JOIN s USING (point_id)""")
def _(t):
    return rounded(P.knn_spacing(t.points, ["cloud_id"]))


@query("depth_to_points", "pixels", f"""WITH q AS (SELECT *, {S.PI} * (x - 10) / 20 AS ax, -{S.PI} * (y - 10) / 20 AS ay FROM pixels WHERE a > 0.99)
SELECT frame_idx, y AS "row", x AS col, {rnd('px=sin(ax)/invd; py=cos(ax)*sin(ay)/invd; pz=cos(ax)*cos(ay)/invd; r; g; b', 4)} FROM q""")
def _(t):
    return rounded(P.depth_to_points(t.pixels, 20), 4)


@query("sort_far_first", "points", f"""SELECT point_id, cloud_id, row_number() OVER (PARTITION BY cloud_id
ORDER BY sqrt((x-1)**2 + y*y + z*z) DESC, point_id) - 1 AS draw_order FROM points""")
def _(t):
    return P.sort_far_first(t.points, ["cloud_id"], (1.0, 0.0, 0.0)).select("point_id", "cloud_id", "draw_order")


@query("append_points", "points", f"""SELECT point_id, {rnd('x')} FROM points UNION ALL
SELECT point_id + 1 + (SELECT max(point_id) FROM points), {rnd('x=-x')} FROM points""")
def _(t):
    a = t.points.select("point_id", "x")
    return rounded(P.append_points(a, t.points.select("point_id", (-F.col("x")).alias("x"))))


@query("dense_points", "samples", f"""SELECT ray_id, sample_idx, {rnd('alpha=1 - exp(-sigma * 0.01); r=b; b=r; g')} FROM samples
WHERE 1 - exp(-sigma * 0.01) > 0.02""")
def _(t):
    return rounded(P.dense_points(t.samples).select("ray_id", "sample_idx", "alpha", "r", "g", "b"))


@query("epipolar_points", "views", f"""WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY cam_idx) AS rn FROM views) q WHERE rn = 1),
{S.rays('f', '200.0', '150.0')},
m AS (SELECT scene_id, cam_idx AS from_cam, i AS step, -(r00*t0 + r10*t1 + r20*t2) + 0.05*i*(r00*rx + r10*ry + r20*rz) AS x,
-(r01*t0 + r11*t1 + r21*t2) + 0.05*i*(r01*rx + r11*ry + r21*rz) AS y, -(r02*t0 + r12*t1 + r22*t2) + 0.05*i*(r02*rx + r12*ry + r22*rz) AS z
FROM ry, range(200) g(i)), {S.project('m', 'views')}
SELECT scene_id, cam_idx, CAST(step AS INTEGER) AS step, {rnd('zc; u=CASE WHEN abs(u) < 10000 THEN u ELSE -1 END; v=CASE WHEN abs(v) < 10000 THEN v ELSE -1 END', 3)} FROM pj WHERE cam_idx <> from_cam""")
def _(t):
    out = P.epipolar_points(t.views, 200.0, 150.0)
    near = lambda c: F.when(F.abs(F.col(c)) < 10000, F.col(c)).otherwise(F.lit(-1.0)).alias(c)
    return rounded(out.select("scene_id", "cam_idx", "step", "zc", near("u"), near("v")), 3)
