"""Queries over ray samples and camera paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenetab.functions.session import broadcast_if_small
from scenetab.operators import paths as C
from scenetab.operators import rays as R
from scenetab.plans import sqltext as S
from scenetab.plans.points_queries import cam_pixels, small_cams
from scenetab.plans.registry import query, rnd, rounded

SMALL_CHUNK = 8


def _weights(drop: str = "false", sigma: str = "sigma") -> str:
    return f"""st AS (SELECT *, coalesce(lead(depth) OVER (PARTITION BY ray_id ORDER BY sample_idx) - depth, 1e10) AS step FROM samples),
al AS (SELECT *, CASE WHEN {drop} THEN 0 ELSE 1 - exp(-({sigma}) * step) END AS al FROM st),
w AS (SELECT *, al * coalesce(exp(sum(ln(1 - al + 1e-10)) OVER (PARTITION BY ray_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS wt FROM al)"""


_INV = "least(greatest(0.1 / (depth + 1e-6), 0), 1)"


@query("composite_rays", "samples", f"WITH {_weights()} SELECT ray_id, {rnd(f'r=sum(wt*r); g=sum(wt*g); b=sum(wt*b); inv_depth=sum(wt*{_INV}); coverage=sum(wt)')} FROM w GROUP BY ray_id")
def _(t):
    return rounded(R.composite_rays(t.samples, ["ray_id"], chunk=SMALL_CHUNK))


@query("composite_rays_bounded", "samples", f"""WITH {_weights('depth < 1 OR depth > 4 OR step >= 1e10')} SELECT ray_id, {rnd(f'r=sum(wt*r)/(sum(wt)+1e-10); g=sum(wt*g)/(sum(wt)+1e-10); b=sum(wt*b)/(sum(wt)+1e-10); inv_depth=least(greatest(sum(wt*{_INV})/(sum(wt)+1e-10), 0), 1); coverage=sum(wt)')} FROM w GROUP BY ray_id""")
def _(t):
    return rounded(R.composite_rays(t.samples, ["ray_id"], (F.lit(1.0), F.lit(4.0)), True, chunk=SMALL_CHUNK))


@query("composite_rays_transparent", "samples", f"WITH {_weights('step >= 1e10')} SELECT ray_id, {rnd('r=sum(wt*r); coverage=sum(wt)')} FROM w GROUP BY ray_id")
def _(t):
    return rounded(R.composite_rays(t.samples, ["ray_id"], None, True).select("ray_id", "r", "coverage"))


@query("query_depths", "samples", f"""WITH i AS (SELECT ray_id, i, {S.h('(ray_id * 16 + i)', 91)} AS j FROM (SELECT DISTINCT ray_id FROM samples) q, range(16) g(i)),
d AS (SELECT ray_id, i, CASE WHEN i < 8 THEN 0.2 + (i % 8 + j) * 9.8 / 7 ELSE 1 / (0.001 + (i % 8 + j) * 0.099 / 7) END AS depth FROM i)
SELECT ray_id, CAST(row_number() OVER (PARTITION BY ray_id ORDER BY depth, i) - 1 AS INTEGER) AS sample_idx, {rnd('depth', 5)} FROM d""")
def _(t):
    return rounded(R.query_depths(t.samples.select("ray_id").distinct(), "ray_id", 16, 91), 5)


@query("importance_depths", "samples", f"""WITH {_weights(sigma='CASE WHEN step < 1e10 THEN sigma + 1e-5 ELSE sigma END')},
p AS (SELECT *, wt / sum(wt) OVER (PARTITION BY ray_id) AS pdf FROM w),
c AS (SELECT *, coalesce(sum(pdf) OVER (PARTITION BY ray_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
coalesce((depth + lag(depth) OVER (PARTITION BY ray_id ORDER BY sample_idx)) / 2, 0.2) AS bs, depth + step / 2 AS be FROM p),
d AS (SELECT ray_id, k, {S.h('(ray_id * 12 + k)', 92)} AS u FROM (SELECT DISTINCT ray_id FROM samples) q, range(12) g(k)),
n AS (SELECT d.ray_id, d.k, bs + (u - lo) / (CASE WHEN pdf < 1e-5 THEN 1 ELSE pdf END) * (be - bs) AS depth FROM d JOIN c ON c.ray_id = d.ray_id
AND c.sample_idx < 19 AND (u > lo OR c.sample_idx = 0) AND (u <= lo + pdf OR c.sample_idx = 18))
SELECT ray_id, CAST(row_number() OVER (PARTITION BY ray_id ORDER BY depth, k) - 1 AS INTEGER) AS sample_idx, {rnd('depth', 4)} FROM n""")
def _(t):
    return rounded(R.importance_depths(t.samples, "ray_id", 12, 92, chunk=SMALL_CHUNK), 4)


@query("ray_distortion", "samples", f"""WITH {_weights()}, m AS (SELECT ray_id, sample_idx, wt, step, depth + step / 2 AS mid FROM w WHERE step < 1e10),
pr AS (SELECT a.ray_id, sum(a.wt * b.wt * abs(a.mid - b.mid)) / (19 * 19) AS d FROM m a JOIN m b USING (ray_id) GROUP BY a.ray_id),
sz AS (SELECT ray_id, avg(wt * wt * step / 3) AS s FROM m GROUP BY ray_id)
SELECT ray_id, {rnd('distortion=s + d')} FROM pr JOIN sz USING (ray_id)""")
def _(t):
    return rounded(R.ray_distortion(R.ray_weights(t.samples, ["ray_id"], chunk=SMALL_CHUNK).drop("step", "alpha"), "ray_id", chunk=SMALL_CHUNK))


@query("shell_bounds", "pixels", f"""WITH s AS (SELECT frame_idx, y, x, list_sort([b, g, r]) AS s FROM pixels)
SELECT frame_idx, y, x, {rnd('near_shell=least(greatest(0.1 / ((s[2] + s[3]) / 2 + 1e-6), 0), 1000); far_shell=least(greatest(0.1 / ((s[1] + s[2]) / 2 + 1e-6), 0), 1000)', 4)} FROM s""")
def _(t):
    return rounded(R.shell_bounds(t.pixels, ("b", "g", "r")).select("frame_idx", "y", "x", "near_shell", "far_shell"), 4)


def _masked(t):
    return cam_pixels(t).withColumn("ignore", F.col("a") > 0.7).withColumn("depth", 10.0 * F.col("invd"))


def _frame_cams(t):
    """A camera per frame: the rig's cameras in turn."""
    rig = small_cams(t)
    frames = t.pixels.select(F.col("frame_idx").alias("f")).distinct()
    return frames.join(broadcast_if_small(rig), F.col("f") % 25 == F.col("cam_idx")).withColumn("cam_idx", F.col("f")).drop("f")


_FRAME_CAMS = f"{S.SMALL}, fcam AS (SELECT s.* REPLACE (f.frame_idx AS cam_idx) FROM (SELECT DISTINCT frame_idx FROM pixels) f JOIN small s ON s.cam_idx = f.frame_idx % 25)"


# twenty draws for a ray: rejections never use them up
@query("sample_rays", "cams pixels", f"""WITH {_FRAME_CAMS}, m AS (SELECT CAST(floor(count(*) / 10) AS BIGINT) AS n FROM pixels), fc AS (SELECT count(*) AS c FROM fcam),
d AS (SELECT id, CAST(floor({S.h('id', 93)} * fc.c) AS BIGINT) AS row_, {S.h('id', 94)} AS a_, {S.h('id', 95)} AS b_ FROM (SELECT unnest(range(20 * n)) AS id FROM m), fc),
e AS (SELECT id, f.cam_idx AS frame_idx, a_ * (f.width - 1) AS u, b_ * (f.height - 1) AS v, f.* FROM d JOIN fcam f ON f.cam_idx = d.row_),
q AS (SELECT e.* FROM e JOIN pixels px ON px.frame_idx = e.frame_idx AND px.y = floor(e.v) AND px.x = floor(e.u)
WHERE px.a <= 0.7 AND (e.cam_model <> 'equiangular' OR sqrt((e.u - e.cx)**2 + (e.v - e.cy)**2) <= e.useable_radius) QUALIFY row_number() OVER (ORDER BY e.id) <= (SELECT n FROM m)),
{S.bilinear('q', 'id', 'frame_idx', 'pixels', ['b', 'g', 'r'], '20', '20')}, {S.rays('q')}
SELECT id, cam_idx, {rnd('u; v; ox=-(r00*t0 + r10*t1 + r20*t2); oy=-(r01*t0 + r11*t1 + r21*t2); oz=-(r02*t0 + r12*t1 + r22*t2)')},
{rnd('dx=r00*rx + r10*ry + r20*rz; dy=r01*rx + r11*ry + r21*rz; dz=r02*rx + r12*ry + r22*rz; b; g; r')} FROM ry JOIN bl USING (id)""")
def _(t):
    cams = _frame_cams(t).withColumn("row", F.col("cam_idx"))
    n = t.pixels.count() // 10
    return rounded(R.sample_rays(cams, _masked(t), n, 93))


@query("sample_depth_points", "cams pixels", f"""WITH {_FRAME_CAMS}, q AS (SELECT cam_idx AS frame_idx, cam_idx * 20 + k AS point_id, 2 + 16 * {S.h('(cam_idx * 20 + k)', 94)} AS u, 2 + 16 * {S.h('(cam_idx * 20 + k)', 95)} AS v FROM fcam, range(20) g(k)),
{S.bilinear('q', 'point_id', 'frame_idx', '(SELECT *, 10 * invd AS depth FROM pixels)', ['depth', 'b'], '20', '20')},
o AS (SELECT q.point_id, q.u, q.v, bl.depth, bl.b, f.* FROM q JOIN bl USING (point_id) JOIN fcam f ON f.cam_idx = q.frame_idx WHERE bl.depth >= 0.01), {S.rays('o')},
a AS (SELECT *, rx*depth/rz - t0 AS ax, ry*depth/rz - t1 AS ay, depth - t2 AS az FROM ry)
SELECT point_id, {rnd('x=r00*ax + r10*ay + r20*az; y=r01*ax + r11*ay + r21*az; z=r02*ax + r12*ay + r22*az; b', 4)} FROM a""")
def _(t):
    cams = _frame_cams(t)
    out = R.sample_depth_points(cams, _masked(t), 20 * cams.count(), 94)
    return rounded(out.select("point_id", "x", "y", "z", "b"), 4)


# 400 draws for 20 points a camera: replacements never run out
@query("sample_depth_points_exact", "cams pixels", f"""WITH {_FRAME_CAMS}, m0 AS (SELECT frame_idx, y, x, CASE WHEN a > 0.95 THEN 1 ELSE 0 END AS m FROM pixels), {S.morph('m0', 'max', ['m'], 1, 'm1')},
q AS (SELECT cam_idx AS frame_idx, k, 0.2 + {S.h('(cam_idx * 1000000007 + k)', 96)} * CAST(19.6 AS DOUBLE) AS u, 0.2 + {S.h('(cam_idx * 1000000007 + k)', 97)} * CAST(19.6 AS DOUBLE) AS v FROM fcam, range(400) g(k)),
f AS (SELECT q.* FROM q LEFT JOIN m1 ON m1.frame_idx = q.frame_idx AND m1.y = floor(q.v) AND m1.x = floor(q.u) WHERE coalesce(m1.m, 0) = 0),
{S.bilinear('f', 'frame_idx, k', 'frame_idx', '(SELECT *, 10 * invd AS depth FROM pixels)', ['depth', 'b', 'g', 'r'], '20', '20').replace('SELECT frame_idx, k, frame_idx,', 'SELECT frame_idx, k,')},
d AS (SELECT f.frame_idx, f.k, f.u, f.v, bl.depth, bl.b, bl.g, bl.r FROM f JOIN bl USING (frame_idx, k) WHERE bl.depth >= 0.01 QUALIFY row_number() OVER (PARTITION BY f.frame_idx ORDER BY f.k) <= 20),
o AS (SELECT d.frame_idx, d.k, d.u, d.v, d.depth, d.b, d.g, d.r, f.* FROM d JOIN fcam f ON f.cam_idx = d.frame_idx), {S.rays('o')},
a AS (SELECT *, rx*depth/rz - t0 AS ax, ry*depth/rz - t1 AS ay, depth - t2 AS az FROM ry)
SELECT cam_idx, k, {rnd('u; v; depth; b; g; r; x=r00*ax + r10*ay + r20*az; y=r01*ax + r11*ay + r21*az; z=r02*ax + r12*ay + r22*az')} FROM a""")
def _(t):
    return rounded(R.sample_depth_points_exact(_frame_cams(t), _masked(t).withColumn("ignore", F.col("a") > 0.95), (20, 20), 20, 96))


_FR = "fr AS (SELECT p.path_id, i AS frame_idx FROM (SELECT DISTINCT path_id FROM keys) p, range(CAST((SELECT max(frame_idx) + 1 FROM keys) AS BIGINT)) g(i))"


def _frames(t, first: bool = False):
    """Frames from 0 (or from each path's first key) to the last key of all paths."""
    last = F.lit(t.keys.agg(F.max("frame_idx")).first()[0])
    start = F.min("frame_idx") if first else F.lit(0).cast("bigint")
    ends = t.keys.groupBy("path_id").agg(start.alias("s"))
    return ends.select("path_id", F.explode(F.sequence(F.col("s"), last)).alias("frame_idx"))


_LIN = "; ".join(f"{c}=CASE WHEN n.frame_idx IS NULL THEN p.{c} ELSE p.{c} + (n.{c} - p.{c}) * (f.frame_idx - p.frame_idx) / (n.frame_idx - p.frame_idx) END" for c in C.SIX)


@query("interpolate_keyframes", "keys", f"""WITH {_FR}, f AS (SELECT fr.* FROM fr JOIN (SELECT path_id, min(frame_idx) AS m FROM keys GROUP BY ALL) k USING (path_id) WHERE frame_idx >= m),
kn AS (SELECT *, lead(frame_idx) OVER (PARTITION BY path_id ORDER BY frame_idx) AS nf FROM keys)
SELECT f.path_id, f.frame_idx, {rnd(_LIN, 11)} FROM f JOIN kn p ON p.path_id = f.path_id AND f.frame_idx >= p.frame_idx AND (p.nf IS NULL OR f.frame_idx < p.nf)
LEFT JOIN keys n ON n.path_id = p.path_id AND n.frame_idx = p.nf""")
def _(t):
    return rounded(C.interpolate_keyframes(_frames(t, True), t.keys), 11)


_POSE = """w AS (SELECT *, rx * 3.141592653589793 / 180 AS a, ry * 3.141592653589793 / 180 AS b, rz * 3.141592653589793 / 180 AS c FROM keys),
v AS (SELECT *, sqrt(a*a + b*b + c*c) AS th FROM w), q AS (SELECT *, a/th*sin(th/2) AS qx, b/th*sin(th/2) AS qy, c/th*sin(th/2) AS qz, cos(th/2) AS qw FROM v),
po AS (SELECT path_id, frame_idx, focal, tx, ty, tz, qx*qx-qy*qy-qz*qz+qw*qw AS r00, 2*(qx*qy-qz*qw) AS r01, 2*(qx*qz+qy*qw) AS r02, 2*(qx*qy+qz*qw) AS r10, -qx*qx+qy*qy-qz*qz+qw*qw AS r11,
2*(qy*qz-qx*qw) AS r12, 2*(qx*qz-qy*qw) AS r20, 2*(qy*qz+qx*qw) AS r21, -qx*qx-qy*qy+qz*qz+qw*qw AS r22 FROM q)"""


# the relative rotation of two keys as a vector, by their quaternions
def _turn(a: str, b: str, out: str) -> str:
    w = f"({a}.qw*{b}.qw + {a}.qx*{b}.qx + {a}.qy*{b}.qy + {a}.qz*{b}.qz)"
    x = f"({a}.qw*{b}.qx - {a}.qx*{b}.qw - {a}.qy*{b}.qz + {a}.qz*{b}.qy)"
    y = f"({a}.qw*{b}.qy + {a}.qx*{b}.qz - {a}.qy*{b}.qw - {a}.qz*{b}.qx)"
    z = f"({a}.qw*{b}.qz - {a}.qx*{b}.qy + {a}.qy*{b}.qx - {a}.qz*{b}.qw)"
    n = f"sqrt({x}*{x} + {y}*{y} + {z}*{z})"
    k = f"(CASE WHEN {n} < 1e-12 THEN 2 ELSE 2 * atan2({n}, abs({w})) / {n} END * CASE WHEN {w} < 0 THEN -1 ELSE 1 END)"
    return ", ".join(f"{v} * {k} AS {out}{i}" for i, v in enumerate((x, y, z)))


_H10, _H01, _H11 = "(u*u*u - 2*u*u + u)", "(3*u*u - 2*u*u*u)", "(u*u*u - u*u)"
_CURVE = ", ".join(f"(1 - {_H01}) * p.t{c} + {_H10} * p.v{c} * gap + {_H01} * n.t{c} + {_H11} * n.v{c} * gap AS e{c}" for c in "xyz")
_SPIN = ", ".join(f"{_H10} * p.w{i} + {_H01} * p.a{i} + {_H11} * n.w{i} AS g{i}" for i in range(3))
_ROWS = [[f"p.r{i}{j}" for j in range(3)] for i in range(3)]
# Rodrigues: one more factor for the small angles
_STEP = [["1 - kb*(g1*g1 + g2*g2)", "-ka*g2 + kb*g0*g1", "ka*g1 + kb*g0*g2"], ["ka*g2 + kb*g0*g1", "1 - kb*(g0*g0 + g2*g2)", "-ka*g0 + kb*g1*g2"], ["-ka*g1 + kb*g0*g2", "ka*g0 + kb*g1*g2", "1 - kb*(g0*g0 + g1*g1)"]]
_TURNED = ", ".join(f"{' + '.join(f'q{i}{k}*({_STEP[k][j]})' for k in range(3))} AS r{i}{j}" for i in range(3) for j in range(3))


@query("interpolate_path", "keys", f"""WITH {_POSE}, {_FR},
o AS (SELECT po.*, q.qw, q.qx, q.qy, q.qz, row_number() OVER (PARTITION BY path_id ORDER BY frame_idx) AS i, count(*) OVER (PARTITION BY path_id) AS m FROM po JOIN q USING (path_id, frame_idx)),
nb AS (SELECT k.*, {_turn('k', 'hi', 'a')}, {_turn('lo', 'k', 'c')}, CAST(k.frame_idx - lo.frame_idx AS DOUBLE) AS dl, CAST(hi.frame_idx - k.frame_idx AS DOUBLE) AS dh,
{', '.join(f'coalesce((hi.t{c} - lo.t{c}) / nullif(hi.frame_idx - lo.frame_idx, 0), 0) AS v{c}' for c in 'xyz')}
FROM o k JOIN o lo ON lo.path_id = k.path_id AND lo.i = greatest(k.i - 1, 1) JOIN o hi ON hi.path_id = k.path_id AND hi.i = least(k.i + 1, k.m)),
kk AS (SELECT *, {', '.join(f'CASE WHEN i = 1 THEN a{k} WHEN i = m THEN c{k} ELSE (c{k} * dh + a{k} * dl) / (dl + dh) END AS w{k}' for k in range(3))} FROM nb),
sg AS (SELECT f.path_id, f.frame_idx, greatest(count(k.i), 1) AS at, least(count(k.i) + 1, max(all_.m)) AS nx, count(k.i) AS c FROM fr f JOIN (SELECT DISTINCT path_id, m FROM o) all_ ON all_.path_id = f.path_id
LEFT JOIN kk k ON k.path_id = f.path_id AND k.frame_idx <= f.frame_idx GROUP BY f.path_id, f.frame_idx),
s2 AS (SELECT s.path_id, s.frame_idx AS f, s.at, CASE WHEN s.c = 0 THEN s.at ELSE s.nx END AS nx FROM sg s),
s3 AS (SELECT s.*, CAST(n.frame_idx - p.frame_idx AS DOUBLE) AS gap, CASE WHEN n.frame_idx > p.frame_idx THEN (s.f - p.frame_idx) / CAST(n.frame_idx - p.frame_idx AS DOUBLE) ELSE 0 END AS u
FROM s2 s JOIN kk p ON p.path_id = s.path_id AND p.i = s.at JOIN kk n ON n.path_id = s.path_id AND n.i = s.nx),
s4 AS (SELECT s.path_id, s.f AS frame_idx, (1 - u) * p.focal + u * n.focal AS focal, {_CURVE}, {_SPIN}, {', '.join(f'{_ROWS[i][j]} AS q{i}{j}' for i in range(3) for j in range(3))}
FROM s3 s JOIN kk p ON p.path_id = s.path_id AND p.i = s.at JOIN kk n ON n.path_id = s.path_id AND n.i = s.nx),
s5 AS (SELECT *, sqrt(g0*g0 + g1*g1 + g2*g2) AS th FROM s4), s6 AS (SELECT *, CASE WHEN th < 1e-8 THEN 1 ELSE sin(th) / th END AS ka, CASE WHEN th < 1e-8 THEN 0.5 ELSE (1 - cos(th)) / (th * th) END AS kb FROM s5),
s7 AS (SELECT path_id, frame_idx, focal, ex, ey, ez, {_TURNED} FROM s6)
SELECT path_id, frame_idx, {rnd('focal; r00; r01; r02; r10; r11; r12; r20; r21; r22; ' + '; '.join(f't{i}=-(r{i}0*ex + r{i}1*ey + r{i}2*ez)' for i in range(3)))} FROM s7""")
def _(t):
    keys = C.keyframe_pose(t.keys)
    return rounded(C.interpolate_path(_frames(t), keys))


@query("keyframe_pose", "keys", f"WITH {_POSE} SELECT path_id, frame_idx, {rnd('r00; r01; r02; r10; r11; r12; r20; r21; r22; t0=-(r00*tx+r01*ty+r02*tz); t1=-(r10*tx+r11*ty+r12*tz); t2=-(r20*tx+r21*ty+r22*tz)')} FROM po")
def _(t):
    return rounded(C.keyframe_pose(t.keys).select("path_id", "frame_idx", *C.geom.POSE))


for _kind, _vals in (("mono", "(0, 0, 0, 0.0)"), ("stereo", "(0, 0, 0, -0.032), (1, 0, 1, 0.032)"), ("vr180", "(0, 0, 0, -0.032), (1, 0, 1, 0.032)"),
                     ("quilt", None)):
    _V = f"(VALUES {_vals}) q(view, \"row\", col, shift)" if _vals else "(SELECT (5 - r) * 8 + c AS view, r AS \"row\", c AS col, 0.064 * (((5 - r) * 8 + c) / 47.0 - 0.5) AS shift FROM range(6) a(r), range(8) b(c)) q"

    @query(f"expand_views_{_kind}", "keys", f"""WITH {_POSE} SELECT path_id, frame_idx, CAST(view AS INTEGER) AS view, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col,
    {rnd('t0=-(r00*(tx + r00*shift) + r01*(ty + r01*shift) + r02*(tz + r02*shift)); t1=-(r10*(tx + r00*shift) + r11*(ty + r01*shift) + r12*(tz + r02*shift))')} FROM po, {_V}""")
    def _(t, kind=_kind):
        return rounded(C.expand_views(C.keyframe_pose(t.keys), kind, 0.064).select("path_id", "frame_idx", "view", "row", "col", "t0", "t1"))


@query("preset_keyframes", "", f"SELECT c_custkey AS path_id, CASE WHEN e = 0 THEN 0 ELSE 29 + c_custkey % 50 END AS frame_idx, {rnd('tx=e - 0.5; ty=0; rz=0')} FROM customer, (VALUES (0), (1)) q(e)")
def _(t):
    paths = t.customer.select(F.col("c_custkey").alias("path_id"), (30 + F.col("c_custkey") % 50).alias("num_frames"))
    return rounded(C.preset_keyframes(paths, "pan_right").select("path_id", "frame_idx", "tx", "ty", "rz"))


@query("orbit_keyframes", "", f"""WITH a AS (SELECT c_custkey AS path_id, i AS frame_idx, (i / n * 30 + (1 - i / n) * 150) * 3.141592653589793 / 180 AS th FROM (SELECT c_custkey, 10 + c_custkey % 5 AS n FROM customer) q, range(14) g(i) WHERE i < n)
SELECT path_id, frame_idx, {rnd('tx=2*cos(th) + 1; tz=2*sin(th); ry=90 + 180 / 3.141592653589793 * atan2(2*sin(th), 2*cos(th))')} FROM a""")
def _(t):
    paths = t.customer.select(F.col("c_custkey").alias("path_id"), (10 + F.col("c_custkey") % 5).alias("num_frames"))
    return rounded(C.orbit_keyframes(paths, 2.0, 30.0, 150.0, (1.0, 0.0, 0.0)).select("path_id", "frame_idx", "tx", "tz", "ry"))
