"""Queries over warps and layered pictures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scenetab.operators import layers as L
from scenetab.operators import warps as W
from scenetab.plans import sqltext as S
from scenetab.plans.points_queries import small_cams
from scenetab.plans.registry import query, rnd, rounded

PI = "3.141592653589793"
ID = "frame_idx, y, x"
DEST = {"radius_at_90": 3.0, "cx": 2.0, "cy": 2.5, "k1": 0.05, "tilt": -0.01, "width": 4, "height": 4}
OPTS = {
    "fisheye_to_rectified": {}, "rectified_to_fisheye": {"rect_width": 8, "rect_height": 6, "scale": 0.9}, "fisheye_to_fisheye": {"dest": DEST, "scale": 0.8},
    "fisheye_to_inflated": {"dest": DEST, "exponent": 3.0}, "fisheye_to_equirect180": {}, "fisheye_to_equirect360": {},
    "vr180_to_ftheta": {"eqr_size": 16, "scale": 1.1}, "fisheye_to_pinhole": {"focal_multiplier": 0.4}, "primary_to_ldi": {"dest": DEST}, "pinhole_radial": {"focal_multiplier": 0.8},
}
_GRID = "SELECT c.*, y.i AS y, x.i AS x FROM views c, range(4) y(i), range(4) x(i)"
_FISH = "REPLACE ('equiangular' AS cam_model)"


def _world(ray: str, pose: bool = True) -> str:
    """Pixel of a ray in the row's fisheye camera."""
    move = ["r00*dx + r01*dy + r02*dz + t0", "r10*dx + r11*dy + r12*dz + t1", "r20*dx + r21*dy + r22*dz + t2"] if pose else ["dx", "dy", "dz"]
    return f"""d AS ({ray}), e AS (SELECT *, {move[0]} AS xc, {move[1]} AS yc, {move[2]} AS zc FROM d),
    p AS (SELECT *, sqrt(1e-9 + xc*xc + yc*yc) AS rho, atan2(sqrt(1e-9 + xc*xc + yc*yc), zc) AS ph FROM e),
    q AS (SELECT *, ph * (1 + ph*ph*k1) * radius_at_90 / ({PI} / 2) AS rr FROM p),
    o AS (SELECT cam_idx, y, x, rr * (1 + tilt) * xc / rho + cx AS u, -rr * yc / rho + cy AS v FROM q)"""


def _dest_rays(radius: str, cx: str, cy: str, k1: str, tilt: str) -> str:
    """Fisheye rays of a second camera given by numbers; the row's own camera columns stay."""
    g = f"g0 AS ({_GRID}), gg AS (SELECT cam_idx, y, x, 'equiangular' AS cam_model, {cx} AS cx, {cy} AS cy, {radius} AS radius_at_90, {k1} AS k1, {tilt} AS tilt, 1.0 AS fx, 1.0 AS fy, 4 AS height FROM g0)"
    return f"{g}, {S.rays('gg', 'x', 'y')}"


_INFL = "SELECT *, cos(th)*sin(f) AS dx, -sin(th)*sin(f) AS dy, cos(f) AS dz FROM (SELECT *, atan2(y - 2.5, x - 2.0) AS th, (0.5*r + 0.5*r**3) * 3.141592653589793 / 2 AS f FROM (SELECT *, sqrt((x-2.0)**2 + (y-2.5)**2) / 3.0 AS r FROM g0) a) b"
_EQ = "SELECT *, cos(la)*cos(lo) AS dx, -sin(la) AS dy, cos(la)*sin(lo) AS dz FROM (SELECT *, {lon} AS lo, 3.141592653589793*(y/4.0 - 0.5) AS la FROM g0) a"
_WARP = {
    "fisheye_to_rectified": f"WITH g0 AS ({_GRID}), {_world(f'SELECT *, sin(a) AS dx, cos(a)*sin(b) AS dy, cos(a)*cos(b) AS dz FROM (SELECT *, {PI}*(x-2)/4.0 AS a, -{PI}*(y-2)/4.0 AS b FROM g0) z')}",
    "rectified_to_fisheye": f"""WITH g0 AS ({_GRID}), gg AS (SELECT * REPLACE ('equiangular' AS cam_model, radius_at_90 * 0.9 AS radius_at_90) FROM g0), {S.rays('gg', 'x', 'y')},
      a AS (SELECT *, rx - t0 AS ax, ry - t1 AS ay, rz - t2 AS az FROM ry), b AS (SELECT *, r00*ax + r10*ay + r20*az AS wx, r01*ax + r11*ay + r21*az AS wy, r02*ax + r12*ay + r22*az AS wz FROM a),
      o AS (SELECT cam_idx, y, x, CASE WHEN sqrt((x-cx)**2 + (y-cy)**2) > 1.1*radius_at_90 THEN -123 ELSE atan2(wx, sqrt(wz*wz + wy*wy)) * 8 / {PI} + 4 END AS u,
      CASE WHEN sqrt((x-cx)**2 + (y-cy)**2) > 1.1*radius_at_90 THEN -456 ELSE atan2(wz, wy) * 6 / {PI} END AS v FROM b)""",
    "fisheye_to_fisheye": f"""WITH {_dest_rays('2.4', '2.0', '2.5', '0.05', '-0.01')}, {_world('SELECT c.*, r.y, r.x, r.rx AS dx, r.ry AS dy, r.rz AS dz FROM ry r JOIN views c USING (cam_idx)').replace('o AS (', 'o_ AS (')},
      o AS (SELECT cam_idx, y, x, CASE WHEN sqrt((x-2.0)**2 + (y-2.5)**2) > 1.1*2.4 THEN -123 ELSE u END AS u, CASE WHEN sqrt((x-2.0)**2 + (y-2.5)**2) > 1.1*2.4 THEN -456 ELSE v END AS v FROM o_)""",
    "fisheye_to_inflated": f"WITH g0 AS ({_GRID}), {_world(_INFL)}",
    "fisheye_to_equirect180": f"WITH g0 AS ({_GRID}), {_world(_EQ.format(lon=f'-{PI}*(x/4.0 - 0.5) + {PI}/2'))}",
    "fisheye_to_equirect360": f"WITH g0 AS ({_GRID}), {_world(_EQ.format(lon=f'-2*{PI}*x/4.0 - {PI}/2'))}",
    "vr180_to_ftheta": f"""WITH {_dest_rays('2.2', '2.0', '2.0', '0.0', '0.0')}, o AS (SELECT cam_idx, y, x, CASE WHEN (x-2)**2 + (y-2)**2 > 2.2**2 THEN -1 ELSE 16 * (0.5 + atan2(rx, rz) / {PI}) END AS u,
      CASE WHEN (x-2)**2 + (y-2)**2 > 2.2**2 THEN -1 ELSE 16 * (0.5 + atan2(-ry, sqrt(rz*rz + rx*rx)) / {PI}) END AS v FROM ry)""",
    "fisheye_to_pinhole": f"WITH g0 AS ({_GRID}), {_world('SELECT *, a/n AS dx, b/n AS dy, 1/n AS dz FROM (SELECT *, (x-2)/1.6 AS a, -(y-2)/1.6 AS b, sqrt(((x-2)/1.6)**2 + ((y-2)/1.6)**2 + 1) AS n FROM g0) z', False)}",
    "primary_to_ldi": f"WITH g0 AS ({_GRID}), {_world(_INFL, False)}",
    "pinhole_radial": f"""WITH g0 AS ({_GRID}), a AS (SELECT *, (x-2)/(0.8*fx) AS a, (y-2)/(0.8*fy) AS b FROM g0), b AS (SELECT *, sqrt(a*a + b*b) AS r, atan(sqrt(a*a + b*b)) AS th FROM a),
      c AS (SELECT *, CASE WHEN r = 0 THEN 1 ELSE th / r END * (1 + th**2 * (k1 + th**2 * 0.02)) AS k FROM b), o AS (SELECT cam_idx, y, x, a*k*fx + cx AS u, b*k*fy + cy AS v FROM c)""",
}
for _kind in W.KINDS:

    @query(f"build_warp_{_kind}", "views", f"{_WARP[_kind]} SELECT cam_idx, y, x, {rnd('u; v', 4)} FROM o")
    def _(t, kind=_kind):
        return rounded(W.build_warp(t.views.withColumn("k2", F.lit(0.02)), kind, 4, 4, **OPTS[kind]), 4)


# a simple bending warp for every frame
_BEND = "wp AS (SELECT frame_idx, y, x, x + 6*g - 3 AS u, y + 6*r - 3 AS v FROM pixels)"


def _bend(t):
    return t.pixels.select("frame_idx", "y", "x", (F.col("x") + 6 * F.col("g") - 3).alias("u"), (F.col("y") + 6 * F.col("r") - 3).alias("v"))


def _gather(warp: str, src: str, col: str, out: str) -> str:
    """Linear gather with zeros outside, by four left joins."""
    at = lambda i, j: f"coalesce((1 - abs(u - (floor(u) + {i}))) * (1 - abs(v - (floor(v) + {j}))) * p{i}{j}.{col}, 0)"
    joins = " ".join(f"LEFT JOIN {src} p{i}{j} ON p{i}{j}.frame_idx = w.frame_idx AND p{i}{j}.x = floor(u) + {i} AND p{i}{j}.y = floor(v) + {j}" for i in (0, 1) for j in (0, 1))
    return f"{out} AS (SELECT w.frame_idx, w.y, w.x, {' + '.join(at(i, j) for i in (0, 1) for j in (0, 1))} AS {col} FROM {warp} w {joins})"


@query("apply_warp", "pixels", f"WITH {_BEND}, {_gather('wp', 'pixels', 'b', 'o')} SELECT {ID}, {rnd('b')} FROM o")
def _(t):
    return rounded(W.apply_warp(t.pixels, _bend(t), "frame_idx", ["b"]))


@query("apply_warp_nearest", "pixels", f"""WITH {_BEND} SELECT w.frame_idx, w.y, w.x, {rnd('b=coalesce(p.b, 0)')} FROM wp w
LEFT JOIN pixels p ON p.frame_idx = w.frame_idx AND p.x = floor(u + 0.5) AND p.y = floor(v + 0.5)""")
def _(t):
    return rounded(W.apply_warp(t.pixels, _bend(t), "frame_idx", ["b"], "nearest"))


@query("compose_warps", "pixels", f"""WITH {_BEND}, w2 AS (SELECT frame_idx, y, x, x + b AS u2, y - b AS v2 FROM pixels),
{S.bilinear('wp', 'frame_idx, y, x', 'frame_idx', 'w2', ['u2', 'v2'], '20', '20').replace('SELECT frame_idx, y, x, frame_idx,', 'SELECT frame_idx, y, x,')}
SELECT {ID}, {rnd('u=u2; v=v2')} FROM bl""")
def _(t):
    second = t.pixels.select("frame_idx", "y", "x", (F.col("x") + F.col("b")).alias("u"), (F.col("y") - F.col("b")).alias("v"))
    return rounded(W.compose_warps(_bend(t), second, "frame_idx", 20, 20))


@query("stereo_error", "pixels", f"""WITH d AS (SELECT frame_idx, y, x, greatest(0, 4*b + 0.1) AS rd, greatest(0, 4*g + 0.1) AS ld, abs(r - 0.5) * 1.5 AS rv, abs(a - 0.5) * 1.5 AS lv FROM pixels),
w1 AS (SELECT frame_idx, y, x, x + rd AS u, y AS v FROM d), w2 AS (SELECT frame_idx, y, x, x - ld AS u, y AS v FROM d),
{_gather('w1', 'd', 'ld', 'g1')}, {_gather('w2', 'd', 'rd', 'g2')}
SELECT d.frame_idx, d.y, d.x, {rnd('r_disp=d.rd; l_disp=d.ld; r_error=least(greatest(rv + abs(g1.ld - d.rd) * 5, 0), 1); l_error=least(greatest(lv + abs(g2.rd - d.ld) * 5, 0), 1)')}
FROM d JOIN g1 USING (frame_idx, y, x) JOIN g2 USING (frame_idx, y, x)""")
def _(t):
    flow = t.pixels.select(
        "frame_idx", "y", "x", (4 * F.col("b")).alias("rfx"), (F.col("r") - 0.5).alias("rfy"), (-4 * F.col("g")).alias("lfx"), (F.col("a") - 0.5).alias("lfy")
    )
    return rounded(W.stereo_error(flow, 20, 20, 0.1))


_VG = f"""{S.SMALL}, vg AS (SELECT cam_idx, y.i AS y, x.i AS x, (CASE WHEN sqrt((x.i-cx)**2 + (y.i-cy)**2) > 9*0.7 THEN 1 - least(greatest((sqrt((x.i-cx)**2 + (y.i-cy)**2) - 9*0.7) / (9*0.2), 0), 1) ELSE 1 END)
* (CASE WHEN least(20, x.i, y.i, abs(x.i - 19), abs(y.i - 19)) < 3 THEN least(1, (least(20, x.i, y.i, abs(x.i - 19), abs(y.i - 19)) - 0) / 3.0) ELSE 1 END) AS v FROM small, range(20) y(i), range(20) x(i)),
{S.blur('vg', ['v'], 5, 2.0, 20, 20, 'vb', 'cam_idx')}"""


@query("apply_vignette", "cams pixels", f"WITH {_VG} SELECT p.frame_idx, p.y, p.x, {rnd('b=p.b * vb.v; invd=p.invd * vb.v')} FROM pixels p JOIN vb ON vb.cam_idx = p.frame_idx % 25 AND vb.y = p.y AND vb.x = p.x")
def _(t):
    vig = L.vignette(small_cams(t), (20, 20), 0.7, 0.9, 0.1, 0.4, 5, 2.0, tile=8)
    px = t.pixels.withColumn("cam_idx", F.col("frame_idx") % 25)
    return rounded(L.apply_vignette(px, vig, ["cam_idx"], ["b", "invd"]).select("frame_idx", "y", "x", "b", "invd"))


@query("superellipse", "pixels", f"""WITH r AS (SELECT {ID}, pow(pow(abs(-1 + 2*x/19.0), 10) + pow(abs(-1 + 2*y/19.0), 10), 0.1) AS r FROM pixels)
SELECT {ID}, {rnd('v=exp(-0.5*r*r) * least(greatest((0.99 - r) / 0.04, 0), 1)')} FROM r""")
def _(t):
    return rounded(L.superellipse(t.pixels.select("frame_idx", "y", "x"), (20, 20)))


_LAYERS = "ly AS (SELECT frame_idx, CAST(l AS INTEGER) AS layer, y, x, CASE l WHEN 0 THEN b WHEN 1 THEN g ELSE r END AS b, g, r, CASE l WHEN 0 THEN 1 WHEN 1 THEN a ELSE b END AS a, invd * (l + 1) / 3.0 AS invd FROM pixels, range(3) q(l))"


def _layers(t):
    l = F.col("layer")
    src = t.pixels.withColumn("layer", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    pick = lambda a, b, c: F.when(l == 0, a).when(l == 1, b).otherwise(c)
    return src.select(
        "frame_idx", "layer", "y", "x", pick(F.col("b"), F.col("g"), F.col("r")).alias("b"), "g", "r",
        pick(F.lit(1.0), F.col("a"), F.col("b")).alias("a"), (F.col("invd") * (l + 1) / 3.0).alias("invd"),
    )


def _fuse(n: int) -> str:
    low, top = f"f{n - 1}", f"(SELECT * FROM ly WHERE layer = {n})"
    na = "(1 - (1 - l.a) * (1 - t.a))"
    fr = f"least(greatest(t.a / ({na} + 1e-6), 0), 1)"
    mix = ", ".join(f"l.{c} * (1 - {fr}) + t.{c} * {fr} AS {c}" for c in "bgr")
    return f"f{n} AS (SELECT l.frame_idx, l.y, l.x, {mix}, {na} AS a, l.invd * (1 - t.a) + t.invd * t.a AS invd FROM {low} l JOIN {top} t USING (frame_idx, y, x))"


@query("fuse_layers", "pixels", f"WITH {_LAYERS}, f0 AS (SELECT * FROM ly WHERE layer = 0), {_fuse(1)}, {_fuse(2)} SELECT {ID}, {rnd('b; g; r; a; invd')} FROM f2")
def _(t):
    return rounded(L.fuse_layers(_layers(t)))


_PACK = f"""{_LAYERS}, dp AS (SELECT frame_idx, layer, y // 2 AS y, x // 2 AS x, avg(invd) AS d FROM ly GROUP BY ALL),
cd AS (SELECT *, CAST(floor(least(greatest(d, 0), 1) * 4095) AS INTEGER) AS c FROM dp),
pk AS (SELECT frame_idx, (2 - layer) * 20 + y AS y, x, CAST(round_even(b * 255, 0) AS INTEGER) AS b, CAST(round_even(g * 255, 0) AS INTEGER) AS g FROM ly
UNION ALL SELECT frame_idx, (2 - layer) * 20 + y, x + 40, CAST(round_even(a * 255, 0) AS INTEGER), CAST(round_even(a * 255, 0) AS INTEGER) FROM ly
UNION ALL SELECT frame_idx, (2 - layer) * 20 + y, x + 20, CASE WHEN (c & 256) = 0 THEN c & 255 ELSE 255 - (c & 255) END, CASE WHEN (c & 256) = 0 THEN c & 255 ELSE 255 - (c & 255) END FROM cd
UNION ALL SELECT frame_idx, (2 - layer) * 20 + y, x + 30, (c >> 8) * 16 + 8, (c >> 8) * 16 + 8 FROM cd
UNION ALL SELECT frame_idx, (2 - layer) * 20 + y + 10, x + 20, CAST(round_even(d * 255, 0) AS INTEGER), CAST(round_even(d * 255, 0) AS INTEGER) FROM cd
UNION ALL SELECT frame_idx, (2 - layer) * 20 + y + 10, x + 30, 0, 0 FROM cd)"""


@query("pack_ldi", "pixels", f"WITH {_PACK} SELECT {ID}, b, g FROM pk")
def _(t):
    return L.pack_ldi(_layers(t), 20).select("frame_idx", "y", "x", "b", "g")


@query("unpack_ldi_color", "pixels", f"WITH {_LAYERS} SELECT frame_idx, layer, y, x, {rnd('b=round_even(b * 255, 0) / 255; a=round_even(a * 255, 0) / 255')} FROM ly")
def _(t):
    return rounded(L.unpack_ldi(L.pack_ldi(_layers(t), 20), 20)[0].select("frame_idx", "layer", "y", "x", "b", "a"))


@query("unpack_ldi_depth", "pixels", f"WITH {_PACK} SELECT frame_idx, layer, y, x, {rnd('invd=c / 4095.0')} FROM cd")
def _(t):
    return rounded(L.unpack_ldi(L.pack_ldi(_layers(t), 20), 20)[1])


@query("layer_mesh_vertices", "pixels", f"""WITH {_LAYERS}, q AS (SELECT *, 2*(x/19.0 - 0.5) AS a_, 2*(y/19.0 - 0.5) AS b_ FROM ly), p AS (SELECT *, sqrt(a_*a_ + b_*b_) AS r_, atan2(b_, a_) AS t_, least(greatest(0.1 / (1e-6 + invd), 0), 50) AS d FROM q),
f AS (SELECT *, (0.5*r_ + 0.5*r_**3) * {PI} / 2 AS f FROM p)
SELECT frame_idx, CAST(layer * 400 + y * 20 + x AS BIGINT) AS vertex_id, {rnd('vx=cos(t_)*sin(f)*d; vy=-sin(t_)*sin(f)*d; vz=-cos(f)*d; tu=x/19.0/3 + layer/3.0; tv=1 - y/19.0')} FROM f""")
def _(t):
    return rounded(L.layer_mesh(_layers(t), 20)[0])


@query("layer_mesh_triangles", "pixels", f"""WITH {_LAYERS}, c AS (SELECT frame_idx, CAST(layer * 400 + y * 20 + x AS BIGINT) AS i FROM ly WHERE (x-10)**2 + (y-10)**2 <= 49)
SELECT frame_idx, i AS cell_id, CAST(0 AS INTEGER) AS k, i AS a, i + 20 AS b, i + 1 AS c FROM c UNION ALL SELECT frame_idx, i, 1, i + 20, i + 21, i + 1 FROM c""")
def _(t):
    return L.layer_mesh(_layers(t), 20)[1]


@query("blend_selection", "pixels", f"""WITH {_LAYERS}, sl AS (SELECT y, x, a AS s FROM pixels WHERE frame_idx = 0),
bs AS (SELECT l.* EXCLUDE (invd), CASE WHEN layer IN (1, 2) AND frame_idx BETWEEN 1 AND 15 AND s IS NOT NULL THEN s * 0.05 + (1 - s) * invd ELSE invd END AS invd FROM ly l LEFT JOIN sl USING (y, x)),
w AS (SELECT frame_idx, y, x, max(CASE WHEN layer = 2 THEN invd END) AS d2, max(CASE WHEN layer = 1 THEN invd END) AS e1, max(CASE WHEN layer = 0 THEN invd END) AS e0,
max(CASE WHEN layer = 2 THEN a END) AS a2, max(CASE WHEN layer = 1 THEN a END) AS a1 FROM bs GROUP BY ALL),
o AS (SELECT *, CASE WHEN a2 > 0 THEN greatest(0, least(e1, d2 - 1 / 255.0)) ELSE e1 END AS d1 FROM w)
SELECT {ID}, {rnd('d2; d1; d0=CASE WHEN a1 > 0 THEN greatest(0, least(e0, d1 - 1 / 255.0)) ELSE e0 END')} FROM o""")
def _(t):
    sel = t.pixels.where("frame_idx = 0").select("y", "x", F.col("a").alias("s"))
    out = L.blend_selection(_layers(t), sel, [1, 2], {"invd": F.lit(0.05)}, 1, 15)
    d = lambda i: F.max(F.when(F.col("layer") == i, F.col("invd"))).alias(f"d{i}")
    return rounded(out.groupBy("frame_idx", "y", "x").agg(d(2), d(1), d(0)))


_ASM = f"""dh AS (SELECT frame_idx, y // 2 AS y, x // 2 AS x, avg(invd) AS invd, avg(g) AS mid, avg(r) AS bot, avg(a) AS lb1, avg(b) AS lb0 FROM pixels GROUP BY ALL),
m1 AS (SELECT {ID}, invd, mid * lb1 + invd * (1 - lb1) AS mid, bot * lb0 + invd * (1 - lb0) AS bot FROM dh),
m2 AS (SELECT {ID}, invd, greatest(0, least(mid, invd - 1/1024.0)) AS mid, bot FROM m1), m3 AS (SELECT {ID}, invd, mid, greatest(0, least(bot, mid - 1/1024.0)) AS bot FROM m2),
{S.enlarge('m3', ['invd', 'mid', 'bot'], 2, 10, 10, 'en')}"""


@query("assemble_layers", "pixels", f"""WITH {_ASM}, j AS (SELECT p.frame_idx, p.y, p.x, p.b, p.g, p.r, p.a, en.invd, en.mid, en.bot FROM pixels p JOIN en ON en.frame_idx = p.frame_idx AND en.y = p.y AND en.x = p.x)
SELECT {ID}, CAST(2 AS INTEGER) AS layer, {rnd('b=b*0.9; a=r*0.9; invd=invd*0.8', 9)} FROM j UNION ALL
SELECT {ID}, 1, {rnd('b=(g*a + b*(1-a))*0.9; a=g*0.9; invd=mid*0.8', 9)} FROM j UNION ALL SELECT {ID}, 0, {rnd('b=(r*b + b*(1-b))*0.9; a=1; invd=bot*0.8', 9)} FROM j""")
def _(t):
    c = F.col
    color = t.pixels.select(
        "frame_idx", "y", "x", "b", "g", "r", *[c("g").alias(f"m{n}") for n in "bgr"], *[c("r").alias(f"k{n}") for n in "bgr"], c("a").alias("l1_blend"),
        c("b").alias("l0_blend"), c("g").alias("l1_alpha"), c("r").alias("l2_alpha"), F.lit(0.9).alias("cv"), F.lit(0.8).alias("dv"),
    )
    depth = L.S.shrink(t.pixels, ["frame_idx"], ["invd", "g", "r"], 2).withColumnsRenamed({"g": "mid", "r": "bot"})
    return rounded(L.assemble_layers(color, depth, (20, 20), tile=8).select("frame_idx", "y", "x", "layer", "b", "a", "invd"), 9)


@query("relax_grid")
def _(t):
    src = t.pixels.withColumn("m", F.col("a") > 0.7)
    return rounded(L.relax_grid(src, "invd", mask="m", sweeps=4, tol=1e-3, tile=32), 4)


@query("relax_grid_weighted")
def _(t):
    return rounded(L.relax_grid(t.pixels, "invd", weight="a", smooth=0.3, sweeps=4, tol=1e-3, tile=32), 4)


# A hole that leaves the border only. Edges to fixed pixels weigh half, so they span two steps of the slope that fills it.
_SLOPE = "(frame_idx % 5) / CAST(10 AS DOUBLE) + (1 - (frame_idx % 3) / CAST(10 AS DOUBLE) - (frame_idx % 5) / CAST(10 AS DOUBLE)) * (CASE WHEN x = 0 THEN 0 WHEN x = 19 THEN 21 ELSE x + 1 END) / 21"


@query("relax_grid_hole", "pixels", f"SELECT {ID}, {rnd(f'want={_SLOPE}; error=0', 4)} FROM pixels")
def _(t):
    src = t.pixels.select("frame_idx", "y", "x", F.expr(_SLOPE).alias("want"), (F.col("y").between(1, 18) & F.col("x").between(1, 18)).alias("m"))
    got = L.relax_grid(src.withColumn("v", F.when(F.col("m"), 0.0).otherwise(F.col("want"))), "v", mask="m", tile=32)
    both = src.select("frame_idx", "y", "x", "want").join(got, ["frame_idx", "y", "x"])
    return rounded(both.select("frame_idx", "y", "x", "want", F.round(F.col("v") - F.col("want"), 3).alias("error")), 4)


# targets made so that b solves the weighted problem: the pull of the neighbours is added to it
@query("relax_grid_known", "pixels", f"SELECT {ID}, {rnd('want=b; error=0', 4)} FROM pixels")
def _(t):
    src = t.pixels.select("frame_idx", "y", "x", F.col("b").cast("double").alias("want"), (F.col("a") * 0.5 + 0.5).alias("w"))
    row, col = Window.partitionBy("frame_idx", "y").orderBy("x"), Window.partitionBy("frame_idx", "x").orderBy("y")
    pull = sum((F.coalesce(F.col("want") - f("want").over(w), F.lit(0.0)) for f in (F.lag, F.lead) for w in (row, col)), F.lit(0.0))
    got = L.relax_grid(src.withColumn("v", F.col("want") + 2 * 0.3 * 0.3 * pull / (F.col("w") * F.col("w"))), "v", weight="w", smooth=0.3, tile=32)
    both = src.select("frame_idx", "y", "x", "want").join(got, ["frame_idx", "y", "x"])
    return rounded(both.select("frame_idx", "y", "x", "want", F.round(F.col("v") - F.col("want"), 3).alias("error")), 4)


def _flow(t, sign=1.0):
    return t.pixels.select("frame_idx", "y", "x", (sign * (6 * F.col("g") - 3)).alias("fx"), (sign * (6 * F.col("r") - 3)).alias("fy"))


def _splatted(out: str, sign: float, t: float, radius: int, sigma2: float = 0.5625) -> str:
    """CTEs ending in ``out``: what lands on each pixel, folded in the order of the sources."""
    far = "0.33 * (r[1] * r[1] + r[2] * r[2] - s[1] * s[1] - s[2] * s[2])"
    w = f"((tanh({far}) * 0.5 + 0.5) * r[3])"
    fold = f"[r[1] * {w} + s[1] * (1 - {w}), r[2] * {w} + s[2] * (1 - {w}), greatest(least(s[3] + {w}, 1), 0)]"
    reach = f"range(-{radius}, {radius + 1})"
    return f"""{out}_s AS (SELECT frame_idx, y * 20 + x AS src, x, y, CAST({sign * t!r} AS DOUBLE) * (6 * g - 3) AS fx, CAST({sign * t!r} AS DOUBLE) * (6 * r - 3) AS fy FROM pixels),
{out}_t AS (SELECT frame_idx, src, fx, fy, x + fx AS px, y + fy AS py, CAST(trunc(x + fx) AS BIGINT) + i AS tx, CAST(trunc(y + fy) AS BIGINT) + j AS ty FROM {out}_s, {reach} a(i), {reach} b(j)),
{out}_l AS (SELECT frame_idx, ty AS y, tx AS x, list([-fx, -fy, exp(-0.5 * ((tx - px) * (tx - px) + (ty - py) * (ty - py)) / {sigma2})] ORDER BY src) AS l
FROM {out}_t WHERE tx BETWEEN 0 AND 19 AND ty BETWEEN 0 AND 19 GROUP BY ALL),
{out}_f AS (SELECT frame_idx, y, x, list_reduce(list_prepend(CAST([0, 0, 0] AS DOUBLE[]), l), lambda s, r: {fold}) AS s FROM {out}_l),
{out} AS (SELECT p.frame_idx, p.y, p.x, coalesce(s[1], 0) AS wx, coalesce(s[2], 0) AS wy, coalesce(s[3], 0) AS weight FROM pixels p LEFT JOIN {out}_f f USING (frame_idx, y, x))"""


@query("flow_splat", "pixels", f"WITH {_splatted('sp', 1.0, 0.5, 3)} SELECT {ID}, {rnd('wx; wy; weight')} FROM sp")
def _(t):
    return rounded(L.flow_splat(_flow(t), (20, 20), 0.5))


def _warped(out: str, splat: str, shift: int) -> str:
    """CTEs ending in ``out``: the picture ``shift`` frames on, read where the splat points to, with the cleaned weight."""
    corner = "CAST(floor({c}) AS BIGINT) + {k}"
    part = lambda c, k: f"(CASE WHEN {k} = 1 THEN {c} - floor({c}) ELSE 1 - ({c} - floor({c})) END)"
    return f"""{S.morph(splat, 'min', ['weight'], 1, f'{out}_e')}, {S.blur(f'{out}_e', ['weight'], 3, 0.5, 20, 20, f'{out}_c')},
{out}_q AS (SELECT frame_idx, y, x, weight, x + wx AS u, y + wy AS v FROM {out}_c),
{out}_k AS (SELECT frame_idx, y, x, {corner.format(c='u', k='i')} AS cx, {corner.format(c='v', k='j')} AS cy, {part('u', 'i')} * {part('v', 'j')} AS wt FROM {out}_q, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
{out}_g AS (SELECT k.frame_idx, k.y, k.x, {', '.join(f'coalesce(sum(wt * p.{c}), 0) AS {c}' for c in 'bgr')} FROM {out}_k k LEFT JOIN pixels p ON p.frame_idx = k.frame_idx + {shift} AND p.y = cy AND p.x = cx GROUP BY ALL),
{out} AS (SELECT g.*, q.weight FROM {out}_g g JOIN {out}_q q USING (frame_idx, y, x))"""


_MIXED = "; ".join(f"{c}=a.{c} * (w0 / (w0 + w1)) + z.{c} * (w1 / (w0 + w1))" for c in "bgr")


@query("blend_views", "pixels", f"""WITH {_splatted('s0', 1.0, 0.4, 1)}, {_splatted('s1', -1.0, 0.6, 1)}, {_warped('v0', 's0', 0)}, {_warped('v1', 's1', 1)},
w AS (SELECT a.frame_idx, a.y, a.x, 1e-6 + a.weight * CAST(0.6 AS DOUBLE) AS w0, 1e-6 + z.weight * CAST(0.4 AS DOUBLE) AS w1 FROM v0 a JOIN v1 z USING (frame_idx, y, x))
SELECT w.frame_idx, w.y, w.x, {rnd(_MIXED)} FROM w JOIN v0 a USING (frame_idx, y, x) JOIN v1 z USING (frame_idx, y, x)""")
def _(t):
    nxt = t.pixels.withColumn("frame_idx", F.col("frame_idx") - 1).where("frame_idx >= 0")
    s0, s1 = L.flow_splat(_flow(t), (20, 20), 0.4, radius=1), L.flow_splat(_flow(t, -1.0), (20, 20), 0.6, radius=1)
    return rounded(L.blend_views(t.pixels, nxt, s0, s1, (20, 20), 0.4, radius=1, tile=16))


def _brighten(pdf):
    return pdf.assign(b=pdf["b"] * 0.5 + 0.25)


@query("tiled_map", "pixels", f"SELECT {ID}, {rnd('want=b * 0.5 + 0.25; error=0')} FROM pixels")
def _(t):
    got = L.tiled_map(t.pixels, (20, 20), 8, 3, _brighten, ["b"]).withColumnRenamed("b", "got")
    j = t.pixels.select("frame_idx", "y", "x", (F.col("b") * 0.5 + 0.25).alias("want")).join(got, ["frame_idx", "y", "x"])
    return rounded(j.select("frame_idx", "y", "x", "want", F.round(F.col("got") - F.col("want"), 5).alias("error")))
