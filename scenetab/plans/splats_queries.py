"""Queries over splat tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenetab.operators import points as P
from scenetab.operators import splats as G
from scenetab.plans import sqltext as S
from scenetab.plans.points_queries import small_cams
from scenetab.plans.registry import query, rnd, rounded

ID = "frame_idx, splat_idx"
SIG = lambda e: f"(1 / (1 + exp(-({e}))))"
SC = lambda e: f"(1 - 7 * {SIG(e)})"

_WIRE = f"""wire AS (SELECT {ID}, CASE WHEN alive THEN x ELSE 0 END AS x, CASE WHEN alive THEN y ELSE 0 END AS y, CASE WHEN alive THEN z ELSE 0 END AS z,
CASE WHEN alive THEN {SIG('c2')} ELSE 0 END AS cr, CASE WHEN alive THEN {SIG('c1')} ELSE 0 END AS cg, CASE WHEN alive THEN {SIG('c0')} ELSE 0 END AS cb,
CASE WHEN alive THEN {SIG('alpha')} ELSE 0 END AS ca, CASE WHEN alive THEN {SC('s0')} ELSE 0 END AS e0, CASE WHEN alive THEN {SC('s1')} ELSE 0 END AS e1,
CASE WHEN alive THEN {SC('s2')} ELSE 0 END AS e2, CASE WHEN alive THEN q0 / sqrt(q0*q0+q1*q1+q2*q2+q3*q3) ELSE 1 END AS q0,
CASE WHEN alive THEN q1 / sqrt(q0*q0+q1*q1+q2*q2+q3*q3) ELSE 0 END AS q1, CASE WHEN alive THEN q2 / sqrt(q0*q0+q1*q1+q2*q2+q3*q3) ELSE 0 END AS q2,
CASE WHEN alive THEN q3 / sqrt(q0*q0+q1*q1+q2*q2+q3*q3) ELSE 0 END AS q3 FROM splats)"""
_W = "x; y; z; cr; cg; cb; ca; e0; e1; e2; q0; q1; q2; q3"


@query("splat_wire_form", "splats", f"WITH {_WIRE} SELECT {ID}, {rnd(_W)} FROM wire")
def _(t):
    return rounded(G.splat_wire_form(t.splats))


_LOGIT = lambda e: f"(ln(least(greatest({e}, 0.001), 0.999)) - ln(1 - least(greatest({e}, 0.001), 0.999)))"
_RAW = lambda e: _LOGIT(f"least(greatest((1 - {e}) / 7, 0.000001), 0.999999)")


@query("splat_model_form", "splats", f"""WITH {_WIRE} SELECT {ID}, {rnd(f'x; y; z; c2={_LOGIT("cr")}; c1={_LOGIT("cg")}; c0={_LOGIT("cb")}; alpha={_LOGIT("ca")}; s0={_RAW("e0")}; s1={_RAW("e1")}; s2={_RAW("e2")}; q0; q1; q2; q3')}, ca <> 0 AS alive FROM wire""")
def _(t):
    return rounded(G.splat_model_form(G.splat_wire_form(t.splats)))


_NIB = lambda e, k: f"((CAST(floor(least(greatest({e}, 0), 1) * 4095) AS BIGINT) >> {k}) & 15) * 16 + 8"
_ENC = f"""{_WIRE}, f1 AS (SELECT *, x / 5 AS fx_, y / 5 AS fy_, -z / 5 AS fz_, sqrt(x*x + y*y + z*z) / 5 AS m FROM wire),
f2 AS (SELECT *, 0.25 * (fx_ * k + 2) AS nx, 0.25 * (fy_ * k + 2) AS ny, 0.25 * (fz_ * k + 2) AS nz, greatest(abs(q0), abs(q1), abs(q2), abs(q3)) AS tq
FROM (SELECT *, CASE WHEN m < 1 THEN 1 ELSE (2 - 1 / m) / m END AS k FROM f1) q),
cells AS (SELECT frame_idx, splat_idx, unnest([{', '.join(_NIB(n, s) for n in ('nx', 'ny', 'nz') for s in (0, 4, 8))}, {', '.join(f'CAST(floor({c} * 255) AS BIGINT)' for c in ('cr', 'cg', 'cb', 'ca'))},
{', '.join(f'CAST(floor(least(greatest((1 - e{i}) / 7, 0), 1) * 255) AS BIGINT)' for i in range(3))}, {', '.join(f'CAST(floor(255 * ({s}q{i} / tq + 1) / 2) AS BIGINT)' for i, s in enumerate(('-', '', '', '-')))}]) AS value,
unnest(range(20)) AS k FROM f2)"""


@query("encode_splats", "splats", f"WITH {_ENC} SELECT frame_idx, CAST((splat_idx // 40) * 20 + k AS BIGINT) AS y, splat_idx % 40 AS x, CAST(value AS INTEGER) AS value FROM cells")
def _(t):
    return G.encode_splats(G.splat_wire_form(t.splats), 40, 500)


@query("decode_splats", "splats", f"""WITH {_ENC}, w AS (SELECT frame_idx, splat_idx, {', '.join(f'max(CASE WHEN k = {k} THEN value END) AS v{k}' for k in range(20))} FROM cells GROUP BY ALL),
p AS (SELECT *, 4 * ((v2 // 16 * 256 + v1 // 16 * 16 + v0 // 16) / 4095.0 - 0.5) AS ax, 4 * ((v5 // 16 * 256 + v4 // 16 * 16 + v3 // 16) / 4095.0 - 0.5) AS ay,
4 * ((v8 // 16 * 256 + v7 // 16 * 16 + v6 // 16) / 4095.0 - 0.5) AS az FROM w WHERE v12 <> 0),
m AS (SELECT *, sqrt(ax*ax + ay*ay + az*az) AS m FROM p), g AS (SELECT *, CASE WHEN m < 1 THEN 5 ELSE 5 / (m * (2 - m)) END AS g FROM m)
SELECT {ID}, {rnd('x=ax*g; y=ay*g; z=-az*g; cr=v9/255.0; cg=v10/255.0; cb=v11/255.0; ca=v12/255.0; e0=1-7*v13/255.0; e1=1-7*v14/255.0; e2=1-7*v15/255.0; q0=1-2*v16/255.0; q1=2*v17/255.0-1; q2=2*v18/255.0-1; q3=1-2*v19/255.0', 5)} FROM g""")
def _(t):
    return rounded(G.decode_splats(G.encode_splats(G.splat_wire_form(t.splats), 40, 500), 40), 5)


_TURN = [[0.8, 0.0, 0.6, 0.1], [0.0, 1.0, 0.0, -0.2], [-0.6, 0.0, 0.8, 0.3], [0.0, 0.0, 0.0, 1.0]]
_DIST = "sqrt((0.8*x + 0.6*z + 0.1)**2 + (y - 0.2)**2 + (-0.6*x + 0.8*z + 0.3)**2)"


@query("crop_sphere_zero", "splats", f"""SELECT {ID}, {rnd(f'x=CASE WHEN {_DIST} > 3 THEN 0 ELSE x END; alpha=CASE WHEN {_DIST} > 3 THEN 0 ELSE alpha END; q3=CASE WHEN {_DIST} > 3 THEN 0 ELSE q3 END')} FROM splats""")
def _(t):
    return rounded(G.crop_sphere(t.splats, _TURN, 3.0, "zero").select("frame_idx", "splat_idx", "x", "alpha", "q3"))


@query("crop_sphere_mark", "splats", f"SELECT {ID}, alive AND {_DIST} < 3 AS alive FROM splats")
def _(t):
    return G.crop_sphere(t.splats, _TURN, 3.0, "mark").select("frame_idx", "splat_idx", "alive")


@query("kill_nonfinite", "splats", f"""SELECT {ID}, {rnd('x=CASE WHEN splat_idx % 13 = 0 OR splat_idx % 17 = 0 THEN 0 ELSE x END; y=CASE WHEN splat_idx % 13 = 0 OR splat_idx % 17 = 0 THEN 0 ELSE y END')},
alive AND splat_idx % 13 <> 0 AND splat_idx % 17 <> 0 AS alive FROM splats""")
def _(t):
    bad = t.splats.withColumns(
        {
            "x": F.when(F.col("splat_idx") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("x")),
            "y": F.when(F.col("splat_idx") % 17 == 0, F.lit(float("-inf"))).otherwise(F.col("y")),
        }
    )
    return rounded(G.kill_nonfinite(bad).select("frame_idx", "splat_idx", "x", "y", "alive"))


@query("cull_splats", "splats views", f"""WITH {S.project('splats', 'views')},
w AS (SELECT frame_idx, splat_idx, zc, fx*xc/zc + cx AS u, -fy*yc/zc + cy AS v, width, height FROM pj),
s AS (SELECT frame_idx, splat_idx, coalesce(bool_or(zc > 0.01 AND u >= -width AND u < 2*width AND v >= -height AND v < 2*height), false)
AND NOT bool_or(zc > 0 AND zc < 0.01) AS vis FROM w GROUP BY ALL)
SELECT {ID}, alive AND {SIG('alpha')} > 0.05 AND least({SC('s0')}, {SC('s1')}, {SC('s2')}) > -6.65 AND grad > 1e-9 AND coalesce(vis, false) AS alive
FROM splats LEFT JOIN s USING ({ID})""")
def _(t):
    return G.cull_splats(t.splats, t.views).select("frame_idx", "splat_idx", "alive")


_KNN = """d AS (SELECT a.cloud_id, a.point_id, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d
FROM points a JOIN points b ON a.cloud_id = b.cloud_id AND a.point_id <> b.point_id AND abs(a.x - b.x) <= 0.31 AND abs(a.y - b.y) <= 0.31),
rk AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d) AS rn FROM d),
s2 AS (SELECT point_id, sum(d) / 3 AS m FROM rk WHERE rn <= 2 GROUP BY point_id HAVING count(*) = 2),
sp AS (SELECT p.*, least(greatest(coalesce(m, 0.1), 0.003), 0.1) AS spacing FROM points p LEFT JOIN s2 USING (point_id))"""
_SP = _RAW("least(greatest(ln(spacing), -7), 0)")


@query("init_splats", "points", f"""WITH {_KNN}, n AS (SELECT cloud_id, count(*) AS n FROM points GROUP BY ALL),
lv AS (SELECT cloud_id AS frame_idx, row_number() OVER (PARTITION BY cloud_id ORDER BY point_id) - 1 AS splat_idx, x, y, z, {_LOGIT('r')} AS c0, CAST(-1 AS DOUBLE) AS alpha, {_SP} AS s0, CAST(1 AS DOUBLE) AS q3, true AS alive FROM sp),
g AS (SELECT cloud_id, i, {S.h('(cloud_id * 1500 + i)', 71)} - 0.5 AS a, {S.h('(cloud_id * 1500 + i)', 72)} - 0.5 AS b, {S.h('(cloud_id * 1500 + i)', 73)} - 0.5 AS c FROM n, range(1500) r(i) WHERE i >= n),
al AS (SELECT * FROM lv UNION ALL SELECT cloud_id, i, 1000*a/sqrt(a*a+b*b+c*c), 1000*b/sqrt(a*a+b*b+c*c), 1000*c/sqrt(a*a+b*b+c*c), 0, -10, 0, 1, false FROM g)
SELECT {ID}, {rnd('x; y; z; c0; alpha; s0; q3', 5)}, alive FROM al""")
def _(t):
    return rounded(G.init_splats(t.points, "cloud_id", 1500, 71).select("frame_idx", "splat_idx", "x", "y", "z", "c0", "alpha", "s0", "q3", "alive"), 5)


@query("fill_dead_slots", "splats points", f"""WITH dd AS (SELECT {ID}, row_number() OVER (PARTITION BY frame_idx ORDER BY splat_idx) AS k FROM splats WHERE NOT alive),
nn AS (SELECT CAST(floor(point_id / 1000) AS BIGINT) AS frame_idx, row_number() OVER (PARTITION BY floor(point_id / 1000) ORDER BY point_id) AS k, x, {_LOGIT('r')} AS c0, {_RAW('ln(0.05)')} AS s0 FROM points),
pu AS (SELECT dd.frame_idx, dd.splat_idx, x, c0, s0 FROM dd JOIN nn USING (frame_idx, k))
SELECT s.frame_idx, s.splat_idx, {rnd('x=CASE WHEN p.x IS NOT NULL THEN p.x ELSE s.x END; c0=CASE WHEN p.x IS NOT NULL THEN p.c0 ELSE s.c0 END; s0=CASE WHEN p.x IS NOT NULL THEN p.s0 ELSE s.s0 END; alpha=CASE WHEN p.x IS NOT NULL THEN -1 ELSE s.alpha END')},
s.alive OR p.x IS NOT NULL AS alive FROM splats s LEFT JOIN pu p USING (frame_idx, splat_idx)""")
def _(t):
    new = t.points.withColumn("spacing", F.lit(0.05)).withColumn("frame_idx", F.floor(F.col("point_id") / 1000).cast("bigint"))
    return rounded(G.fill_dead_slots(t.splats, new).select("frame_idx", "splat_idx", "x", "c0", "s0", "alpha", "alive"))


def _jit(s: int) -> str:
    v = [f"(({S.h('(frame_idx * 1000003 + slot)', s + i)}) - 0.5) * 0.1 * exp(k{i})" for i in range(3)]
    rows = [("a*a - b*b - c*c + d*d", "2*(a*b - c*d)", "2*(a*c + b*d)"), ("2*(a*b + c*d)", "-a*a + b*b - c*c + d*d", "2*(b*c - a*d)"),
            ("2*(a*c - b*d)", "2*(b*c + a*d)", "-a*a - b*b + c*c + d*d")]
    return ", ".join(f"({rows[0][j]}) * {v[0]} + ({rows[1][j]}) * {v[1]} + ({rows[2][j]}) * {v[2]} AS o{s}{'xyz'[j]}" for j in range(3))


_IN = lambda e: f"least(greatest({e}, 1e-7), 1 - 1e-7)"
_LT = lambda e: f"ln({_IN(e)} / (1 - {_IN(e)}))"


_SPAWN = f"""WITH n AS (SELECT frame_idx, count(*) FILTER (WHERE alive) AS p, count(*) AS total FROM splats GROUP BY ALL),
m AS (SELECT frame_idx, p, greatest(0, least(least(950, 2 * p) - p, total - p)) AS m FROM n),
sl AS (SELECT frame_idx, splat_idx AS slot, row_number() OVER (PARTITION BY frame_idx ORDER BY CASE WHEN alive THEN {SIG('alpha')} ELSE 0 END, splat_idx) - 1 AS rk FROM splats),
pa AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY grad DESC, splat_idx) - 1 AS prk FROM splats WHERE alive),
pr AS (SELECT pa.*, sl.slot, q0/(qn+1e-6) AS a, q1/(qn+1e-6) AS b, q2/(qn+1e-6) AS c, q3/(qn+1e-6) AS d, {SC('s0')} AS k0, {SC('s1')} AS k1, {SC('s2')} AS k2
FROM sl JOIN m USING (frame_idx) JOIN (SELECT *, sqrt(q0*q0+q1*q1+q2*q2+q3*q3) AS qn FROM pa) pa ON pa.frame_idx = sl.frame_idx AND pa.prk = sl.rk % m.p WHERE sl.rk < m.m),
of_ AS (SELECT *, {_jit(81)}, {_jit(84)}, {_LT('(1 - (k0 - ln(1.1))) / 7')} AS n0, {_LT('(1 - (k1 - ln(1.1))) / 7')} AS n1 FROM pr),
pu AS (SELECT frame_idx, splat_idx, sum(o84x) AS ox, sum(o84y) AS oy, sum(o84z) AS oz, any_value(n0) AS n0, any_value(n1) AS n1 FROM of_ GROUP BY ALL),
ch AS (SELECT frame_idx, slot AS splat_idx, x + o81x AS x, y + o81y AS y, z + o81z AS z, n0, n1, c0, alpha FROM of_)"""


@query("spawn_splats", "splats", f"""{_SPAWN}
SELECT s.frame_idx, s.splat_idx, {rnd('x=coalesce(ch.x, s.x + coalesce(pu.ox, 0)); y=coalesce(ch.y, s.y + coalesce(pu.oy, 0)); z=coalesce(ch.z, s.z + coalesce(pu.oz, 0)); s0=coalesce(ch.n0, pu.n0, s.s0); s1=coalesce(ch.n1, pu.n1, s.s1); c0=coalesce(ch.c0, s.c0); alpha=coalesce(ch.alpha, s.alpha)')},
s.alive OR ch.x IS NOT NULL AS alive FROM splats s LEFT JOIN pu USING (frame_idx, splat_idx) LEFT JOIN ch USING (frame_idx, splat_idx)""")
def _(t):
    out = G.spawn_splats(t.splats, 950, 81)
    return rounded(out.select("frame_idx", "splat_idx", "x", "y", "z", "s0", "s1", "c0", "alpha", "alive"))


# two slots of three are held to the frame before
_HELD = """fl AS (SELECT s.frame_idx, s.splat_idx, s.splat_idx % 3 <> 0 AND s.alive AND ch.x IS NULL AND pu.ox IS NULL AS stabilize
FROM splats s LEFT JOIN pu USING (frame_idx, splat_idx) LEFT JOIN ch USING (frame_idx, splat_idx))"""


def _spawned(t):
    return G.spawn_splats(t.splats.withColumn("stabilize", F.col("splat_idx") % 3 != 0), 950, 81)


@query("spawn_flags", "splats", f"{_SPAWN}, {_HELD} SELECT frame_idx, splat_idx, stabilize FROM fl")
def _(t):
    return _spawned(t).select("frame_idx", "splat_idx", "stabilize")


@query("isolated_splats", "splats", f"""WITH b AS (SELECT frame_idx, abs(xor(xor(CAST(floor(x / 0.3) AS BIGINT) * 73856093, CAST(floor(y / 0.3) AS BIGINT) * 19349663), CAST(floor(z / 0.3) AS BIGINT) * 83492791)) AS hh, {SIG('alpha')} AS a FROM splats WHERE alive),
c AS (SELECT *, count(*) OVER (PARTITION BY frame_idx, hh) AS n FROM b)
SELECT frame_idx, {rnd('isolation=avg(CASE WHEN n = 1 THEN a ELSE 0 END)')}, count(*) FILTER (WHERE n = 1) AS isolated FROM c GROUP BY frame_idx""")
def _(t):
    return rounded(G.isolated_splats(t.splats, 0.3))


def _covariance(cams: str, near: str) -> str:
    """CTE ``ps``: 2x2 covariance by way of the full 3x3 one."""
    keep = "p.frame_idx, p.splat_idx, p.alpha, p.c0, p.c1, p.c2, p.s0, p.s1, p.s2, p.q0/p.qn AS a, p.q1/p.qn AS b, p.q2/p.qn AS c, p.q3/p.qn AS d, c.r00, c.r01, c.r02, c.r10, c.r11, c.r12, c.r20, c.r21, c.r22"
    m = [["a*a-b*b-c*c+d*d", "2*(a*b-c*d)", "2*(a*c+b*d)"], ["2*(a*b+c*d)", "-a*a+b*b-c*c+d*d", "2*(b*c-a*d)"], ["2*(a*c-b*d)", "2*(b*c+a*d)", "-a*a-b*b+c*c+d*d"]]
    mm = ", ".join(f"({m[i][j]}) * exp({SC(f's{j}')}) AS m{i}{j}" for i in range(3) for j in range(3))
    sig = ", ".join(f"m{i}0*m{j}0 + m{i}1*m{j}1 + m{i}2*m{j}2 AS g{i}{j}" for i in range(3) for j in range(i, 3))
    tt = ", ".join(f"fx/zc*r0{j} - fx*xc/(zc*zc)*r2{j} AS t0{j}, -fy/zc*r1{j} + fy*yc/(zc*zc)*r2{j} AS t1{j}" for j in range(3))
    g = lambda i, j: f"g{min(i, j)}{max(i, j)}"
    cov = lambda p, q: " + ".join(f"t{p}{i}*{g(i, j)}*t{q}{j}" for i in range(3) for j in range(3))
    return f"""al AS (SELECT *, sqrt(q0*q0+q1*q1+q2*q2+q3*q3) AS qn FROM splats WHERE alive), rc AS (SELECT * FROM {cams} WHERE cam_model = 'rectilinear'),
{S.project('al', 'rc', keep)}, p1 AS (SELECT *, {mm}, {tt} FROM pj WHERE zc >= {near}), p2 AS (SELECT *, {sig} FROM p1),
p3 AS (SELECT *, {cov(0, 0)} AS cov00, {cov(0, 1)} AS cov01, {cov(1, 1)} AS cov11 FROM p2),
ps AS (SELECT frame_idx, splat_idx, cam_idx, width, height, u, v, zc AS depth, cov00, cov01, cov11, {SIG('alpha')} AS opacity, {SIG('c0')} AS col0, {SIG('c1')} AS col1, {SIG('c2')} AS col2,
3 * sqrt((cov00 + cov11) / 2 + sqrt(((cov00 - cov11) / 2)**2 + cov01*cov01)) AS radius FROM p3)"""


@query("project_splats", "splats cams", f"""WITH {_covariance('cams', '0.1')} SELECT {ID}, cam_idx, {rnd('u; v; depth; radius; cov00; cov01; cov11', 2)} FROM ps""")
def _(t):
    out = G.project_splats(t.splats, t.cams)
    return rounded(out.select("frame_idx", "splat_idx", "cam_idx", "u", "v", "depth", "radius", "cov00", "cov01", "cov11"), 2)


_TOUCH = "radius > 0 AND u + radius > 0 AND u - radius < width AND v + radius > 0 AND v - radius < height"
_TILED = f"""{S.SMALL}, {_covariance('small', '0.1')}, tl AS (SELECT ps.*, ty.i AS ty, tx.i AS tx FROM ps, range(3) ty(i), range(3) tx(i) WHERE {_TOUCH}
AND ty.i BETWEEN floor((v - radius) / 8) AND floor((v + radius) / 8) AND tx.i BETWEEN floor((u - radius) / 8) AND floor((u + radius) / 8)),
tr AS (SELECT *, row_number() OVER (PARTITION BY frame_idx, cam_idx, ty, tx ORDER BY depth, splat_idx) - 1 AS draw_order FROM tl)"""


@query("splats_in_tiles", "splats cams", f"WITH {_TILED} SELECT {ID}, cam_idx, ty, tx, draw_order FROM tr")
def _(t):
    out = G.splats_in_tiles(G.project_splats(t.splats, small_cams(t)), 8)
    return out.select("frame_idx", "splat_idx", "cam_idx", "ty", "tx", "draw_order")


@query("composite_tiles", "splats cams", f"""WITH {_TILED}, px AS (SELECT tr.*, ty * 8 + a.i AS y, tx * 8 + b.i AS x, ty * 8 + a.i + 0.5 - v AS dy, tx * 8 + b.i + 0.5 - u AS dx,
cov00 * cov11 - cov01 * cov01 AS det FROM tr, range(8) a(i), range(8) b(i) WHERE ty * 8 + a.i < 20 AND tx * 8 + b.i < 20),
al2 AS (SELECT *, least(0.999, opacity * exp(-0.5 * (cov11*dx*dx - 2*cov01*dx*dy + cov00*dy*dy) / det)) AS al FROM px WHERE det > 0),
w AS (SELECT *, al * coalesce(exp(sum(ln(1 - al)) OVER (PARTITION BY frame_idx, cam_idx, y, x ORDER BY draw_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS w FROM al2 WHERE al >= 1 / 255.0)
SELECT frame_idx, cam_idx, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, {rnd('col0=sum(w*col0); depth=sum(w*depth); coverage=sum(w)', 4)} FROM w GROUP BY frame_idx, cam_idx, y, x""")
def _(t):
    out = G.composite_tiles(G.splats_in_tiles(G.project_splats(t.splats, small_cams(t)), 8), 8)
    return rounded(out.select("frame_idx", "cam_idx", "y", "x", "col0", "depth", "coverage"), 4)


@query("splat_health", "splats cams", f"""WITH fc AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY cam_idx) AS rn FROM cams WHERE cam_model = 'rectilinear') q WHERE rn = 1),
{_covariance('fc', '0.01')}, nf AS (SELECT frame_idx, sum(opacity) AS s FROM ps WHERE {_TOUCH} AND depth > 0.01 AND depth < 0.5 GROUP BY ALL),
b AS (SELECT *, {SIG('alpha')} AS a, sqrt(x*x+y*y+z*z) AS nn, exp(greatest({SC('s0')}, {SC('s1')}, {SC('s2')}) - least({SC('s0')}, {SC('s1')}, {SC('s2')})) AS ra FROM splats)
SELECT b.frame_idx, count(*) FILTER (WHERE alive) AS n_alive, {rnd('mean_alpha=avg(a) FILTER (WHERE alive); scale_excess=avg(greatest(ra - 4, 0)) FILTER (WHERE alive); far_excess=avg(greatest(nn - 1000, 0)**2) FILTER (WHERE alive); near_floaters=coalesce(any_value(nf.s), 0) / count(*)')},
CAST(0 AS BIGINT) AS n_nonfinite FROM b LEFT JOIN nf USING (frame_idx) GROUP BY b.frame_idx""")
def _(t):
    return rounded(G.splat_health(t.splats, G.first_camera(t.cams)))


def _sl1(cur: list[str]) -> str:
    one = [f"(CASE WHEN abs({e.replace('#', 'c.')} - {e.replace('#', 'p.')}) < 1 THEN 0.5 * ({e.replace('#', 'c.')} - {e.replace('#', 'p.')})**2 ELSE abs({e.replace('#', 'c.')} - {e.replace('#', 'p.')}) - 0.5 END)" for e in cur]
    return f"avg(({' + '.join(one)}) / {len(cur)})"


_DRIFT = f"""{rnd('pos_drift=' + _sl1(['#x', '#y', '#z']) + '; color_drift=' + _sl1([SIG('#c0'), SIG('#c1'), SIG('#c2')]) + '; alpha_drift=' + _sl1([SIG('#alpha')]) + '; scale_drift=' + _sl1([SC('#s0'), SC('#s1'), SC('#s2')]) + '; quat_drift=' + _sl1(['#q0', '#q1', '#q2', '#q3']))}"""


@query("splat_drift", "splats", f"""SELECT c.frame_idx, {_DRIFT}
FROM splats c JOIN splats p ON p.splat_idx = c.splat_idx AND p.frame_idx = c.frame_idx - 1 WHERE c.alive GROUP BY c.frame_idx""")
def _(t):
    return rounded(G.splat_drift(t.splats))


@query("splat_drift_held", "splats", f"""{_SPAWN}, {_HELD} SELECT c.frame_idx, {_DRIFT}
FROM splats c JOIN fl USING (frame_idx, splat_idx) JOIN splats p ON p.splat_idx = c.splat_idx AND p.frame_idx = c.frame_idx - 1 WHERE stabilize GROUP BY c.frame_idx""")
def _(t):
    """Drift over the slots that the population step leaves as they are."""
    held = _spawned(t).select("frame_idx", "splat_idx", "stabilize")
    return rounded(G.splat_drift(t.splats.join(held, ["frame_idx", "splat_idx"]), "stabilize"))


@query("norm_summary", "splats", f"""WITH l AS (SELECT 'pos' AS attr, sqrt(x*x+y*y+z*z) AS n FROM splats WHERE alive UNION ALL SELECT 'quat', sqrt(q0*q0+q1*q1+q2*q2+q3*q3) FROM splats WHERE alive
UNION ALL SELECT 'alpha', abs(alpha) FROM splats WHERE alive) SELECT attr, {rnd('max_norm=max(n); min_norm=min(n); mean_norm=avg(n)')} FROM l GROUP BY attr""")
def _(t):
    return rounded(G.norm_summary(t.splats, {"pos": G.XYZ, "quat": G.QUAT, "alpha": ["alpha"]}))


@query("spacing_of_points", "points", f"WITH {_KNN} SELECT cloud_id, {rnd('mean_spacing=avg(spacing)')}, count(*) AS n FROM sp GROUP BY cloud_id")
def _(t):
    sp = P.knn_spacing(t.points, ["cloud_id"])
    return rounded(sp.groupBy("cloud_id").agg(F.avg("spacing").alias("mean_spacing"), F.count(F.lit(1)).alias("n")))
