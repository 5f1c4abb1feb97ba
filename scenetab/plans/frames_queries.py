"""Queries over stacks of pixel frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenetab.functions.session import broadcast_if_small
from scenetab.operators import frames as R
from scenetab.operators import stencil as ST
from scenetab.plans import sqltext as S
from scenetab.plans.registry import Tables, query, rnd, rounded

SIZE = (20, 20)
TILE = 8
ID = "frame_idx, y, x"


def P(t: Tables, *cols: str):
    return t.pixels.select("frame_idx", "y", "x", *cols) if cols else t.pixels


@query("stride_frames", "pixels", f"SELECT {ID}, {rnd('invd')} FROM pixels WHERE frame_idx % 3 = 0 AND frame_idx BETWEEN 1 AND 20")
def _(t):
    return rounded(R.stride_frames(P(t, "invd"), 3, 1, 20))


_OFFS = "SELECT n_regionkey AS scene_id, n_nationkey AS cam_idx, n_nationkey % 3 AS off FROM nation"


@query("sync_frames", "", f"""WITH c AS ({_OFFS}), f AS (SELECT DISTINCT c.scene_id, c.cam_idx, event_id // 100 AS fr FROM events JOIN c
ON event_id % 25 = c.cam_idx), s AS (SELECT c.scene_id, f.fr - c.off AS t, count(*) AS n FROM f JOIN c USING (scene_id, cam_idx)
WHERE f.fr >= c.off GROUP BY ALL), g AS (SELECT scene_id, count(*) AS k FROM c GROUP BY ALL),
full_ AS (SELECT s.*, row_number() OVER (PARTITION BY s.scene_id ORDER BY t) - 1 AS rk FROM s JOIN g USING (scene_id) WHERE n = k)
SELECT CAST(scene_id AS BIGINT) AS scene_id, CAST(t AS BIGINT) AS t, n AS n_cams FROM full_ WHERE rk = t""")
def _(t):
    cams = t.nation.select(
        F.col("n_regionkey").cast("bigint").alias("scene_id"), F.col("n_nationkey").cast("bigint").alias("cam_idx"),
        (F.col("n_nationkey") % 3).alias("time_offset_frames"),
    )
    frames = t.events.select(
        (F.col("event_id") % 25).alias("cam_idx"), F.floor(F.col("event_id") / 100).alias("frame_idx")
    ).distinct().join(broadcast_if_small(cams.select("scene_id", "cam_idx")), "cam_idx")
    return R.sync_frames(frames, cams)


for _op, _fn in (("erode", "min"), ("dilate", "max"), ("box", "avg")):

    _SQL = f"WITH {S.morph('pixels', _fn, ['invd', 'b'], 3, 'm')} SELECT {ID}, {rnd('invd; b', 9)} FROM m"
    if _op == "box":
        _SQL = f"""SELECT p.frame_idx, p.y, p.x, {rnd('invd=avg(q.invd); b=avg(q.b)', 9)} FROM pixels p JOIN pixels q ON q.frame_idx = p.frame_idx
        AND q.y BETWEEN p.y - 3 AND p.y + 3 AND q.x BETWEEN p.x - 3 AND p.x + 3 GROUP BY p.frame_idx, p.y, p.x"""

    @query(f"{_op}_frames", "pixels", _SQL)
    def _(t, op=_op):
        return rounded(R.morphology(P(t), op, ["invd", "b"], 3, tile=TILE), 9)


@query("gaussian_blur", "pixels", f"WITH {S.blur('pixels', ['invd', 'g'], 5, 1.5, 20, 20, 'bl')} SELECT {ID}, {rnd('invd; g')} FROM bl")
def _(t):
    return rounded(R.gaussian_blur(P(t), ["invd", "g"], 5, 1.5, SIZE, tile=TILE))


@query("median3", "pixels", f"WITH {S.median('pixels', 'invd', 20, 20, 'md')} SELECT {ID}, {rnd('invd')} FROM md")
def _(t):
    return rounded(R.median3(P(t), ["invd"], SIZE, tile=TILE))


@query("shrink_frames", "pixels", f"WITH {S.shrink('pixels', ['invd', 'b'], 4, 'sh')} SELECT {ID}, {rnd('invd; b', 9)} FROM sh")
def _(t):
    return rounded(ST.shrink(P(t), ["frame_idx"], ["invd", "b"], 4), 9)


@query("enlarge_frames", "pixels", f"""WITH {S.enlarge('pixels', ['invd', 'b'], 3, 20, 20, 'en')}
SELECT frame_idx, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, {rnd('invd; b')} FROM en""")
def _(t):
    return rounded(ST.enlarge(P(t), ["frame_idx"], ["invd", "b"], 3, SIZE, tile=TILE))


@query("stabilize_depth", "pixels", f"""WITH pr AS (SELECT a.frame_idx, b.frame_idx AS nb, a.y, a.x,
greatest(0, tanh(5 * (abs(a.b - b.b) + abs(a.g - b.g) + abs(a.r - b.r)) - 0.3)) AS d, b.invd AS nd
FROM pixels a JOIN pixels b ON b.y = a.y AND b.x = a.x AND b.frame_idx <> a.frame_idx AND abs(b.frame_idx - a.frame_idx) <= 3),
{S.morph('pr', 'max', ['d'], 2, 'dl', 'frame_idx, nb')}, {S.blur('dl', ['d'], 3, 2.0, 20, 20, 'bl', 'frame_idx, nb')},
w AS (SELECT *, least(greatest(1 - d, 0.001), 1) AS w FROM bl),
s AS (SELECT frame_idx, y, x, sum(w) AS sw, sum(w * nd) AS sv FROM w GROUP BY ALL)
SELECT p.frame_idx, p.y, p.x, {rnd('invd=(p.invd + coalesce(sv, 0)) / (1 + coalesce(sw, 0))')} FROM pixels p LEFT JOIN s USING (frame_idx, y, x)""")
def _(t):
    return rounded(R.stabilize_depth(P(t), SIZE, radius=3, dilate=2, blur_size=3, block=8, tile=16))


@query("stabilize_fill", "pixels", f"""SELECT p.frame_idx, p.y, p.x, {rnd('invd=(p.invd + coalesce(sum(q.a * q.invd), 0)) / (1 + coalesce(sum(q.a), 0)); b=(p.b + coalesce(sum(q.a * q.b), 0)) / (1 + coalesce(sum(q.a), 0))')}
FROM pixels p LEFT JOIN pixels q ON q.y = p.y AND q.x = p.x AND q.frame_idx <> p.frame_idx AND abs(q.frame_idx - p.frame_idx) <= 13
GROUP BY p.frame_idx, p.y, p.x, p.invd, p.b""")
def _(t):
    return rounded(R.stabilize_fill(P(t), ["invd", "b"], "a", 13, block=32))


def _scores_sql(new: bool) -> str:
    parts, keep, joins = [], [], []
    for i, (k, src, h) in enumerate([(3, "pixels", 20), (5, "pixels", 20), (3, "small", 5)]):
        base = f"k{i}"
        parts += [
            f"{base} AS (SELECT frame_idx, y, x, invd, invd AS lo, invd AS hi FROM {src})",
            S.morph(base, "min", ["lo"], k, f"{base}e"), S.morph(f"{base}e", "max", ["hi"], k, f"{base}d"),
            S.blur(f"{base}d", ["lo", "hi"], k, k / 2.0, h, h, f"{base}b"),
            f"{base}f AS (SELECT frame_idx, y, x, invd - lo AS md, hi - invd AS bg, hi - lo AS sc, invd - lo AS m_, hi - invd AS b_ FROM {base}b)",
            S.morph(f"{base}f", "min", ["m_", "b_"], 2, f"{base}g"),
            f"{base}h AS (SELECT frame_idx, y, x, md, bg, sc, sqrt(m_ * b_ + 0.001) AS fg FROM {base}g)",
        ]
        last = f"{base}h"
        if src == "small":
            parts.append(S.enlarge(last, ["md", "bg", "sc", "fg"], 4, 5, 5, f"{base}z"))
            last = f"{base}z"
        keep.append(last)
    far = "greatest(0, 1 - 20 * p.invd)"
    j = "pixels p " + " ".join(f"JOIN {n} t{i} ON t{i}.frame_idx = p.frame_idx AND t{i}.y = p.y AND t{i}.x = p.x" for i, n in enumerate(keep))
    add = lambda e: " + ".join(e.replace("#", f"t{i}") for i in range(3))
    if new:
        fg, md = add("#.fg * (0.01 + 0.3 / (#.sc + 0.01))"), add("#.md * (0.5 + 0.5 / (#.sc + 0.01))")
        bg = add(f"#.bg * (0.6 + 0.6 / (#.sc + 0.01)) + {far} * 0.5")
    else:
        fg, bg, md = add("#.md / (#.sc + 0.01)"), add("#.bg / (#.sc + 0.01)"), "3.0"
    s, eps = (2, "0") if new else (4, "0.000001")
    return f"""WITH {S.shrink('pixels', ['invd'], 4, 'small')}, {', '.join(parts)},
    q AS (SELECT p.frame_idx, p.y, p.x, exp({s} * ({fg})) AS f, exp({s} * ({bg})) AS b, exp({s} * ({md})) AS m FROM {j}),
    sc AS (SELECT frame_idx, y, x, f / (f + b + m + {eps}) AS s_top, m / (f + b + m + {eps}) AS s_mid, b / (f + b + m + {eps}) AS s_bot FROM q)"""


def _scores(t, variant="new"):
    return R.three_layer_scores(P(t), SIZE, kernels=(3, 5, 12), big=10, shrink=4, variant=variant, tile=16)


for _v in ("new", "old"):

    @query(f"three_layer_scores_{_v}", "pixels", f"{_scores_sql(_v == 'new')} SELECT {ID}, {rnd('s_top; s_mid; s_bot', 5)} FROM sc")
    def _(t, v=_v):
        return rounded(_scores(t, v), 5)


_EDGE = """CASE WHEN (x-10)*(x-10) + (y-9)*(y-9) > 81 THEN 0 ELSE (1 - least(greatest((sqrt((x-10)*(x-10) + (y-9)*(y-9)) / 9 - 0.8) / 0.1, 0), 1))
* least(greatest(tanh(10 * ({d}) - 0.1), 0), 1) END"""


@query("depth_edges", "pixels", f"""WITH k AS (SELECT frame_idx, y, x, invd, invd AS lo, invd AS hi FROM pixels),
{S.morph('k', 'min', ['lo'], 2, 'e')}, {S.morph('e', 'max', ['hi'], 2, 'd')},
g AS (SELECT frame_idx, y, x, {_EDGE.format(d='invd - lo')} AS eh, {_EDGE.format(d='hi - invd')} AS el FROM d),
{S.morph('g', 'min', ['eh', 'el'], 1, 'g2')}, {S.blur('g2', ['eh', 'el'], 3, 1.0, 20, 20, 'g3')}
SELECT {ID}, {rnd('edge_hi=least(greatest(eh - el, 0), 1); edge_lo=least(greatest(el - eh, 0), 1)')} FROM g3""")
def _(t):
    return rounded(R.depth_edges(P(t), SIZE, 10.0, 9.0, 9.0, k=2, tile=16))


_SHARP = "(tanh(10 * ({e})) + 1) * 0.5"
_AL = f"""WITH sc0 AS (SELECT frame_idx, y, x, a AS s_top, (1 - a) * g AS s_mid, (1 - a) * (1 - g) AS s_bot FROM pixels),
sc1 AS (SELECT *, {_SHARP.format(e='s_top - (s_mid + s_bot)')} AS a2 FROM sc0),
sc AS (SELECT *, {_SHARP.format(e='(1 - s_bot) - (1 - (a2 + s_mid))')} AS a1 FROM sc1),
{S.median('sc', 'a2', 20, 20, 'ma')}, {S.median('ma', 'a1', 20, 20, 'mb')},
th AS (SELECT *, CAST(a2 > 0.999 AS INTEGER) AS m1, CAST(a1 > 0.999 AS INTEGER) AS m0 FROM mb),
{S.morph('th', 'max', ['m1', 'm0'], 2, 'th2')}, th3 AS (SELECT *, CAST(m1 AS DOUBLE) AS b1, CAST(m0 AS DOUBLE) AS b0 FROM th2),
{S.blur('th3', ['b1', 'b0'], 5, 2.0, 20, 20, 'th4')},
tr AS (SELECT *, tanh(10 * (0.5 - abs(a1 - 0.5))) AS t1, tanh(10 * (0.5 - abs(a2 - 0.5))) AS t2,
greatest(0, tanh(7 * (greatest(s_top, s_mid, s_bot) - least(s_top, s_mid, s_bot) - 0.7))) AS pu FROM th4),
{S.morph('tr', 'min', ['t1', 't2'], 1, 'tr2')}, {S.morph('tr2', 'max', ['t1', 't2'], 3, 'tr3')},
{S.blur('tr3', ['t1', 't2'], 3, 1.0, 20, 20, 'tr4')}, {S.morph('tr4', 'max', ['pu'], 3, 'tr5')},
tr6 AS (SELECT * REPLACE (greatest(0, b1 - 3 * greatest(0, t2 - 1.1 * pu)) AS b1, greatest(0, b0 - 3 * greatest(0, t1 - 1.1 * pu)) AS b0) FROM tr5),
{S.morph('tr6', 'min', ['a2', 'a1'], 1, 'f1')}, {S.blur('f1', ['a2', 'a1'], 3, 1.0, 20, 20, 'f2')}
SELECT {ID}, {rnd('l1_alpha=a1; l2_alpha=a2; l0_mask=m0; l1_mask=m1; l0_blend=b0; l1_blend=b1', 5)} FROM f2"""


@query("layer_alphas", "pixels", _AL)
def _(t):
    scores = P(t).select(
        "frame_idx", "y", "x", F.col("a").alias("s_top"), ((1 - F.col("a")) * F.col("g")).alias("s_mid"),
        ((1 - F.col("a")) * (1 - F.col("g"))).alias("s_bot"),
    )
    return rounded(R.layer_alphas(scores, SIZE, 2, tile=16, spread=3), 5)


def _painted(t):
    red = F.col("a") > 0.8
    paint = {"b": F.when(red, 0.0).otherwise(F.col("b")), "g": F.when(red, 0.0).otherwise(F.col("g")), "r": F.when(red, 1.0).otherwise(F.col("r"))}
    return P(t).withColumns(paint)


@query("red_mask", "pixels", f"SELECT {ID}, a > 0.8 AS \"ignore\" FROM pixels")
def _(t):
    return R.red_mask(_painted(t)).select("frame_idx", "y", "x", "ignore")


@query("apply_mask", "pixels", f"SELECT {ID}, {rnd('invd=CASE WHEN a > 0.8 THEN 0 ELSE invd END')} FROM pixels")
def _(t):
    return rounded(R.apply_mask(P(t, "invd"), R.red_mask(_painted(t)), ["frame_idx"], ["invd"]))


_PSNR = """WITH m AS (SELECT p.frame_idx, avg((p.b - q.b)**2 + (p.g - q.g)**2 + (p.r - q.r)**2) / 3 AS mse FROM pixels p
JOIN pixels q ON q.frame_idx = p.frame_idx + 1 AND q.y = p.y AND q.x = p.x GROUP BY p.frame_idx),
ps AS (SELECT frame_idx, mse, 20 * log10(1 / sqrt(mse)) AS psnr FROM m)"""


def _psnr(t):
    nxt = P(t, "b", "g", "r").withColumn("frame_idx", F.col("frame_idx") - 1)
    return R.image_psnr(P(t, "b", "g", "r"), nxt, ["b", "g", "r"])


@query("image_psnr", "pixels", f"{_PSNR} SELECT frame_idx, {rnd('mse; psnr')} FROM ps")
def _(t):
    return rounded(_psnr(t))


@query("mean_psnr", "pixels", f"{_PSNR} SELECT {rnd('psnr=avg(psnr)')}, count(*) AS images FROM ps")
def _(t):
    return rounded(R.mean_psnr(_psnr(t)))


@query("depth_bands", "pixels", f"""WITH i AS (SELECT * FROM pixels WHERE (x-10)*(x-10) + (y-10)*(y-10) <= 81 * 0.9),
o AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY invd) - 1 AS rn, count(*) OVER (PARTITION BY frame_idx) AS n FROM i),
m AS (SELECT frame_idx, max(CASE WHEN rn = 0 THEN invd END) AS p0, max(CASE WHEN rn = floor(0.1 * n) THEN invd END) AS p10,
max(CASE WHEN rn = floor(0.9 * n) THEN invd END) AS p90, max(invd) AS p100 FROM o GROUP BY frame_idx)
SELECT i.frame_idx, i.y, i.x, {rnd('bottom_weight=CASE WHEN abs(p10 - p0) < 0.001 THEN CAST(invd <= p10 AS INTEGER) ELSE least(greatest((p10 - invd) / (p10 - p0), 0), 1) END; top_weight=CASE WHEN abs(p90 - p100) < 0.001 THEN CAST(invd >= p90 AS INTEGER) ELSE least(greatest((invd - p90) / (p100 - p90), 0), 1) END')}
FROM i JOIN m USING (frame_idx)""")
def _(t):
    return rounded(R.depth_bands(P(t), 10.0, 10.0, 9.0))


@query("fit_scale_bias", "pixels", f"""WITH s AS (SELECT frame_idx, least(greatest(a * 5, 0.01), 1000) AS m, least(greatest(3 * invd + a, 0.01), 1000) AS d FROM pixels
WHERE 3 * invd + a > 0.01), f1 AS (SELECT frame_idx, covar_pop(m, d) / var_pop(m) AS k, avg(d) - covar_pop(m, d) / var_pop(m) * avg(m) AS c FROM s GROUP BY ALL),
e AS (SELECT s.*, abs(k * m + c - d) AS r FROM s JOIN f1 USING (frame_idx)),
o AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY r) AS rn, count(*) OVER (PARTITION BY frame_idx) AS n FROM e),
t AS (SELECT frame_idx, max(r) AS cut FROM o WHERE rn <= floor(0.9 * n) GROUP BY ALL),
f2 AS (SELECT e.frame_idx, covar_pop(m, d) / var_pop(m) AS k, avg(d) - covar_pop(m, d) / var_pop(m) * avg(m) AS c FROM e JOIN t USING (frame_idx) WHERE r <= cut GROUP BY ALL)
SELECT s.frame_idx, {rnd('scale=any_value(k); bias=any_value(c); error=avg(abs(k * m + c - d))')} FROM s JOIN f2 USING (frame_idx) GROUP BY s.frame_idx""")
def _(t):
    src = P(t).withColumns({"mono": F.col("a") * 5, "render": 3 * F.col("invd") + F.col("a")})
    return rounded(R.fit_scale_bias(src, SIZE))


@query("ordinal_depth_score", "pixels", f"""WITH fr AS (SELECT DISTINCT frame_idx FROM pixels),
d AS (SELECT frame_idx, CAST(floor({S.h('(frame_idx * 300 + k)', 51)} * 400) AS BIGINT) AS i, CAST(floor({S.h('(frame_idx * 300 + k)', 52)} * 400) AS BIGINT) AS j FROM fr, range(300) g(k)),
p AS (SELECT frame_idx, y * 20 + x AS p, invd, a FROM pixels)
SELECT d.frame_idx, {rnd('score=avg(abs(tanh(a.a - b.a) - CASE WHEN a.invd > b.invd THEN 1 ELSE -1 END))')} FROM d
JOIN p a ON a.frame_idx = d.frame_idx AND a.p = d.i JOIN p b ON b.frame_idx = d.frame_idx AND b.p = d.j GROUP BY d.frame_idx""")
def _(t):
    src = P(t).select("frame_idx", "y", "x", F.col("invd").alias("pred"), F.col("a").alias("render"))
    return rounded(R.ordinal_depth_score(src, SIZE, 300, 51))


@query("smoothness_score", "pixels", f"""WITH s AS (SELECT p.frame_idx, p.y, p.x, any_value(p.invd) AS c, sum(q.invd) AS s FROM pixels p JOIN pixels q
ON q.frame_idx = p.frame_idx AND abs(q.y - p.y) <= 2 AND abs(q.x - p.x) <= 2 GROUP BY ALL)
SELECT frame_idx, {rnd('smoothness=avg(abs(25 * c - s))', 9)} FROM s GROUP BY frame_idx""")
def _(t):
    return rounded(R.smoothness_score(P(t), "invd", tile=TILE), 9)


@query("alpha_attenuate", "pixels", f"SELECT {ID}, {rnd('invd=invd * (1 - exp(-10 * a))')} FROM pixels")
def _(t):
    return rounded(R.alpha_attenuate(P(t)).select("frame_idx", "y", "x", "invd"))


@query("feather_alpha", "pixels", f"WITH {S.morph('pixels', 'min', ['a'], 3, 'e')}, {S.blur('e', ['a'], 3, 1.0, 20, 20, 'f')} SELECT {ID}, {rnd('a; b')} FROM f")
def _(t):
    return rounded(R.feather_alpha(P(t), 3, SIZE, tile=TILE).select("frame_idx", "y", "x", "a", "b"))


_ANG = f"({S.PI} - {S.PI} * ({{c}}) / 20) - {S.PI} / 2"


@query("disparity_to_depth", "pixels", f"""WITH g AS (SELECT frame_idx, y, x, {_ANG.format(c='x + 3 * invd + 0.1')} AS l, {_ANG.format(c='x')} AS r FROM pixels),
i AS (SELECT *, least(greatest(sin(r - l) / (0.065 * cos(l)), 0.001), 10000) AS inv FROM g)
SELECT {ID}, {rnd('inv_depth=inv; stored=least(greatest(inv * 0.1, 0), 1)', 4)} FROM i""")
def _(t):
    src = P(t).select("frame_idx", "y", "x", (3 * F.col("invd") + 0.1).alias("disparity"))
    return rounded(R.disparity_to_depth(src, 20, 0.065).select("frame_idx", "y", "x", "inv_depth", "stored"), 4)


@query("mono_depth", "pixels", f"SELECT {ID}, {rnd('mono_depth=least(greatest(10 / (3 * invd + 0.1), 0.1), 50)')} FROM pixels")
def _(t):
    src = P(t).select("frame_idx", "y", "x", (3 * F.col("invd") + 0.1).alias("disparity"))
    return rounded(R.mono_depth(src).drop("disparity"))


@query("bilateral", "pixels", f"""WITH w AS (SELECT p.frame_idx, p.y, p.x, p.b AS pb, p.g AS pg, p.r AS pr, q.b, q.g, q.r,
exp(-((q.x-p.x)**2 + (q.y-p.y)**2) / (2 * 1.5**2)) * exp(-((q.b-p.b)**2 + (q.g-p.g)**2 + (q.r-p.r)**2) / (2 * 0.3**2)) AS w
FROM pixels p JOIN pixels q ON q.frame_idx = p.frame_idx AND abs(q.y - p.y) <= 2 AND abs(q.x - p.x) <= 2)
SELECT frame_idx, y, x, {rnd('b=0.25 * any_value(pb) + 0.75 * sum(w * b) / sum(w); g=0.25 * any_value(pg) + 0.75 * sum(w * g) / sum(w); r=0.25 * any_value(pr) + 0.75 * sum(w * r) / sum(w)')} FROM w GROUP BY frame_idx, y, x""")
def _(t):
    return rounded(R.bilateral(P(t), 2, 1.5, 0.3, 0.75, tile=TILE))


@query("split_stereo", "pixels", "SELECT frame_idx, y, CASE WHEN x < 10 THEN x ELSE x - 10 END AS x, CASE WHEN x < 10 THEN 'left' ELSE 'right' END AS eye FROM pixels")
def _(t):
    return R.split_stereo(P(t), 20, 10).select("frame_idx", "y", "x", "eye")


@query("atlas", "pixels", f"SELECT {ID}, {rnd('v=b')} FROM pixels UNION ALL SELECT frame_idx, y, x + 20, {rnd('v=g')} FROM pixels UNION ALL SELECT frame_idx, y + 20, x, {rnd('v=r')} FROM pixels")
def _(t):
    one = lambda c: P(t).select("frame_idx", "y", "x", F.col(c).alias("v"))
    return rounded(R.atlas([(one("b"), 0, 0), (one("g"), 0, 20), (one("r"), 20, 0)]))


@query("random_crops", "pixels", f"""WITH c AS (SELECT frame_idx, frame_idx * 4 + k AS crop_id, CAST(floor({S.h('(frame_idx * 4 + k)', 61)} * 13) AS BIGINT) AS x0,
CAST(floor({S.h('(frame_idx * 4 + k)', 62)} * 13) AS BIGINT) AS y0 FROM (SELECT DISTINCT frame_idx FROM pixels) f, range(4) g(k))
SELECT p.frame_idx, c.crop_id, p.y - y0 AS y, p.x - x0 AS x, {rnd('b=p.b')} FROM pixels p JOIN c ON c.frame_idx = p.frame_idx
AND p.y BETWEEN y0 AND y0 + 7 AND p.x BETWEEN x0 AND x0 + 7""")
def _(t):
    images = P(t).select("frame_idx").distinct().withColumns({"width": F.lit(20), "height": F.lit(20)})
    return rounded(R.random_crops(images, P(t, "b"), 8, 4, 61).select("frame_idx", "crop_id", "y", "x", "b"))
