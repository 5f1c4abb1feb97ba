"""Pieces of SQL the checks share. Written apart from the column builders of the library, so that they can disagree."""

from __future__ import annotations

from scenetab.functions.hashing import hash01_sql

PI = "CAST(3.141592653589793 AS DOUBLE)"


def h(expr: str, seed: int | str) -> str:
    return hash01_sql(expr, seed)


def project(src: str, cams: str = "cams", keep: str = "p.*", cond: str = "p.scene_id = c.scene_id", out: str = "pj") -> str:
    """CTEs ending in ``pj``: every row of src with xc, yc, zc, u, v in every camera of its scene."""
    return f"""pc_ AS (SELECT {keep}, c.cam_idx, c.cam_model, c.width, c.height, c.fx, c.fy, c.cx, c.cy, c.radius_at_90,
  c.k1, c.tilt, c.r00*p.x + c.r01*p.y + c.r02*p.z + c.t0 AS xc, c.r10*p.x + c.r11*p.y + c.r12*p.z + c.t1 AS yc,
  c.r20*p.x + c.r21*p.y + c.r22*p.z + c.t2 AS zc FROM {src} p JOIN {cams} c ON {cond}),
pn_ AS (SELECT *, sqrt(1e-9 + xc*xc + yc*yc) AS rho_ FROM pc_),
pr_ AS (SELECT *, atan2(rho_, zc) AS phi_ FROM pn_),
pq_ AS (SELECT *, phi_ * (1 + phi_*phi_*k1) * radius_at_90 / ({PI} / 2) AS rr_ FROM pr_),
{out} AS (SELECT *, CASE WHEN cam_model = 'rectilinear' THEN fx * xc / zc + cx ELSE rr_ * (1 + tilt) * xc / rho_ + cx END AS u,
  CASE WHEN cam_model = 'rectilinear' THEN -fy * yc / zc + cy ELSE -rr_ * yc / rho_ + cy END AS v FROM pq_)"""


def rays(src: str, u: str = "u", v: str = "v", out: str = "ry") -> str:
    """CTEs ending in ``ry``: rows of src (which hold camera columns) with the camera-space ray rx, ry, rz."""
    newton = "ang_ - (ang_*(1 + k1*ang_*ang_) - ph_) / (1 + 3*k1*ang_*ang_)"
    return f"""y0_ AS (SELECT *, ({u} - cx) / (1 + tilt) AS dx_, {v} - cy AS dy_, ({u} - cx) / fx AS qx_,
  (height - {v} - cy) / fy AS qy_ FROM {src}),
y1_ AS (SELECT *, atan2(dy_, dx_) AS th_, sqrt(dx_*dx_ + dy_*dy_ + 1e-9) * {PI} / 2 / radius_at_90 AS ph_ FROM y0_),
y2_ AS (SELECT *, ph_ * (1 - k1*ph_**2 + 3*k1**2*ph_**4 - 12*k1**3*ph_**6) AS ang_ FROM y1_),
y3_ AS (SELECT * EXCLUDE (ang_), {newton} AS ang_ FROM y2_), y4_ AS (SELECT * EXCLUDE (ang_), {newton} AS ang_ FROM y3_),
y5_ AS (SELECT * EXCLUDE (ang_), {newton} AS ang_ FROM y4_),
{out} AS (SELECT *, CASE WHEN cam_model = 'rectilinear' THEN qx_ / sqrt(qx_*qx_ + qy_*qy_ + 1) ELSE cos(th_) * sin(ang_) END AS rx,
  CASE WHEN cam_model = 'rectilinear' THEN qy_ / sqrt(qx_*qx_ + qy_*qy_ + 1) ELSE -sin(th_) * sin(ang_) END AS ry,
  CASE WHEN cam_model = 'rectilinear' THEN 1 / sqrt(qx_*qx_ + qy_*qy_ + 1) ELSE cos(ang_) END AS rz FROM y5_)"""


def bilinear(queries: str, key: str, image: str, pixels: str, values: list[str], w: str, hgt: str, out: str = "bl", u: str = "u", v: str = "v") -> str:
    """CTE ``bl``: (key, values) interpolated with repeated borders."""
    vals = ", ".join(f"sum(k.wt * px.{c}) AS {c}" for c in values)
    return f"""bc_ AS (SELECT {key}, {image}, greatest(least(CAST(floor({u}) + i AS BIGINT), CAST({w} AS BIGINT) - 1), 0) AS bx,
  greatest(least(CAST(floor({v}) + j AS BIGINT), CAST({hgt} AS BIGINT) - 1), 0) AS by,
  (CASE WHEN i = 1 THEN {u} - floor({u}) ELSE 1 - ({u} - floor({u})) END) *
  (CASE WHEN j = 1 THEN {v} - floor({v}) ELSE 1 - ({v} - floor({v})) END) AS wt
  FROM {queries}, (VALUES (0), (1)) ii(i), (VALUES (0), (1)) jj(j)),
{out} AS (SELECT {', '.join('k.' + c.strip() for c in key.split(','))}, {vals} FROM bc_ k
  JOIN {pixels} px ON px.{image} = k.{image} AND px.y = k.by AND px.x = k.bx WHERE k.wt > 0 GROUP BY {', '.join('k.' + c.strip() for c in key.split(','))})"""


# the cameras of the rig with images of 20 x 20, to go with the pixel frames
SMALL = """small AS (SELECT * REPLACE (20 AS width, 20 AS height, CAST(12 AS DOUBLE) AS fx, CAST(12 AS DOUBLE) AS fy,
  CAST(10 AS DOUBLE) AS cx, CAST(10 AS DOUBLE) AS cy, CAST(9 AS DOUBLE) AS radius_at_90) FROM cams)"""


def _mirror(e: str, n: int) -> str:
    return f"(CASE WHEN {e} < 0 THEN -({e}) WHEN {e} > {n - 1} THEN {2 * (n - 1)} - ({e}) ELSE {e} END)"


def blur(src: str, cols: list[str], size: int, sigma: float, h: int, w: int, out: str, key: str = "frame_idx") -> str:
    """CTEs replacing cols of src by their blurred values."""
    import math

    half = size // 2
    raw = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-half, half + 1)]
    taps = ", ".join(f"({d}, CAST({r / sum(raw)!r} AS DOUBLE))" for d, r in zip(range(-half, half + 1), raw))
    k = key.split(",")
    on = " AND ".join(f"q.{c.strip()} = p.{c.strip()}" for c in k)
    ks = ", ".join(f"p.{c.strip()}" for c in k)
    sums = ", ".join(f"sum(t.wt * q.{c}) AS {c}" for c in cols)
    cl = ", ".join(cols)
    return f"""{out}_x AS (SELECT {ks}, p.y, p.x, {sums} FROM {src} p CROSS JOIN (VALUES {taps}) t(d, wt)
  JOIN {src} q ON {on} AND q.y = p.y AND q.x = {_mirror('p.x + t.d', w)} GROUP BY {ks}, p.y, p.x),
{out}_y AS (SELECT {ks}, p.y, p.x, {sums} FROM {out}_x p CROSS JOIN (VALUES {taps}) t(d, wt)
  JOIN {out}_x q ON {on} AND q.x = p.x AND q.y = {_mirror('p.y + t.d', h)} GROUP BY {ks}, p.y, p.x),
{out} AS (SELECT s.* EXCLUDE ({cl}), {', '.join('b.' + c for c in cols)} FROM {src} s JOIN {out}_y b USING ({key}, y, x))"""


def morph(src: str, fn: str, cols: list[str], k: int, out: str, key: str = "frame_idx") -> str:
    def win(axis: str, other: str) -> str:
        return ", ".join(
            f"{fn}({c}) OVER (PARTITION BY {key}, {other} ORDER BY {axis} RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS {c}"
            for c in cols
        )

    return f"""{out}_x AS (SELECT * REPLACE ({win('x', 'y')}) FROM {src}),
{out} AS (SELECT * REPLACE ({win('y', 'x')}) FROM {out}_x)"""


def median(src: str, col: str, h: int, w: int, out: str) -> str:
    return f"""{out}_m AS (SELECT p.frame_idx, p.y, p.x, median(q.{col}) AS {col} FROM {src} p
  CROSS JOIN (VALUES (-1), (0), (1)) a(i) CROSS JOIN (VALUES (-1), (0), (1)) c(j)
  JOIN {src} q ON q.frame_idx = p.frame_idx AND q.y = least(greatest(p.y + a.i, 0), {h - 1})
  AND q.x = least(greatest(p.x + c.j, 0), {w - 1}) GROUP BY p.frame_idx, p.y, p.x),
{out} AS (SELECT s.* EXCLUDE ({col}), b.{col} FROM {src} s JOIN {out}_m b USING (frame_idx, y, x))"""


def shrink(src: str, cols: list[str], f: int, out: str) -> str:
    avgs = ", ".join(f"avg({c}) AS {c}" for c in cols)
    return f"{out} AS (SELECT frame_idx, y // {f} AS y, x // {f} AS x, {avgs} FROM {src} GROUP BY ALL)"


def enlarge(src: str, cols: list[str], f: int, h: int, w: int, out: str) -> str:
    q = f"""{out}_q AS (SELECT fr.frame_idx, oy.i AS oy, ox.i AS ox, (oy.i + 0.5) / {f} - 0.5 AS v, (ox.i + 0.5) / {f} - 0.5 AS u
  FROM (SELECT DISTINCT frame_idx FROM {src}) fr, range({h * f}) oy(i), range({w * f}) ox(i))"""
    b = bilinear(f"{out}_q", "frame_idx, oy, ox", "frame_idx", src, cols, str(w), str(h), out=f"{out}_b")
    b = b.replace("bc_", f"{out}_c").replace("SELECT frame_idx, oy, ox, frame_idx,", "SELECT frame_idx, oy, ox,")
    return f"{q}, {b}, {out} AS (SELECT * RENAME (oy AS y, ox AS x) FROM {out}_b)"
