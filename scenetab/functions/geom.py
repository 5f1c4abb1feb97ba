"""Column expressions for lens models, poses and activations.

Axes are x right, y up, z forward; pixel y grows downwards. A pose is the twelve columns r00..r22 (row-major
cam_from_world rotation) and t0..t2. Every helper takes a getter ``cam(name) -> Column`` so the same expression works
on flat columns and on the fields of a camera struct inside a higher-order function.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenetab.functions.columns import settle

Getter = Callable[[str], Column]

# fixed values of the data model
Z_NEAR = 0.01
Z_FAR = 1000.0
INV_DEPTH_COEF = 0.1
SCALE_BIAS = 1.0
MAX_SCALE_EXPONENT = 7.0
DEAD_ALPHA = 0.05
LINEAR_RADIUS = 5.0
RAY_NEAR, RAY_MID, RAY_FAR = 0.2, 10.0, 1000.0
LENS_EPS = 1e-9

ROT = [f"r{i}{j}" for i in range(3) for j in range(3)]
TRANS = ["t0", "t1", "t2"]
POSE = ROT + TRANS
INTRINSICS = ["cam_model", "width", "height", "fx", "fy", "cx", "cy", "radius_at_90", "useable_radius", "k1", "tilt"]


def flat(prefix: str = "") -> Getter:
    return lambda name: F.col(prefix + name)


def field(struct: Column) -> Getter:
    return lambda name: struct.getField(name)


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def norm(*cs: Column) -> Column:
    total = cs[0] * cs[0]
    for c in cs[1:]:
        total = total + c * c
    return F.sqrt(total)


def div(a: Column, b: Column) -> Column:
    """Division giving NULL instead of an error at zero."""
    return F.try_divide(a, b)


# ---- poses -----------------------------------------------------------------------------------------------------


def to_cam(cam: Getter, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(
        cam(f"r{i}0") * x + cam(f"r{i}1") * y + cam(f"r{i}2") * z + cam(f"t{i}") for i in range(3)
    )


def rotate_to_world(cam: Getter, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(cam(f"r0{j}") * x + cam(f"r1{j}") * y + cam(f"r2{j}") * z for j in range(3))


def position(cam: Getter) -> tuple[Column, Column, Column]:
    p = rotate_to_world(cam, cam("t0"), cam("t1"), cam("t2"))
    return tuple(-c for c in p)


def to_world(cam: Getter, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return rotate_to_world(cam, x - cam("t0"), y - cam("t1"), z - cam("t2"))


def rotvec_matrix(rx: Column, ry: Column, rz: Column, eps: float = 1e-12) -> list[Column]:
    """Axis-angle to the nine row-major entries (Rodrigues)."""
    theta = norm(rx, ry, rz)
    small = theta < eps
    safe = F.when(small, F.lit(1.0)).otherwise(theta)
    a = F.when(small, F.lit(1.0)).otherwise(F.sin(theta) / safe)
    b = F.when(small, F.lit(0.5)).otherwise((F.lit(1.0) - F.cos(theta)) / (safe * safe))
    k = [[F.lit(0.0), -rz, ry], [rz, F.lit(0.0), -rx], [-ry, rx, F.lit(0.0)]]
    w = [rx, ry, rz]
    t2 = theta * theta
    return [
        F.lit(1.0 if i == j else 0.0) + a * k[i][j] + b * (w[i] * w[j] - (t2 if i == j else F.lit(0.0)))
        for i in range(3)
        for j in range(3)
    ]


def quat_matrix(x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    """Unit quaternion (xyzw) to row-major rotation entries."""
    return [
        x * x - y * y - z * z + w * w, 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), -x * x + y * y - z * z + w * w, 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), -x * x - y * y + z * z + w * w,
    ]


# ---- lens models -----------------------------------------------------------------------------------------------


def _project_rectilinear(cam: Getter, x, y, z):
    return div(x, z) * cam("fx") + cam("cx"), div(-y, z) * cam("fy") + cam("cy")


def _project_fisheye(cam: Getter, x, y, z):
    rho = F.sqrt(F.lit(LENS_EPS) + x * x + y * y)
    phi = F.atan2(rho, z)
    r = phi * (F.lit(1.0) + phi * phi * cam("k1")) * cam("radius_at_90") / F.lit(math.pi / 2)
    return r * (F.lit(1.0) + cam("tilt")) * x / rho + cam("cx"), -r * y / rho + cam("cy")


def _ray_rectilinear(cam: Getter, u, v):
    x = (u - cam("cx")) / cam("fx")
    y = (cam("height") - v - cam("cy")) / cam("fy")
    n = norm(x, y, F.lit(1.0))
    return x / n, y / n, F.lit(1.0) / n


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression."""
    return F.get(F.transform(F.array(value), body), 0)


def fisheye_angle(phi: Column, k1: Column) -> Column:
    """Undo the radial distortion: a series start, then three Newton steps."""

    def start(p: Column) -> Column:
        q = p * p
        return F.struct(p.alias("p"), (p * (1 - k1 * q + 3.0 * k1 * k1 * q * q - 12.0 * k1 * k1 * k1 * q * q * q)).alias("a"))

    def newton(s: Column) -> Column:
        a, p = s.getField("a"), s.getField("p")
        return F.struct(p.alias("p"), (a - (a * (1.0 + k1 * a * a) - p) / (1.0 + 3 * k1 * a * a)).alias("a"))

    steps = F.transform(F.array(phi), start)
    for _ in range(3):
        steps = F.transform(steps, newton)
    return F.get(steps, 0).getField("a")


def _ray_fisheye(cam: Getter, u, v):
    dx = (u - cam("cx")) / (F.lit(1.0) + cam("tilt"))
    dy = v - cam("cy")
    theta = F.atan2(dy, dx)
    phi = F.sqrt(dx * dx + dy * dy + F.lit(LENS_EPS)) * F.lit(math.pi / 2) / cam("radius_at_90")
    a = fisheye_angle(phi, cam("k1"))
    axis = F.struct(F.cos(theta).alias("c"), F.sin(theta).alias("s"), a.alias("a"))
    out = let(
        axis,
        lambda t: F.array(
            t.getField("c") * F.sin(t.getField("a")), -t.getField("s") * F.sin(t.getField("a")), F.cos(t.getField("a"))
        ),
    )
    return tuple(F.get(out, i) for i in range(3))


def ray_inflated(cam: Getter, u, v, exponent: float = 3.0):
    dx, dy = u - cam("cx"), v - cam("cy")
    theta = F.atan2(dy, dx)
    r = norm(dx, dy) / cam("radius_at_90")
    phi = (0.5 * r + 0.5 * F.pow(r, F.lit(exponent))) * F.lit(math.pi / 2)
    return F.cos(theta) * F.sin(phi), -F.sin(theta) * F.sin(phi), F.cos(phi)


def _ray_equirect(full: bool):
    def ray(cam: Getter, u, v):
        turn = -2.0 * math.pi if full else -math.pi
        shift = math.pi / 2 if full else math.pi
        theta = F.lit(turn) * u / cam("width") - F.lit(shift)
        phi = F.lit(math.pi) * (v / cam("height") - F.lit(0.5))
        return F.cos(phi) * F.cos(theta), -F.sin(phi), F.cos(phi) * F.sin(theta)

    return ray


# model name -> expression builder; user code may add entries
PROJECTORS = {"rectilinear": _project_rectilinear, "equiangular": _project_fisheye}
RAYS = {
    "rectilinear": _ray_rectilinear,
    "equiangular": _ray_fisheye,
    "equirect180": _ray_equirect(False),
    "equirect360": _ray_equirect(True),
}


def _dispatch(builders: dict, cam: Getter, args: tuple, n: int) -> tuple[Column, ...]:
    outs = [None] * n
    for model, build in builders.items():
        for i, c in enumerate(build(cam, *args)):
            hit = cam("cam_model") == F.lit(model)
            outs[i] = F.when(hit, c) if outs[i] is None else outs[i].when(hit, c)
    return tuple(outs)


def project(cam: Getter, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Camera-space point to pixel for whichever lens the camera row names."""
    return _dispatch(PROJECTORS, cam, (x, y, z), 2)


def ray(cam: Getter, u: Column, v: Column, models: tuple[str, ...] | None = None) -> tuple[Column, Column, Column]:
    builders = RAYS if models is None else {m: RAYS[m] for m in models}
    return _dispatch(builders, cam, (u, v), 3)


def with_ray(df, cam: Getter, u: Column, v: Column, names=("_rx", "_ry", "_rz"), models: tuple[str, ...] | None = None):
    """Add the camera-space ray of a pixel as three columns, each intermediate value computed once per row."""
    staged = df.withColumns(
        {
            "_dx": (u - cam("cx")) / (F.lit(1.0) + cam("tilt")), "_dy": v - cam("cy"),
            "_k1": cam("k1"), "_model": cam("cam_model"),
        }
    ).withColumn("_ph", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy") + F.lit(LENS_EPS))
                 * F.lit(math.pi / 2) / cam("radius_at_90"))
    p, k1 = F.col("_ph"), F.col("_k1")
    q = p * p
    staged = staged.withColumns(
        {"_th": F.atan2(F.col("_dy"), F.col("_dx")),
         "_a": p * (1 - k1 * q + 3.0 * k1 * k1 * q * q - 12.0 * k1 * k1 * k1 * q * q * q)}
    )
    a = F.col("_a")
    for _ in range(3):
        staged = staged.withColumn("_a", a - (a * (1.0 + k1 * a * a) - p) / (1.0 + 3 * k1 * a * a))
    th = F.col("_th")
    fish = (F.cos(th) * F.sin(a), -F.sin(th) * F.sin(a), F.cos(a))
    others = {m: b for m, b in RAYS.items() if m != "equiangular" and (models is None or m in models)}
    cols = {}
    for i, n in enumerate(names):
        c = F.when(F.col("_model") == F.lit("equiangular"), fish[i])
        for m, build in others.items():
            c = c.when(F.col("_model") == F.lit(m), build(cam, u, v)[i])
        cols[n] = c
    return settle(staged.withColumns(cols).drop("_dx", "_dy", "_k1", "_model", "_ph", "_th", "_a"), list(names))


def with_pixel(df, cam: Getter, xyz: tuple[str, str, str] = ("xc", "yc", "zc"), names=("u", "v")):
    """Add the pixel of camera-space columns, each intermediate value computed once per row."""
    x, y, z = (F.col(c) for c in xyz)
    staged = df.withColumn("_rho", F.sqrt(F.lit(LENS_EPS) + x * x + y * y))
    staged = staged.withColumn("_ph", F.atan2(F.col("_rho"), z))
    ph = F.col("_ph")
    scale = ph * (F.lit(1.0) + ph * ph * cam("k1")) * cam("radius_at_90") / F.lit(math.pi / 2) / F.col("_rho")
    staged = staged.withColumn("_s", scale)
    flat_u, flat_v = _project_rectilinear(cam, x, y, z)
    fish = cam("cam_model") == F.lit("equiangular")
    u = F.when(fish, F.col("_s") * (F.lit(1.0) + cam("tilt")) * x + cam("cx"))
    v = F.when(fish, -F.col("_s") * y + cam("cy"))
    pin = cam("cam_model") == F.lit("rectilinear")
    out = staged.withColumns({names[0]: u.when(pin, flat_u), names[1]: v.when(pin, flat_v)}).drop("_rho", "_ph", "_s")
    return settle(out, list(names))


def rig_pixels(rig: Column, x: Column, y: Column, z: Column) -> Column:
    """For an array of camera structs: array of (cam_idx, w, h, z, u, v) for one point, each value computed once."""

    def local(c: Column) -> Column:
        xc, yc, zc = to_cam(field(c), x, y, z)
        return F.struct(c.alias("c"), xc.alias("x"), yc.alias("y"), zc.alias("z"))

    def pixel(s: Column) -> Column:
        c = s.getField("c")
        u, v = project(field(c), s.getField("x"), s.getField("y"), s.getField("z"))
        return F.struct(
            c.getField("cam_idx").alias("cam_idx"), c.getField("width").alias("w"), c.getField("height").alias("h"),
            s.getField("z").alias("z"), u.alias("u"), v.alias("v"),
        )

    return F.transform(F.transform(rig, local), pixel)


# ---- activations -----------------------------------------------------------------------------------------------


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def logit(c: Column, eps: float = 0.001) -> Column:
    p = clamp(c, eps, 1.0 - eps)
    return F.ln(p) - F.ln(F.lit(1.0) - p)


def logit_tensor(c: Column) -> Column:
    p = clamp(c, 1e-7, 1.0 - 1e-7)
    return F.ln(p / (F.lit(1.0) - p))


def scale_active(c: Column) -> Column:
    return F.lit(-MAX_SCALE_EXPONENT) * sigmoid(c) + F.lit(SCALE_BIAS)


def scale_raw(s: Column) -> Column:
    return logit(clamp((F.lit(SCALE_BIAS) - s) / F.lit(MAX_SCALE_EXPONENT), 1e-6, 1.0 - 1e-6))


def contract(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """All of space into a ball of radius 2, linear inside the radius."""
    sx, sy, sz = (c / F.lit(LINEAR_RADIUS) for c in (x, y, z))
    m = norm(sx, sy, sz)
    k = F.when(m < 1.0, F.lit(1.0)).otherwise((F.lit(2.0) - div(F.lit(1.0), m)) * div(F.lit(1.0), m))
    return sx * k, sy * k, sz * k


def expand(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    m = norm(x, y, z)
    k = F.when(m < 1.0, F.lit(1.0)).otherwise(div(F.lit(1.0), m * (F.lit(2.0) - m))) * F.lit(LINEAR_RADIUS)
    return x * k, y * k, z * k
