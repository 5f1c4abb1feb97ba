"""Camera paths from key frames, and rigs of virtual cameras."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetab.functions import geom
from scenetab.functions.columns import settle
from scenetab.functions.scan import carry_both
from scenetab.functions.session import cut_lineage

SIX = ["tx", "ty", "tz", "rx", "ry", "rz"]


def _segments(frames: DataFrame, keys: DataFrame, path: str, cols: list[str]) -> DataFrame:
    """Each frame with the key frames before (p, at or before it) and after (n) as structs: an as-of join both ways.

    Frames and keys are stacked and scanned in two levels, so a path of any length is spread over tasks.
    """
    payload = F.struct("frame_idx", *cols)
    stacked = frames.select(path, "frame_idx", F.lit(True).alias("want")).join(
        keys.select(path, "frame_idx", payload.alias("k")), [path, "frame_idx"], "full"
    )
    out = carry_both(stacked, [path], "frame_idx", F.col("k"), "p", "n")
    return out.where("want").select(path, "frame_idx", "p", "n")


def interpolate_keyframes(frames: DataFrame, keys: DataFrame, path: str = "path_id") -> DataFrame:
    """Linear in six parameters between key frames, held after the last. A frame before the first key is an error."""
    seg = _segments(frames, keys, path, SIX)
    first = F.col("p.frame_idx")
    prev = F.when(F.col("p").isNull(), F.raise_error(F.lit("frame before the first key frame")).cast("bigint")).otherwise(first)
    seg = seg.withColumn("_f", prev)
    a = geom.div((F.col("frame_idx") - F.col("_f")).cast("double"), (F.col("n.frame_idx") - F.col("_f")).cast("double"))
    seg = seg.withColumn("_a", F.coalesce(a, F.lit(0.0)))
    mix = {c: F.coalesce(F.col(f"n.{c}"), F.col(f"p.{c}")) * F.col("_a") + F.col(f"p.{c}") * (1.0 - F.col("_a")) for c in SIX}
    return seg.select(path, "frame_idx", *[e.alias(c) for c, e in mix.items()])


def keyframe_pose(df: DataFrame) -> DataFrame:
    """Pose columns of a camera at (tx, ty, tz) turned by the axis-angle (rx, ry, rz) in degrees."""
    rad = [F.col(c) * (math.pi / 180.0) for c in ("rx", "ry", "rz")]
    out = settle(df.withColumns({f"_w{i}": c for i, c in enumerate(rad)}), ["_w0", "_w1", "_w2"])
    rot = geom.rotvec_matrix(F.col("_w0"), F.col("_w1"), F.col("_w2"))
    out = out.withColumns(dict(zip(geom.ROT, rot)))
    pos = [F.col(c) for c in ("tx", "ty", "tz")]
    t = {f"t{i}": -sum((F.col(f"r{i}{j}") * pos[j] for j in range(3)), F.lit(0.0)) for i in range(3)}
    return out.withColumns(t).drop("_w0", "_w1", "_w2")


def _mat(get, a: str) -> list[Column]:
    return [get(f"{a}{c}") for c in geom.ROT]


def _mul(a: list[Column], b: list[Column], ta: bool = False) -> list[Column]:
    at = lambda i, k: a[3 * k + i] if ta else a[3 * i + k]
    return [sum((at(i, k) * b[3 * k + j] for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)]


def _log_rotation(m: list[Column]) -> Column:
    """Rotation vector of a rotation matrix by way of its quaternion, chosen by the largest component."""
    tr = m[0] + m[4] + m[8]
    s = lambda e: F.sqrt(F.greatest(e, F.lit(1e-30))) * 2.0
    s0, s1, s2, s3 = s(1 + tr), s(1 + m[0] - m[4] - m[8]), s(1 - m[0] + m[4] - m[8]), s(1 - m[0] - m[4] + m[8])
    a, b, c = m[7] - m[5], m[2] - m[6], m[3] - m[1]
    p, q, r = m[1] + m[3], m[2] + m[6], m[5] + m[7]
    big0, big1, big2 = tr > 0, (m[0] >= m[4]) & (m[0] >= m[8]), m[4] >= m[8]
    pick = lambda w, x, y, z: F.when(big0, w).when(big1, x).when(big2, y).otherwise(z)
    quat = F.struct(
        pick(s0 / 4, a / s1, b / s2, c / s3).alias("w"), pick(a / s0, s1 / 4, p / s2, q / s3).alias("x"),
        pick(b / s0, p / s1, s2 / 4, r / s3).alias("y"), pick(c / s0, q / s1, r / s2, s3 / 4).alias("z"),
    )

    def vector(v: Column) -> Column:
        w, x, y, z = (v.getField(n) for n in "wxyz")
        n = geom.norm(x, y, z)
        k = F.when(n < 1e-12, F.lit(2.0)).otherwise(geom.div(2.0 * F.atan2(n, F.abs(w)), n)) * F.when(w < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        return F.array(x * k, y * k, z * k)

    return geom.let(quat, vector)


def interpolate_path(frames: DataFrame, keys: DataFrame, path: str = "path_id") -> DataFrame:
    """Smooth path: Hermite position, Hermite rotation in the tangent space, linear focal length, held at both ends.

    ``keys`` has frame_idx, the pose columns, and focal. Every key first learns its neighbours; a frame then reads
    everything it needs from its segment's first key.
    """
    pos = geom.position(geom.flat())
    k = settle(keys.select(path, "frame_idx", "focal", *geom.ROT, *[c.alias(f"p{a}") for c, a in zip(pos, "xyz")]), ["px", "py", "pz"])
    body = F.struct("frame_idx", "focal", *geom.ROT, "px", "py", "pz")
    k = k.withColumn("k", body)
    k = carry_both(k, [path], "frame_idx", F.col("k"), "b", "n", inclusive=False)
    f = lambda s: F.col(f"{s}.frame_idx").cast("double")
    col = lambda s: lambda c: F.col(f"{s}.{c}")
    lo, hi = F.coalesce(F.col("b"), F.col("k")), F.coalesce(F.col("n"), F.col("k"))
    k = settle(k.withColumns({"lo": lo, "hi": hi}), ["lo", "hi"])
    tangent = {f"v{a}": geom.div(F.col(f"hi.p{a}") - F.col(f"lo.p{a}"), f("hi") - f("lo")) for a in "xyz"}
    to_next = _mul(_mat(col("k"), ""), _mat(col("hi"), ""), ta=True)
    from_last = _mul(_mat(col("lo"), ""), _mat(col("k"), ""), ta=True)
    k = k.withColumns({f"_m{i}": c for i, c in enumerate(to_next)} | {f"_l{i}": c for i, c in enumerate(from_last)})
    k = settle(k, [f"_{a}{i}" for a in "ml" for i in range(9)])
    chord = _log_rotation([F.col(f"_m{i}") for i in range(9)])
    before = _log_rotation([F.col(f"_l{i}") for i in range(9)])
    k = settle(k.withColumns({**tangent, "_a": chord, "_c": before}), [*tangent, "_a", "_c"])
    k = k.withColumns({f"{n}{i}": F.get(f"_{n}", i) for n in "ac" for i in range(3)})
    d_lo, d_hi = f("k") - f("lo"), f("hi") - f("k")
    turn = {}
    for i in range(3):
        both = geom.div(F.col(f"c{i}") * d_hi + F.col(f"a{i}") * d_lo, d_lo + d_hi)
        turn[f"w{i}"] = F.when(F.col("b").isNull(), F.col(f"a{i}")).when(F.col("n").isNull(), F.col(f"c{i}")).otherwise(both)
    k = settle(k.withColumns(turn), [*turn, "a0", "a1", "a2"])
    k = cut_lineage(k)  # key frames are few and read twice below
    cols = ["focal", *geom.ROT, "px", "py", "pz", "vx", "vy", "vz", "a0", "a1", "a2", "w0", "w1", "w2"]
    seg = _segments(frames, k.select(path, "frame_idx", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols]), path, cols)
    seg = seg.withColumns({"p": F.coalesce("p", "n"), "n": F.when(F.col("p").isNull(), F.lit(None)).otherwise(F.col("n"))})
    seg = settle(seg, ["p", "n"])
    gap = f("n") - f("p")
    u = F.coalesce(geom.div(F.col("frame_idx") - f("p"), gap), F.lit(0.0))
    seg = settle(seg.withColumns({"u": u, "gap": F.coalesce(gap, F.lit(0.0))}), ["u", "gap"])
    seg = settle(seg.withColumn("n", F.coalesce("n", "p")), ["n"])
    uu = F.col("u")
    h10, h01, h11 = uu * uu * uu - 2 * uu * uu + uu, -2 * uu * uu * uu + 3 * uu * uu, uu * uu * uu - uu * uu
    h00 = 1.0 - h01
    hermite = {
        f"p{a}": h00 * F.col(f"p.p{a}") + h10 * F.col(f"p.v{a}") * F.col("gap") + h01 * F.col(f"n.p{a}") + h11 * F.col(f"n.v{a}") * F.col("gap")
        for a in "xyz"
    }
    alpha = {f"g{i}": h10 * F.col(f"p.w{i}") + h01 * F.col(f"p.a{i}") + h11 * F.col(f"n.w{i}") for i in range(3)}
    focal = (1.0 - uu) * F.col("p.focal") + uu * F.col("n.focal")
    seg = seg.withColumns({**hermite, **alpha, "focal": focal})
    seg = settle(seg, ["g0", "g1", "g2", *hermite])
    delta = geom.rotvec_matrix(F.col("g0"), F.col("g1"), F.col("g2"), eps=1e-8)
    seg = settle(seg.withColumns({f"d{i}": c for i, c in enumerate(delta)}), [f"d{i}" for i in range(9)])
    rot = _mul(_mat(col("p"), ""), [F.col(f"d{i}") for i in range(9)])
    seg = seg.withColumns(dict(zip(geom.ROT, rot)))
    t = {f"t{i}": -sum((F.col(f"r{i}{j}") * F.col(f"p{a}") for j, a in enumerate("xyz")), F.lit(0.0)) for i in range(3)}
    return seg.withColumns(t).select(path, "frame_idx", "focal", *geom.POSE)


QUILT_ROWS, QUILT_COLS, QUILT_SIZE = 6, 8, 3360


def rig_views(kind: str, baseline: float) -> list[tuple]:
    """Offsets along the camera's right, one per virtual view: (view, row, col, shift)."""
    if kind == "mono":
        return [(0, 0, 0, 0.0)]
    if kind in ("stereo", "vr180"):
        return [(0, 0, 0, -baseline / 2), (1, 0, 1, baseline / 2)]
    if kind == "quilt":
        n = QUILT_ROWS * QUILT_COLS
        cells = [(r, c, (QUILT_ROWS - 1 - r) * QUILT_COLS + c) for r in range(QUILT_ROWS) for c in range(QUILT_COLS)]
        return [(tile, r, c, baseline * (tile / (n - 1) - 0.5)) for r, c, tile in cells]
    raise ValueError(f"unknown rig {kind}")


def expand_views(path: DataFrame, kind: str, baseline: float, hfov: float = 40.0, downscale: int = 1) -> DataFrame:
    """One row per virtual camera of each path frame: an explode over the fixed list of views."""
    views = F.array(
        *[F.struct(F.lit(v).alias("view"), F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(s).alias("shift")) for v, r, c, s in rig_views(kind, baseline)]
    )
    out = path.withColumn("_v", F.explode(views)).select(*path.columns, "_v.view", "_v.row", "_v.col", "_v.shift")
    # moving along the own right axis changes only the first translation entry
    out = out.withColumn("t0", F.col("t0") - F.col("shift"))
    if kind == "vr180":
        return out.withColumn("cam_model", F.lit("equirect180"))
    if kind != "quilt":
        return out
    w, h = QUILT_SIZE // downscale // QUILT_COLS, QUILT_SIZE // downscale // QUILT_ROWS
    focal = w / (2.0 * math.tan(hfov * math.pi / 360.0))
    return out.withColumns({"width": F.lit(w), "height": F.lit(h), "cx": F.lit(float(w // 2)), "cy": F.lit(float(h // 2)), "focal": F.lit(focal)})


# fixed values of the presets: first and last key
PRESETS = {
    "origin": {}, "pan_right": {"tx": (-0.5, 0.5)}, "pan_left": {"tx": (0.5, -0.5)}, "dolly_forward": {"tz": (-0.5, 0.5)},
    "dolly_backward": {"tz": (0.5, -0.5)}, "boom_up": {"ty": (-0.5, 0.5)}, "boom_down": {"ty": (0.5, -0.5)},
}


def preset_keyframes(paths: DataFrame, preset: str, path: str = "path_id") -> DataFrame:
    """Key frames of a named move for every path; ``paths`` has num_frames."""
    ends = F.array(F.lit(0), F.lit(1)) if preset != "origin" else F.array(F.lit(0))
    out = paths.withColumn("_e", F.explode(ends))
    move = PRESETS[preset]
    val = lambda c: F.when(F.col("_e") == 0, F.lit(move[c][0])).otherwise(F.lit(move[c][1])) if c in move else F.lit(0.0)
    return out.select(path, (F.col("_e") * (F.col("num_frames") - 1)).cast("bigint").alias("frame_idx"), *[val(c).alias(c) for c in SIX])


def orbit_keyframes(paths: DataFrame, radius: float, start: float, end: float, center=(0.0, 0.0, 0.0), path: str = "path_id") -> DataFrame:
    """A key per frame on a circle, yawed towards its centre."""
    out = paths.withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("num_frames") - 1).cast("bigint"))))
    a = F.col("frame_idx") / F.col("num_frames")
    theta = (a * start + (1.0 - a) * end) * (math.pi / 180.0)
    x, z = radius * F.cos(theta), radius * F.sin(theta)
    return out.select(
        path, "frame_idx", (x + center[0]).alias("tx"), F.lit(center[1]).alias("ty"), (z + center[2]).alias("tz"),
        F.lit(0.0).alias("rx"), (90.0 + (180.0 / math.pi) * F.atan2(z, x)).alias("ry"), F.lit(0.0).alias("rz"),
    )
