"""Gaussian splat tables: encoding, culling, spawning, health, projection and compositing.

Columns: frame_idx, splat_idx, position x y z, raw colour c0 c1 c2, raw alpha, raw scale s0 s1 s2, quaternion q0..q3
(xyzw), alive. Raw values become usable ones through a sigmoid (colour, alpha) or ``scale_active`` (log scale).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenetab.functions import geom
from scenetab.functions.batches import whole_groups
from scenetab.functions.columns import settle
from scenetab.functions.hashing import hash01
from scenetab.functions.ranks import exact_rank
from scenetab.functions.scan import with_chunk
from scenetab.functions.session import broadcast_if_small
from scenetab.operators.points import knn_spacing, visible_to_any
from scenetab.operators.rigs import in_cam, per_camera

KEY = ["frame_idx", "splat_idx"]
ROWS_PER_SPLAT = 20
XYZ, COLOR, SCALE, QUAT = ["x", "y", "z"], ["c0", "c1", "c2"], ["s0", "s1", "s2"], ["q0", "q1", "q2", "q3"]
PARAMS = [*XYZ, *COLOR, "alpha", *SCALE, *QUAT]


def _cols(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


# ---- wire form and image form ------------------------------------------------------------------------------------


def splat_wire_form(splats: DataFrame) -> DataFrame:
    """Usable values as written to files: swapped colour order, unit quaternion; dead rows become zeros in place."""
    alive = F.col("alive")
    qn = geom.norm(*_cols(QUAT))
    out = {c: F.when(alive, F.col(c)).otherwise(0.0) for c in XYZ}
    out |= {w: F.when(alive, geom.sigmoid(F.col(c))).otherwise(0.0) for w, c in zip(("cb", "cg", "cr"), COLOR)}
    out["ca"] = F.when(alive, geom.sigmoid(F.col("alpha"))).otherwise(0.0)
    out |= {f"e{i}": F.when(alive, geom.scale_active(F.col(c))).otherwise(0.0) for i, c in enumerate(SCALE)}
    out |= {c: F.when(alive, geom.div(F.col(c), qn)).otherwise(1.0 if i == 0 else 0.0) for i, c in enumerate(QUAT)}
    return splats.select(*KEY, *[c.alias(n) for n, c in out.items()])


def splat_model_form(wire: DataFrame) -> DataFrame:
    """Back to raw parameters."""
    qn = geom.norm(*_cols(QUAT))
    return wire.select(
        *KEY, *XYZ, *[geom.logit(F.col(w)).alias(c) for w, c in zip(("cb", "cg", "cr"), COLOR)],
        geom.logit(F.col("ca")).alias("alpha"), *[geom.scale_raw(F.col(f"e{i}")).alias(c) for i, c in enumerate(SCALE)],
        *[geom.div(F.col(c), qn).alias(c) for c in QUAT], (F.col("ca") != 0.0).alias("alive"),
    )


def encode_splats(wire: DataFrame, width: int, height: int) -> DataFrame:
    """Wire-form splats as 8-bit picture cells (frame_idx, y, x, value): 20 rows per splat, slot = splat_idx."""
    capacity = width * (height // ROWS_PER_SPLAT)
    room = F.when(F.col("splat_idx") < capacity, F.col("splat_idx")).otherwise(
        F.raise_error(F.concat(F.lit(f"slot beyond the {capacity} that fit: "), F.col("splat_idx").cast("string"))).cast("bigint")
    )
    px, py, pz = geom.contract(F.col("x"), F.col("y"), -F.col("z"))
    src = wire.withColumn("_slot", room).withColumns({n: 0.25 * (p + 2.0) for n, p in (("_x", px), ("_y", py), ("_z", pz))})
    src = src.withColumns({"_q0": -F.col("q0"), "_q1": F.col("q1"), "_q2": F.col("q2"), "_q3": -F.col("q3")})
    unit = [F.col(n).between(0.0, 1.0) & ~F.isnan(n) for n in ("_x", "_y", "_z")]
    fit = unit[0] & unit[1] & unit[2] & (geom.norm(*_cols(QUAT)) != 0.0)
    top = F.greatest(*[F.abs(F.col(f"_q{i}")) for i in range(4)])
    src = src.withColumns({"_fit": F.coalesce(fit, F.lit(False)), "_top": top})
    cells = []
    for n in ("_x", "_y", "_z"):
        code = (geom.clamp(F.col(n), 0.0, 1.0) * 4095).cast("int")
        cells += [F.shiftright(code, s).bitwiseAND(F.lit(15)) * 16 + 8 for s in (0, 4, 8)]
    cells += [(F.col(c) * 255).cast("int") for c in ("cr", "cg", "cb", "ca")]
    room_for = lambda c: geom.clamp((geom.SCALE_BIAS - c) / geom.MAX_SCALE_EXPONENT, 0.0, 1.0)
    cells += [(room_for(F.col(f"e{i}")) * 255).cast("int") for i in range(3)]
    cells += [(255.0 * (geom.div(F.col(f"_q{i}"), F.col("_top")) + 1.0) / 2.0).cast("int") for i in range(4)]
    values = F.when(F.col("_fit"), F.array(*cells)).otherwise(F.array_repeat(F.lit(0), ROWS_PER_SPLAT))
    out = src.select("frame_idx", "_slot", F.posexplode(values).alias("k", "value"))
    return out.select(
        "frame_idx", (F.floor(F.col("_slot") / width) * ROWS_PER_SPLAT + F.col("k")).cast("bigint").alias("y"),
        (F.col("_slot") % width).alias("x"), "value",
    )


def decode_splats(cells: DataFrame, width: int) -> DataFrame:
    """Inverse of ``encode_splats``; slots of alpha 0 are dropped."""
    slot = (F.floor(F.col("y") / ROWS_PER_SPLAT) * width + F.col("x")).cast("bigint")
    wide = cells.groupBy("frame_idx", slot.alias("splat_idx")).agg(
        *[F.max(F.when(F.col("y") % ROWS_PER_SPLAT == k, F.col("value"))).alias(f"v{k}") for k in range(ROWS_PER_SPLAT)]
    )
    wide = wide.where(F.col("v12") != 0)

    def code(k: int) -> Column:
        nib = lambda i: F.shiftright(F.col(f"v{k + i}"), 4)
        return (nib(2) * 256 + nib(1) * 16 + nib(0)).cast("double") / 4095.0

    wide = wide.withColumns({f"_{a}": 4.0 * (code(k) - 0.5) for a, k in (("x", 0), ("y", 3), ("z", 6))})
    x, y, z = geom.expand(F.col("_x"), F.col("_y"), F.col("_z"))
    quat = [F.col(f"v{16 + i}") * (2.0 / 255.0) - 1.0 for i in range(4)]
    return wide.select(
        *KEY, x.alias("x"), y.alias("y"), (-z).alias("z"),
        *[(F.col(f"v{9 + i}") / 255.0).alias(c) for i, c in enumerate(("cr", "cg", "cb", "ca"))],
        *[(F.col(f"v{13 + i}") * (-geom.MAX_SCALE_EXPONENT / 255.0) + geom.SCALE_BIAS).alias(f"e{i}") for i in range(3)],
        (-quat[0]).alias("q0"), quat[1].alias("q1"), quat[2].alias("q2"), (-quat[3]).alias("q3"),
    )


# ---- filters -----------------------------------------------------------------------------------------------------


def crop_sphere(splats: DataFrame, transform: list[list[float]], radius: float, mode: str) -> DataFrame:
    """Crop by a sphere after a 4x4 transform. ``zero`` blanks rows beyond it in place, ``mark`` kills rows not within."""
    p = [sum((F.lit(float(transform[i][j])) * F.col(c) for j, c in enumerate(XYZ)), F.lit(float(transform[i][3]))) for i in range(3)]
    src = splats.withColumn("_d", geom.norm(*p))
    if mode == "mark":
        return src.withColumn("alive", F.col("alive") & (F.col("_d") < radius)).drop("_d")
    blank = [c for c in splats.columns if c not in (*KEY, "scene_id", "alive", "grad")]
    return src.withColumns({c: F.when(F.col("_d") > radius, F.lit(0.0)).otherwise(F.col(c)) for c in blank}).drop("_d")


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf")))


def kill_nonfinite(splats: DataFrame) -> DataFrame:
    good = _finite("x") & _finite("y") & _finite("z")
    src = splats.withColumn("_ok", good)
    out = {c: F.when(F.col("_ok"), F.col(c)).otherwise(F.lit(0.0)) for c in XYZ}
    return src.withColumns({**out, "alive": F.col("alive") & F.col("_ok")}).drop("_ok")


def cull_splats(splats: DataFrame, cams: DataFrame) -> DataFrame:
    """Keep alive only splats that are finite, opaque, not tiny, have a gradient and are visible."""
    seen = visible_to_any(splats, cams, KEY)
    limit = math.exp(-geom.MAX_SCALE_EXPONENT * 0.95)
    keep = _finite("x") & _finite("y") & _finite("z") & (geom.sigmoid(F.col("alpha")) > geom.DEAD_ALPHA)
    for c in SCALE:
        keep = keep & (F.exp(geom.scale_active(F.col(c))) > limit)
    keep = keep & (F.col("grad") > 1e-9) & F.col("visible")
    return seen.withColumn("alive", F.col("alive") & F.coalesce(keep, F.lit(False))).drop("visible")


# ---- population --------------------------------------------------------------------------------------------------


def _from_points(spacing: Column) -> dict[str, Column]:
    s = geom.scale_raw(geom.clamp(F.ln(spacing), -geom.MAX_SCALE_EXPONENT, 0.0))
    out = {c: geom.logit(F.col(p)) for c, p in zip(COLOR, "rgb")}
    out |= {"alpha": F.lit(-1.0), **{c: s for c in SCALE}}
    return out | {c: F.lit(1.0 if c == "q3" else 0.0) for c in QUAT}


def init_splats(points: DataFrame, scope: str, max_n: int, seed: int, key: str = "point_id") -> DataFrame:
    """A splat per point, slots by id, padded to ``max_n`` per scope with dead rows on the far sphere."""
    spaced = points.join(knn_spacing(points, [scope], key).hint("merge"), [scope, key])
    ranked = exact_rank(spaced, [scope], key, key, out="splat_idx")
    live = ranked.select(
        F.col(scope).alias("frame_idx"), "splat_idx", *XYZ, *[c.alias(n) for n, c in _from_points(F.col("spacing")).items()],
        F.lit(True).alias("alive"),
    )
    block = 4096
    have = points.groupBy(F.col(scope).alias("frame_idx")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < max_n)
    pad = have.withColumn("b", F.explode(F.sequence(F.floor(F.col("n") / block), F.lit((max_n - 1) // block).cast("bigint"))))
    pad = pad.withColumn(
        "splat_idx",
        F.explode(F.sequence(F.greatest(F.col("n"), F.col("b") * block), F.least(F.lit(max_n - 1), F.col("b") * block + block - 1))),
    )
    did = F.col("frame_idx") * max_n + F.col("splat_idx")
    pad = pad.withColumns({f"_{c}": hash01(did, seed + i) - 0.5 for i, c in enumerate(XYZ)})
    n = geom.norm(F.col("_x"), F.col("_y"), F.col("_z"))
    far = {c: geom.div(F.col(f"_{c}") * geom.Z_FAR, n) for c in XYZ}
    rest = {c: F.lit(0.0) for c in (*COLOR, *SCALE, *QUAT)} | {"alpha": F.lit(-10.0), "q3": F.lit(1.0)}
    dead = pad.select("frame_idx", "splat_idx", *[c.alias(n) for n, c in (far | rest).items()], F.lit(False).alias("alive"))
    return live.unionByName(dead)


def fill_dead_slots(splats: DataFrame, new_points: DataFrame, key: str = "point_id") -> DataFrame:
    """New points (with their spacing and frame_idx) take the lowest dead slots of their frame, as far as they reach."""
    dead = exact_rank(splats.where(~F.col("alive")).select(*KEY), ["frame_idx"], "splat_idx", "splat_idx")
    new = exact_rank(new_points, ["frame_idx"], key, key)
    new = new.select("frame_idx", "rank", *XYZ, *[c.alias(n) for n, c in _from_points(F.col("spacing")).items()])
    put = dead.join(new, ["frame_idx", "rank"]).select(*KEY, F.struct(*PARAMS).alias("n"))
    j = splats.join(put, KEY, "left")
    fresh = F.col("n").isNotNull()
    return j.withColumns(
        {**{c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(c)) for c in PARAMS}, "alive": F.col("alive") | fresh}
    ).drop("n")


SHRINK, JITTER = math.log(1.1), 0.1


def _jitter(did: Column, seed: int, m: list[Column], scales: list[Column]) -> list[Column]:
    """A random offset inside the parent's box, turned by the transposed rotation."""
    v = [(hash01(did, seed + i) - 0.5) * JITTER * s for i, s in enumerate(scales)]
    return [m[j] * v[0] + m[3 + j] * v[1] + m[6 + j] * v[2] for j in range(3)]


def spawn_splats(splats: DataFrame, target: int, seed: int) -> DataFrame:
    """Clone the splats with the largest gradient into the weakest slots of their frame.

    Grows to ``target`` but at most to twice the living, and never beyond the slots. Parents repeat in order of rank
    when there are fewer than clones; a parent shrinks once and is pushed once per clone. A column ``stabilize`` tells the slots that
    are held to the frame before: it is cleared for the dead, for parents and for children.
    """
    imp = F.when(F.col("alive"), geom.sigmoid(F.col("alpha"))).otherwise(F.lit(0.0))
    counts = splats.groupBy("frame_idx").agg(F.count_if("alive").alias("_p"), F.count(F.lit(1)).alias("_all"))
    grow = F.least(F.lit(target), F.col("_p") * 2) - F.col("_p")
    counts = counts.select("frame_idx", "_p", F.greatest(F.lit(0), F.least(grow, F.col("_all") - F.col("_p"))).alias("_m"))
    counts = broadcast_if_small(counts.where((F.col("_m") > 0) & (F.col("_p") > 0)))
    slots = exact_rank(splats.select(*KEY, imp.alias("_imp")), ["frame_idx"], "_imp", "splat_idx")
    slots = slots.join(counts, "frame_idx").where(F.col("rank") < F.col("_m"))
    slots = slots.select("frame_idx", F.col("splat_idx").alias("_slot"), (F.col("rank") % F.col("_p")).alias("rank"))
    parents = exact_rank(splats.where("alive"), ["frame_idx"], "grad", "splat_idx", descending=True)
    pairs = slots.join(parents.select("frame_idx", "rank", "splat_idx", *PARAMS), ["frame_idx", "rank"])
    qn = geom.norm(*_cols(QUAT)) + 1e-6
    pairs = pairs.withColumns({f"_u{i}": F.col(c) / qn for i, c in enumerate(QUAT)})
    rot = geom.quat_matrix(*[F.col(f"_u{i}") for i in range(4)])
    pairs = pairs.withColumns({f"_m{i}": c for i, c in enumerate(rot)} | {f"_e{i}": geom.scale_active(F.col(c)) for i, c in enumerate(SCALE)})
    m, size = [F.col(f"_m{i}") for i in range(9)], [F.exp(F.col(f"_e{i}")) for i in range(3)]
    did = F.col("frame_idx") * 1_000_003 + F.col("_slot")
    off1, off2 = _jitter(did, seed, m, size), _jitter(did, seed + 3, m, size)
    small = {c: geom.logit_tensor((geom.SCALE_BIAS - (F.col(f"_e{i}") - SHRINK)) / geom.MAX_SCALE_EXPONENT) for i, c in enumerate(SCALE)}
    pairs = pairs.withColumns(
        {f"_n{c}": F.col(c) + o for c, o in zip(XYZ, off1)} | {f"_o{c}": o for c, o in zip(XYZ, off2)} | {f"_n{c}": s for c, s in small.items()}
    )
    child = {**{c: F.col(f"_n{c}") for c in (*XYZ, *SCALE)}, **{c: F.col(c) for c in (*COLOR, "alpha", *QUAT)}}
    children = pairs.select("frame_idx", F.col("_slot").alias("splat_idx"), F.struct(*[child[c].alias(c) for c in PARAMS]).alias("ch"))
    pushed = pairs.groupBy(*KEY).agg(
        F.struct(*[F.sum(f"_o{c}").alias(c) for c in XYZ], *[F.first(f"_n{c}").alias(c) for c in SCALE]).alias("pu")
    )
    j = splats.join(children, KEY, "left").join(pushed, KEY, "left")
    is_child, is_parent = F.col("ch").isNotNull(), F.col("pu").isNotNull()

    def value(c: str) -> Column:
        own = F.col(c)
        if c in XYZ:
            own = F.when(is_parent, F.col(c) + F.col(f"pu.{c}")).otherwise(own)
        if c in SCALE:
            own = F.when(is_parent, F.col(f"pu.{c}")).otherwise(own)
        return F.when(is_child, F.col(f"ch.{c}")).otherwise(own)

    held = {"stabilize": F.col("stabilize") & F.col("alive") & ~is_child & ~is_parent} if "stabilize" in splats.columns else {}
    return j.withColumns({**{c: value(c) for c in PARAMS}, **held, "alive": F.col("alive") | is_child}).drop("ch", "pu")


# ---- measures ----------------------------------------------------------------------------------------------------


def _voxel_hash(voxel: float) -> Column:
    # fixed values of the voxel hash
    parts = [
        F.floor(F.col(c) / voxel).cast("bigint") * F.lit(k).cast("bigint")
        for c, k in zip(XYZ, (73856093, 19349663, 83492791))
    ]
    return F.abs(parts[0].bitwiseXOR(parts[1]).bitwiseXOR(parts[2]))


def isolated_splats(splats: DataFrame, voxel: float = 0.1) -> DataFrame:
    """Mean opacity of the living splats that are alone in their hash bucket, over all living, per frame.

    A bucket's sum is only used when its count is one, so buckets are aggregated rather than joined back.
    """
    buckets = (
        splats.where("alive")
        .groupBy("frame_idx", _voxel_hash(voxel).alias("h"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(geom.sigmoid(F.col("alpha"))).alias("a"))
    )
    alone = F.when(F.col("n") == 1, F.col("a")).otherwise(F.lit(0.0))
    return buckets.groupBy("frame_idx").agg((F.sum(alone) / F.sum("n")).alias("isolation"), F.count_if(F.col("n") == 1).alias("isolated"))


def first_camera(cams: DataFrame, scene: str = "scene_id") -> DataFrame:
    """The lowest-index rectilinear camera of each scene."""
    pin = cams.where(F.col("cam_model") == "rectilinear")
    return pin.groupBy(scene).agg(F.min_by(F.struct(*pin.columns), "cam_idx").alias("c")).select("c.*")


def splat_health(splats: DataFrame, cams: DataFrame) -> DataFrame:
    """One row of conditional aggregates per frame. ``cams`` holds one camera per scene."""
    a = geom.sigmoid(F.col("alpha"))
    sizes = [F.exp(geom.scale_active(F.col(c))) for c in SCALE]
    src = splats.withColumns({"_a": a, "_n": geom.norm(*_cols(XYZ)), "_ratio": F.greatest(*sizes) / F.least(*sizes)})
    finite = _finite("x") & _finite("y") & _finite("z")
    live = lambda c: F.when(F.col("alive"), c)
    base = src.groupBy("frame_idx").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if("alive").alias("n_alive"), F.avg(live(F.col("_a"))).alias("mean_alpha"),
        F.avg(live(F.greatest(F.col("_ratio") - 4.0, F.lit(0.0)))).alias("scale_excess"),
        F.avg(live(F.pow(F.greatest(F.col("_n") - geom.Z_FAR, F.lit(0.0)), F.lit(2.0)))).alias("far_excess"),
        F.count_if(~finite).alias("n_nonfinite"),
    )
    near = project_splats(splats.where("alive"), cams, near=geom.Z_NEAR).where(
        touches_image() & (F.col("depth") > geom.Z_NEAR) & (F.col("depth") < 0.5)
    )
    near = near.groupBy("frame_idx").agg(F.sum("opacity").alias("_near"))
    j = base.join(near, "frame_idx", "left")
    return j.withColumn("near_floaters", F.coalesce("_near", F.lit(0.0)) / F.col("_all")).drop("_all", "_near")


def splat_drift(splats: DataFrame, stable: str = "alive") -> DataFrame:
    """Smooth-L1 distance of each frame's usable attributes to the frame before, over the slots where ``stable`` holds.

    After a population step that is ``stabilize``, which ``spawn_splats`` clears for what has been killed, moved or made.
    """
    groups = {
        "pos": [F.col(c) for c in XYZ], "color": [geom.sigmoid(F.col(c)) for c in COLOR], "alpha": [geom.sigmoid(F.col("alpha"))],
        "scale": [geom.scale_active(F.col(c)) for c in SCALE], "quat": _cols(QUAT),
    }
    cur = splats.where(stable).select(*KEY, *[c.alias(f"{g}{i}") for g, cs in groups.items() for i, c in enumerate(cs)])
    prev = splats.select(
        (F.col("frame_idx") + 1).alias("frame_idx"), "splat_idx", *[c.alias(f"_{g}{i}") for g, cs in groups.items() for i, c in enumerate(cs)]
    )
    j = cur.join(prev, KEY)

    def loss(name: str) -> Column:
        d = F.abs(F.col(name) - F.col(f"_{name}"))
        return F.when(d < 1.0, 0.5 * d * d).otherwise(d - 0.5)

    mean = lambda g, n: (F.sum(sum((loss(f"{g}{i}") for i in range(n)), F.lit(0.0))) / (F.count(F.lit(1)) * n)).alias(f"{g}_drift")
    return j.groupBy("frame_idx").agg(*[mean(g, len(cs)) for g, cs in groups.items()])


def norm_summary(splats: DataFrame, attrs: dict[str, list[str]]) -> DataFrame:
    """Largest, smallest and mean length per attribute over the living rows: one pass, one row per attribute."""
    rows = F.array(*[F.struct(F.lit(n).alias("attr"), geom.norm(*_cols(cs)).alias("len")) for n, cs in attrs.items()])
    long = splats.where("alive").select(F.explode(rows).alias("r")).select("r.*")
    return long.groupBy("attr").agg(F.max("len").alias("max_norm"), F.min("len").alias("min_norm"), F.avg("len").alias("mean_norm"))


# ---- projection, tiles, compositing ------------------------------------------------------------------------------


def project_splats(splats: DataFrame, cams: DataFrame, near: float = 0.1, scene: str = "scene_id") -> DataFrame:
    """Screen centre, 2x2 covariance, axes and 3-sigma radius of every living splat in its rectilinear cameras."""
    src = splats.where("alive")
    qn = geom.norm(*_cols(QUAT))
    src = src.withColumns({f"_u{i}": geom.div(F.col(c), qn) for i, c in enumerate(QUAT)})
    src = src.withColumns({f"_e{i}": F.exp(geom.scale_active(F.col(c))) for i, c in enumerate(SCALE)})
    rot = geom.quat_matrix(*[F.col(f"_u{i}") for i in range(4)])
    src = src.withColumns({f"_m{i}": c * F.col(f"_e{i % 3}") for i, c in enumerate(rot)})
    src = src.select(
        scene, *KEY, *XYZ, *[f"_m{i}" for i in range(9)], geom.sigmoid(F.col("alpha")).alias("opacity"),
        *[geom.sigmoid(F.col(c)).alias(n) for c, n in zip(COLOR, ("col0", "col1", "col2"))],
    )
    pairs = per_camera(src, cams.where(F.col("cam_model") == "rectilinear"), scene)
    xc, yc, zc = in_cam(F.col("cam"))
    pairs = settle(pairs.withColumns({"_xc": xc, "_yc": -yc, "depth": zc}), ["_xc", "_yc", "depth"])
    pairs = pairs.where(F.col("depth") >= near)
    cam = geom.field(F.col("cam"))
    z = F.col("depth")
    sign = {0: 1.0, 1: -1.0}
    jac = {}
    for i, (f, p) in enumerate((("fx", "_xc"), ("fy", "_yc"))):
        for j in range(3):
            jac[f"_t{i}{j}"] = cam(f) / z * (sign[i] * cam(f"r{i}{j}") - F.col(p) / z * cam(f"r2{j}"))
    pairs = pairs.withColumns(jac)
    pairs = pairs.withColumns(
        {f"_a{i}{k}": sum((F.col(f"_t{i}{j}") * F.col(f"_m{3 * j + k}") for j in range(3)), F.lit(0.0)) for i in range(2) for k in range(3)}
    )
    dot = lambda i, j: sum((F.col(f"_a{i}{k}") * F.col(f"_a{j}{k}") for k in range(3)), F.lit(0.0))
    pairs = pairs.withColumns({"cov00": dot(0, 0), "cov01": dot(0, 1), "cov11": dot(1, 1)})
    mid = (F.col("cov00") + F.col("cov11")) / 2.0
    half = (F.col("cov00") - F.col("cov11")) / 2.0
    spread = F.sqrt(half * half + F.col("cov01") * F.col("cov01"))
    pairs = pairs.withColumns({"lambda1": mid + spread, "lambda2": F.greatest(mid - spread, F.lit(0.0))})
    out = pairs.select(
        *KEY, cam("cam_idx").alias("cam_idx"), cam("width").alias("width"), cam("height").alias("height"),
        (F.col("_xc") / z * cam("fx") + cam("cx")).alias("u"), (F.col("_yc") / z * cam("fy") + cam("cy")).alias("v"),
        "depth", "cov00", "cov01", "cov11", "lambda1", "lambda2", (3.0 * F.sqrt("lambda1")).alias("radius"),
        "opacity", "col0", "col1", "col2",
    )
    return settle(out, ["u", "v", "depth", "cov00", "cov01", "cov11", "lambda1", "lambda2", "radius"])


def touches_image() -> Column:
    u, v, r = F.col("u"), F.col("v"), F.col("radius")
    return (r > 0) & (u + r > 0) & (u - r < F.col("width")) & (v + r > 0) & (v - r < F.col("height"))


VIEW = ["frame_idx", "cam_idx", "ty", "tx"]


def splats_in_tiles(projected: DataFrame, tile: int = 16) -> DataFrame:
    """Every tile of the image that a splat's box touches, with the splat's place in depth order there."""

    def span(c: str, dim: str) -> Column:
        last = F.floor((F.col(dim) - 1) / F.lit(tile))
        lo = F.greatest(F.floor((F.col(c) - F.col("radius")) / tile), F.lit(0))
        hi = F.least(F.floor((F.col(c) + F.col("radius")) / tile), last)
        return F.sequence(lo.cast("bigint"), hi.cast("bigint"))

    on = projected.where(touches_image())
    out = on.withColumn("ty", F.explode(span("v", "height"))).withColumn("tx", F.explode(span("u", "width")))
    return exact_rank(out, VIEW, "depth", "splat_idx", out="draw_order")


ALPHA_MIN, ALPHA_MAX = 1.0 / 255.0, 0.999


MIXED = ["col0", "col1", "col2", "depth"]


def _composited(tile: int):
    """Sums of each pixel over a chunk of a tile's splats, and what the chunk lets through."""
    at = np.arange(tile * tile)
    names = ["u", "v", "cov00", "cov01", "cov11", "_det", "opacity", "width", "height"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, group in whole_groups(batches, [*VIEW, "_c"]):
            cols = {c: pdf[c].to_numpy("f8")[:, None] for c in names}
            values, there = pdf[MIXED].to_numpy("f8"), pdf[[f"_has_{c}" for c in MIXED]].to_numpy(bool)
            ends = np.r_[np.flatnonzero(np.diff(group)) + 1, len(group)]
            found = []
            for lo, hi in zip(np.r_[0, ends[:-1]], ends):
                u, v, c00, c01, c11, det, opacity, width, height = (cols[c][lo:hi] for c in names)
                y, x = pdf["ty"].iat[lo] * tile + at // tile, pdf["tx"].iat[lo] * tile + at % tile
                dx, dy = x + 0.5 - u, y + 0.5 - v
                with np.errstate(all="ignore"):
                    power = (c11 * dx * dx - 2.0 * c01 * dx * dy + c00 * dy * dy) / det
                    alpha = np.fmin(ALPHA_MAX, opacity * np.exp(-0.5 * power))
                hit = (alpha >= ALPHA_MIN) & (y < height) & (x < width)
                through = np.cumprod(np.where(hit, 1.0 - alpha, 1.0), axis=0)
                w = np.where(hit, alpha, 0.0)
                w[1:] *= through[:-1]
                used = hit.any(axis=0)
                rows = pdf.iloc[[lo]][["frame_idx", "cam_idx", "_c"]]
                rows = rows.loc[rows.index.repeat(used.sum())].assign(y=y[used], x=x[used], coverage=w.sum(axis=0)[used], _t=through[-1][used])
                for k, c in enumerate(MIXED):
                    rows[c] = np.where(hit, w * values[lo:hi, k, None], 0.0).sum(axis=0)[used]
                    rows[f"_n_{c}"] = (hit & there[lo:hi, k, None]).sum(axis=0)[used]
                found.append(rows)
            yield pd.concat(found, ignore_index=True)

    return run


def composite_tiles(tiles: DataFrame, tile: int = 16) -> DataFrame:
    """Front-to-back colour, inverse depth weight and coverage per pixel.

    The rows of a tile are cut by draw order into chunks, which are shuffled as they are; a task makes their pixels and passes on
    one row for each pixel of a chunk. What a chunk's pixel gets is then multiplied by what the chunks before it let through.
    """
    det = F.col("cov00") * F.col("cov11") - F.col("cov01") * F.col("cov01")
    src = with_chunk(tiles.withColumn("_det", det).where(F.col("_det") > 0), "draw_order")
    src = src.select(
        *VIEW, "_c", "draw_order", "u", "v", "cov00", "cov01", "cov11", "_det", "opacity", "width", "height",
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in MIXED], *[F.col(c).isNotNull().alias(f"_has_{c}") for c in MIXED],
    )
    src = src.repartition(*VIEW, "_c").sortWithinPartitions(*VIEW, "_c", "draw_order")
    keys = ["frame_idx", "cam_idx", "y", "x"]
    whole = [(c, T.LongType()) for c in ("_c", "y", "x")] + [(c, T.DoubleType()) for c in ("coverage", "_t", *MIXED)] + [(f"_n_{c}", T.LongType()) for c in MIXED]
    out = T.StructType([f for f in src.schema if f.name in keys] + [T.StructField(*f) for f in whole])
    px = src.mapInPandas(_composited(tile), out)
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    px = px.withColumn("_in", F.coalesce(F.product("_t").over(before), F.lit(1.0)))
    # a value that no splat of a pixel has stays missing
    mixed = [F.when(F.sum(f"_n_{c}") > 0, F.sum(F.col("_in") * F.col(c))).alias(c) for c in MIXED]
    return px.groupBy(*keys).agg(*mixed, F.sum(F.col("_in") * F.col("coverage")).alias("coverage"))
