"""Layered pictures: vignettes, assembly, fusing, packing, meshes, selections, relaxation, view blending, tiled maps."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenetab.functions import geom
from scenetab.functions.batches import whole_groups
from scenetab.functions.session import broadcast_if_small, cut_lineage
from scenetab.operators import stencil as S
from scenetab.operators.warps import apply_warp, camera_grid

Size = tuple[int, int]
PIXEL = ["frame_idx", "y", "x"]


# ---- vignettes ---------------------------------------------------------------------------------------------------


def vignette(cams: DataFrame, frame: Size, r0: float, r1: float, e0: float, e1: float, blur: int = 21, sigma: float = 11.0, tile: int = S.TILE) -> DataFrame:
    """Radial and edge fade per camera, blurred. The edge distance starts from the width on both axes."""
    h, w = frame
    g = camera_grid(cams.select("cam_idx", "cx", "cy", "radius_at_90"), w, h)
    rad = F.col("radius_at_90")
    r = geom.norm(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    start, end = rad * r0, rad * r1
    a = F.when(r > start, 1.0 - geom.clamp((r - start) / (end - start), 0.0, 1.0)).otherwise(F.lit(1.0))
    edge = F.least(F.lit(w).cast("bigint"), F.col("x"), F.col("y"), F.abs(F.col("x") - w + 1), F.abs(F.col("y") - h + 1))
    fade_end, fade_start = (rad * e0).cast("int"), (rad * e1).cast("int")
    fade = F.least(F.lit(1.0), geom.div((edge - fade_end).cast("double"), (fade_start - fade_end).cast("double")))
    g = g.select("cam_idx", "y", "x", (a * F.when(edge < fade_start, fade).otherwise(F.lit(1.0))).alias("v"))
    t = S.tiled(g, ["cam_idx"], blur // 2, frame, tile)
    return S.untiled(S.blur(t, ["cam_idx"], ["v"], blur, sigma), frame, tile)


def superellipse(pixels: DataFrame, frame: Size, sigma: float = 0.5, r0: float = 0.95, r1: float = 0.99, p: float = 10.0) -> DataFrame:
    """Adds v, a fade by the p-norm of the normalized position; needs no second table."""
    h, w = frame
    at = lambda c, n: F.abs(-1.0 + 2.0 * F.col(c) / float(n - 1))
    r = F.pow(F.pow(at("x", w), F.lit(p)) + F.pow(at("y", h), F.lit(p)), F.lit(1.0 / p))
    src = pixels.withColumn("_r", r)
    v = F.exp(-sigma * F.col("_r") * F.col("_r")) * geom.clamp((r1 - F.col("_r")) / (r1 - r0), 0.0, 1.0)
    return src.withColumn("v", v).drop("_r")


def apply_vignette(pixels: DataFrame, vig: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Multiply by a vignette table, which is small and the same for all frames."""
    v = broadcast_if_small(vig.select(*keys, "y", "x", F.col("v").alias("_v")))
    j = pixels.join(v, [*keys, "y", "x"])
    return j.withColumns({c: F.col(c) * F.col("_v") for c in cols}).drop("_v")


# ---- assembly ----------------------------------------------------------------------------------------------------

ORDER_GAP = 1.0 / 1024.0


def assemble_layers(color: DataFrame, depth: DataFrame, frame: Size, tile: int = S.TILE) -> DataFrame:
    """Three layers per pixel: blended colours and depths, depths kept in order, vignettes applied.

    ``color`` (full size): b g r, fills mb mg mr (middle) and kb kg kr (bottom), blends l1_blend l0_blend, alphas l1_alpha
    l2_alpha, vignettes cv dv. ``depth`` (half size): invd, mid and bot depth fills.
    """
    half = (frame[0] // 2, frame[1] // 2)
    blend = S.shrink(color.select(*PIXEL, "l0_blend", "l1_blend"), ["frame_idx"], ["l0_blend", "l1_blend"], 2)
    mix = lambda fill, own, a: F.col(fill) * F.col(a) + F.col(own) * (1.0 - F.col(a))
    d = depth.join(blend, PIXEL).withColumns({"mid": mix("mid", "invd", "l1_blend"), "bot": mix("bot", "invd", "l0_blend")})
    under = lambda low, high: F.greatest(F.lit(0.0), F.least(F.col(low), F.col(high) - ORDER_GAP))
    d = d.withColumn("mid", under("mid", "invd")).withColumn("bot", under("bot", "mid"))
    d = S.enlarge(d, ["frame_idx"], ["invd", "mid", "bot"], 2, half, tile)
    j = color.join(d, PIXEL)
    v = F.col("cv")
    layer = lambda i, names, a, invd: F.struct(
        F.lit(i).alias("layer"), *[(e * v).alias(c) for c, e in zip("bgr", names)], a.alias("a"), (F.col(invd) * F.col("dv")).alias("invd")
    )
    top = layer(2, [F.col(c) for c in "bgr"], F.col("l2_alpha") * v, "invd")
    mid = layer(1, [mix(f"m{c}", c, "l1_blend") for c in "bgr"], F.col("l1_alpha") * v, "mid")
    bot = layer(0, [mix(f"k{c}", c, "l0_blend") for c in "bgr"], F.lit(1.0), "bot")
    return j.select(*PIXEL, F.explode(F.array(bot, mid, top)).alias("l")).select(*PIXEL, "l.*")


def fuse_layers(layers: DataFrame) -> DataFrame:
    """Back to front into one picture. Colour mixes by coverage, depth by the top alpha alone."""
    stack = layers.groupBy(*PIXEL).agg(F.array_sort(F.collect_list(F.struct("layer", "b", "g", "r", "a", "invd"))).alias("s"))
    first = F.get("s", 0)
    start = F.struct(*[first.getField(c).alias(c) for c in ("b", "g", "r", "a", "invd")])

    def merge(low: Column, top: Column) -> Column:
        ta = top.getField("a")
        new_a = 1.0 - (1.0 - low.getField("a")) * (1.0 - ta)
        f = geom.clamp(ta / (new_a + 1e-6), 0.0, 1.0)
        mixed = [(low.getField(c) * (1.0 - f) + top.getField(c) * f).alias(c) for c in "bgr"]
        return F.struct(*mixed, new_a.alias("a"), (low.getField("invd") * (1.0 - ta) + top.getField("invd") * ta).alias("invd"))

    out = F.aggregate(F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))), start, merge)
    return stack.select(*PIXEL, out.alias("o")).select(*PIXEL, "o.*")


# ---- packing -----------------------------------------------------------------------------------------------------


def _byte(c: Column) -> Column:
    return geom.clamp(F.rint(c * 255.0), 0.0, 255.0).cast("int")


def pack_ldi(layers: DataFrame, size: int, num_layers: int = 3, dilate_invd: int = 0, tile: int = S.TILE) -> DataFrame:
    """Layers as one picture of 8-bit b, g, r: per layer colour, split depth and alpha, top layer first."""
    half = size // 2
    up = (F.lit(num_layers - 1) - F.col("layer")) * size
    at = lambda df, y, x, b, g, r: df.select("frame_idx", (up + y).alias("y"), x.alias("x"), b.alias("b"), g.alias("g"), r.alias("r"))
    y, x = F.col("y"), F.col("x")
    color = at(layers, y, x, *[_byte(F.col(c)) for c in "bgr"])
    alpha = at(layers, y, x + 2 * size, *[_byte(F.col("a"))] * 3)
    depth = layers.select(*PIXEL, "layer", "invd")
    if dilate_invd:
        keys = ["frame_idx", "layer"]
        wide = S.untiled(S.dilate(S.tiled(depth, keys, dilate_invd, None, tile), keys, ["invd"], dilate_invd), None, tile)
        depth = wide.where("layer > 0").unionByName(depth.where("layer = 0"))
    depth = S.shrink(depth, ["frame_idx", "layer"], ["invd"], 2)
    code = (geom.clamp(F.col("invd"), 0.0, 1.0) * 4095).cast("int")
    low = code.bitwiseAND(F.lit(255))
    low = F.when(code.bitwiseAND(F.lit(256)) == 0, low).otherwise(255 - low)
    quarter = F.array(
        *[
            F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), v.alias("v"))
            for dy, dx, v in ((0, 0, low), (0, half, F.shiftright(code, 8) * 16 + 8), (half, 0, _byte(F.col("invd"))), (half, half, F.lit(0)))
        ]
    )
    cells = depth.select("frame_idx", "layer", "y", "x", F.explode(quarter).alias("q"))
    packed = at(cells, y + F.col("q.dy"), x + F.col("q.dx") + size, *[F.col("q.v")] * 3)
    return color.unionByName(alpha).unionByName(packed)


def unpack_ldi(packed: DataFrame, size: int, num_layers: int = 3) -> tuple[DataFrame, DataFrame]:
    """(colour and alpha at full size, inverse depth at half size) of a packed picture."""
    half = size // 2
    src = packed.withColumns(
        {"layer": (F.lit(num_layers - 1) - F.floor(F.col("y") / size)).cast("int"), "cell": F.floor(F.col("x") / size), "y": F.col("y") % size, "x": F.col("x") % size}
    )
    keys = ["frame_idx", "layer", "y", "x"]
    own = lambda c, cell: F.max(F.when(F.col("cell") == cell, F.col(c)))
    color = src.where("cell <> 1").groupBy(*keys).agg(*[(own(c, 0) / 255.0).alias(c) for c in "bgr"], (own("b", 2) / 255.0).alias("a"))
    depth = src.where((F.col("cell") == 1) & (F.col("y") < half))
    side = F.col("x") >= half
    pair = depth.groupBy("frame_idx", "layer", "y", (F.col("x") % half).alias("x")).agg(
        F.max(F.when(~side, F.col("b"))).alias("lo"), F.max(F.when(side, F.col("b"))).alias("hi")
    )
    hi = F.shiftright(F.col("hi"), 4)
    lo = F.when(hi.bitwiseAND(F.lit(1)) == 0, F.col("lo")).otherwise(255 - F.col("lo"))
    return color, pair.select(*keys, ((lo + hi * 256).cast("double") / 4095.0).alias("invd"))


# ---- meshes ------------------------------------------------------------------------------------------------------

MESH_MAX_DIST, MESH_MARGIN = 50.0, 3


def layer_mesh(layers: DataFrame, size: int, ftheta_scale: float = 1.0, inflation: float = 3.0, coef: float = geom.INV_DEPTH_COEF, num_layers: int = 3) -> tuple[DataFrame, DataFrame]:
    """(vertices with uv, triangles) of square layers, ids computed from position so no counter is shared."""
    u, v = F.col("x") / float(size - 1), F.col("y") / float(size - 1)
    a, b = 2.0 * (u - 0.5), 2.0 * (v - 0.5)
    src = layers.withColumns({"_u": u, "_v": v, "_t": F.atan2(b, a), "_r": geom.norm(a, b) / ftheta_scale})
    phi = (0.5 * F.col("_r") + 0.5 * F.pow(F.col("_r"), F.lit(inflation))) * (math.pi / 2)
    d = geom.clamp(coef / (1e-6 + F.col("invd")), 0.0, MESH_MAX_DIST)
    src = src.withColumns({"_p": phi, "_d": d})
    vid = (F.col("layer") * (size * size) + F.col("y") * size + F.col("x")).cast("bigint")
    t, p, dist = F.col("_t"), F.col("_p"), F.col("_d")
    verts = src.select(
        "frame_idx", vid.alias("vertex_id"), (F.cos(t) * F.sin(p) * dist).alias("vx"), (-F.sin(t) * F.sin(p) * dist).alias("vy"),
        (-F.cos(p) * dist).alias("vz"), (F.col("_u") / num_layers + F.col("layer") / float(num_layers)).alias("tu"), (1.0 - F.col("_v")).alias("tv"),
    )
    mid = size // 2
    di, dj = F.col("x") - mid, F.col("y") - mid
    inside = layers.where(di * di + dj * dj <= (mid - MESH_MARGIN) ** 2)
    va, vb, vc, vd = vid, vid + 1, vid + size, vid + size + 1
    tri = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), i.alias("a"), j.alias("b"), l.alias("c")) for k, i, j, l in ((0, va, vc, vb), (1, vc, vd, vb))]))
    tris = inside.select("frame_idx", vid.alias("cell_id"), tri.alias("t")).select("frame_idx", "cell_id", "t.*")
    return verts, tris


# ---- editing -----------------------------------------------------------------------------------------------------

EDIT_GAP = 1.0 / 255.0


def blend_selection(
    layers: DataFrame, selection: DataFrame, on_layers: list[int], values: dict[str, Column], first: int, last: int, keep_order: bool = True
) -> DataFrame:
    """s * new + (1 - s) * old on chosen layers and channels over a frame range; lower layers stay behind upper ones.

    ``values`` maps a channel to its new value: a literal, or a column of ``selection`` (a source picture).
    """
    sel = broadcast_if_small(selection)
    j = layers.join(sel, ["layer", "y", "x"] if "layer" in selection.columns else ["y", "x"], "left")
    hit = F.col("layer").isin(on_layers) & F.col("frame_idx").between(first, last) & F.col("s").isNotNull()
    j = j.withColumns({c: F.when(hit, F.col("s") * v + (1.0 - F.col("s")) * F.col(c)).otherwise(F.col(c)) for c, v in values.items()})
    j = j.select(*layers.columns)
    if not keep_order:
        return j
    stack = j.groupBy(*PIXEL).agg(F.reverse(F.array_sort(F.collect_list(F.struct("layer", *[c for c in layers.columns if c not in (*PIXEL, "layer")])))).alias("s"))

    def push(acc: Column, cur: Column) -> Column:
        up = F.get(acc, F.size(acc) - 1)
        low = F.greatest(F.lit(0.0), F.least(cur.getField("invd"), up.getField("invd") - EDIT_GAP))
        moved = cur.withField("invd", F.when(up.isNull() | (up.getField("a") <= 0), cur.getField("invd")).otherwise(low))
        return F.concat(acc, F.array(moved))

    kind = stack.schema["s"].dataType
    empty = F.array().cast(kind)
    done = stack.withColumn("s", F.aggregate("s", empty, push))
    return done.select(*PIXEL, F.explode("s").alias("l")).select(*PIXEL, "l.*")


# ---- relaxation --------------------------------------------------------------------------------------------------


# cells along a side of the grid that one task solves directly
COARSE = 32
EDGES = {"wl": ("x", -1), "wr": ("x", 1), "wu": ("y", -1), "wd": ("y", 1)}


def _cells(pdf: pd.DataFrame, group: np.ndarray) -> tuple[int, np.ndarray, dict[str, np.ndarray]]:
    """(number of cells, each row's cell, each cell's neighbour by edge); a neighbour that is missing has the number after the last."""
    y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
    y, x = y - y.min() + 1, x - x.min() + 1
    high, wide = y.max() + 2, x.max() + 2
    cells, cell = np.unique((group * high + y) * wide + x, return_inverse=True)
    near = {}
    for name, (axis, step) in EDGES.items():
        want = cells + step * (wide if axis == "y" else 1)
        at = np.minimum(np.searchsorted(cells, want), len(cells) - 1)
        near[name] = np.where(cells[at] == want, at, len(cells))
    return len(cells), cell, near


def _swept(sweeps: int, tile: int, keys: list[str]):
    """Damped Jacobi sweeps of the correction ``z`` on tiles with their margins, and its product ``az`` with the matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, group in whole_groups(batches, [*keys, "ty", "tx"]):
            n, cell, near = _cells(pdf, group)

            def lay(name: str) -> np.ndarray:
                out = np.zeros(n + 1)
                out[cell] = pdf[name].to_numpy()
                return out

            z = lay("z")
            r, c, *w = (lay(name)[:n] for name in ("r", "c", *EDGES))
            d = c + w[0] + w[1] + w[2] + w[3]

            def around() -> np.ndarray:
                left, right, up, down = (e * z[at] for e, at in zip(w, near.values()))
                return left + right + up + down

            held = np.where(d > 0, d, 1.0)
            for _ in range(sweeps):
                z[:n] += np.where(d > 0, 0.8 * ((r + around()) / held - z[:n]), 0.0)
            az = d * z[:n] - around()
            pdf = pdf.assign(z=z[cell], az=az[cell])
            home = (pdf["y"] // tile == pdf["ty"]) & (pdf["x"] // tile == pdf["tx"])
            yield pdf[home].drop(columns=["ty", "tx"])

    return run


# numbers in the matrices that are solved at once
MATRICES = 1 << 22


def _solved(keys: list[str]):
    """The coarsest grids of frames, at most COARSE x COARSE cells each, solved directly; those of equal size at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, group in whole_groups(batches, keys):
            n, cell, near = _cells(pdf, group)
            row = np.zeros(n + 1, np.int64)
            row[cell] = np.arange(len(pdf))
            d = pdf[["c", *EDGES]].sum(axis=1).to_numpy()
            b = np.where(d > 0, pdf["r"].to_numpy(), 0.0)
            # a part without any fixed pixel has no single solution; the tiny addition picks the one that moves least
            own = np.where(d > 0, d * (1 + 1e-9), 1.0)
            edges = [(near[name][cell], pdf[name].to_numpy()) for name in EDGES]
            sizes = np.bincount(group)
            starts = np.cumsum(sizes) - sizes
            z = np.zeros(len(pdf))
            for k in np.unique(sizes):
                same, most = starts[sizes == k], max(1, MATRICES // (k * k))
                for at in range(0, len(same), most):
                    rows = same[at : at + most, None] + np.arange(k)
                    a = np.zeros((len(rows), k, k))
                    a[:, np.arange(k), np.arange(k)] = own[rows]
                    for other, w in edges:
                        f, i = np.nonzero((other[rows] < n) & (w[rows] > 0))
                        a[f, i, row[other[rows[f, i]]] - rows[f, 0]] -= w[rows[f, i]]
                    z[rows] = np.linalg.solve(a, b[rows][..., None])[..., 0]
            yield pdf[[*keys, "y", "x"]].assign(z=z)

    return run


def _coarser(level: DataFrame, keys: list[str]) -> DataFrame:
    """The system of blocks of 2 x 2 cells. A step between blocks covers two cells, so edges between them count half."""
    inner = {"wl": F.col("x") % 2 == 0, "wr": F.col("x") % 2 != 0, "wu": F.col("y") % 2 == 0, "wd": F.col("y") % 2 != 0}
    up = level.select(*keys, F.shiftright("y", 1).alias("y"), F.shiftright("x", 1).alias("x"), "c", "r", *[F.when(edge, F.col(n) / 2).otherwise(0.0).alias(n) for n, edge in inner.items()])
    return up.groupBy(*keys, "y", "x").agg(*[F.sum(n).alias(n) for n in ("c", "r", *EDGES)])


def _corrected(state: DataFrame, keys: list[str], depth: int, sweeps: int, tile: int) -> DataFrame:
    """``state`` with ``z``, an approximate solution for its residual ``r``, and ``az``, the product with the matrix.

    The residual is summed up to the coarsest grid and solved there; on the way back each level starts from its parent's
    solution and makes sweeps inside tiles, one shuffle a level.
    """
    levels = [state]
    for _ in range(depth):
        levels.append(_coarser(levels[-1], keys))
    cell = T.StructType([f for f in levels[-1].schema if f.name in (*keys, "y", "x")])
    coarsest = levels[-1].repartition(*keys).sortWithinPartitions(*keys)
    z = coarsest.mapInPandas(_solved(keys), T.StructType(cell.fields + [T.StructField("z", T.DoubleType())]))
    for level in reversed(levels[:-1]):
        parent = z.select(*keys, F.col("y").alias("_py"), F.col("x").alias("_px"), "z")
        both = level.withColumns({"_py": F.shiftright("y", 1), "_px": F.shiftright("x", 1)}).join(parent, [*keys, "_py", "_px"]).drop("_py", "_px")
        cut = S.tiled(both, keys, sweeps + 1, None, tile)
        kept = [f for f in cut.schema if f.name not in ("ty", "tx")]
        z = cut.sortWithinPartitions(*keys, "ty", "tx").mapInPandas(_swept(sweeps, tile, keys), T.StructType(kept + [T.StructField("az", T.DoubleType())]))
    return z


def _fill_system(cur: DataFrame, keys: list[str], edge: float, shared: float, tile: int) -> DataFrame:
    """One row per free pixel: weights of its edges to free neighbours, weight ``c`` of its fixed terms, residual ``r``."""
    row, col = S._axes(keys)
    t = S.tiled(cur, keys, 1, None, tile)
    look = {"wl": (F.lag, row), "wr": (F.lead, row), "wu": (F.lag, col), "wd": (F.lead, col)}
    t = t.withColumns({f"_{n}": fn(F.struct("_v", "_free", EDGES[n][0]), 1).over(w) for n, (fn, w) in look.items()})
    t = S.untiled(t, None, tile).where("_free")
    c, pull = F.col("_w") * F.col("_w"), F.lit(0.0)
    for n, (axis, step) in EDGES.items():
        near = F.col(f"_{n}")
        there = F.coalesce(near[axis] == F.col(axis) + step, F.lit(False))
        weight = F.when(there, F.when(near["_free"], F.lit(shared)).otherwise(F.lit(edge))).otherwise(F.lit(0.0))
        t = t.withColumn(n, F.when(there & near["_free"], F.lit(shared)).otherwise(F.lit(0.0)))
        c = c + F.when(there & ~near["_free"], F.lit(edge)).otherwise(F.lit(0.0))
        pull = pull + F.when(there, weight * (near["_v"] - F.col("_v"))).otherwise(F.lit(0.0))
    zero = F.lit(0.0)
    # the data term starts at its own target, so only the neighbours pull
    return t.select(*keys, "y", "x", *EDGES, c.alias("c"), F.col("_v").alias("v"), pull.alias("r"), zero.alias("p"), zero.alias("q"), "_b", F.lit(False).alias("_held"))


def relax_grid(
    pixels: DataFrame, value: str, keys: list[str] | None = None, mask: str | None = None, weight: str | None = None,
    upper: str | None = None, smooth: float = 3.0, sweeps: int = 4, tol: float = 1e-4, max_rounds: int = 60, tile: int = S.TILE,
) -> DataFrame:
    """Smooth fill: the least-squares solution over all frames at once, to within ``tol``.

    With ``mask`` the masked pixels minimize squared differences to their four neighbours (an edge between two masked
    pixels counts twice, since both ask for the smoothness). With ``weight`` every pixel keeps a data term of that weight.
    ``upper`` softly keeps a masked pixel 2/255 below a bound. Pixels outside the mask stay.

    The normal equations are solved by conjugate directions over coarse grids: each round sums the residual into ever
    larger blocks, solves the coarsest grid of each frame (at most 32 x 32 cells), and refines the correction level by
    level with sweeps inside tiles, so a hole of any width takes about as many rounds. A round cuts the change to a half or
    less; rounds stop when a whole round moves no pixel by more than a quarter of ``tol``. It is an error if that isn't
    reached in ``max_rounds``. Bounds hold for the pixels above them; that set is fixed, solved for and looked at again.
    """
    keys = keys or ["frame_idx"]
    free = F.lit(True) if mask is None else F.coalesce(F.col(mask).cast("boolean"), F.lit(False))
    cur = pixels.select(
        *keys, F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.col(value).cast("double").alias("_v"), free.alias("_free"),
        (F.lit(0.0) if weight is None else F.col(weight).cast("double")).alias("_w"),
        (F.lit(None).cast("double") if upper is None else F.col(upper) - 2.0 / 255.0).alias("_b"),
    )
    edge, shared = (1.0, 2.0) if weight is None else (2.0 * smooth * smooth,) * 2
    state = cut_lineage(_fill_system(cur, keys, edge, shared, tile))
    span = state.groupBy(*keys).agg(F.greatest(F.max("y") - F.min("y"), F.max("x") - F.min("x")).alias("n")).agg(F.max("n")).first()[0] or 0
    depth = 1
    while (span >> depth) + 2 > COARSE:
        depth += 1
    moved, loose = 0.0, 0
    for _ in range(max_rounds):
        if upper is not None:
            above = F.coalesce(F.col("v") > F.col("_b"), F.lit(False))
            turned = (above != F.col("_held")) & (F.abs(F.col("v") - F.col("_b")) > tol / 4)
            change = F.when(~turned, 0).when(above, 1).otherwise(-1)
            state = state.withColumn("_turn", F.coalesce(change, F.lit(0)))
            loose = state.where("_turn <> 0").limit(1).count()
            state = state.withColumns({"c": F.col("c") + F.col("_turn"), "r": F.col("r") + F.col("_turn") * F.coalesce(F.col("_b") - F.col("v"), F.lit(0.0)), "_held": F.col("_held") != (F.col("_turn") != 0)}).drop("_turn")
            if loose:  # another matrix: directions start anew
                state = state.withColumns({"p": F.lit(0.0), "q": F.lit(0.0)})
            elif _ and moved <= tol / 4:
                break
        both = cut_lineage(_corrected(state, keys, depth, sweeps, tile))
        dots = {"rz": ("r", "z"), "rp": ("r", "p"), "zaz": ("z", "az"), "zq": ("z", "q"), "pq": ("p", "q")}
        steps = both.groupBy(*keys).agg(*[F.sum(F.col(a) * F.col(b)).alias(f"_{n}") for n, (a, b) in dots.items()])
        steps = steps.withColumn("_beta", F.when(F.col("_pq") > 0, F.col("_zq") / F.col("_pq")).otherwise(0.0))
        along = F.col("_zaz") - F.col("_beta") * F.col("_zq")
        steps = cut_lineage(steps.select(*keys, "_beta", F.when(along > 0, (F.col("_rz") - F.col("_beta") * F.col("_rp")) / along).otherwise(0.0).alias("_alpha")))
        state = both.join(broadcast_if_small(steps), keys).withColumns({"p": F.col("z") - F.col("_beta") * F.col("p"), "q": F.col("az") - F.col("_beta") * F.col("q")})
        state = state.withColumns({"v": F.col("v") + F.col("_alpha") * F.col("p"), "r": F.col("r") - F.col("_alpha") * F.col("q"), "_by": F.abs(F.col("_alpha") * F.col("p"))})
        moved = state.agg(F.max("_by")).first()[0] or 0.0
        state = state.drop("z", "az", "_beta", "_alpha", "_by")
        if moved <= tol / 4 and upper is None:
            break
    else:
        raise RuntimeError(f"the fill still moves by {moved} after {max_rounds} rounds")
    filled = state.select(*keys, "y", "x", F.col("v").alias("_new"))
    out = cur.select(*keys, "y", "x", "_v").join(filled, [*keys, "y", "x"], "left")
    return out.select(*keys, "y", "x", geom.clamp(F.coalesce("_new", "_v"), 0.0, 1.0).alias(value))


def relax_grid_small(pixels: DataFrame, value: str, factor: int, mask: str, keys: list[str] | None = None, upper: str | None = None, tile: int = S.TILE, **how) -> DataFrame:
    """``relax_grid`` on frames shrunk by a whole ``factor``; the small frames are the result.

    Values, mask and bound are averaged over blocks; a block is filled if at least half of it is masked. Frame sides should
    be multiples of the factor: blocks at a cut edge average what they have.
    """
    keys = keys or ["frame_idx"]
    both = pixels.withColumn("_mask", F.col(mask).cast("boolean").cast("double"))
    small = S.shrink(both, keys, [value, "_mask", *([upper] if upper else [])], factor).withColumn("_mask", F.col("_mask") >= 0.5)
    return relax_grid(small, value, keys, mask="_mask", upper=upper, tile=tile, **how)


# ---- between-frame views -----------------------------------------------------------------------------------------


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold contributions into each target pixel, in source order, over rows sorted by (target, source).

    Rows stream through in batches and one target's state is carried over a batch edge, so no target is ever gathered;
    within a batch all targets advance together.
    """
    held: tuple | None = None
    for pdf in batches:
        if pdf.empty:
            continue
        k = pdf[["frame_idx", "y", "x"]].to_numpy()
        new = np.r_[True, (k[1:] != k[:-1]).any(1)]
        gid = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        rank = np.arange(len(pdf)) - first[gid]
        state = np.zeros((len(first), 3))
        if held is not None:
            if tuple(k[0]) == held[0]:
                state[0] = held[1]
            else:
                yield _rows([held[0]], np.array([held[1]]))
        vx, vy, g = (pdf[c].to_numpy() for c in ("vx", "vy", "g"))
        order = np.argsort(rank, kind="stable")
        ends = np.r_[np.flatnonzero(np.diff(rank[order])) + 1, len(order)]
        lo = 0
        for hi in ends:
            at = order[lo:hi]
            s = state[gid[at]]
            gain = np.tanh(0.33 * (vx[at] ** 2 + vy[at] ** 2 - s[:, 0] ** 2 - s[:, 1] ** 2)) * 0.5 + 0.5
            w = gain * g[at]
            s[:, 0] = vx[at] * w + s[:, 0] * (1 - w)
            s[:, 1] = vy[at] * w + s[:, 1] * (1 - w)
            s[:, 2] = np.clip(s[:, 2] + w, 0.0, 1.0)
            state[gid[at]] = s
            lo = hi
        if len(first) > 1:
            yield _rows(k[first[:-1]], state[:-1])
        held = (tuple(k[-1]), state[-1].copy())
    if held is not None:
        yield _rows([held[0]], np.array([held[1]]))


def _rows(keys, state: np.ndarray) -> pd.DataFrame:
    k = np.asarray(keys, dtype="int64")
    return pd.DataFrame({"frame_idx": k[:, 0], "y": k[:, 1], "x": k[:, 2], "wx": state[:, 0], "wy": state[:, 1], "weight": state[:, 2]})


SPLAT_TILE = 32


def flow_splat(flow: DataFrame, frame: Size, t: float, radius: int = 3, sigma: float = 0.75) -> DataFrame:
    """Forward-splat the displacement of each pixel (fx, fy, scaled by t) to the pixels around where it lands.

    Later sources are laid over earlier ones in raster order, larger motion winning, so the order is part of the result.
    """
    h, w = frame
    size, back = {"y": h, "x": w}, 2 * radius + 1
    src = flow.select("frame_idx", F.col("y").alias("_sy"), F.col("x").alias("_sx"), (F.col("fx") * t).alias("_fx"), (F.col("fy") * t).alias("_fy"))
    land = {"y": F.col("_sy") + F.col("_fy"), "x": F.col("_sx") + F.col("_fx")}
    # sources go to the tiles they reach and become a row for each pixel only there
    src = src.where(land["y"].isNotNull() & land["x"].isNotNull())
    lo = {a: F.greatest(p.cast("bigint") - radius, F.lit(0).cast("bigint")) for a, p in land.items()}
    hi = {a: F.least(p.cast("bigint") + radius, F.lit(size[a] - 1).cast("bigint")) for a, p in land.items()}
    tiles = {a: F.sequence(F.floor(lo[a] / SPLAT_TILE).cast("bigint"), F.floor(hi[a] / SPLAT_TILE).cast("bigint")) for a in land}
    src = src.where((lo["y"] <= hi["y"]) & (lo["x"] <= hi["x"])).withColumn("_ty", F.explode(tiles["y"])).withColumn("_tx", F.explode(tiles["x"]))
    src = S.dealt(src, flow.count() * back * back, "frame_idx", "_ty", "_tx")
    for a in land:
        first = F.col(f"_t{a}") * SPLAT_TILE
        src = src.withColumn(a, F.explode(F.sequence(F.greatest(lo[a], first), F.least(hi[a], first + SPLAT_TILE - 1))))
    src = src.withColumns({"_px": land["x"], "_py": land["y"], "src": F.col("_sy") * w + F.col("_sx")})
    dx, dy = F.col("x") - F.col("_px"), F.col("y") - F.col("_py")
    g = F.exp(-0.5 * (dx * dx + dy * dy) / (sigma * sigma))
    rows = src.select("frame_idx", "y", "x", "src", (-F.col("_fx")).alias("vx"), (-F.col("_fy")).alias("vy"), g.alias("g"))
    rows = rows.sortWithinPartitions("frame_idx", "y", "x", "src").drop("src")
    hit = rows.mapInPandas(_fold, "frame_idx bigint, y bigint, x bigint, wx double, wy double, weight double")
    return flow.select(*PIXEL).join(hit, PIXEL, "left").fillna(0.0, ["wx", "wy", "weight"])


def blend_views(image0: DataFrame, image1: DataFrame, splat0: DataFrame, splat1: DataFrame, frame: Size, t: float, radius: int = 3, tile: int = S.TILE) -> DataFrame:
    """Warp both pictures by their splatted displacements and mix them by cleaned weights and time."""

    def side(image: DataFrame, splat: DataFrame, tag: str) -> DataFrame:
        c = S.tiled(splat, ["frame_idx"], radius + 1, frame, tile)
        c = S.untiled(S.blur(S.erode(c, ["frame_idx"], ["weight"], radius), ["frame_idx"], ["weight"], 3, 0.5), frame, tile)
        warp = c.select(*PIXEL, (F.col("x") + F.col("wx")).alias("u"), (F.col("y") + F.col("wy")).alias("v"))
        got = apply_warp(image, warp, "frame_idx", ["b", "g", "r"])
        return got.join(c.select(*PIXEL, "weight"), PIXEL).withColumnsRenamed({n: f"{n}{tag}" for n in ("b", "g", "r", "weight")})

    j = side(image0, splat0, "0").join(side(image1, splat1, "1"), PIXEL)
    w0, w1 = 1e-6 + F.col("weight0") * (1.0 - t), 1e-6 + F.col("weight1") * t
    return j.select(*PIXEL, *[(F.col(f"{c}0") * (w0 / (w0 + w1)) + F.col(f"{c}1") * (w1 / (w0 + w1))).alias(c) for c in "bgr"])


# ---- tiled maps --------------------------------------------------------------------------------------------------


def _starts(size: int, tile: int, overlap: int) -> list[int]:
    """Tile starts; the last ones move back so that every tile is whole."""
    return sorted({max(0, min(p + tile, size) - tile) for p in range(0, size, tile - overlap)})


def tiled_map(
    pixels: DataFrame, frame: Size, tile: int, overlap: int, fn: Callable[[pd.DataFrame], pd.DataFrame], cols: list[str], scale: int = 1
) -> DataFrame:
    """Run a user function on overlapping tiles and mix its results with cosine ramps.

    ``fn`` gets one tile (y, x from the tile's corner, and cols) and returns the same columns at ``scale`` times the size.
    Tile and overlap count output pixels. Tiles that start twice at the same place run once and count once more.
    """
    h, w = frame[0] * scale, frame[1] * scale

    def spans(size: int) -> Column:
        all_starts = [max(0, min(p + tile, size) - tile) for p in range(0, size, tile - overlap)]
        return F.array(*[F.struct(F.lit(s).alias("s"), F.lit(all_starts.count(s)).alias("n")) for s in _starts(size, tile, overlap)])

    def touching(axis: str, size: int) -> Column:
        end = lambda s: F.least(s + tile, F.lit(size))
        return F.filter(
            spans(size), lambda p: (F.col(axis) >= F.floor(p.getField("s") / scale)) & (F.col(axis) < F.floor(end(p.getField("s")) / scale))
        )

    src = pixels.select(*PIXEL, *cols).withColumn("_ty", F.explode(touching("y", h))).withColumn("_tx", F.explode(touching("x", w)))
    src = src.select(
        "frame_idx", F.col("_ty.s").alias("sy"), F.col("_tx.s").alias("sx"), (F.col("_ty.n") * F.col("_tx.n")).alias("times"),
        (F.col("y") - F.floor(F.col("_ty.s") / scale)).alias("y"), (F.col("x") - F.floor(F.col("_tx.s") / scale)).alias("x"), *cols,
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f, sy, sx, times = (pdf[c].iloc[0] for c in ("frame_idx", "sy", "sx", "times"))
        out = fn(pdf[["y", "x", *cols]].sort_values(["y", "x"], ignore_index=True))
        out = out.assign(frame_idx=f, sy=sy, sx=sx, times=times)
        return out[["frame_idx", "sy", "sx", "times", "y", "x", *cols]]

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("frame_idx", "sy", "sx", "times", "y", "x")] + [T.StructField(c, T.DoubleType()) for c in cols])
    done = src.groupBy("frame_idx", "sy", "sx").applyInPandas(run, schema)
    ramp = lambda i: 0.5 * (1.0 - F.cos(F.lit(math.pi) * i / overlap))

    def weight() -> Column:
        """Each ramp overwrites whole rows or columns of the mask, in a fixed order; the last one written counts."""
        y, x = F.col("y"), F.col("x")
        th, tw = F.least(F.lit(tile), F.lit(h) - F.col("sy")), F.least(F.lit(tile), F.lit(w) - F.col("sx"))
        marks = [(F.col("sy") > 0, y), (F.col("sy") + th < h, th - 1 - y), (F.col("sx") > 0, x), (F.col("sx") + tw < w, tw - 1 - x)]
        # step i writes side 0, 1, 2, 3 in turn, so the largest (i, side) that reaches the pixel wins
        # the far sides have no step 0
        hits = F.array(*[F.when(on & (i < overlap) & (i >= s % 2), i.cast("double") * 4.0 + float(s)).otherwise(F.lit(-1.0)) for s, (on, i) in enumerate(marks)])
        top = F.array_max(hits)
        return F.when(top < 0, F.lit(1.0)).otherwise(ramp(F.floor(top / 4.0)))

    done = done.withColumn("_w", weight() * F.col("times"))
    out = done.groupBy("frame_idx", (F.col("sy") + F.col("y")).alias("y"), (F.col("sx") + F.col("x")).alias("x")).agg(
        *[F.sum(F.col("_w") * F.col(c)).alias(c) for c in cols], F.sum("_w").alias("_w")
    )
    return out.select(*PIXEL, *[(F.col(c) / (F.col("_w") + 1e-8)).alias(c) for c in cols])
