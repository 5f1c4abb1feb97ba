"""Frame stacks: stabilization, segmentation scores, edges, masks, quality measures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetab.functions import geom
from scenetab.functions.hashing import hash01
from scenetab.functions.ranks import exact_rank, pick_at
from scenetab.functions.session import broadcast_if_small
from scenetab.operators import stencil as S

KEY = ["frame_idx"]
Size = tuple[int, int]


def stride_frames(frames: DataFrame, k: int, first: int | None = None, last: int | None = None, order: str = "frame_idx") -> DataFrame:
    """Every k-th frame of a range; a plain filter, so it prunes partitions of a table partitioned by frame."""
    out = frames.where(F.col(order) % k == 0)
    if first is not None:
        out = out.where(F.col(order) >= first)
    return out if last is None else out.where(F.col(order) <= last)


def sync_frames(frames: DataFrame, cams: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Instants at which every camera of the scene has a frame, from 0 up to the first gap.

    ``frames`` has one row per (scene, cam_idx, frame_idx); cams holds time_offset_frames.
    """
    size = cams.groupBy(scene).agg(F.countDistinct("cam_idx").alias("_n"))
    shifted = (
        frames.join(broadcast_if_small(cams.select(scene, "cam_idx", "time_offset_frames")), [scene, "cam_idx"])
        .withColumn("t", F.col("frame_idx") - F.col("time_offset_frames"))
        .where(F.col("t") >= 0)
    )
    full = shifted.groupBy(scene, "t").agg(F.countDistinct("cam_idx").alias("n_cams")).join(broadcast_if_small(size), scene)
    full = full.where(F.col("n_cams") == F.col("_n"))
    # instants are distinct, so those before the first gap are exactly the ones whose rank equals them
    ranked = exact_rank(full, [scene], "t", "t")
    return ranked.where(F.col("rank") == F.col("t")).select(scene, "t", "n_cams")


def morphology(pixels: DataFrame, op: str, cols: list[str], k: int, keys: list[str] = KEY, tile: int = S.TILE) -> DataFrame:
    """erode, dilate or box (mean over the pixels that exist) with a (2k+1)-square."""
    src = S.tiled(pixels.select(*keys, "y", "x", *cols), keys, k, None, tile)
    if op == "box":
        src = S.box_sum(src.withColumn("_one", F.lit(1.0)), keys, [*cols, "_one"], k)
        src = src.withColumns({c: F.col(c) / F.col("_one") for c in cols}).drop("_one")
    else:
        src = {"erode": S.erode, "dilate": S.dilate}[op](src, keys, cols, k)
    return S.untiled(src, None, tile)


def gaussian_blur(pixels: DataFrame, cols: list[str], size: int, sigma: float, frame: Size, keys: list[str] = KEY, tile: int = S.TILE) -> DataFrame:
    src = S.tiled(pixels.select(*keys, "y", "x", *cols), keys, size // 2, frame, tile)
    return S.untiled(S.blur(src, keys, cols, size, sigma), frame, tile)


def median3(pixels: DataFrame, cols: list[str], frame: Size, keys: list[str] = KEY, tile: int = S.TILE) -> DataFrame:
    src = S.tiled(pixels.select(*keys, "y", "x", *cols), keys, 1, frame, tile)
    return S.untiled(S.median3(src, keys, cols, frame), frame, tile)


def _frame_blocks(radius: int, block: int) -> Column:
    lo = F.floor((F.col("frame_idx") - radius) / F.lit(block)).cast("bigint")
    hi = F.floor((F.col("frame_idx") + radius) / F.lit(block)).cast("bigint")
    return F.explode(F.sequence(lo, hi))


# fixed values of the motion weight
MOTION_GAIN, MOTION_BIAS, MOTION_FLOOR = 5.0, 0.3, 0.001


def stabilize_depth(
    pixels: DataFrame, frame: Size, radius: int = 13, dilate: int = 11, blur_size: int = 21, block: int = 32, tile: int = S.TILE,
) -> DataFrame:
    """Depth averaged over the frames within ``radius``, weighted by how little the neighbourhood moved.

    One shuffle by (frame block, tile) serves everything: pixels of a block are gathered per position, unordered frame
    pairs come out of those short arrays (the motion of a pair is the same both ways, so it is computed once), and the
    stencils and sums run inside the partition.
    """
    halo = dilate + blur_size // 2
    src = pixels.select("frame_idx", "y", "x", "b", "g", "r", "invd").withColumn("blk", _frame_blocks(radius, block))
    # a row of the stack makes up to ``radius`` pairs, and the pairs are what is sorted
    src = S.tiled(src, ["blk"], halo, frame, tile, pixels.count() * (1 + 2 * radius / block) * max(radius, 1))
    place = ["blk", "ty", "tx"]
    stack = src.groupBy(*place, "y", "x").agg(F.collect_list(F.struct("frame_idx", "b", "g", "r", "invd")).alias("fs"))
    own = lambda f: F.floor(f / F.lit(block)) == F.col("blk")

    def partners(a: Column) -> Column:
        fa = a.getField("frame_idx")
        near = F.filter(
            "fs",
            lambda b: (b.getField("frame_idx") > fa) & (b.getField("frame_idx") <= fa + radius)
            & (own(fa) | own(b.getField("frame_idx"))),
        )
        gap = lambda b, n: F.abs(a.getField(n) - b.getField(n))
        return F.transform(
            near,
            lambda b: F.struct(
                fa.alias("fa"), b.getField("frame_idx").alias("fb"), a.getField("invd").alias("da"),
                b.getField("invd").alias("db"), (gap(b, "b") + gap(b, "g") + gap(b, "r")).alias("d"),
            ),
        )

    pairs = stack.select(*place, "y", "x", F.explode(F.flatten(F.transform("fs", partners))).alias("p")).select(
        *place, "y", "x", "p.*"
    )
    move = F.greatest(F.lit(0.0), F.tanh(F.lit(MOTION_GAIN) * F.col("d") - F.lit(MOTION_BIAS)))
    pairs = pairs.withColumn("d", move)
    keys = ["blk", "fa", "fb"]
    pairs = S.blur(S.dilate(pairs, keys, ["d"], dilate), keys, ["d"], blur_size, float(dilate))
    home = (F.floor(F.col("y") / tile) == F.col("ty")) & (F.floor(F.col("x") / tile) == F.col("tx"))
    inside = home & F.col("y").between(0, frame[0] - 1) & F.col("x").between(0, frame[1] - 1)
    weight = geom.clamp(F.lit(1.0) - F.col("d"), MOTION_FLOOR, 1.0)
    one = lambda f, d: F.struct(F.col(f).alias("frame_idx"), F.col(d).alias("v"))
    sums = (
        pairs.where(inside).withColumn("w", weight)
        .select(*place, "y", "x", "w", F.explode(F.array(one("fa", "db"), one("fb", "da"))).alias("t"))
        .where(own(F.col("t.frame_idx")))
        .groupBy(*place, F.col("t.frame_idx").alias("frame_idx"), "y", "x")
        .agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("t.v")).alias("sv"))
        .select("frame_idx", "y", "x", "sw", "sv")
    )
    base = pixels.select("frame_idx", "y", "x", "invd").join(sums, ["frame_idx", "y", "x"], "left")
    total = F.col("invd") + F.coalesce("sv", F.lit(0.0))
    return base.select("frame_idx", "y", "x", (total / (1.0 + F.coalesce("sw", F.lit(0.0)))).alias("invd"))


def stabilize_fill(pixels: DataFrame, cols: list[str], mask: str, radius: int = 13, block: int = 256) -> DataFrame:
    """Average over the frames within ``radius`` weighted by each neighbour's mask; the own frame has weight 1."""
    src = pixels.select("frame_idx", "y", "x", mask, *cols).withColumn("blk", _frame_blocks(radius, block))
    w = Window.partitionBy("blk", "y", "x").orderBy("frame_idx").rangeBetween(-radius, radius)
    m = F.col(mask)
    weight = F.sum(m).over(w) - m + 1.0
    out = {c: (F.sum(m * F.col(c)).over(w) - m * F.col(c) + F.col(c)) / weight for c in cols}
    done = src.select("frame_idx", "y", "x", "blk", *[e.alias(c) for c, e in out.items()])
    return done.where(F.floor(F.col("frame_idx") / F.lit(block)) == F.col("blk")).drop("blk")


KERNELS, BIG_KERNEL = (17, 31, 63, 127, 255), 50


def three_layer_scores(
    pixels: DataFrame, frame: Size, kernels: tuple[int, ...] = KERNELS, big: int = BIG_KERNEL, shrink: int = 4,
    variant: str = "new", tile: int = S.TILE, double: bool = False,
) -> DataFrame:
    """Top, middle and bottom scores from multi-scale minima and maxima of the inverse depth.

    Kernels above ``big`` run on the reduced picture. All kernels of one resolution share one tiling.
    """
    new = variant == "new"

    n = pixels.count()

    def level(src: DataFrame, ks: list[tuple[int, int]], size: Size, rows: float) -> DataFrame:
        halo = max(k + k // 2 + 2 for _, k in ks)
        t = S.tiled(src.select("frame_idx", "y", "x", "invd"), KEY, halo, size, tile, rows)
        keep = []
        for i, k in ks:
            lo, hi = f"lo{i}", f"hi{i}"
            t = t.withColumns({lo: F.col("invd"), hi: F.col("invd")})
            t = S.erode_dilate(t, KEY, lo, hi, k)
            t = S.blur(t, KEY, [lo, hi], k, k / 2.0)
            t = t.withColumns(
                {f"md{i}": F.col("invd") - F.col(lo), f"bg{i}": F.col(hi) - F.col("invd"), f"sc{i}": F.col(hi) - F.col(lo)}
            ).drop(lo, hi)
            keep += [f"md{i}", f"bg{i}", f"sc{i}"]
            if new:
                t = t.withColumns({"_m": F.col(f"md{i}"), "_b": F.col(f"bg{i}")})
                t = S.erode(t, KEY, ["_m", "_b"], 2)
                t = t.withColumn(f"fg{i}", F.sqrt(F.col("_m") * F.col("_b") + 1e-3)).drop("_m", "_b")
                keep.append(f"fg{i}")
        return S.untiled(t, size, tile).select("frame_idx", "y", "x", *keep)

    fine = [(i, k) for i, k in enumerate(kernels) if k <= big]
    coarse = [(i, k // shrink) for i, k in enumerate(kernels) if k > big]
    out = pixels.select("frame_idx", "y", "x", "invd")
    if fine:
        out = out.join(level(pixels, fine, frame, n), ["frame_idx", "y", "x"])
    if coarse:
        small = (frame[0] // shrink, frame[1] // shrink)
        low = level(S.shrink(pixels, KEY, ["invd"], shrink), coarse, small, n / shrink**2)
        cols = [c for c in low.columns if c not in ("frame_idx", "y", "x")]
        out = out.join(S.enlarge(low, KEY, cols, shrink, small, tile, n / shrink**2), ["frame_idx", "y", "x"])
    far = F.greatest(F.lit(0.0), 1.0 - 20.0 * F.col("invd"))
    fg, bg, md = F.lit(0.0), F.lit(0.0), F.lit(0.0 if new else 3.0)
    for i in range(len(kernels)):
        s = F.col(f"sc{i}") + 0.01
        if new:
            fg = fg + F.col(f"fg{i}") * (0.01 + 0.3 / s)
            bg = bg + F.col(f"bg{i}") * (0.6 + 0.6 / s) + far * 0.5
            md = md + F.col(f"md{i}") * (0.5 + 0.5 / s)
        else:
            fg = fg + F.col(f"md{i}") / s
            bg = bg + F.col(f"bg{i}") / s
    steep = 2.0 if new else 4.0
    out = out.select("frame_idx", "y", "x", *[F.exp(steep * e).alias(n) for n, e in (("_f", fg), ("_b", bg), ("_m", md))])
    total = F.col("_f") + F.col("_b") + F.col("_m") + (0.0 if new else 1e-6)
    top, mid, bot = F.col("_f") / total, F.col("_m") / total, F.col("_b") / total
    scores = out.select("frame_idx", "y", "x", top.alias("s_top"), mid.alias("s_mid"), bot.alias("s_bot"))
    return S.enlarge(scores, KEY, ["s_top", "s_mid", "s_bot"], 2, frame, tile, n) if double else scores


def depth_edges(pixels: DataFrame, frame: Size, cx: float, cy: float, radius: float, k: int = 13, tile: int = S.TILE) -> DataFrame:
    """Strength of near-side and far-side depth edges, each less the other."""
    t = S.tiled(pixels.select("frame_idx", "y", "x", "invd"), KEY, k + 2, frame, tile, pixels.count())
    t = t.withColumns({"lo": F.col("invd"), "hi": F.col("invd")})
    t = S.erode_dilate(t, KEY, "lo", "hi", k)
    # a mirrored copy takes the position of the pixel it shows
    dx, dy = (_shown("x", frame[1]) - cx), (_shown("y", frame[0]) - cy)
    r2 = dx * dx + dy * dy
    ramp = 1.0 - geom.clamp((F.sqrt(r2) / F.lit(radius) - 0.8) / 0.1, 0.0, 1.0)
    strength = lambda d: F.when(r2 > radius * radius, F.lit(0.0)).otherwise(
        ramp * geom.clamp(F.tanh(10.0 * d - 0.1), 0.0, 1.0)
    )
    t = t.withColumns({"hi": strength(F.col("invd") - F.col("lo")), "lo": strength(F.col("hi") - F.col("invd"))})
    t = S.blur(S.erode(t, KEY, ["hi", "lo"], 1), KEY, ["hi", "lo"], 3, 1.0)
    return S.untiled(t, frame, tile).select(
        "frame_idx", "y", "x",
        geom.clamp(F.col("hi") - F.col("lo"), 0.0, 1.0).alias("edge_hi"),
        geom.clamp(F.col("lo") - F.col("hi"), 0.0, 1.0).alias("edge_lo"),
    )


def _shown(axis: str, size: int) -> Column:
    """Position inside the frame of the pixel that a mirrored position shows."""
    if size == 1:
        return F.lit(0)
    p = F.pmod(F.col(axis), F.lit(2 * (size - 1)))
    return F.least(p, F.lit(2 * (size - 1)) - p)


def layer_alphas(scores: DataFrame, frame: Size, reach: int, tile: int = S.TILE, spread: int = 17) -> DataFrame:
    """Alphas, fill masks and blend weights of the upper layers, with gaps in smooth transitions suppressed."""
    halo = 1 + max(2 * reach, spread + 2)
    t = S.tiled(scores.select("frame_idx", "y", "x", "s_top", "s_mid", "s_bot"), KEY, halo, frame, tile, scores.count())
    sharp = lambda d: (F.tanh(10.0 * d) + 1.0) * 0.5
    top, mid, bot = F.col("s_top"), F.col("s_mid"), F.col("s_bot")
    t = t.withColumn("a2", sharp(top - (mid + bot)))
    t = t.withColumn("a1", sharp((1.0 - bot) - (1.0 - (F.col("a2") + mid))))
    t = S.median3(t, KEY, ["a2", "a1"], frame)
    step = lambda c: F.when(F.col(c) > 0.999, F.lit(1.0)).otherwise(F.lit(0.0))
    t = t.withColumns({"m1": step("a2"), "m0": step("a1")})
    t = S.dilate(t, KEY, ["m1", "m0"], reach)
    t = t.withColumns({"b1": F.col("m1"), "b0": F.col("m0")})
    t = S.blur(t, KEY, ["b1", "b0"], 2 * reach + 1, float(reach))
    edge = lambda c: F.tanh(10.0 * (0.5 - F.abs(F.col(c) - 0.5)))
    pure = F.greatest(F.lit(0.0), F.tanh(7.0 * (F.greatest(top, mid, bot) - F.least(top, mid, bot) - 0.7)))
    t = t.withColumns({"t1": edge("a1"), "t2": edge("a2"), "p": pure})
    t = S.erode(t, KEY, ["t1", "t2"], 1)
    t = S.dilate(t, KEY, ["t1", "t2"], spread)
    t = S.blur(t, KEY, ["t1", "t2"], 3, 1.0)
    t = S.dilate(t, KEY, ["p"], 3)
    t = t.withColumns({c: F.greatest(F.lit(0.0), F.col(c) - 1.1 * F.col("p")) for c in ("t1", "t2")})
    t = t.withColumns(
        {"b1": F.greatest(F.lit(0.0), F.col("b1") - 3.0 * F.col("t2")), "b0": F.greatest(F.lit(0.0), F.col("b0") - 3.0 * F.col("t1"))}
    )
    t = S.blur(S.erode(t, KEY, ["a2", "a1"], 1), KEY, ["a2", "a1"], 3, 1.0)
    return S.untiled(t, frame, tile).select(
        "frame_idx", "y", "x", F.col("a1").alias("l1_alpha"), F.col("a2").alias("l2_alpha"), F.col("m0").alias("l0_mask"),
        F.col("m1").alias("l1_mask"), F.col("b0").alias("l0_blend"), F.col("b1").alias("l1_blend"),
    )


def red_mask(pixels: DataFrame) -> DataFrame:
    """Pixels painted pure red are ignored; one polarity everywhere: ``ignore``."""
    red = (F.col("b") == 0) & (F.col("g") == 0) & (F.col("r") == 1)
    return pixels.withColumn("ignore", red)


def apply_mask(pixels: DataFrame, mask: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Zero the masked pixels; pixels without a mask row are kept."""
    joined = pixels.join(mask.select(*keys, "y", "x", "ignore"), [*keys, "y", "x"], "left")
    hit = F.coalesce("ignore", F.lit(False))
    return joined.withColumns({c: F.when(hit, F.lit(0.0)).otherwise(F.col(c)) for c in cols}).drop("ignore")


def image_psnr(pred: DataFrame, target: DataFrame, channels: list[str], keys: list[str] = KEY) -> DataFrame:
    """PSNR per image, and the mean over images beside it."""
    t = target.select(*keys, "y", "x", *[F.col(c).alias(f"_{c}") for c in channels])
    sq = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in channels), F.lit(0.0))
    mse = pred.join(t, [*keys, "y", "x"]).groupBy(*keys).agg((F.sum(sq) / (F.count(F.lit(1)) * len(channels))).alias("mse"))
    return mse.withColumn("psnr", 20.0 * F.log10(geom.div(F.lit(1.0), F.sqrt("mse"))))


def mean_psnr(per_image: DataFrame) -> DataFrame:
    return per_image.agg(F.avg("psnr").alias("psnr"), F.count(F.lit(1)).alias("images"))


def depth_bands(pixels: DataFrame, cx: float, cy: float, radius: float) -> DataFrame:
    """Per-frame depth marks inside the image circle and per-pixel ramps for the far and near bands."""
    dx, dy = F.col("x") - cx, F.col("y") - cy
    inside = pixels.where(dx * dx + dy * dy <= radius * radius * 0.9).select("frame_idx", "y", "x", "invd")
    at = lambda f: F.floor(F.lit(f) * F.col("n"))
    marks = pick_at(inside, KEY, "invd", {"p0": F.lit(0), "p10": at(0.1), "p90": at(0.9), "p100": F.col("n") - 1})
    j = inside.join(broadcast_if_small(marks.drop("n")), KEY)
    v, p0, p10, p90, p100 = (F.col(c) for c in ("invd", "p0", "p10", "p90", "p100"))
    flag = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    bottom = F.when(F.abs(p10 - p0) < 1e-3, flag(v <= p10)).otherwise(geom.clamp(geom.div(p10 - v, p10 - p0), 0.0, 1.0))
    top = F.when(F.abs(p90 - p100) < 1e-3, flag(v >= p90)).otherwise(geom.clamp(geom.div(v - p90, p100 - p90), 0.0, 1.0))
    return j.select("frame_idx", "y", "x", bottom.alias("bottom_weight"), top.alias("top_weight"))


def ordinal_depth_score(pixels: DataFrame, frame: Size, n: int, seed: int) -> DataFrame:
    """Mean disagreement in depth order of ``render`` with ``pred`` over n random pixel pairs per frame."""
    h, w = frame
    area = h * w
    frames = pixels.select("frame_idx").distinct()
    draws = frames.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    did = F.col("frame_idx") * n + F.col("k")
    draws = draws.select(
        "frame_idx", "k", F.floor(hash01(did, seed) * area).alias("i"), F.floor(hash01(did, seed + 1) * area).alias("j")
    )
    flat = pixels.select("frame_idx", (F.col("y") * w + F.col("x")).alias("p"), "pred", "render")
    a = flat.select("frame_idx", F.col("p").alias("i"), F.col("pred").alias("pa"), F.col("render").alias("ra"))
    b = flat.select("frame_idx", F.col("p").alias("j"), F.col("pred").alias("pb"), F.col("render").alias("rb"))
    both = draws.join(a, ["frame_idx", "i"]).join(b, ["frame_idx", "j"])
    sign = F.when(F.col("pa") > F.col("pb"), F.lit(1.0)).otherwise(F.lit(-1.0))
    loss = F.abs(F.tanh(F.col("ra") - F.col("rb")) - sign)
    return both.groupBy("frame_idx").agg(F.avg(loss).alias("score"))


def smoothness_score(pixels: DataFrame, col: str, tile: int = S.TILE) -> DataFrame:
    """Mean absolute 5x5 Laplacian per frame, zeros outside."""
    t = S.tiled(pixels.select("frame_idx", "y", "x", F.col(col).alias("c")), KEY, 2, None, tile).withColumn("s", F.col("c"))
    t = S.untiled(S.box_sum(t, KEY, ["s"], 2), None, tile)
    return t.groupBy("frame_idx").agg(F.avg(F.abs(25.0 * F.col("c") - F.col("s"))).alias("smoothness"))


def fit_scale_bias(pixels: DataFrame, frame: Size) -> DataFrame:
    """Scale and bias taking ``mono`` to ``render``, refitted without the worst tenth; mean absolute error per frame."""
    h, w = frame
    my, mx = int(h * 0.01), int(w * 0.01)
    ok = F.col("y").between(my, h - 1 - my) & F.col("x").between(mx, w - 1 - mx)
    hold = lambda c: geom.clamp(F.col(c), geom.Z_NEAR, geom.Z_FAR)
    src = pixels.where(ok).select("frame_idx", "y", "x", hold("mono").alias("m"), hold("render").alias("d"))
    src = src.where(F.col("d") > geom.Z_NEAR)

    def fit(df: DataFrame, tag: str) -> DataFrame:
        moments = df.groupBy("frame_idx").agg(
            F.covar_pop("m", "d").alias("_c"), F.var_pop("m").alias("_v"), F.avg("m").alias("_am"),
            F.avg("d").alias("_ad"), F.count(F.lit(1)).alias("_n"),
        )
        flat = F.col("_v") * F.col("_n") <= 1e-10
        scale = F.when(flat, F.lit(1.0)).otherwise(geom.div(F.col("_c"), F.col("_v")))
        out = moments.withColumn(f"scale{tag}", scale)
        return out.select("frame_idx", f"scale{tag}", (F.col("_ad") - F.col(f"scale{tag}") * F.col("_am")).alias(f"bias{tag}"))

    j = src.join(broadcast_if_small(fit(src, "1")), KEY)
    j = j.withColumn("res", F.abs(F.col("scale1") * F.col("m") + F.col("bias1") - F.col("d")))
    last = F.greatest(F.floor(F.lit(0.9) * F.col("n")) - 1, F.lit(0))
    cut = pick_at(j, KEY, "res", {"cut": last})
    kept = j.join(broadcast_if_small(cut.drop("n")), KEY).where(F.col("res") <= F.col("cut"))
    second = fit(kept, "2")
    err = F.abs(F.col("scale2") * F.col("m") + F.col("bias2") - F.col("d"))
    return src.join(broadcast_if_small(second), KEY).groupBy("frame_idx").agg(
        F.first("scale2").alias("scale"), F.first("bias2").alias("bias"), F.avg(err).alias("error")
    )


def alpha_attenuate(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("invd", F.col("invd") * (1.0 - F.exp(-10.0 * F.col("a"))))


def feather_alpha(pixels: DataFrame, k: int, frame: Size, tile: int = S.TILE) -> DataFrame:
    """Erode and blur the alpha channel only."""
    size = k // 2 * 2 + 1
    t = S.tiled(pixels, KEY, k + size // 2, frame, tile)
    t = S.erode(t, KEY, ["a"], k)
    return S.untiled(S.blur(t, KEY, ["a"], size, float(k // 2)) if k >= 2 else t, frame, tile)


def disparity_to_depth(pixels: DataFrame, size: int, baseline: float, coef: float = geom.INV_DEPTH_COEF) -> DataFrame:
    """Clamped inverse depth of a disparity, and its stored form scaled and clamped to [0, 1]."""
    angle = lambda c: (F.lit(math.pi) - F.lit(math.pi) * c / F.lit(float(size))) - F.lit(math.pi / 2)
    left, right = angle(F.col("x") + F.col("disparity")), angle(F.col("x").cast("double"))
    inv = geom.div(F.sin(right - left), F.lit(baseline) * F.cos(left))
    out = pixels.withColumn("inv_depth", geom.clamp(inv, 0.001, 10000.0))
    return out.withColumn("stored", geom.clamp(F.col("inv_depth") * coef, 0.0, 1.0))


def mono_depth(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("mono_depth", geom.clamp(geom.div(F.lit(10.0), F.col("disparity")), 0.1, 50.0))


def bilateral(pixels: DataFrame, radius: int, sigma: float, sigma_color: float, strength: float = 1.0, tile: int = S.TILE) -> DataFrame:
    """Colour-aware smoothing of b, g, r, then mixed with the source by ``strength``.

    Neighbours arrive as short arrays per row inside a tile (window over the row), so the join per offset is replaced by
    two local windows after one shuffle.
    """
    px = F.struct("y", "x", "b", "g", "r")
    t = S.tiled(pixels.select("frame_idx", "y", "x", "b", "g", "r"), KEY, radius, None, tile)
    row = Window.partitionBy("frame_idx", "ty", "tx", "y").orderBy("x").rangeBetween(-radius, radius)
    col = Window.partitionBy("frame_idx", "ty", "tx", "x").orderBy("y").rangeBetween(-radius, radius)
    t = t.withColumn("_r", F.collect_list(px).over(row))
    t = t.withColumn("_n", F.flatten(F.collect_list("_r").over(col))).drop("_r")
    t = S.untiled(t, None, tile)
    diff = lambda q, c: q.getField(c) - F.col(c)

    def weight(q: Column) -> Column:
        d2 = diff(q, "x") * diff(q, "x") + diff(q, "y") * diff(q, "y")
        c2 = sum((diff(q, c) * diff(q, c) for c in "bgr"), F.lit(0.0))
        w = F.exp(-d2 / F.lit(2.0 * sigma * sigma)) * F.exp(-c2 / F.lit(2.0 * sigma_color * sigma_color))
        return F.struct(w.alias("w"), *[q.getField(c).alias(c) for c in "bgr"])

    t = t.withColumn("_n", F.transform("_n", weight))
    t = t.withColumn("_w", F.aggregate("_n", F.lit(0.0), lambda acc, q: acc + q.getField("w")))
    mixed = {c: F.col(c) * (1.0 - strength) + _weighted("_n", c) / F.col("_w") * strength for c in "bgr"}
    return t.select("frame_idx", "y", "x", *[e.alias(c) for c, e in mixed.items()])


def _weighted(arr: str, c: str) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, q: acc + q.getField("w") * q.getField(c))


def split_stereo(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Left and right halves as two pictures; a square picture serves both eyes."""
    if width == height:
        return pixels.withColumn("eye", F.explode(F.array(F.lit("left"), F.lit("right"))))
    half = width // 2
    left = F.col("x") < half
    return pixels.withColumn("eye", F.when(left, F.lit("left")).otherwise(F.lit("right"))).withColumn(
        "x", F.when(left, F.col("x")).otherwise(F.col("x") - half)
    )


def atlas(parts: list[tuple[DataFrame, int, int]]) -> DataFrame:
    """Pictures put side by side or stacked: union with shifted positions."""
    out = None
    for df, dy, dx in parts:
        moved = df.withColumns({"y": F.col("y") + dy, "x": F.col("x") + dx})
        out = moved if out is None else out.unionByName(moved)
    return out


def frame_brightness(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("frame_idx").agg(F.avg((F.col("b") + F.col("g") + F.col("r")) / 3.0).alias("brightness"))


def random_crops(images: DataFrame, pixels: DataFrame, size: int, n: int, seed: int) -> DataFrame:
    """n crops per image with uniform corners, clipped to the image. ``images`` has frame_idx, width, height.

    Crops are cut into cells of the crop size, so pixels meet them by an equi join on (image, cell).
    """
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    crops = images.withColumn("k", k)
    did = F.col("frame_idx") * n + F.col("k")
    place = lambda s, dim: F.floor(hash01(did, s) * F.greatest(F.col(dim) - size + 1, F.lit(1))).cast("bigint")
    crops = crops.select(
        "frame_idx", did.alias("crop_id"), place(seed, "width").alias("x0"), place(seed + 1, "height").alias("y0")
    )
    cell = lambda c: F.floor(c / F.lit(size)).cast("bigint")
    cut = crops.withColumn("cy", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y0") + size - 1)))).withColumn(
        "cx", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x0") + size - 1)))
    )
    px = pixels.withColumns({"cy": cell(F.col("y")), "cx": cell(F.col("x"))})
    inside = F.col("y").between(F.col("y0"), F.col("y0") + size - 1) & F.col("x").between(F.col("x0"), F.col("x0") + size - 1)
    hit = px.join(cut, ["frame_idx", "cy", "cx"]).where(inside).drop("cy", "cx")
    return hit.withColumns({"y": F.col("y") - F.col("y0"), "x": F.col("x") - F.col("x0")}).drop("x0", "y0")
