"""Samples along rays: compositing, importance sampling, measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetab.functions import geom
from scenetab.functions.hashing import hash01
from scenetab.functions.ranks import exact_rank, take_smallest
from scenetab.functions.scan import CHUNK, carry, running, with_chunk
from scenetab.functions.session import cut_lineage
from scenetab.operators.points import sample_bilinear, unproject
from scenetab.operators.stencil import dilate, tiled, untiled

LAST_STEP = 1e10


def with_step(samples: DataFrame, keys: list[str], order: str = "sample_idx", chunk: int = CHUNK, last: str | None = None) -> DataFrame:
    """Distance to the next sample of the ray; the last one reaches 1e10. ``last``: a column for the ray's last index.

    Looks ahead inside chunks of the order key and takes the first depth of the next chunk from a row per chunk, so a
    ray of any length is spread over tasks.
    """
    src = with_chunk(samples, order, chunk)
    part = [*keys, "_c"]
    heads = src.groupBy(*part).agg(F.min_by("depth", order).alias("_h"), F.max(order).alias("_m"))
    nxt = F.lead("_h").over(Window.partitionBy(*keys).orderBy("_c"))
    heads = heads.select(*part, nxt.alias("_next"), *([F.max("_m").over(Window.partitionBy(*keys)).alias(last)] if last else []))
    ahead = F.lead("depth").over(Window.partitionBy(*part).orderBy(order))
    out = src.join(heads, part).withColumn("_ahead", F.coalesce(ahead, F.col("_next")))
    step = F.coalesce(F.col("_ahead") - F.col("depth"), F.lit(LAST_STEP))
    return out.withColumn("step", step).drop("_c", "_next", "_ahead")


def ray_weights(
    samples: DataFrame, keys: list[str], bounds: tuple[Column, Column] | None = None, transparent: bool = False, chunk: int = CHUNK
) -> DataFrame:
    """alpha and weight of each sample: alpha times what earlier samples let through."""
    return _weighed(with_step(samples, keys, chunk=chunk), keys, bounds, transparent, chunk)


def _weighed(src: DataFrame, keys: list[str], bounds: tuple[Column, Column] | None, transparent: bool, chunk: int) -> DataFrame:
    alpha = F.lit(1.0) - F.exp(-F.col("sigma") * F.col("step"))
    drop = F.lit(False)
    if bounds is not None:
        drop = (F.col("depth") < bounds[0]) | (F.col("depth") > bounds[1])
    if transparent:
        drop = drop | (F.col("step") >= LAST_STEP)
    src = src.withColumn("alpha", F.when(drop, F.lit(0.0)).otherwise(alpha))
    src = running(src, keys, "sample_idx", 1.0 - F.col("alpha") + 1e-10, "_through", kind="product", chunk=chunk)
    return src.withColumn("weight", F.col("alpha") * F.col("_through")).drop("_through")


def composite_rays(
    samples: DataFrame, keys: list[str], bounds: tuple[Column, Column] | None = None, transparent: bool = False, chunk: int = CHUNK
) -> DataFrame:
    """Colour, inverse depth and coverage per ray; with bounds both are normalized by the coverage."""
    w = ray_weights(samples, keys, bounds, transparent, chunk)
    inv = geom.clamp(geom.INV_DEPTH_COEF / (F.col("depth") + 1e-6), 0.0, 1.0)
    out = w.groupBy(*keys).agg(
        *[F.sum(F.col("weight") * F.col(c)).alias(c) for c in "rgb"], F.sum(F.col("weight") * inv).alias("inv_depth"),
        F.sum("weight").alias("coverage"),
    )
    if bounds is None:
        return out
    total = F.col("coverage") + 1e-10
    return out.withColumns({**{c: F.col(c) / total for c in "rgb"}, "inv_depth": geom.clamp(F.col("inv_depth") / total, 0.0, 1.0)})


def query_depths(rays: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n sample depths per ray: half even up to 10, half even in inverse depth beyond, jittered, numbered in order."""
    half = n // 2
    near, mid, far = geom.RAY_NEAR, geom.RAY_MID, geom.RAY_FAR
    src = rays.select(key, F.explode(F.sequence(F.lit(0), F.lit(2 * half - 1))).alias("i"))
    j = hash01(F.col(key) * n + F.col("i"), seed)
    k = F.col("i") % half
    step_a, step_b = (mid - near) / (half - 1), (1 / mid - 1 / far) / (half - 1)
    a = near + k * step_a + j * step_a
    b = 1.0 / (1.0 / far + k * step_b + j * step_b)
    src = src.withColumn("depth", F.when(F.col("i") < half, a).otherwise(b))
    w = Window.partitionBy(key).orderBy("depth", "i")
    return src.select(key, (F.row_number().over(w) - 1).alias("sample_idx"), "depth")


def importance_depths(samples: DataFrame, key: str, n: int, seed: int, keep: bool = False, chunk: int = CHUNK) -> DataFrame:
    """n new depths per ray where the weights are: draws inverted through the running distribution.

    A draw meets its bin by a join on (ray, slice of the distribution), so only bins of that slice are compared. The last
    index and the total of a ray come with the tables of chunks that the scans build, so the samples are read in one pass.
    """
    keys = [key]
    src = with_step(samples, keys, chunk=chunk, last="_last")
    src = src.withColumn("sigma", F.when(F.col("sample_idx") < F.col("_last"), F.col("sigma") + 1e-5).otherwise(F.col("sigma")))
    w = _weighed(src, keys, None, False, chunk)
    w = running(w, keys, "sample_idx", F.col("weight"), "_lo", chunk=chunk, total="_sum")
    w = w.withColumns({"lo": F.col("_lo") / F.col("_sum"), "hi": (F.col("_lo") + F.col("weight")) / F.col("_sum")})
    half = F.col("step") / 2.0
    w = w.withColumn("end", F.when(F.col("sample_idx") == F.col("_last"), F.lit(geom.RAY_FAR)).otherwise(F.col("depth") + half))
    w = carry(w, keys, "sample_idx", F.col("end"), "start", inclusive=False, chunk=chunk)
    bins = w.withColumn("start", F.coalesce("start", F.lit(geom.RAY_NEAR)))
    # draws beyond the last but one bin use that bin
    bins = bins.where(F.col("sample_idx") < F.col("_last")).withColumn("top", F.col("sample_idx") == F.col("_last") - 1)
    slices = 16
    cut = lambda c: F.least(F.floor(c * slices), F.lit(slices - 1)).cast("bigint")
    upto = F.when(F.col("top"), F.lit(slices - 1).cast("bigint")).otherwise(cut(F.col("hi")))
    bins = bins.withColumn("_s", F.explode(F.sequence(F.least(cut(F.col("lo")), upto), upto)))
    draws = samples.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    draws = draws.withColumn("u", hash01(F.col(key) * n + F.col("k"), seed)).withColumn("_s", cut(F.col("u")))
    u, lo, hi = F.col("u"), F.col("lo"), F.col("hi")
    inside = ((u > lo) | (F.col("sample_idx") == 0)) & ((u <= hi) | F.col("top"))
    hit = draws.join(bins.select(key, "_s", "sample_idx", "lo", "hi", "start", "end", "top"), [key, "_s"]).where(inside)
    den = F.when(hi - lo < 1e-5, F.lit(1.0)).otherwise(hi - lo)
    new = hit.select(key, (F.col("start") + (u - lo) / den * (F.col("end") - F.col("start"))).alias("depth"), F.col("k").cast("bigint").alias("k"))
    if keep:
        # the ray's own samples come along, however many they are
        new = new.unionByName(samples.select(key, "depth", (F.col("sample_idx") + n).cast("bigint").alias("k")))
        return exact_rank(new, [key], "depth", "k", out="sample_idx").select(key, "sample_idx", "depth")
    order = Window.partitionBy(key).orderBy("depth", "k")
    return new.select(key, (F.row_number().over(order) - 1).alias("sample_idx"), "depth")


def ray_distortion(weighted: DataFrame, key: str, chunk: int = CHUNK) -> DataFrame:
    """Spread of the weights along each ray: interval sizes plus distances of all interval pairs.

    Midpoints are in order along the ray, so the pair sum is two running sums instead of all pairs. ``weighted`` has
    sample_idx, depth and weight; the last sample only closes the last interval.
    """
    src = with_step(weighted, [key], chunk=chunk).where(F.col("step") < LAST_STEP)
    src = src.withColumn("mid", F.col("depth") + F.col("step") / 2.0)
    src = running(src, [key], "sample_idx", F.col("weight"), "_w", chunk=chunk)
    src = running(src, [key], "sample_idx", F.col("weight") * F.col("mid"), "_wm", chunk=chunk)
    pair = 2.0 * F.col("weight") * (F.col("mid") * F.col("_w") - F.col("_wm"))
    n = F.count(F.lit(1))
    size = F.sum(F.col("weight") * F.col("weight") * F.col("step") / 3.0) / n
    return src.groupBy(key).agg((size + F.sum(pair) / (n * n)).alias("distortion"))


# draws repeat after so many numbers
DRAWS = 1 << 31


def shell_bounds(pixels: DataFrame, cols: tuple[str, str, str] = ("invd0", "invd1", "invd2")) -> DataFrame:
    """Two shell distances per pixel between three layers of inverse depth in any order."""
    s = F.array_sort(F.array(*cols))
    src = pixels.withColumn("_s", s)
    at = lambda i: geom.clamp(
        geom.INV_DEPTH_COEF / ((F.get("_s", i) + F.get("_s", i + 1)) * 0.5 + 1e-6), 0.0, geom.Z_FAR
    )
    return src.withColumns({"near_shell": at(1), "far_shell": at(0)}).drop("_s")


def _open_pixels(cams: DataFrame, pixels: DataFrame, limit_radius: bool) -> DataFrame:
    """Pixels that a draw can hit: not ignored, not in the last row or column, some corner inside the useable radius."""
    seen = pixels.where(~F.col("ignore")).select("cam_idx", "y", "x").join(cams, "cam_idx")
    seen = seen.where((F.col("x") < F.col("width") - 1) & (F.col("y") < F.col("height") - 1))
    if limit_radius:
        near = lambda a, c: F.greatest(F.lit(0.0), F.col(a) - F.col(c), F.col(c) - F.col(a) - 1)
        seen = seen.where((F.col("cam_model") != "equiangular") | (geom.norm(near("x", "cx"), near("y", "cy")) < F.col("useable_radius")))
    return seen


def sample_rays(cams: DataFrame, pixels: DataFrame, n: int, seed: int, limit_radius: bool = True) -> DataFrame:
    """n rays through unmasked pixels of random images: origin, world direction, target colour.

    ``cams`` has dense ``row`` numbers from 0; ``pixels`` is keyed by cam_idx with ``ignore``. Draws are rejected by filters
    and more are drawn until enough are left; the first n by draw number are kept. A round goes on where the one before it has
    ended, and what that accepted is stored. It is an error if no pixel can be drawn.
    """
    spark = cams.sparkSession
    n_cams = cams.count()
    start, m, ok, found = 0, max(2 * n, 64), None, 0
    while True:
        did = F.col("id")
        draws = spark.range(start, m).select("id", F.floor(hash01(did, seed) * n_cams).alias("row"), hash01(did, seed + 1).alias("_a"), hash01(did, seed + 2).alias("_b"))
        d = draws.join(cams, "row").withColumns({"u": F.col("_a") * (F.col("width") - 1), "v": F.col("_b") * (F.col("height") - 1)})
        d = d.withColumns({"y": F.floor("v"), "x": F.floor("u")})
        if limit_radius:
            r = geom.norm(F.col("u") - F.col("cx"), F.col("v") - F.col("cy"))
            d = d.where((F.col("cam_model") != "equiangular") | (r <= F.col("useable_radius")))
        new = cut_lineage(d.join(pixels.where("ignore").select("cam_idx", "y", "x"), ["cam_idx", "y", "x"], "left_anti"))
        ok = new if ok is None else ok.unionByName(new)
        found += new.count()
        if found >= n:
            break
        if m > 1000 * n and (m > DRAWS or _open_pixels(cams, pixels, limit_radius).isEmpty()):
            raise ValueError("no pixel is left to draw from")
        start, m = m, 2 * m
    first = take_smallest(ok.drop("y", "x"), "id", "id", n)
    colors = sample_bilinear(first.select("id", "cam_idx", "u", "v", "width", "height"), pixels, ["id"], "cam_idx", ["b", "g", "r"], F.col("width"), F.col("height"))
    cam = geom.flat()
    rays = geom.with_ray(first, cam, F.col("u"), F.col("v"))
    dx, dy, dz = geom.rotate_to_world(cam, F.col("_rx"), F.col("_ry"), F.col("_rz"))
    ox, oy, oz = geom.position(cam)
    out = rays.select("id", "cam_idx", "u", "v", ox.alias("ox"), oy.alias("oy"), oz.alias("oz"), dx.alias("dx"), dy.alias("dy"), dz.alias("dz"))
    return out.join(colors, "id")


def sample_depth_points(cams: DataFrame, pixels: DataFrame, n: int, seed: int, margin: float = 0.1) -> DataFrame:
    """Equal draws per camera inside the margin, lifted by the depth there; draws with depth below 0.01 are skipped.

    ``pixels`` is keyed by cam_idx and holds depth, b, g, r. Fewer than n points come out when draws are skipped.
    """
    per = n // cams.count()
    draws = cams.select("cam_idx", "width", "height", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(per - 1).cast("bigint"))).alias("k"))
    did = F.col("cam_idx") * per + F.col("k")
    at = lambda dim, s: F.col(dim) * margin + hash01(did, s) * (F.col(dim) - 2.0 * F.col(dim) * margin)
    draws = draws.select("cam_idx", "width", "height", did.alias("point_id"), at("width", seed).alias("u"), at("height", seed + 1).alias("v"))
    got = sample_bilinear(draws, pixels, ["cam_idx", "point_id", "u", "v"], "cam_idx", ["depth", "b", "g", "r"], F.col("width"), F.col("height"))
    return unproject(got.where(F.col("depth") >= geom.Z_NEAR), cams)


def _numbers(df: DataFrame, start: int, end: int, out: str, block: int = 1 << 16) -> DataFrame:
    """Each row with the numbers from ``start`` to before ``end``, by blocks, so that no list is long."""
    whole = lambda n: F.lit(n).cast("bigint")
    blocks = df.withColumn("_b", F.explode(F.sequence(whole(start // block), whole((end - 1) // block))))
    first, last = F.greatest(whole(start), F.col("_b") * block), F.least(whole(end - 1), (F.col("_b") + 1) * block - 1)
    return blocks.withColumn(out, F.explode(F.sequence(first, last))).drop("_b")


def _depth_left(cams: DataFrame, pixels: DataFrame, masked: DataFrame, size: tuple[int, int], margin: float) -> DataFrame:
    """The cameras with an unmasked pixel in whose part inside the margin some depth is enough.

    Depth is bilinear between four pixels, so its largest value in that part is at one of the corners.
    """
    h, w = size
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    grid = cams.select("cam_idx", upto(h).alias("y")).select("cam_idx", "y", upto(w).alias("x"))
    grid = grid.join(masked, ["cam_idx", "y", "x"], "left_anti")
    # the upper sides belong to the next pixel; draws come nearer to them than this
    ends = lambda c, n: (F.greatest(F.col(c) + 0.0, F.lit(n * margin)), F.least(F.col(c) + 1.0, F.lit(n - n * margin)) - n / DRAWS * 4)
    (u0, u1), (v0, v1) = ends("x", w), ends("y", h)
    corners = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), u.alias("u"), v.alias("v")) for k, (u, v) in enumerate([(u0, v0), (u0, v1), (u1, v0), (u1, v1)])])
    corners = grid.where((u0 <= u1) & (v0 <= v1)).select("cam_idx", "y", "x", F.explode(corners).alias("c")).select("cam_idx", F.col("y").alias("_y"), F.col("x").alias("_x"), "c.*")
    got = sample_bilinear(corners, pixels, ["cam_idx", "_y", "_x", "k"], "cam_idx", ["depth"], F.lit(w), F.lit(h))
    return got.where(F.col("depth") >= geom.Z_NEAR).select("cam_idx").distinct()


def sample_depth_points_exact(cams: DataFrame, pixels: DataFrame, size: tuple[int, int], n: int, seed: int, margin: float = 0.01) -> DataFrame:
    """Single-image form: draws on a dilated mask or without depth are replaced until each camera has n points.

    A round draws only for the cameras that are still short of points, and goes on where their last draws have ended; what it accepts is
    stored. It is an error if a camera has no place left to draw from.
    """
    h, w = size
    mask = pixels.select("cam_idx", "y", "x", F.when(F.col("ignore"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("m"))
    wide = untiled(dilate(tiled(mask, ["cam_idx"], 1), ["cam_idx"], ["m"], 1)).where("m > 0").select("cam_idx", "y", "x")
    left, got, start, per = cams.select("cam_idx"), None, 0, 2 * n
    while True:
        pts = _numbers(left, start, per, "k")
        did = F.col("cam_idx") * 1_000_000_007 + F.col("k")
        at = lambda dim, s: dim * margin + hash01(did, s) * (dim - 2.0 * dim * margin)
        pts = pts.withColumns({"u": at(w, seed), "v": at(h, seed + 1)}).withColumns({"y": F.floor("v"), "x": F.floor("u")})
        pts = pts.join(wide, ["cam_idx", "y", "x"], "left_anti").select("cam_idx", "k", "u", "v")
        new = sample_bilinear(pts, pixels, ["cam_idx", "k", "u", "v"], "cam_idx", ["depth", "b", "g", "r"], F.lit(w), F.lit(h))
        new = cut_lineage(new.where(F.col("depth") >= geom.Z_NEAR))
        got = new if got is None else got.unionByName(new)
        have = got.groupBy("cam_idx").agg(F.count(F.lit(1)).alias("c"))
        left = cut_lineage(left.join(have, "cam_idx", "left").where(F.coalesce("c", F.lit(0)) < n).select("cam_idx"))
        if left.isEmpty():
            break
        if per > 1000 * n and (per > DRAWS or not left.join(_depth_left(left, pixels, wide, size, margin), "cam_idx", "left_anti").isEmpty()):
            raise ValueError("a camera has no pixel left to draw from")
        start, per = per, 2 * per
    rank = F.row_number().over(Window.partitionBy("cam_idx").orderBy("k"))
    kept = got.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")
    return unproject(kept, cams)

