"""Keypoints, match graphs and tracks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetab.functions import geom
from scenetab.functions.columns import settle
from scenetab.functions.ranks import fraction_index, pick_at
from scenetab.functions.session import broadcast_if_small, cut_lineage
from scenetab.functions.skew import join_counted
from scenetab.operators.points import sample_bilinear



# ---- keypoints ---------------------------------------------------------------------------------------------------


def keypoints_in_useable_radius(kps: DataFrame, cams: DataFrame) -> DataFrame:
    """Drop keypoints of fisheye images beyond the useable radius around the optical centre."""
    c = broadcast_if_small(cams.select(F.col("cam_idx").alias("image_idx"), "cam_model", "cx", "cy", "useable_radius"))
    r = geom.norm(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    keep = (F.col("cam_model") != "equiangular") | (r <= F.col("useable_radius"))
    return kps.join(c, "image_idx").where(keep).select(*kps.columns)


def _near_cells(df: DataFrame, reach: int = 2) -> DataFrame:
    offs = F.array(*[F.lit(i).cast("bigint") for i in range(-reach, reach + 1)])
    return df.withColumn("_dx", F.explode(offs)).withColumn("_dy", F.explode(offs)).withColumns(
        {"gx": F.col("gx") + F.col("_dx"), "gy": F.col("gy") + F.col("_dy")}
    ).drop("_dx", "_dy")


def thin_keypoints(kps: DataFrame, radius: float, existing: DataFrame | None = None, image: str = "image_idx", order: str = "kp_idx") -> DataFrame:
    """The keypoints a greedy scan in input order keeps: none nearer than ``radius`` to a kept or existing one.

    Cells are smaller than the radius across, so a cell can keep one keypoint only and only its first undecided one can
    be next. A round compares every undecided keypoint with the first ones of the 25 cells around it (linear in the
    keypoints, however crowded a cell is), keeps the first ones with no earlier undecided neighbour, drops what is near
    them and goes on with the rest.
    """
    side = radius / math.sqrt(2.0) * 0.999
    cell = lambda c: F.floor(F.col(c) / F.lit(side)).cast("bigint")
    grid = lambda df: df.select(image, F.col(order).alias("k"), "x", "y", cell("x").alias("gx"), cell("y").alias("gy"))
    todo = grid(kps)
    cells = [image, "gx", "gy"]

    def near(a: DataFrame, b: DataFrame) -> DataFrame:
        """Rows of a paired with the rows of b (named kb, xb, yb) nearer than the radius."""
        around = _near_cells(b.select(*cells, F.col("k").alias("kb"), F.col("x").alias("xb"), F.col("y").alias("yb")))
        d = geom.norm(F.col("x") - F.col("xb"), F.col("y") - F.col("yb"))
        return a.join(around, cells).where(d < radius)

    if existing is not None:
        old = existing.select(image, F.lit(-1).cast("bigint").alias("k"), "x", "y", cell("x").alias("gx"), cell("y").alias("gy"))
        taken = near(todo, old).select(image, "k").distinct()
        todo = todo.join(taken, [image, "k"], "left_anti")
    todo = cut_lineage(todo)
    kept = None
    # the least undecided keypoint of an image is always kept, so every round settles some
    while not todo.isEmpty():
        first = todo.groupBy(*cells).agg(F.min("k").alias("k"), F.min_by("x", "k").alias("x"), F.min_by("y", "k").alias("y"))
        blocked = near(todo, first).where(F.col("k") < F.col("kb")).select(image, F.col("kb").alias("k")).distinct()
        ok = cut_lineage(first.join(blocked, [image, "k"], "left_anti").select(image, "k", "x", "y", "gx", "gy"))
        kept = ok.select(image, "k") if kept is None else kept.unionByName(ok.select(image, "k"))
        gone = near(todo, ok).select(image, "k").distinct()
        todo = cut_lineage(todo.join(gone, [image, "k"], "left_anti"))
    if kept is None:
        return kps.limit(0)
    return kps.join(kept.withColumnRenamed("k", order), [image, order], "left_semi")


# ---- matching ----------------------------------------------------------------------------------------------------


# partners in one row, pairs made by one task, and the bound of the tasks
PIECE, PAIRS_PER_TASK, MOST_TASKS = 512, 1 << 22, 1 << 14


def candidate_pairs(images: DataFrame, window: int, interval: int = 5, image: str = "image_idx") -> DataFrame:
    """Pairs i < j of dense image indices within the window, or both keyframes; a window of 0 means all pairs.

    Each image generates its own partners, so no product of images is formed. They are runs of numbers, which are cut into pieces of at
    most PIECE partners and dealt to tasks of some PAIRS_PER_TASK pairs, so no row or task grows with the number of images. Tasks get
    tiles of neighbouring images and the same partners, so that written columns have few values and stay small.
    """
    n = images.agg(F.coalesce(F.max(image), F.lit(-1)).alias("m")).first()["m"] + 1
    last = F.lit(n - 1).cast("bigint")
    i = F.col("image_idx1")
    run = lambda start, stop, step: F.struct(start.cast("bigint").alias("start"), stop.cast("bigint").alias("stop"), F.lit(step).cast("bigint").alias("step"))
    if window == 0:
        runs = F.array(run(i + 1, last, 1))
    else:
        # no run has a number of another one: keyframes begin beyond the window, and the last image is added unless it is one
        beyond = i + max(window, 0)
        first = beyond - F.pmod(beyond, F.lit(interval).cast("bigint")) + interval
        marks, end = run(first, last, interval), run(F.greatest(beyond + 1, last), last, 1)
        far = F.array(marks, end) if (n - 1) % interval else F.array(marks)
        near = F.array(run(i + 1, F.least(i + window, last), 1))
        runs = F.when((i % interval == 0) | (i == last), F.concat(near, far)).otherwise(near)
    held = images.select(F.col(image).cast("bigint").alias("image_idx1")).where(i.isNotNull())
    held = held.select("image_idx1", F.inline(F.filter(runs, lambda r: r["start"] <= r["stop"])))
    piece, step = F.col("step") * PIECE, F.col("step")
    pairs = held.agg(F.sum(F.expr("(stop - start) div step + 1"))).first()[0] or 0
    # pieces end at the same numbers for all images, so those of a tile of images have the same partners
    blocks = F.sequence(F.floor(F.col("start") / piece), F.floor(F.col("stop") / piece))
    held = held.select("image_idx1", "step", "start", "stop", F.explode(blocks).alias("_block"))
    if pairs > PAIRS_PER_TASK:
        rows = max(PAIRS_PER_TASK // PIECE // 4, 1)
        tile = ["step", "_block", F.floor(i / (step * rows))]
        held = held.repartition(min(MOST_TASKS, -(-pairs // PAIRS_PER_TASK)), *tile).sortWithinPartitions(*tile, "image_idx1")
    lowest = F.col("_block") * piece
    # a run's numbers are its start and whole steps on
    start = F.greatest(F.col("start"), lowest + F.pmod(F.col("start") - lowest, step))
    stop = F.least(F.col("stop"), lowest + piece - 1)
    held = held.select("image_idx1", "step", start.alias("start"), stop.alias("stop")).where("start <= stop")
    return held.select("image_idx1", F.explode(F.sequence("start", "stop", "step")).alias("image_idx2"))


BLOCK = 1024


def _two_nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """For one block pair: up to two nearest candidates per keypoint, both ways."""
    cols = ["image_idx1", "image_idx2", "side", "query", "cand", "d"]
    if left.empty or right.empty:
        return pd.DataFrame({c: pd.Series(dtype="float64" if c == "d" else "int64") for c in cols})
    a, b = np.stack(left["embedding"].to_numpy()).astype("f8"), np.stack(right["embedding"].to_numpy()).astype("f8")
    ka, kb = left["kp_idx"].to_numpy(), right["kp_idx"].to_numpy()
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    out = []
    for side, (m, q, c, vq, vc) in enumerate(((d2, ka, kb, a, b), (d2.T, kb, ka, b, a))):
        k = min(2, m.shape[1])
        pick = np.argpartition(m, k - 1, axis=1)[:, :k]
        exact = np.sqrt(((vq[:, None, :] - vc[pick]) ** 2).sum(2))
        out.append(pd.DataFrame({"side": side, "query": np.repeat(q, k), "cand": c[pick].ravel(), "d": exact.ravel()}))
    got = pd.concat(out)
    got["image_idx1"], got["image_idx2"] = left["image_idx1"].iloc[0], left["image_idx2"].iloc[0]
    return got[cols]


def match_descriptors(desc: DataFrame, pairs: DataFrame, ratio: float, block: int = BLOCK) -> DataFrame:
    """Mutual nearest neighbours that pass the ratio test in both directions.

    Keypoints are dealt into blocks of about ``block``; a task compares one block with one block by a matrix product and
    returns two candidates per keypoint, which are merged per keypoint. Nothing larger than a block pair meets in a task.
    """
    sizes = desc.groupBy("image_idx").agg(F.count(F.lit(1)).alias("_n"))
    parts = sizes.select("image_idx", F.ceil(F.col("_n") / block).cast("int").alias("_parts"))
    dealt = desc.join(broadcast_if_small(parts), "image_idx").withColumn("_b", F.pmod(F.xxhash64("kp_idx"), F.col("_parts")))
    wide = pairs.select("image_idx1", "image_idx2")
    grid = (
        wide.join(broadcast_if_small(parts.select(F.col("image_idx").alias("image_idx1"), F.col("_parts").alias("_p1"))), "image_idx1")
        .join(broadcast_if_small(parts.select(F.col("image_idx").alias("image_idx2"), F.col("_parts").alias("_p2"))), "image_idx2")
        .withColumn("_b1", F.explode(F.sequence(F.lit(0), F.col("_p1") - 1)))
        .withColumn("_b2", F.explode(F.sequence(F.lit(0), F.col("_p2") - 1)))
        .select("image_idx1", "image_idx2", F.col("_b1").cast("bigint").alias("_b1"), F.col("_b2").cast("bigint").alias("_b2"))
    )
    keys = ["image_idx1", "image_idx2", "_b1", "_b2"]
    side = lambda i: grid.join(
        dealt.select(F.col("image_idx").alias(f"image_idx{i}"), F.col("_b").alias(f"_b{i}"), "kp_idx", "embedding"), [f"image_idx{i}", f"_b{i}"]
    ).select(*keys, "kp_idx", "embedding")
    found = (
        side(1).groupBy(*keys).cogroup(side(2).toDF(*[f"r_{c}" for c in keys], "kp_idx", "embedding").groupBy(*[f"r_{c}" for c in keys]))
        .applyInPandas(_two_nearest, "image_idx1 bigint, image_idx2 bigint, side bigint, query bigint, cand bigint, d double")
    )
    who = ["image_idx1", "image_idx2", "side", "query"]
    w = Window.partitionBy(*who).orderBy("d", "cand")
    two = found.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
    best = two.groupBy(*who).agg(
        F.min_by("cand", "_rn").alias("cand"), F.min("d").alias("d1"), F.max("d").alias("d2"), F.count(F.lit(1)).alias("_n")
    )
    best = best.where((F.col("_n") == 2) & (F.col("d1") < ratio * F.col("d2")))
    fwd = best.where("side = 0").select("image_idx1", "image_idx2", F.col("query").alias("keypoint_idx1"), F.col("cand").alias("keypoint_idx2"), F.col("d1").alias("distance"))
    back = best.where("side = 1").select("image_idx1", "image_idx2", F.col("cand").alias("keypoint_idx1"), F.col("query").alias("keypoint_idx2"))
    return fwd.join(back, ["image_idx1", "image_idx2", "keypoint_idx1", "keypoint_idx2"])


def flow_consistent(matches: DataFrame, flow: DataFrame, threshold: float, pair: list[str]) -> DataFrame:
    """Matches (x1, y1) -> (x2, y2) that agree with the flow at their truncated pixel."""
    m = matches.withColumns({"_y": F.col("y1").cast("int").cast("bigint"), "_x": F.col("x1").cast("int").cast("bigint")})
    f = flow.select(*pair, F.col("y").cast("bigint").alias("_y"), F.col("x").cast("bigint").alias("_x"), "fu", "fv")
    d = geom.norm(F.col("x1") + F.col("fu") - F.col("x2"), F.col("y1") + F.col("fv") - F.col("y2"))
    return m.join(f, [*pair, "_y", "_x"]).where(d < threshold).select(*matches.columns)


# ---- the match graph ---------------------------------------------------------------------------------------------


def _ends(matches: DataFrame) -> DataFrame:
    return matches.select(F.explode(F.array("image_idx1", "image_idx2")).alias("image_idx"))


def matches_per_image(matches: DataFrame, images: DataFrame) -> DataFrame:
    """Matches counted at both ends; images without any get 0."""
    counts = _ends(matches).groupBy("image_idx").agg(F.count(F.lit(1)).alias("n_matches"))
    return images.select("image_idx").join(counts, "image_idx", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


def order_by_connectivity(matches: DataFrame, images: DataFrame, cut_every: int = 8) -> DataFrame:
    """Greedy order: most matches first, then always the image with most matches to those chosen; ties to the lowest index.

    The matches are aggregated once to image-to-image weights. Each round adds the weights of the image chosen last to a
    running score, so a round costs one pass over the small score table.
    """
    both = matches.select("image_idx1", "image_idx2").union(matches.select("image_idx2", "image_idx1"))
    weights = cut_lineage(
        both.groupBy(F.col("image_idx1").alias("chosen"), F.col("image_idx2").alias("image_idx")).agg(F.count(F.lit(1)).alias("w"))
    )
    total = matches_per_image(matches, images).withColumnRenamed("n_matches", "score")
    left = cut_lineage(total.select("image_idx", F.col("score").cast("bigint").alias("score")))
    picks: list[tuple[int, int]] = []
    best = F.max_by(F.struct("image_idx", "score"), F.struct("score", (-F.col("image_idx")).alias("i"))).alias("b")
    n = left.count()
    for pos in range(n):
        b = left.agg(best).first()["b"]
        picks.append((pos, b["image_idx"]))
        add = weights.where(F.col("chosen") == b["image_idx"]).select("image_idx", "w")
        left = left.where(F.col("image_idx") != b["image_idx"])
        if pos == 0:
            left = left.withColumn("score", F.lit(0).cast("bigint"))
        left = left.join(add, "image_idx", "left").select("image_idx", (F.col("score") + F.coalesce("w", F.lit(0))).alias("score"))
        if pos % cut_every == cut_every - 1:
            left = cut_lineage(left)
    return images.sparkSession.createDataFrame(picks, "position bigint, image_idx bigint")


def _greedy(pdf: pd.DataFrame) -> np.ndarray:
    """Image indices in greedy order, from (chosen, image_idx, w); rows without ``chosen`` name the images."""
    images = np.sort(pdf.loc[pdf["chosen"].isna(), "image_idx"].unique())
    edges = pdf[pdf["chosen"].notna() & pdf["image_idx"].isin(images)]
    to, w = np.searchsorted(images, edges["image_idx"].to_numpy()), edges["w"].to_numpy()
    total = np.bincount(to, weights=w, minlength=len(images)).astype(np.int64)
    inner = edges["chosen"].isin(images).to_numpy()
    frm, to, w = np.searchsorted(images, edges["chosen"].to_numpy()[inner]), to[inner], w[inner]
    by = np.argsort(frm, kind="stable")
    to, w, ends = to[by], w[by], np.r_[0, np.cumsum(np.bincount(frm, minlength=len(images)))]
    score, order = total.copy(), []
    for k in range(len(images)):
        best = int(np.argmax(score))  # the lowest index of equal ones
        if k == 0:
            score[:] = 0
        order.append(best)
        some = slice(ends[best], ends[best + 1])
        score[to[some]] += w[some]
        score[order] = -1
    return images[order]


def order_videos(matches: DataFrame, images: DataFrame, video: str = "video") -> DataFrame:
    """The order of ``order_by_connectivity`` for the images of every video, in one job: (video, position, image_idx).

    ``matches`` and ``images`` have the video's key. Matches are summed to one row per pair of images before they meet by video, so a
    task holds the square of a video's images at most, however many matches there are. A video is one capture of some thousand
    images; ``order_by_connectivity`` has no such bound.
    """
    both = matches.select(video, F.col("image_idx1").alias("chosen"), F.col("image_idx2").alias("image_idx"))
    both = both.unionByName(both.select(video, F.col("image_idx").alias("chosen"), F.col("chosen").alias("image_idx")))
    weights = both.groupBy(video, "chosen", "image_idx").agg(F.count(F.lit(1)).alias("w"))
    rows = weights.unionByName(images.select(video, F.lit(None).cast("bigint").alias("chosen"), "image_idx", F.lit(0).cast("bigint").alias("w")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _greedy(pdf)
        return pd.DataFrame({video: pdf[video].iloc[0], "position": np.arange(len(found)), "image_idx": found})

    kind = dict(images.dtypes)[video]
    return rows.select(video, "chosen", F.col("image_idx").cast("bigint").alias("image_idx"), "w").groupBy(video).applyInPandas(run, f"{video} {kind}, position bigint, image_idx bigint")


def _node(image: str, kp: str) -> Column:
    """Image and keypoint in one number, 31 and 32 bits; larger ids are an error, not a merger of strangers."""
    i, k = F.col(image).cast("bigint"), F.col(kp).cast("bigint")
    fits = i.between(0, (1 << 31) - 1) & k.between(0, (1 << 32) - 1)
    wide = F.raise_error(F.concat(F.lit("ids too large for a node: "), i.cast("string"), F.lit(", "), k.cast("string"))).cast("bigint")
    return F.when(fits, F.shiftleft(i, 32).bitwiseOR(k)).when(i.isNull() | k.isNull(), F.lit(None).cast("bigint")).otherwise(wide)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (u, v): root is the smallest node of its component.

    Alternating large-star and small-star rewrites (Kiveris et al. 2014): minima by key are pre-aggregated, edges only ever
    shrink, and each half of a round is written to the checkpoint folder. Ends when a round changes nothing, however many
    that takes: every round brings each end of an edge nearer to the least node of its component. Roots of big components become hubs;
    their minimum comes to their edges by a bounded broadcast, in the shuffle that serves the other keys.
    """
    e = edges.select("u", "v").where("u <> v").distinct()

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    # both steps see at most 2 n rows, so fewer than 2 * HOT_SHARE hubs are broadcast
    def large(df: DataFrame, n: int) -> DataFrame:
        both = df.union(df.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        return join_counted(both.where("v > u"), low, "u", "n", n).select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(df: DataFrame, n: int) -> DataFrame:
        down = df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = join_counted(down, low, "u", "n", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(low.select("u", F.col("m").alias("v"))).distinct()

    e = cut_lineage(e)
    seen = mark(e)
    while seen["n"]:
        e = cut_lineage(small(cut_lineage(large(e, seen["n"])), seen["n"]))
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())


def build_tracks(keypoints: DataFrame, matches: DataFrame, num_images: int, min_obs: int = 2) -> DataFrame:
    """Observations grouped into tracks: keypoints linked by matches, groups of at least min(num_images, min_obs)."""
    kps = keypoints.withColumn("node", _node("image_idx", "kp_idx"))
    edges = matches.select(_node("image_idx1", "keypoint_idx1").alias("u"), _node("image_idx2", "keypoint_idx2").alias("v"))
    roots = connected_components(edges)
    if min(num_images, min_obs) > 1:
        members = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(num_images, min_obs))
        roots = join_counted(roots, members, "root", "n", roots.count())
        return kps.join(roots, "node").withColumnRenamed("root", "track_id").drop("node")
    return kps.join(roots, "node", "left").withColumn("track_id", F.coalesce("root", "node")).drop("node", "root")


# ---- tracks ------------------------------------------------------------------------------------------------------


def eligible_tracks(
    tracks: DataFrame, obs: DataFrame, n_active: int, lo: int, hi: int, need_3d: bool = False, min_obs: int = 2
) -> DataFrame:
    """Unpruned tracks with enough observations in active cameras and one in the unlocked range; the rest flagged."""
    counts = obs.groupBy("track_id").agg(
        F.count_if(F.col("img_idx") < n_active).alias("n_active"),
        F.count_if((F.col("img_idx") < n_active) & F.col("img_idx").between(lo, hi)).alias("n_unlocked"),
    )
    src = tracks.where(~F.col("pruned"))
    if need_3d:
        src = src.where("has_estimated_3d")
    j = src.join(counts, "track_id", "left").fillna(0, ["n_active", "n_unlocked"])
    return j.withColumn("skipped_low_obs", (F.col("n_active") < min_obs) | (F.col("n_unlocked") < 1))


def long_tracks(obs: DataFrame, lo: int = 10, hi: int = 10000) -> DataFrame:
    """Time-series rule: tracks with a length in [lo, hi]."""
    return obs.groupBy("track_id").agg(F.count(F.lit(1)).alias("length")).where(F.col("length").between(lo, hi))


def reprojection_residuals(tracks: DataFrame, obs: DataFrame, cams: DataFrame) -> DataFrame:
    """dx, dy, depth residual and camera-space z for every observation of a track."""
    t = tracks.select("track_id", *[F.col(c).alias(f"_{c}") for c in "xyz"], "weight")
    j = obs.join(t, "track_id").join(broadcast_if_small(cams.drop("name", "scene_id")), F.col("img_idx") == F.col("cam_idx"))
    xc, yc, zc = geom.to_cam(geom.flat(), F.col("_x"), F.col("_y"), F.col("_z"))
    j = settle(j.withColumns({"xc": xc, "yc": yc, "z": zc}), ["xc", "yc", "z"]).withColumn("zc", F.greatest(F.col("z"), F.lit(0.1)))
    j = geom.with_pixel(j, geom.flat())
    return j.select(
        "track_id", "img_idx", "weight", "z", "mono", (F.col("weight") * (F.col("u") - F.col("x"))).alias("dx"),
        (F.col("weight") * (F.col("v") - F.col("y"))).alias("dy"), (F.col("weight") * (F.col("z") - F.col("mono"))).alias("dz"),
    )


def focal_prior(cams: DataFrame, initial: float) -> DataFrame:
    return cams.select("cam_idx", ((F.col("fx") - initial) / (0.1 * initial)).alias("focal_residual"))


def score_tracks(residuals: DataFrame) -> DataFrame:
    """Root mean square error per track (``mean_square`` is the time-series form)."""
    sq = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    agg = residuals.groupBy("track_id").agg(F.avg(sq).alias("mean_square"), F.bool_or(F.col("z") < 0).alias("behind"))
    return agg.withColumn("err", F.sqrt(F.col("mean_square") + 1e-7))


def global_rmse(residuals: DataFrame) -> DataFrame:
    sq = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    return residuals.agg(F.sqrt(F.avg(sq)).alias("rmse"), F.count(F.lit(1)).alias("n_obs"))


OUTLIER_PX, STEEPNESS = 5.0, 2.0


def reweight_tracks(scores: DataFrame, inlier_frac: float) -> DataFrame:
    """Soft outlier weights around max(5 px, percentile); tracks behind a camera are pruned."""
    scores = cut_lineage(scores)
    row = pick_at(scores, [], "err", {"p": fraction_index(inlier_frac)}).first()
    thr = F.lit(max(OUTLIER_PX, row["p"] if row and row["p"] is not None else 0.0))
    w = (F.tanh(STEEPNESS * (thr - F.col("err"))) + 1.0) / 2.0
    return scores.select(
        "track_id", "err", F.when(F.col("behind"), F.lit(0.0)).otherwise(w).alias("weight"), F.col("behind").alias("pruned")
    )


def percentile_at(df: DataFrame, group: list[str], col: str, frac: float) -> DataFrame:
    return pick_at(df, group, col, {"value": fraction_index(frac)}).drop("n")


def median_mid(df: DataFrame, group: list[str], col: str) -> DataFrame:
    """Mean of the two middle values (of the one, for odd counts)."""
    two = pick_at(df, group, col, {"a": F.floor((F.col("n") - 1) / 2), "b": F.floor(F.col("n") / 2)})
    return two.select(*group, ((F.col("a") + F.col("b")) / 2.0).alias("value"))


def _with_position(cams: DataFrame) -> DataFrame:
    px, py, pz = geom.position(geom.flat())
    return cams.withColumns({"_px": px, "_py": py, "_pz": pz})


def _moved(cams: DataFrame) -> DataFrame:
    """Translation columns that put each camera at _px, _py, _pz."""
    t = {f"t{i}": -sum((F.col(f"r{i}{j}") * F.col(f"_p{c}") for j, c in enumerate("xyz")), F.lit(0.0)) for i in range(3)}
    return cams.withColumns(t)


def normalize_radius(cams: DataFrame, points: DataFrame, n_active: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Centre on the mean camera and divide by twice the mean radius.

    With ``n_active`` the centre uses active cameras only, while the radius sum runs over all and is divided by the active
    count. The two numbers are one row, kept on the driver.
    """
    src = _with_position(cams)
    act = src if n_active is None else src.where(F.col("cam_idx") < n_active)
    c = act.agg(*[F.avg(f"_p{a}").alias(a) for a in "xyz"], F.count(F.lit(1)).alias("n")).first()
    d = geom.norm(*[F.col(f"_p{a}") - F.lit(c[a]) for a in "xyz"])
    scale = 2.0 * src.agg(F.sum(d).alias("s")).first()["s"] / c["n"]
    src = src.withColumns({f"_p{a}": (F.col(f"_p{a}") - F.lit(c[a])) / F.lit(scale) for a in "xyz"})
    pts = points.withColumns({a: (F.col(a) - F.lit(c[a])) / F.lit(scale) for a in "xyz"})
    if n_active is not None:
        n = geom.norm(F.col("x"), F.col("y"), F.col("z"))
        k = F.when(n > geom.Z_FAR, geom.div(F.lit(geom.Z_FAR), n)).otherwise(F.lit(1.0))
        pts = pts.withColumns({a: F.col(a) * k for a in "xyz"})
    return _moved(src).drop("_px", "_py", "_pz"), pts


def depth_scale(tracks: DataFrame, obs: DataFrame, cams: DataFrame, min_samples: int = 20) -> float | None:
    """Median ratio of track depth to monocular depth, taken again within a factor 5; None when too few samples."""
    good = tracks.where(~F.col("pruned") & F.col("has_estimated_3d"))
    res = reprojection_residuals(good.withColumn("weight", F.lit(1.0)), obs, cams)
    mono = F.col("mono")
    ratios = res.select(F.when((F.col("z") >= 0.01) & (mono > 0.01), geom.div(F.col("z"), mono)).alias("ratio"))
    ratios = cut_lineage(settle(ratios, ["ratio"]).where(F.col("ratio").isNotNull()))
    mid = {"m": F.floor(F.col("n") / 2)}
    first = pick_at(ratios, [], "ratio", mid).first()
    if first is None or first["n"] is None or first["n"] < min_samples:
        return None
    near = ratios.where((F.col("ratio") > first["m"] / 5.0) & (F.col("ratio") < first["m"] * 5.0))
    second = pick_at(near, [], "ratio", mid).first()
    return second["m"] if second["n"] is not None and second["n"] >= min_samples else first["m"]


def normalize_scale(tracks: DataFrame, obs: DataFrame, cams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scale the world to the monocular depths and centre it on the mean camera; unchanged with too few samples."""
    ratio = depth_scale(tracks, obs, cams)
    if ratio is None:
        return cams, tracks
    k = 1.0 / ratio
    src = _with_position(cams).withColumns({f"_p{a}": F.col(f"_p{a}") * k for a in "xyz"})
    c = src.agg(*[F.avg(f"_p{a}").alias(a) for a in "xyz"]).first()
    src = _moved(src.withColumns({f"_p{a}": F.col(f"_p{a}") - F.lit(c[a]) for a in "xyz"})).drop("_px", "_py", "_pz")
    scaled = lambda a: F.when(F.col("pruned"), F.col(a)).otherwise(F.col(a) * k) - F.lit(c[a])
    pts = tracks.withColumns({a: F.when(F.col("has_estimated_3d"), scaled(a)).otherwise(F.col(a)) for a in "xyz"})
    return src, pts


def track_points(tracks: DataFrame, obs: DataFrame, pixels: DataFrame, width: Column, height: Column) -> DataFrame:
    """Export cloud: good tracks coloured at their first observation, alpha 0.9. ``pixels`` is keyed by img_idx."""
    good = tracks.where(~F.col("pruned") & F.col("has_estimated_3d") & (F.col("weight") >= 0.01))
    first = obs.groupBy("track_id").agg(F.min_by(F.struct("img_idx", F.col("x").alias("u"), F.col("y").alias("v")), "img_idx").alias("o"))
    q = good.select("track_id").join(first, "track_id").select("track_id", "o.*")
    colors = sample_bilinear(q, pixels, ["track_id"], "img_idx", ["b", "g", "r"], width, height)
    return good.select("track_id", "x", "y", "z").join(colors, "track_id").withColumn("a", F.lit(0.9))


def farthest_first(cams: DataFrame, k: int, cut_every: int = 4) -> DataFrame:
    """k cameras: the nearest to the origin, then always the one farthest from those chosen; ties to the first index.

    Fails when all the rest coincide with chosen ones. Each round updates one running distance column.
    """
    px, py, pz = geom.position(geom.flat())
    left = cut_lineage(cams.select("cam_idx", px.alias("x"), py.alias("y"), pz.alias("z")))
    best = lambda key: F.max_by(F.struct("cam_idx", "x", "y", "z", "d"), F.struct(key.alias("k"), (-F.col("cam_idx")).alias("i"))).alias("b")
    left = left.withColumn("d", geom.norm(F.col("x"), F.col("y"), F.col("z")))
    picks = []
    for i in range(k):
        b = left.agg(best(-F.col("d") if i == 0 else F.col("d"))).first()["b"]
        if b is None or (i > 0 and b["d"] <= 0.0):
            raise ValueError("no camera left at a distance from those chosen")
        picks.append((i, b["cam_idx"]))
        gap = geom.norm(*[F.col(a) - F.lit(b[a]) for a in "xyz"])
        left = left.where(F.col("cam_idx") != b["cam_idx"]).withColumn("d", gap if i == 0 else F.least(F.col("d"), gap))
        if i % cut_every == cut_every - 1:
            left = cut_lineage(left)
    return cams.sparkSession.createDataFrame(picks, "position bigint, cam_idx bigint")
