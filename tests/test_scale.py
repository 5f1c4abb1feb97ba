"""What keeps the work of large tables in bounds: plans, tasks and rounds, with results against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scenetab.functions import session
from scenetab.functions.batches import whole_groups
from scenetab.operators import frames, graph, layers, points, splats, stencil
from scenetab.sources import files, paths, rasters


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n, window, interval", [(40, 3, 5), (41, 3, 5), (41, 7, 5), (23, 0, 5), (1, 2, 5), (30, 4, 3)])
def test_candidate_pairs_in_pieces(spark, monkeypatch, n, window, interval):
    monkeypatch.setattr(graph, "PIECE", 3)
    monkeypatch.setattr(graph, "PAIRS_PER_TASK", 20)
    images = spark.range(n).select(F.when(F.col("id") != 2, F.col("id")).alias("image_idx"))
    got = graph.candidate_pairs(images, window, interval)
    key = lambda i: i % interval == 0 or i == n - 1
    want = {(i, j) for i in range(n) if i != 2 for j in range(i + 1, n) if window == 0 or j - i <= window or key(i) and key(j)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    if len(want) > 20:
        assert got.rdd.getNumPartitions() == -(-len(want) // 20)


def test_candidate_pairs_tasks_have_few_partners(spark, monkeypatch):
    """A task's pieces are tiles, so its columns hold few values, which are written small; repeated images keep their rows."""
    monkeypatch.setattr(graph, "PIECE", 16)
    monkeypatch.setattr(graph, "PAIRS_PER_TASK", 1024)
    images = spark.range(400).union(spark.range(3)).withColumnRenamed("id", "image_idx")
    got = graph.candidate_pairs(images, 0).withColumn("task", F.spark_partition_id())
    rows = [tuple(r) for r in got.collect()]
    want = [(i, j) for i in [*range(400), 0, 1, 2] for j in range(i + 1, 400)]
    assert sorted(r[:2] for r in rows) == sorted(want)
    partners = {(r[2], r[1] // 16, r[0] // 16) for r in rows}
    assert len(partners) == len({p[1:] for p in partners})


def test_large_exploded_sides_are_not_broadcast(spark):
    """Spark takes the exploded cells of 4,000 cameras for a small table; they have 108,000 rows."""
    pts = spark.range(100).select(F.col("id").alias("point_id"), F.lit(0).cast("long").alias("scene_id"), *[(F.col("id") % 10).cast("double").alias(c) for c in "xyz"])
    eye = {c: F.lit(1.0 if c in ("r00", "r11", "r22") else 0.0) for c in [f"r{i}{j}" for i in range(3) for j in range(3)]}
    cams = spark.range(4000).select(F.lit(0).cast("long").alias("scene_id"), *[v.alias(c) for c, v in eye.items()], *[(-F.col("id") / 1000).alias(f"t{i}") for i in range(3)])
    left = points.drop_near_cameras(pts, cams, 0.25)
    assert "Broadcast" not in plan(left)
    assert {r.x for r in left.collect()} == {5.0, 6.0, 7.0, 8.0, 9.0}
    assert "Broadcast" in plan(pts.join(session.broadcast_if_small(cams.limit(5)), "scene_id"))


def test_spacing_broadcasts_no_points(spark):
    """Pairs and triples near each other are settled in the first round; no side of the joins goes through the driver."""
    rows = [(3 * i + k, i % 2, float(i), 0.001 * k, 0.0021 * k) for i in range(30) for k in range(3)]
    pts = spark.createDataFrame(rows, "point_id long, c long, x double, y double, z double")
    got = points.knn_spacing(pts, ["c"])
    assert "BroadcastExchange" not in plan(got)
    assert len(got.collect()) == 90
    out = splats.init_splats(pts.withColumns({c: F.lit(0.5) for c in "rgb"}), "c", 50, 1)
    assert out.where("alive").count() == 90
    spacing = plan(pts.join(got.hint("merge"), ["c", "point_id"]))
    assert "BroadcastExchange" not in spacing


def _cameras(spark, n, scenes, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a = rng.uniform(-3, 3)
        rot = [np.cos(a), 0, -np.sin(a), 0, 1, 0, np.sin(a), 0, np.cos(a)]
        rows.append((scenes[i % len(scenes)], i, 640, 480, 400.0, 410.0, 320.0, 240.0, *map(float, rot), *map(float, rng.uniform(-9, 9, 3))))
    names = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["t0", "t1", "t2"]
    schema = "scene_id long, cam_idx long, width int, height int, fx double, fy double, cx double, cy double, " + ", ".join(f"{c} double" for c in names)
    return spark.createDataFrame(rows, schema), rows


def test_visibility_in_rounds(spark, monkeypatch):
    for name, value in (("FIRST_CAMS", 64), ("MOST_CAMS", 128), ("GROUP", 25)):
        monkeypatch.setattr(points, name, value)
    cams, rows = _cameras(spark, 700, [0, 0, 0, 1, None])
    rng = np.random.default_rng(5)
    at = [(i, i % 3, *map(float, rng.uniform(-8, 8, 3))) for i in range(300)] + [(300, None, 0.0, 0.0, 1.0), (301, 0, None, 0.0, 1.0)]
    at += [(i, *at[i][1:]) for i in range(20)]
    src = spark.createDataFrame(at, "splat_idx long, scene_id long, x double, y double, z double").withColumn("frame_idx", F.lit(0))
    got = sorted((r.splat_idx, r.visible) for r in points.visible_to_any(src, cams, ["frame_idx", "splat_idx"]).collect())

    def seen(scene, x, y, z):
        wide = False
        for s, _, w, h, fx, fy, cx, cy, *m in rows:
            if s is None or s != scene or None in (x, y, z):
                continue
            xc, yc, zc = (m[3 * i] * x + m[3 * i + 1] * y + m[3 * i + 2] * z + m[9 + i] for i in range(3))
            if 0 < zc < 0.01:
                return False
            if zc > 0.01:
                u, v = xc / zc * fx + cx, -yc / zc * fy + cy
                wide |= -w <= u < 2 * w and -h <= v < 2 * h
        return wide

    assert got == sorted((i, seen(*p)) for i, *p in at)
    assert {v for _, v in got} == {True, False}


def test_mixed_names_make_few_segments(spark, tmp_path, monkeypatch):
    """Rows of ten files in turn: a task writes a segment for each file, not one for each row."""
    made, cut = [], files.cut_lineage
    monkeypatch.setattr(files, "cut_lineage", lambda df: made.append(cut(df)) or made[-1])
    rows = spark.range(5000, numPartitions=3).select(F.concat(F.lit("f"), F.col("id") % 10).alias("f"), F.col("id").cast("string").alias("value"))
    assert files.write_files(rows, f"{tmp_path}/out", "f", files.lines_of(), lambda n: f"{n}\n".encode()) == 10
    assert made[0].count() == 30 and made[0].select("segment").distinct().count() == 3
    for k in range(10):
        assert (tmp_path / f"out/f{k}").read_text() == "500\n" + "".join(f"{i}\n" for i in range(k, 5000, 10))
    monkeypatch.setattr(files, "HELD", 1000)
    files.write_files(rows, f"{tmp_path}/again", "f", files.lines_of())
    assert (tmp_path / "again/f7").read_text() == "".join(f"{i}\n" for i in range(7, 5000, 10))


def test_many_small_files_share_tasks(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"{i}.pgm").write_bytes(b"P5\n3 2\n255\n" + bytes([i % 256] * 6))
    px = rasters.read_samples(spark, str(tmp_path), 8)
    assert px.rdd.getNumPartitions() <= paths.TASKS
    assert px.count() == 3600 and px.agg(F.sum("r")).first()[0] == 6 * sum(i % 256 for i in range(600))
    big = [("f", at, at + paths.SHARED) for at in range(0, 2000 * paths.SHARED, paths.SHARED)]
    assert [len(r) for r in paths.shared(big, lambda r: r[2] - r[1])] == [1] * 2000 and paths.shared([], len) == []


def _pixels(spark, n):
    return spark.range(n * 400).select(
        F.floor(F.col("id") / 400).alias("frame_idx"), F.floor(F.col("id") % 400 / 20).alias("y"), (F.col("id") % 20).alias("x"),
        *[F.rand(k).alias(c) for k, c in enumerate(("b", "g", "r", "invd", "s_top", "s_mid", "s_bot"))],
    )


def test_tasks_of_windows_grow_with_the_rows(spark, monkeypatch):
    """The tasks of a chain of windows hold a bounded number of rows, and the rows are those of one task."""
    px = session.cut_lineage(_pixels(spark, 30))
    for what in (
        lambda: frames.layer_alphas(px, (20, 20), 2, tile=16, spread=3), lambda: frames.depth_edges(px, (20, 20), 10.0, 9.0, 9.0, k=2, tile=16),
        lambda: frames.three_layer_scores(px, (20, 20), (3,), 10, tile=16), lambda: frames.stabilize_depth(px, (20, 20), 3, 2, 3, 8, 16),
    ):
        monkeypatch.setattr(stencil, "ROWS_PER_TASK", 1 << 30)
        want = sorted(map(tuple, what().collect()))
        monkeypatch.setattr(stencil, "ROWS_PER_TASK", 1000)
        df = what()
        assert "REPARTITION_BY_NUM" in plan(df)
        assert np.allclose(want, sorted(map(tuple, df.collect())), rtol=0, atol=1e-12)
    alphas = frames.layer_alphas(px, (20, 20), 2, tile=16, spread=3)
    assert alphas.rdd.getNumPartitions() == -(-30 * 44 * 44 // 1000)
    assert stencil.copies(6, (20, 20), 16) == pytest.approx(44 * 44 / 400)


def test_groups_stay_whole_between_batches():
    rows = pd.DataFrame({"a": [1.0] * 3 + [2.0] * 5 + [np.nan] * 4, "b": [0] * 6 + [1] * 6, "v": range(12)})
    for cut in (1, 2, 3, 5, 12):
        found = [list(part.v[group == g]) for part, group in whole_groups(iter([rows[i : i + cut] for i in range(0, 12, cut)]), ["a", "b"]) for g in np.unique(group)]
        assert found == [[0, 1, 2], [3, 4, 5], [6, 7], [8, 9, 10, 11]]
    assert list(whole_groups(iter([rows[:0]]), ["a"])) == []


def test_fill_of_many_frames_in_one_call(spark):
    """Frames of several sizes, each with a hole, are filled alike whether they come alone or together."""
    rng = np.random.default_rng(2)
    rows = [(f, y, x, float(rng.random()), 0 < y < 3 + f % 3 and 0 < x < 4) for f in range(12) for y in range(5 + f % 3) for x in range(6)]
    df = spark.createDataFrame(rows, "frame_idx long, y long, x long, invd double, m boolean").repartition(1)
    fill = lambda d: {(r.frame_idx, r.y, r.x): r.invd for r in layers.relax_grid(d, "invd", mask="m", tol=1e-6, tile=4).collect()}
    got = fill(df)
    assert len(got) == len(rows)
    assert "FlatMapGroupsInPandas" not in plan(layers._corrected(layers._fill_system(df.select("frame_idx", "y", "x", F.col("invd").alias("_v"), F.col("m").alias("_free"), F.lit(0.0).alias("_w"), F.lit(None).cast("double").alias("_b")), ["frame_idx"], 1.0, 2.0, 4), ["frame_idx"], 1, 4, 4))
    for f in (4, 11):
        assert all(abs(v - got[k]) < 1e-5 for k, v in fill(df.where(F.col("frame_idx") == f)).items())


def test_splatted_flow_is_shuffled_by_source(spark, monkeypatch):
    """Tiles of four pixels give what one tile gives, and rows for single pixels are made behind the shuffle."""
    rng = np.random.default_rng(6)
    rows = [(f, y, x, float(a), float(b)) for f in range(2) for y in range(11) for x in range(13) for a, b in [rng.normal(size=2) * 6]] + [(2, 0, 0, None, 1.0)]
    df = spark.createDataFrame(rows, "frame_idx long, y long, x long, fx double, fy double")
    want = sorted(map(tuple, layers.flow_splat(df, (11, 13), 0.5, 2).collect()))
    monkeypatch.setattr(layers, "SPLAT_TILE", 4)
    out = layers.flow_splat(df, (11, 13), 0.5, 2)
    assert sorted(map(tuple, out.collect())) == want
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Sort [frame_idx") < text.index("Generate explode") < text.index("RepartitionByExpression")


def test_tiles_are_composited_by_chunks(spark, monkeypatch):
    """One tile of many splats in chunks of seven against a loop; a missing colour adds nothing."""
    rng = np.random.default_rng(7)
    rows = [(0, 3, 0, 1, k, *map(float, rng.uniform(3, 9, 2)), 5.0, 0.5, 4.0, 5, 7, float(rng.uniform(0.1, 1.0)), float(k), None if k % 4 == 0 else float(rng.random()), float(rng.random()), None) for k in range(30)]
    names = "frame_idx long, cam_idx long, ty long, tx long, draw_order long, u double, v double, cov00 double, cov01 double, cov11 double, height int, width int, opacity double, depth double, col0 double, col1 double, col2 double"
    chunk = splats.with_chunk
    monkeypatch.setattr(splats, "with_chunk", lambda df, order: chunk(df, order, 7))
    df = spark.createDataFrame(rows, names)
    out = splats.composite_tiles(df, 4)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in text
    got = {(r.y, r.x): r for r in out.collect()}
    want = {}
    for y in range(4):
        for x in range(4, 7):
            t, sums, n = 1.0, np.zeros(4), 0
            for r in rows:
                u, v, a, b, c = r[5:10]
                dx, dy, det = x + 0.5 - u, y + 0.5 - v, a * c - b * b
                al = min(splats.ALPHA_MAX, r[12] * np.exp(-0.5 * (c * dx * dx - 2 * b * dx * dy + a * dy * dy) / det))
                if al >= splats.ALPHA_MIN:
                    sums += al * t * np.array([r[14] or 0.0, r[15], r[13], 1.0])
                    t, n = t * (1 - al), n + 1
            if n:
                want[y, x] = sums
    assert got.keys() == want.keys() and len(want) > 5
    for k, r in got.items():
        assert np.allclose((r.col0, r.col1, r.depth, r.coverage), want[k], atol=1e-9) and r.col2 is None
