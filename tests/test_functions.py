"""Lens models, activations, ranks and scans against direct computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenetab.functions import geom
from scenetab.functions.ranks import exact_rank, fraction_index, pick_at, take_smallest
from scenetab.functions.scan import carry, carry_both, running
from scenetab.functions.skew import join_counted
from scenetab.operators.rays import importance_depths, ray_weights
from scenetab.operators.series import moving_average
from scenetab.streaming.smoothing import averages

FISH = {"cam_model": "equiangular", "width": 301, "height": 101, "radius_at_90": 50.0, "cx": 150.0, "cy": 50.0, "k1": 0.05, "tilt": -0.01, "fx": 1.0, "fy": 1.0}


def lits(spec):
    return lambda name: F.lit(spec[name])


def test_fisheye_axes(spark):
    cam = lits({**FISH, "k1": 0.0, "tilt": 0.0})
    pts = spark.createDataFrame([(0.0, 0.0, 1.0, 150, 50), (1.0, 0.0, 0.0, 200, 50), (0.0, 1.0, 0.0, 150, 0), (-1.0, 0.0, 0.0, 100, 50)], "x double, y double, z double, eu int, ev int")
    u, v = geom.project(cam, F.col("x"), F.col("y"), F.col("z"))
    for r in pts.select("*", u.alias("u"), v.alias("v")).collect():
        assert abs(r.u - r.eu) < 0.01 and abs(r.v - r.ev) < 0.01


@pytest.mark.parametrize("staged", [False, True])
def test_unproject_then_project_is_identity(spark, staged):
    px = spark.createDataFrame([(162.0, 35.0), (150.0, 50.0), (200.0, 50.0), (150.0, 0.0)], "u double, v double")
    cam = lits(FISH)
    if staged:
        out = geom.with_ray(px, cam, F.col("u"), F.col("v"), ("a", "b", "c"))
        out = geom.with_pixel(out, cam, ("a", "b", "c"), ("u2", "v2"))
    else:
        x, y, z = geom.ray(cam, F.col("u"), F.col("v"))
        u, v = geom.project(cam, x, y, z)
        out = px.select("u", "v", u.alias("u2"), v.alias("v2"))
    for r in out.collect():
        assert abs(r.u - r.u2) < 0.01 and abs(r.v - r.v2) < 0.01


def test_contraction_round_trip(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (10.0, 20.0, 30.0), (100.0, 2000.0, 30000.0)], "x double, y double, z double")
    c = df.select("*", *[e.alias(n) for e, n in zip(geom.contract(F.col("x"), F.col("y"), F.col("z")), "abc")])
    e = c.select("x", "y", "z", *[v.alias(n) for v, n in zip(geom.expand(F.col("a"), F.col("b"), F.col("c")), "pqr")])
    for r in e.collect():
        for a, b in ((r.x, r.p), (r.y, r.q), (r.z, r.r)):
            assert math.isclose(a, b, rel_tol=1e-6)


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group, a third of them with one value."""
    rng = random.Random(5)
    rows = [(i, 0 if i % 3 else 1 + i % 4, 7.0 if i % 3 == 1 else round(rng.random() * 50, 1)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id bigint, g bigint, v double").repartition(5)


@pytest.mark.parametrize("descending", [False, True])
def test_exact_rank(skewed, descending):
    rows, df = skewed
    got = {r.id: r["rank"] for r in exact_rank(df, ["g"], "v", "id", descending=descending).collect()}
    for g in {r[1] for r in rows}:
        want = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2] if descending else r[2], r[0]))
        assert [got[r[0]] for r in want] == list(range(len(want)))


def test_pick_at_and_take_smallest(skewed):
    rows, df = skewed
    got = {r.g: r for r in pick_at(df, ["g"], "v", {"a": F.lit(0), "p": fraction_index(0.7)}).collect()}
    for g in {r[1] for r in rows}:
        vs = sorted(r[2] for r in rows if r[1] == g)
        assert got[g].n == len(vs) and got[g].a == vs[0] and got[g].p == vs[min(len(vs) - 1, int(0.7 * len(vs)))]
    for n in (0, 1, 700, 2500, 3000, 9000):
        want = sorted(rows, key=lambda r: (r[2], r[0]))[:n]
        assert {r.id for r in take_smallest(df, "v", "id", n).collect()} == {r[0] for r in want}


def test_scans_do_not_depend_on_the_chunk(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.random() if rng.random() < 0.4 else None) for k in range(2) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, i bigint, v double").repartition(4)
    for chunk in (7, 1000):
        got = {(r.k, r.i): r for r in carry(carry(df, ["k"], "i", F.col("v"), "p", chunk=chunk), ["k"], "i", F.col("v"), "n", forward=False, inclusive=False, chunk=chunk).collect()}
        both = {(r.k, r.i): r for r in carry_both(df, ["k"], "i", F.col("v"), "p", "n", chunk=chunk).collect()}
        assert all((both[at].p, both[at].n) == (got[at].p, got[at].n) for at in got)
        run = {(r.k, r.i): r.s for r in running(df, ["k"], "i", F.coalesce("v", F.lit(0.0)), "s", chunk=chunk).collect()}
        for k in range(2):
            last, total = None, 0.0
            for i in range(200):
                v = rows[k * 200 + i][2]
                last = v if v is not None else last
                after = next((rows[k * 200 + j][2] for j in range(i + 1, 200) if rows[k * 200 + j][2] is not None), None)
                assert got[k, i].p == last and got[k, i].n == after
                assert math.isclose(run[k, i], total, abs_tol=1e-9)
                total += v or 0.0


def test_weights_and_what_remains_sum_to_one(spark):
    rows = [(r, i, 0.2 + 0.3 * i, 0.5 * (i % 3)) for r in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "ray_id bigint, sample_idx bigint, depth double, sigma double")
    w = ray_weights(df, ["ray_id"], chunk=8)
    for r in w.groupBy("ray_id").agg(F.sum("weight").alias("w"), F.product(1.0 - F.col("alpha")).alias("t")).collect():
        assert math.isclose(r.w + r.t, 1.0, abs_tol=1e-6)


def test_importance_of_two_hand_made_rays(spark):
    """All-zero densities spread the draws; density at two samples gathers them there."""
    rows = [(0, i, float(i), 0.0) for i in range(11)] + [(1, i, float(i), 0.1 if i in (2, 7) else 0.0) for i in range(11)]
    df = spark.createDataFrame(rows, "ray_id bigint, sample_idx bigint, depth double, sigma double")
    got = {}
    for r in importance_depths(df, "ray_id", 200, 3, chunk=4).orderBy("ray_id", "sample_idx").collect():
        got.setdefault(r.ray_id, []).append(r.depth)
    assert all(len(v) == 200 and v == sorted(v) for v in got.values())
    near = [d for d in got[1] if 1.5 <= d <= 2.5 or 6.5 <= d <= 7.5]
    assert len(near) > 190
    assert len([d for d in got[0] if 1.5 <= d <= 2.5]) < 60


def test_moving_average_over_chunks(spark):
    rng = random.Random(2)
    vals = [rng.random() for _ in range(3000)]
    df = spark.createDataFrame([("a", i * 3, v) for i, v in enumerate(vals)], "run string, step bigint, loss double")
    got = {r.step: r.smooth for r in moving_average(df, "run", "step", "loss", 0.9, chunk=500).collect()}
    x = vals[0]
    for i, v in enumerate(vals):
        x = v if i == 0 else 0.9 * x + 0.1 * v
        assert math.isclose(got[i * 3], x, rel_tol=1e-11)


@pytest.mark.parametrize("keep,chunk", [(1e-6, 4096), (0.3, 64), (0.5, 4096), (0.99, 16), (0.9999, 16), (1 - 1e-9, 8)])
def test_segments_compose_for_any_weight(spark, keep, chunk):
    """One chunk length serves short and long memories; a second series goes on from a start value."""
    rng = random.Random(2)
    vals = [rng.random() for _ in range(1500)]
    rows = [("a", i * 3, v) for i, v in enumerate(vals)] + [("b", i, v) for i, v in enumerate(vals[:40])]
    df = spark.createDataFrame(rows, "run string, step bigint, loss double")
    start = spark.createDataFrame([("b", 7.0), ("c", 1.0)], "run string, smooth double")
    got = {(r.run, r.step): r.smooth for r in moving_average(df, "run", "step", "loss", keep, chunk=chunk, start=start).collect()}
    x, y = vals[0], 7.0
    for i, v in enumerate(vals):
        x = v if i == 0 else keep * x + (1.0 - keep) * v
        assert math.isclose(got["a", i * 3], x, rel_tol=1e-11)
        if i < 40:
            y = keep * y + (1.0 - keep) * v
            assert math.isclose(got["b", i], y, rel_tol=1e-11)


def test_smoothing_on_arrays_is_the_loop():
    rng = random.Random(5)
    values = [rng.random() for _ in range(2000)]
    for keep in (0.0, 0.3, 0.5, 0.9, 0.99):
        x, loop = values[0], [values[0]]
        for v in values[1:]:
            x = keep * x + (1.0 - keep) * v
            loop.append(x)
        got = averages(np.array(values), keep)
        assert np.allclose(got, loop, rtol=1e-12)
        # a batch goes on from the last value of the one before
        assert np.allclose(averages(np.array([got[999], *values[1000:]]), keep)[1:], loop[1000:], rtol=1e-12)
    assert np.isnan(averages(np.array([1.0, np.nan, 2.0]), 0.5)).tolist() == [False, True, True]


def test_hot_key_stays_spread_in_a_counted_join(spark):
    rows = spark.range(8000).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).alias("k"), "id").repartition(8, "id")
    sums = rows.groupBy("k").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    got = join_counted(rows, sums, "k", "n", 8000)
    assert sorted(map(tuple, got.collect())) == sorted((r.k, r.id, 7999 if r.k == 0 else r.k) for r in rows.collect())
    largest = max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert largest < 2000


def test_ties_are_cut_by_rank(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 10, 0.0).otherwise(1.0).alias("v"))
    for n in (0, 5, 10, 11, 3000, 5000, 6000):
        assert sorted(r.id for r in take_smallest(df, "v", "id", n).collect()) == list(range(min(n, 5000)))
