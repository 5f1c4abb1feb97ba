"""Queries over keypoints, matches and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenetab.operators import graph as G
from scenetab.plans import sqltext as S
from scenetab.plans.registry import query, rnd, rounded

IMG = 25


@query("keypoints_in_useable_radius", "keypoints cams", """SELECT k.image_idx, k.kp_idx FROM keypoints k JOIN cams c ON c.cam_idx = k.image_idx
WHERE c.cam_model = 'rectilinear' OR sqrt((k.x - cx)**2 + (k.y - cy)**2) <= useable_radius * 0.8""")
def _(t):
    cams = t.cams.withColumn("useable_radius", F.col("useable_radius") * 0.8)
    return G.keypoints_in_useable_radius(t.keypoints, cams).select("image_idx", "kp_idx")


# one keypoint of each image per round, compared with those kept so far
@query("thin_keypoints", "keypoints", """WITH RECURSIVE k AS (SELECT image_idx, kp_idx, x, y, row_number() OVER (PARTITION BY image_idx ORDER BY kp_idx) AS n FROM keypoints),
f(image_idx, n, kept) USING KEY (image_idx) AS (
SELECT image_idx, CAST(0 AS BIGINT), CAST([] AS STRUCT(k BIGINT, x DOUBLE, y DOUBLE)[]) FROM (SELECT DISTINCT image_idx FROM k) i
UNION SELECT f.image_idx, k.n, CASE WHEN len(list_filter(f.kept, lambda e: sqrt((e.x - k.x)**2 + (e.y - k.y)**2) < 8)) > 0 THEN f.kept
ELSE list_append(f.kept, {'k': k.kp_idx, 'x': k.x, 'y': k.y}) END FROM f JOIN k ON k.image_idx = f.image_idx AND k.n = f.n + 1)
SELECT image_idx, e.k AS kp_idx FROM (SELECT image_idx, unnest(kept) AS e FROM f) q""")
def _(t):
    return G.thin_keypoints(t.keypoints, 8.0).select("image_idx", "kp_idx")


@query("candidate_pairs", "", """WITH i AS (SELECT c_custkey AS a FROM customer), n AS (SELECT max(a) AS m FROM i)
SELECT p.a AS image_idx1, q.a AS image_idx2 FROM i p JOIN i q ON p.a < q.a, n WHERE q.a - p.a <= 10
OR ((p.a % 5 = 0 OR p.a = m) AND (q.a % 5 = 0 OR q.a = m))""")
def _(t):
    return G.candidate_pairs(t.customer.select(F.col("c_custkey").alias("image_idx")), 10)


@query("match_descriptors", "descriptors", f"""WITH d AS (SELECT a.image_idx AS i1, b.image_idx AS i2, a.kp_idx AS k1, b.kp_idx AS k2,
sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i])**2))) AS d FROM descriptors a JOIN descriptors b ON b.image_idx > a.image_idx AND (b.image_idx - a.image_idx <= 3 OR ((a.image_idx % 5 = 0 OR a.image_idx = (SELECT max(image_idx) FROM descriptors)) AND (b.image_idx % 5 = 0 OR b.image_idx = (SELECT max(image_idx) FROM descriptors))))),
f AS (SELECT *, row_number() OVER (PARTITION BY i1, i2, k1 ORDER BY d, k2) AS rn, lead(d) OVER (PARTITION BY i1, i2, k1 ORDER BY d, k2) AS nx FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY i1, i2, k2 ORDER BY d, k1) AS rn, lead(d) OVER (PARTITION BY i1, i2, k2 ORDER BY d, k1) AS nx FROM d)
SELECT CAST(f.i1 AS BIGINT) AS image_idx1, CAST(f.i2 AS BIGINT) AS image_idx2, f.k1 AS keypoint_idx1, f.k2 AS keypoint_idx2, {rnd('distance=f.d')} FROM f JOIN g ON g.i1 = f.i1 AND g.i2 = f.i2 AND g.k1 = f.k1 AND g.k2 = f.k2
WHERE f.rn = 1 AND g.rn = 1 AND f.d < 0.95 * f.nx AND g.d < 0.95 * g.nx""")
def _(t):
    images = t.descriptors.select("image_idx").distinct()
    pairs = G.candidate_pairs(images, 3)
    return rounded(G.match_descriptors(t.descriptors, pairs, 0.95))


@query("flow_consistent", "matches keypoints pixels", """WITH m AS (SELECT m.*, a.x / 32 AS x1, a.y / 24 AS y1, b.x / 32 AS x2, b.y / 24 AS y2 FROM matches m
JOIN keypoints a ON a.kp_idx = m.keypoint_idx1 JOIN keypoints b ON b.kp_idx = m.keypoint_idx2)
SELECT m.keypoint_idx1, m.keypoint_idx2 FROM m JOIN pixels p ON p.frame_idx = m.keypoint_idx1 // 400 AND p.y = floor(y1) AND p.x = floor(x1)
WHERE sqrt((x1 + 20 * p.b - 10 - x2)**2 + (y1 + 20 * p.g - 10 - y2)**2) < 6""")
def _(t):
    k = t.keypoints
    one = k.select(F.col("kp_idx").alias("keypoint_idx1"), (F.col("x") / 32).alias("x1"), (F.col("y") / 24).alias("y1"))
    two = k.select(F.col("kp_idx").alias("keypoint_idx2"), (F.col("x") / 32).alias("x2"), (F.col("y") / 24).alias("y2"))
    # a keypoint's frame is that of the pixel with its id
    m = t.matches.withColumn("image_idx1", F.floor(F.col("keypoint_idx1") / 400)).join(one, "keypoint_idx1").join(two, "keypoint_idx2")
    flow = t.pixels.select(
        F.col("frame_idx").alias("image_idx1"), "y", "x", (20 * F.col("b") - 10).alias("fu"), (20 * F.col("g") - 10).alias("fv")
    )
    return G.flow_consistent(m, flow, 6.0, ["image_idx1"]).select("keypoint_idx1", "keypoint_idx2")


def _images(t):
    return t.events.select((F.col("event_id") % 40).alias("image_idx")).distinct()


@query("matches_per_image", "matches", """WITH i AS (SELECT DISTINCT event_id % 40 AS image_idx FROM events),
e AS (SELECT image_idx1 AS image_idx FROM matches UNION ALL SELECT image_idx2 FROM matches)
SELECT i.image_idx, count(e.image_idx) AS n_matches FROM i LEFT JOIN e USING (image_idx) GROUP BY i.image_idx""")
def _(t):
    return G.matches_per_image(t.matches, _images(t))


@query("order_by_connectivity", "matches", """WITH RECURSIVE i AS (SELECT DISTINCT event_id % 25 AS img FROM events),
e AS (SELECT image_idx1 AS a, image_idx2 AS img FROM matches UNION ALL SELECT image_idx2, image_idx1 FROM matches),
w AS (SELECT a, img, count(*) AS w FROM e GROUP BY ALL),
f(n, chosen) AS (SELECT CAST(1 AS BIGINT), [img] FROM (SELECT i.img, count(e.a) AS s FROM i LEFT JOIN e USING (img) GROUP BY i.img ORDER BY s DESC, i.img LIMIT 1) q
UNION ALL SELECT n + 1, list_append(chosen, img) FROM (SELECT f.n, f.chosen, i.img, coalesce(sum(CASE WHEN list_contains(f.chosen, w.a) THEN w.w END), 0) AS s
FROM f JOIN i ON NOT list_contains(f.chosen, i.img) LEFT JOIN w ON w.img = i.img GROUP BY ALL) q QUALIFY row_number() OVER (ORDER BY s DESC, img) = 1)
SELECT unnest(range(n)) AS position, unnest(chosen) AS image_idx FROM (SELECT * FROM f ORDER BY n DESC LIMIT 1) q""")
def _(t):
    return G.order_by_connectivity(t.matches, t.events.select((F.col("event_id") % 25).alias("image_idx")).distinct())


# a video is the matches of two thousand events in turn
@query("order_videos", "matches", """WITH RECURSIVE i AS (SELECT DISTINCT event_id // 2000 AS v, event_id % 25 AS img FROM events),
m AS (SELECT keypoint_idx1 // 2000 AS v, image_idx1, image_idx2 FROM matches),
e AS (SELECT v, image_idx1 AS a, image_idx2 AS img FROM m UNION ALL SELECT v, image_idx2, image_idx1 FROM m),
w AS (SELECT v, a, img, count(*) AS w FROM e GROUP BY ALL),
f(v, n, chosen) AS (SELECT v, CAST(1 AS BIGINT), [img] FROM (SELECT i.v, i.img, count(e.a) AS s FROM i LEFT JOIN e USING (v, img) GROUP BY ALL) q QUALIFY row_number() OVER (PARTITION BY v ORDER BY s DESC, img) = 1
UNION ALL SELECT v, n + 1, list_append(chosen, img) FROM (SELECT f.v, f.n, f.chosen, i.img, coalesce(sum(CASE WHEN list_contains(f.chosen, w.a) THEN w.w END), 0) AS s
FROM f JOIN i ON i.v = f.v AND NOT list_contains(f.chosen, i.img) LEFT JOIN w ON w.v = i.v AND w.img = i.img GROUP BY ALL) q QUALIFY row_number() OVER (PARTITION BY v ORDER BY s DESC, img) = 1)
SELECT v AS video, unnest(range(n)) AS position, unnest(chosen) AS image_idx FROM f QUALIFY n = max(n) OVER (PARTITION BY v)""")
def _(t):
    video = lambda c: F.floor(F.col(c) / 2000).alias("video")
    images = t.events.select(video("event_id"), (F.col("event_id") % 25).alias("image_idx")).distinct()
    return G.order_videos(t.matches.select(video("keypoint_idx1"), "image_idx1", "image_idx2"), images)


@query("build_tracks", "", """WITH n AS (SELECT event_id, (event_id % 25) * 4294967296 + event_id AS node, user_id, event_type FROM events)
SELECT min(node) OVER (PARTITION BY user_id, event_type) AS track_id, event_id % 25 AS image_idx, event_id AS kp_idx FROM n
QUALIFY count(*) OVER (PARTITION BY user_id, event_type) >= 2""")
def _(t):
    return G.build_tracks(t.keypoints, t.matches, IMG).select("track_id", "image_idx", "kp_idx")


@query("eligible_tracks", "tracks obs", """WITH c AS (SELECT track_id, count(*) FILTER (WHERE img_idx < 20) AS na, count(*) FILTER (WHERE img_idx < 20 AND img_idx BETWEEN 5 AND 12) AS nu
FROM obs GROUP BY ALL) SELECT t.track_id, coalesce(na, 0) AS n_active, coalesce(nu, 0) AS n_unlocked, coalesce(na, 0) < 2 OR coalesce(nu, 0) < 1 AS skipped_low_obs
FROM tracks t LEFT JOIN c USING (track_id) WHERE NOT pruned AND has_estimated_3d""")
def _(t):
    return G.eligible_tracks(t.tracks, t.obs, 20, 5, 12, True).select("track_id", "n_active", "n_unlocked", "skipped_low_obs")


@query("long_tracks", "obs", "SELECT track_id, count(*) AS length FROM obs GROUP BY track_id HAVING count(*) BETWEEN 6 AND 10000")
def _(t):
    return G.long_tracks(t.obs, 6)


_RES = f"""src AS (SELECT o.track_id, o.img_idx, o.x AS ox, o.y AS oy, o.mono, t.weight, t.x, t.y, t.z FROM obs o JOIN tracks t USING (track_id)),
{S.project('src', 'cams', 'p.track_id, p.img_idx, p.ox, p.oy, p.mono, p.weight, c.r20*p.x + c.r21*p.y + c.r22*p.z + c.t2 AS z', 'c.cam_idx = p.img_idx').replace('c.r20*p.x + c.r21*p.y + c.r22*p.z + c.t2 AS zc', 'greatest(c.r20*p.x + c.r21*p.y + c.r22*p.z + c.t2, 0.1) AS zc')},
res AS (SELECT track_id, img_idx, weight, z, weight * (u - ox) AS dx, weight * (v - oy) AS dy, weight * (z - mono) AS dz FROM pj)"""


@query("reprojection_residuals", "obs tracks cams", f"WITH {_RES} SELECT track_id, img_idx, {rnd('dx; dy; dz', 4)} FROM res")
def _(t):
    return rounded(G.reprojection_residuals(t.tracks, t.obs, t.cams).select("track_id", "img_idx", "dx", "dy", "dz"), 4)


@query("focal_prior", "views", f"SELECT cam_idx, {rnd('focal_residual=(fx - 420) / 42')} FROM views")
def _(t):
    return rounded(G.focal_prior(t.views, 420.0))


_SCORE = f"{_RES}, sc AS (SELECT track_id, avg(dx*dx + dy*dy) AS ms, bool_or(z < 0) AS behind, sqrt(avg(dx*dx + dy*dy) + 1e-7) AS err FROM res GROUP BY track_id)"


def _scores(t):
    return G.score_tracks(G.reprojection_residuals(t.tracks, t.obs, t.cams))


@query("score_tracks", "obs tracks cams", f"WITH {_SCORE} SELECT track_id, {rnd('mean_square=ms; err', 3)}, behind FROM sc")
def _(t):
    return rounded(_scores(t), 3)


@query("global_rmse", "obs tracks cams", f"WITH {_RES} SELECT {rnd('rmse=sqrt(avg(dx*dx + dy*dy))', 4)}, count(*) AS n_obs FROM res")
def _(t):
    return rounded(G.global_rmse(G.reprojection_residuals(t.tracks, t.obs, t.cams)), 4)


@query("reweight_tracks", "obs tracks cams", f"""WITH {_SCORE}, o AS (SELECT err, row_number() OVER (ORDER BY err) - 1 AS rn, count(*) OVER () AS n FROM sc),
th AS (SELECT greatest(5, max(err)) AS thr FROM o WHERE rn = least(n - 1, floor(0.4 * n)))
SELECT track_id, {rnd('err; weight=CASE WHEN behind THEN 0 ELSE (tanh(2 * (thr - err)) + 1) / 2 END', 4)}, behind AS pruned FROM sc, th""")
def _(t):
    return rounded(G.reweight_tracks(_scores(t), 0.4), 4)


@query("percentile_at", "obs", f"""WITH o AS (SELECT img_idx, x, row_number() OVER (PARTITION BY img_idx ORDER BY x) - 1 AS rn, count(*) OVER (PARTITION BY img_idx) AS n FROM obs)
SELECT img_idx, {rnd('value=x')} FROM o WHERE rn = least(n - 1, floor(0.7 * n))""")
def _(t):
    return rounded(G.percentile_at(t.obs, ["img_idx"], "x", 0.7))


@query("median_mid", "obs", f"SELECT img_idx, {rnd('value=median(y)')} FROM obs GROUP BY img_idx")
def _(t):
    return rounded(G.median_mid(t.obs, ["img_idx"], "y"))


_POS = "p AS (SELECT *, -(r00*t0 + r10*t1 + r20*t2) AS px, -(r01*t0 + r11*t1 + r21*t2) AS py, -(r02*t0 + r12*t1 + r22*t2) AS pz FROM views)"
_NR = f"""{_POS}, c AS (SELECT avg(px) AS mx, avg(py) AS my, avg(pz) AS mz, count(*) AS n FROM p WHERE cam_idx < {{n}}),
s AS (SELECT 2 * sum(sqrt((px-mx)**2 + (py-my)**2 + (pz-mz)**2)) / any_value(n) AS k FROM p, c)"""


@query("normalize_radius_cams", "views", f"""WITH {_NR.format(n=1000000000)} SELECT cam_idx, {rnd('t0=-(r00*(px-mx) + r01*(py-my) + r02*(pz-mz)) / k; t1=-(r10*(px-mx) + r11*(py-my) + r12*(pz-mz)) / k; t2=-(r20*(px-mx) + r21*(py-my) + r22*(pz-mz)) / k')} FROM p, c, s""")
def _(t):
    return rounded(G.normalize_radius(t.views, t.points)[0].select("cam_idx", "t0", "t1", "t2"))


@query("normalize_radius_points", "views points", f"""WITH {_NR.format(n=100)}, q AS (SELECT point_id, (x-mx)/k AS x, (y-my)/k AS y, (z-mz)/k AS z FROM points, c, s)
SELECT point_id, {rnd('x; y; z')} FROM q""")
def _(t):
    return rounded(G.normalize_radius(t.views, t.points, 100)[1].select("point_id", "x", "y", "z"))


_NS = f"""{_RES}, ra AS (SELECT res.z / o.mono AS q FROM res JOIN (SELECT track_id FROM tracks WHERE NOT pruned AND has_estimated_3d) g USING (track_id) JOIN obs o ON o.track_id = res.track_id AND o.img_idx = res.img_idx WHERE res.z >= 0.01 AND o.mono > 0.01),
o1 AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS rn, count(*) OVER () AS n FROM ra), m1 AS (SELECT q AS m FROM o1 WHERE rn = n // 2),
o2 AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS rn, count(*) OVER () AS n FROM ra, m1 WHERE q > m / 5 AND q < m * 5),
k AS (SELECT 1 / q AS k FROM o2 WHERE rn = n // 2), cp AS (SELECT avg(-(r00*t0 + r10*t1 + r20*t2)) AS mx, avg(-(r01*t0 + r11*t1 + r21*t2)) AS my, avg(-(r02*t0 + r12*t1 + r22*t2)) AS mz FROM cams)"""


@query("normalize_scale", "obs tracks cams", f"""WITH {_NS} SELECT track_id, {rnd('x=CASE WHEN has_estimated_3d THEN CASE WHEN pruned THEN x ELSE x * k END - mx * k ELSE x END; z=CASE WHEN has_estimated_3d THEN CASE WHEN pruned THEN z ELSE z * k END - mz * k ELSE z END', 9)} FROM tracks, k, cp""")
def _(t):
    return rounded(G.normalize_scale(t.tracks, t.obs, t.cams)[1].select("track_id", "x", "z"), 9)


# tracks are dealt to all groups of 25 frames
@query("track_points", "tracks obs pixels", f"""WITH g25 AS (SELECT greatest((max(frame_idx) + 1) // 25, 1) AS n FROM pixels), far AS (SELECT o.* REPLACE (img_idx + 25 * (track_id % n) AS img_idx) FROM obs o, g25),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY img_idx) AS rn FROM far) q WHERE rn = 1),
q AS (SELECT track_id, img_idx AS frame_idx, f.x / 32 AS u, f.y / 24 AS v FROM f JOIN (SELECT track_id FROM tracks WHERE NOT pruned AND has_estimated_3d AND weight >= 0.01) g USING (track_id)),
{S.bilinear('q', 'track_id', 'frame_idx', 'pixels', ['b', 'g', 'r'], '20', '20')}
SELECT track_id, {rnd('x; y; z; b; g; r; a=0.9', 9)} FROM (SELECT track_id, x, y, z FROM tracks) t JOIN bl USING (track_id)""")
def _(t):
    groups = max(1, ((t.pixels.agg(F.max("frame_idx")).first()[0] or 0) + 1) // 25)
    obs = t.obs.withColumns({"x": F.col("x") / 32, "y": F.col("y") / 24, "img_idx": F.col("img_idx") + 25 * (F.col("track_id") % groups)})
    px = t.pixels.withColumnRenamed("frame_idx", "img_idx")
    return rounded(G.track_points(t.tracks, obs, px, F.lit(20), F.lit(20)), 9)


def _next_farthest(i: int) -> str:
    chosen = " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(i))
    return f"""c{i} AS MATERIALIZED (SELECT p.* FROM p JOIN ({chosen}) q ON true GROUP BY ALL HAVING min(sqrt((p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2)) > 0
ORDER BY min(sqrt((p.x - q.x)**2 + (p.y - q.y)**2 + (p.z - q.z)**2)) DESC, p.cam_idx LIMIT 1)"""


@query("farthest_first", "views", f"""WITH p AS (SELECT cam_idx, -(r00*t0 + r10*t1 + r20*t2) AS x, -(r01*t0 + r11*t1 + r21*t2) AS y, -(r02*t0 + r12*t1 + r22*t2) AS z FROM views),
c0 AS MATERIALIZED (SELECT * FROM p ORDER BY sqrt(x*x + y*y + z*z), cam_idx LIMIT 1), {", ".join(_next_farthest(i) for i in range(1, 8))}
{" UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS position, cam_idx FROM c{i}" for i in range(8))}""")
def _(t):
    return G.farthest_first(t.views, 8)
