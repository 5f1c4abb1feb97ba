"""Input views over the given tables, written once as SQL that both engines read (see FIXTURES.md).

Draws use a mixing hash instead of a plain multiplicative one, so that coordinates made from one id are independent.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from scenetab.functions.hashing import hash01_sql

# name -> (tables read, text); {table} is a table, h(id, s) a draw, e(k) the k-th embedding entry counted from 1
VIEWS: dict[str, str] = {}

_POSE = """cos({a}) AS r00, CAST(0 AS DOUBLE) AS r01, -sin({a}) AS r02,
  CAST(0 AS DOUBLE) AS r10, CAST(1 AS DOUBLE) AS r11, CAST(0 AS DOUBLE) AS r12,
  sin({a}) AS r20, CAST(0 AS DOUBLE) AS r21, cos({a}) AS r22,
  -({px} * cos({a})) + {pz} * sin({a}) AS t0, -({py}) AS t1, -({px} * sin({a})) - {pz} * cos({a}) AS t2"""


def _camera(key: str, scene: str, name: str, a: str, px: str, py: str, pz: str, frm: str) -> str:
    return f"""SELECT CAST({scene} AS BIGINT) AS scene_id, CAST({key} AS BIGINT) AS cam_idx, {name} AS name,
  CASE WHEN {key} % 2 = 0 THEN 'rectilinear' ELSE 'equiangular' END AS cam_model, 640 AS width, 480 AS height,
  CAST(400 + {key} % 100 AS DOUBLE) AS fx, CAST(400 + {key} % 100 AS DOUBLE) AS fy, CAST(320 AS DOUBLE) AS cx,
  CAST(240 AS DOUBLE) AS cy, CAST(300 AS DOUBLE) AS radius_at_90, CAST(320 AS DOUBLE) AS useable_radius,
  CAST(0.05 AS DOUBLE) AS k1, CAST(-0.01 AS DOUBLE) AS tilt, {_POSE.format(a=a, px=px, py=py, pz=pz)}
  FROM {frm}"""


# one rig of five cameras per scene, both lens models
VIEWS["cams"] = _camera(
    "n_nationkey", "n_regionkey", "n_name", "((n_nationkey - 12) * CAST(0.05 AS DOUBLE))",
    "((n_nationkey - 12) * CAST(0.1 AS DOUBLE))", "CAST(0.0 AS DOUBLE)", "CAST(0.0 AS DOUBLE)", "{nation}",
)

# many cameras: one per customer, the scene is the nation
VIEWS["views"] = _camera(
    "c_custkey", "c_nationkey", "c_name", "(6 * h(c_custkey, 31) - 3)",
    "(4 * h(c_custkey, 32) - 2)", "(h(c_custkey, 33) - CAST(0.5 AS DOUBLE))", "(4 * h(c_custkey, 34) - 2)", "{customer}",
)

# a third of the points sits in a tight clump
VIEWS["points"] = """SELECT event_id AS point_id, event_id % 10 AS cloud_id, event_id % 5 AS scene_id,
  CASE WHEN event_id % 3 = 0 THEN h(event_id, 11) / 20 ELSE 8 * h(event_id, 11) - 4 END AS x,
  CASE WHEN event_id % 3 = 0 THEN h(event_id, 12) / 20 ELSE 4 * h(event_id, 12) - 2 END AS y,
  CASE WHEN event_id % 3 = 0 THEN 2 + h(event_id, 13) / 20 ELSE 6 * h(event_id, 13) - 1 END AS z,
  h(event_id, 1) AS r, h(event_id, 2) AS g, h(event_id, 3) AS b FROM {events}"""

# whole frames of 20 x 20 only
VIEWS["pixels"] = """SELECT CAST(floor(event_id / 400) AS BIGINT) AS frame_idx,
  CAST(floor((event_id % 400) / 20) AS BIGINT) AS y, event_id % 20 AS x,
  h(event_id, 1) AS b, h(event_id, 2) AS g, h(event_id, 3) AS r, h(event_id, 4) AS a,
  CAST(value AS DOUBLE) / 500 AS invd
  FROM {events} WHERE event_id < 400 * (SELECT CAST(floor((max(event_id) + 1) / 400) AS BIGINT) FROM {events})"""

VIEWS["obs"] = """SELECT l_orderkey AS track_id, l_suppkey % 25 AS img_idx, min(l_partkey) AS kp_idx,
  min(l_quantity) * CAST(12.8 AS DOUBLE) AS x, min(l_discount) * 4800 AS y, min(l_tax) AS mono
  FROM {lineitem} GROUP BY l_orderkey, l_suppkey % 25"""

VIEWS["tracks"] = """SELECT o_orderkey AS track_id, (o_custkey % 100) / CAST(50 AS DOUBLE) - 1 AS x,
  (o_orderkey % 77) / CAST(38 AS DOUBLE) - 1 AS y, 2 + o_totalprice / 200000 AS z,
  CAST(1 AS DOUBLE) AS weight, o_orderstatus <> 'P' AS has_estimated_3d, o_orderkey % 50 = 0 AS pruned FROM {orders}"""

# each event to the next of the same user and type, so components are exactly (user_id, event_type)
VIEWS["matches"] = """SELECT prev_id % 25 AS image_idx1, prev_id AS keypoint_idx1, event_id % 25 AS image_idx2,
  event_id AS keypoint_idx2, abs(value) AS distance
  FROM (SELECT event_id, value, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS prev_id
  FROM {events}) q WHERE prev_id IS NOT NULL"""

VIEWS["keypoints"] = """SELECT event_id % 25 AS image_idx, event_id AS kp_idx, 640 * h(event_id, 5) AS x,
  480 * h(event_id, 6) AS y, CAST(1 AS DOUBLE) + h(event_id, 7) AS size FROM {events}"""

VIEWS["descriptors"] = "SELECT label AS image_idx, vec_id AS kp_idx, embedding FROM {embeddings}"

VIEWS["samples"] = """SELECT CAST(floor(event_id / 20) AS BIGINT) AS ray_id, event_id % 20 AS sample_idx,
  CAST(0.2 AS DOUBLE) + (event_id % 20) * CAST(0.25 AS DOUBLE) + CAST(value AS DOUBLE) / 10000 AS depth,
  CAST(value AS DOUBLE) / 100 AS sigma, h(event_id, 1) AS r, h(event_id, 2) AS g, h(event_id, 3) AS b FROM {events}"""

# raw (pre-activation) parameters, frames of 1000 slots
VIEWS["splats"] = """SELECT CAST(floor(event_id / 1000) AS BIGINT) AS frame_idx, event_id % 1000 AS splat_idx,
  CAST(floor(event_id / 1000) AS BIGINT) % 5 AS scene_id,
  8 * h(event_id, 11) - 4 AS x, 4 * h(event_id, 12) - 2 AS y, 6 * h(event_id, 13) - 1 AS z,
  4 * h(event_id, 21) - 2 AS c0, 4 * h(event_id, 22) - 2 AS c1, 4 * h(event_id, 23) - 2 AS c2,
  10 * h(event_id, 24) - 5 AS alpha, 8 * h(event_id, 25) - 2 AS s0, 8 * h(event_id, 26) - 2 AS s1,
  8 * h(event_id, 27) - 2 AS s2, 2 * h(event_id, 14) - 1 AS q0, 2 * h(event_id, 15) - 1 AS q1,
  2 * h(event_id, 16) - 1 AS q2, 2 * h(event_id, 17) - 1 AS q3, event_id % 7 <> 0 AS alive,
  CASE WHEN event_id % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE h(event_id, 18) END AS grad FROM {events}"""

VIEWS["keys"] = """SELECT CAST(s_nationkey AS BIGINT) AS path_id, s_suppkey AS frame_idx, s_acctbal / 1000 AS tx,
  h(s_suppkey, 1) AS ty, h(s_suppkey, 2) AS tz, 90 * h(s_suppkey, 3) AS rx, 90 * h(s_suppkey, 4) AS ry,
  90 * h(s_suppkey, 5) AS rz, 400 + 100 * h(s_suppkey, 6) AS focal FROM {supplier}"""

VIEWS["loss"] = "SELECT event_type AS run, event_id AS step, CAST(value AS DOUBLE) AS loss FROM {events}"

VIEWS["lines"] = """SELECT user_id AS job, event_id AS seq, concat('Batch: ', CAST(event_id AS VARCHAR(20)),
  ' / 100000 # Points: ', CAST(2 * event_id AS VARCHAR(20)), ' / 300000') AS line FROM {events}"""

VIEWS["files"] = """SELECT event_id AS file_id, concat('ldi3_', lpad(CAST(event_id AS VARCHAR(20)), 6, '0'),
  CASE event_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.mp4' WHEN 3 THEN '.mov' ELSE '.txt' END)
  AS filename FROM {events}"""


def text(name: str, spark: bool) -> str:
    sql = VIEWS[name]
    sql = re.sub(r"\bh\((\w+), (\d+)\)", lambda m: hash01_sql(m[1], int(m[2]), spark), sql)
    return sql if spark else re.sub(r"\{(\w+)\}", r"\1", sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = text(name, spark=True)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def with_views(needs: str, sql: str) -> str:
    ctes = [f"{n} AS ({text(n, spark=False)})" for n in needs.split()]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join([*ctes, body[15:]])
    if body[:5].upper() == "WITH ":
        ctes.append(body[5:])
        return "WITH " + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
