"""Queries over files, manifests, series and streams."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenetab.functions import geom
from scenetab.functions.session import scratch_path
from scenetab.operators import series as E
from scenetab.operators.layers import layer_mesh
from scenetab.operators.splats import splat_wire_form
from scenetab.plans import sqltext as S
from scenetab.plans.layers_queries import _LAYERS, _layers
from scenetab.plans.registry import query, rnd, rounded
from scenetab.plans.splats_queries import _WIRE
from scenetab.sources import clouds as C
from scenetab.sources import manifests as M
from scenetab.sources import media as D
from scenetab.sources import rasters as R
from scenetab.sources.paths import open_fs
from scenetab.streaming import frames as SF
from scenetab.streaming import progress as SP
from scenetab.streaming.smoothing import run_ewma, stream_ewma

_POSE = "; ".join(geom.POSE)


def _lines_as_docs(lines: DataFrame, key: str) -> DataFrame:
    """Whole documents of small groups, to feed the parsers."""
    parts = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("p"))
    return parts.select(key, F.concat_ws("\n", F.transform("p", lambda s: s.getField("value"))).alias("value"))


def _captures(t) -> DataFrame:
    """Cameras in captures of a hundred, so that a document stays small at any scale."""
    return t.views.withColumn("scene_id", F.floor(F.col("cam_idx") / 100))


@query("parse_camera_manifest", "views", f"""SELECT cam_idx // 100 AS scene_id, cam_idx % 100 AS cam_idx, name, cam_model, {rnd('fx=CASE WHEN cam_model = ' + "'rectilinear'" + ' THEN fx END; cx; ' + _POSE)} FROM views""")
def _(t):
    docs = _lines_as_docs(M.manifest_lines(_captures(t)), "scene_id")
    return rounded(M.parse_camera_manifest(docs, keep=["scene_id"]).select("scene_id", "cam_idx", "name", "cam_model", "fx", "cx", *geom.POSE))


@query("read_camera_manifest", "views", "SELECT cam_idx // 100 AS scene_id, count(*) AS n_cameras FROM views GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "manifest")
    docs = _lines_as_docs(M.manifest_lines(_captures(t)), "scene_id")
    docs.repartition("scene_id").write.partitionBy("scene_id").text(path)
    cams = M.read_camera_manifest(t.spark, f"{path}/*/*.txt")
    scene = F.regexp_extract("path", r"scene_id=(\d+)", 1).cast("bigint").alias("scene_id")
    return cams.groupBy(scene).agg(F.count(F.lit(1)).alias("n_cameras"))


_WFC = "r00; r01; r02; r10; r11; r12; r20; r21; r22"


@query("world_from_cam", "views", f"""SELECT cam_idx, {rnd('m0=r00; m1=r01; m2=r02; m4=r10; m5=r11; m6=r12; m8=r20; m9=r21; m10=r22; m12=-(r00*t0+r10*t1+r20*t2); m13=-(r01*t0+r11*t1+r21*t2); m14=-(r02*t0+r12*t1+r22*t2); m15=1')} FROM views""")
def _(t):
    m = t.views.withColumn("m", M.world_from_cam())
    return rounded(m.select("cam_idx", *[F.get("m", i).alias(f"m{i}") for i in (0, 1, 2, 4, 5, 6, 8, 9, 10, 12, 13, 14, 15)]))


@query("write_camera_manifest", "views", "SELECT scene_id, count(*) + 2 AS n_lines FROM views GROUP BY scene_id")
def _(t):
    path = scratch_path(t.spark, "manifest-out")
    M.write_camera_manifest(t.views, path)
    return t.spark.read.text(path).groupBy(F.col("scene_id").cast("bigint").alias("scene_id")).agg(F.count(F.lit(1)).alias("n_lines"))


_ROTV = f"""q AS (SELECT c_name AS name, 2*{S.h('c_custkey', 1)} - 1 AS a, 2*{S.h('c_custkey', 2)} - 1 AS b, 2*{S.h('c_custkey', 3)} - 1 AS c, {S.h('c_custkey', 4)} AS px, {S.h('c_custkey', 5)} AS py, {S.h('c_custkey', 6)} AS pz FROM customer),
v AS (SELECT *, sqrt(a*a + b*b + c*c) AS th FROM q), w AS (SELECT *, cos(th/2) AS qw, a/th*sin(th/2) AS qx, b/th*sin(th/2) AS qy, c/th*sin(th/2) AS qz FROM v ORDER BY name LIMIT 1200)"""


@query("convert_rotvec_manifest", "", f"""WITH {_ROTV} SELECT name AS image_filename, {rnd('m0=qx*qx-qy*qy-qz*qz+qw*qw; m1=-2*(qx*qy-qz*qw); m2=2*(qx*qz+qy*qw); m4=-2*(qx*qy+qz*qw); m5=-qx*qx+qy*qy-qz*qz+qw*qw; m6=-2*(qy*qz-qx*qw); m8=2*(qx*qz-qy*qw); m9=-2*(qy*qz+qx*qw); m10=-qx*qx-qy*qy+qz*qz+qw*qw; m12=px; m13=-py; m14=pz')} FROM w""")
def _(t):
    from scenetab.functions.hashing import hash01

    d = lambda s: hash01("c_custkey", s)
    src = t.customer.select(
        F.col("c_name").alias("name"), F.array(*[2 * d(i) - 1 for i in (1, 2, 3)]).alias("orientation"), F.array(d(4), d(5), d(6)).alias("position"),
        F.array(F.lit(320.0), F.lit(240.0)).alias("principal_point"), F.lit(400.0).alias("focal_length"), F.array(F.lit(0.1), F.lit(0.02)).alias("radial_distortion"),
        F.lit(640.0).alias("width"), F.lit(480.0).alias("height"),
    )
    out = M.convert_rotvec_manifest(src, 1200)
    return rounded(out.select("image_filename", *[F.get("world_from_cam", i).alias(f"m{i}") for i in (0, 1, 2, 4, 5, 6, 8, 9, 10, 12, 13, 14)]))


@query("attach_time_offsets", "views", "SELECT cam_idx, CASE WHEN cam_idx % 4 = 0 THEN 0 ELSE CAST(cam_idx % 7 AS INTEGER) END AS time_offset_frames FROM views")
def _(t):
    offs = t.views.where("cam_idx % 4 <> 0").select("name", (F.col("cam_idx") % 7).cast("int").alias("time_offset_frames"))
    return M.attach_time_offsets(t.views, offs, strict=False).select("cam_idx", "time_offset_frames")


@query("default_time_offsets", "views", """WITH n AS (SELECT DISTINCT name FROM views) SELECT name AS ord, (CASE WHEN name = (SELECT min(name) FROM n) THEN '{' ELSE ',' END) || '"' || name || '":0' || (CASE WHEN name = (SELECT max(name) FROM n) THEN '}' ELSE '' END) AS value FROM n""")
def _(t):
    return M.default_time_offsets(t.views)


_BYTE = "CAST(floor({c} * 255) AS INTEGER)"


@query("point_csv_rows", "points", f"SELECT {rnd('x; y; z', 9)}, {', '.join(_BYTE.format(c=c) + ' AS ' + c for c in 'rgb')} FROM points")
def _(t):
    return rounded(C.point_csv_rows(t.points), 9)


@query("point_csv_round_trip", "points", f"SELECT {rnd('x; y; z; r=floor(r * 255) / 255; g=floor(g * 255) / 255; b=floor(b * 255) / 255')} FROM points")
def _(t):
    path = scratch_path(t.spark, "csv")
    C.write_point_csv(t.points, path)
    return rounded(C.read_point_csv(t.spark, path))


@query("point_bin_round_trip", "points", f"SELECT {rnd('x=CAST(x AS FLOAT); y=CAST(y AS FLOAT); z=CAST(z AS FLOAT); r=floor(r * 255) / 255; g=floor(g * 255) / 255; b=floor(b * 255) / 255')} FROM points")
def _(t):
    path = scratch_path(t.spark, "bin")
    C.write_point_bin(t.points.repartition(4), path)
    return rounded(C.read_point_bin(t.spark, path, 1000).drop("path"))


@query("point_files_round_trip", "points", f"SELECT cloud_id, count(*) OVER (PARTITION BY cloud_id) AS n_points, {rnd('x=CAST(x AS FLOAT); y=CAST(y AS FLOAT); z=CAST(z AS FLOAT); r=floor(r * 255) / 255; g=floor(g * 255) / 255; b=floor(b * 255) / 255')} FROM points")
def _(t):
    """One complete file per cloud, written by all tasks at offsets, then read by ranges of bytes."""
    path = scratch_path(t.spark, "clouds")
    C.write_point_files(t.points.repartition(4), path, "cloud_id")
    rows = C.read_point_bin(t.spark, path, 1000).withColumn("cloud_id", F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("bigint"))
    sizes = rows.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n_points"))
    return rounded(rows.join(sizes, "cloud_id").select("cloud_id", "n_points", "x", "y", "z", "r", "g", "b"))


_NUM = lambda c: f"printf('%.6f', {c} + 0.0)"


@query("ply_lines", "points", f"""SELECT point_id AS ord, concat_ws(' ', {_NUM('x')}, {_NUM('y')}, {_NUM('z')}, {', '.join(f"CAST({_BYTE.format(c=c)} AS VARCHAR)" for c in 'rgb')}) AS value FROM points
UNION ALL SELECT i - 1001, ['ply', 'format ascii 1.0', 'element vertex ' || (SELECT count(*) FROM points), 'property float x', 'property float y', 'property float z', 'property uint8 red', 'property uint8 green', 'property uint8 blue', 'end_header'][i] FROM range(1, 11) r(i)""")
def _(t):
    return C.ply_lines(t.points)


@query("pcd_lines", "points", f"""SELECT point_id AS ord, concat_ws(' ', {_NUM('x')}, {_NUM('y')}, {_NUM('z')}, CAST({_BYTE.format(c='r')} * 65536 + {_BYTE.format(c='g')} * 256 + {_BYTE.format(c='b')} AS VARCHAR)) AS value FROM points
UNION ALL SELECT i - 1001, ['# .PCD v0.7 - Point Cloud Data file format', 'VERSION 0.7', 'FIELDS x y z rgb', 'SIZE 4 4 4 4', 'TYPE F F F U', 'COUNT 1 1 1 1', 'WIDTH ' || (SELECT count(*) FROM points), 'HEIGHT 1', 'VIEWPOINT 0 0 0 1 0 0 0', 'POINTS ' || (SELECT count(*) FROM points), 'DATA ascii'][i] FROM range(1, 12) r(i)""")
def _(t):
    return C.pcd_lines(t.points)


@query("obj_faces", "pixels", f"""WITH {_LAYERS}, c AS (SELECT frame_idx, CAST(layer * 400 + y * 20 + x AS BIGINT) AS i FROM ly WHERE (x-10)**2 + (y-10)**2 <= 49),
f AS (SELECT frame_idx, i * 2 AS k, i AS a, i + 20 AS b, i + 1 AS c FROM c UNION ALL SELECT frame_idx, i * 2 + 1, i + 20, i + 21, i + 1 FROM c)
SELECT frame_idx, k, concat('f ', a, '/', a, ' ', b, '/', b, ' ', c, '/', c) AS value FROM f""")
def _(t):
    lines = C.obj_lines(*layer_mesh(_layers(t), 20), "mesh", "frame_idx")
    return lines.where("ord.s = 3").select("frame_idx", F.col("ord.k").alias("k"), "value")


_MESH = f"""WITH {_LAYERS}, c AS (SELECT frame_idx, CAST(layer * 400 + y * 20 + x AS BIGINT) AS i FROM ly WHERE (x-10)**2 + (y-10)**2 <= 49),
f AS (SELECT frame_idx, i * 2 AS k, i AS a, i + 20 AS b, i + 1 AS c FROM c UNION ALL SELECT frame_idx, i * 2 + 1, i + 20, i + 21, i + 1 FROM c),
q AS (SELECT *, 2*(x/19.0 - 0.5) AS a_, 2*(y/19.0 - 0.5) AS b_ FROM ly), p AS (SELECT *, sqrt(a_*a_ + b_*b_) AS r_, atan2(b_, a_) AS t_, least(greatest(0.1 / (1e-6 + invd), 0), 50) AS d FROM q),
v AS (SELECT *, CAST(layer * 400 + y * 20 + x AS BIGINT) AS k, (0.5*r_ + 0.5*r_**3) * {S.PI} / 2 AS f FROM p)
"""
_MESH_LINES = f"""SELECT frame_idx, 0 AS section, CAST(i - 1001 AS BIGINT) AS k, ['mtllib mesh.mtl', 'usemtl mesh'][i] AS value FROM (SELECT DISTINCT frame_idx FROM pixels), range(1, 3) r(i)
UNION ALL SELECT frame_idx, 1, k, concat_ws(' ', 'v', {_NUM('cos(t_)*sin(f)*d')}, {_NUM('-sin(t_)*sin(f)*d')}, {_NUM('-cos(f)*d')}) FROM v
UNION ALL SELECT frame_idx, 2, k, concat_ws(' ', 'vt', {_NUM('x/19.0/3 + layer/3.0')}, {_NUM('1 - y/19.0')}) FROM v
UNION ALL SELECT frame_idx, 3, k, concat('f ', a, '/', a, ' ', b, '/', b, ' ', c, '/', c) FROM f"""


@query("obj_meshes", "pixels", _MESH + _MESH_LINES)
def _(t):
    """All lines of one mesh per frame, over every frame."""
    lines = C.obj_lines(*layer_mesh(_layers(t), 20), "mesh", "frame_idx")
    return lines.select("frame_idx", F.col("ord.s").alias("section"), F.col("ord.k").alias("k"), "value")


@query("obj_files", "pixels", _MESH.rstrip() + f""",
l AS ({_MESH_LINES}),
o AS (SELECT frame_idx, 'obj' AS kind, row_number() OVER (PARTITION BY frame_idx ORDER BY section, k) AS line,
CASE WHEN value = 'mtllib mesh.mtl' THEN 'mtllib ' || frame_idx || '.mtl' WHEN value = 'usemtl mesh' THEN 'usemtl ' || frame_idx ELSE value END AS value FROM l)
SELECT * FROM o UNION ALL SELECT frame_idx, 'mtl', i, ['newmtl ' || frame_idx, 'Ka 1.0 1.0 1.0', 'Kd 1.0 1.0 1.0', 'Ks 0.0 0.0 0.0', 'map_Kd ' || frame_idx || '.png'][i]
FROM (SELECT DISTINCT frame_idx FROM pixels), range(1, 6) r(i)""")
def _(t):
    """One mesh and one material file per frame, written and read again line by line."""
    path = scratch_path(t.spark, "meshes")
    C.write_meshes(*layer_mesh(_layers(t), 20), path, "frame_idx")
    text = t.spark.read.text(path, wholetext=True).withColumn("f", F.element_at(F.split(F.input_file_name(), "/"), -1))
    rows = text.select("f", F.posexplode(F.split(F.expr("substr(value, 1, length(value) - 1)"), "\n")).alias("line", "value"))
    return rows.select(F.split("f", r"\.")[0].cast("bigint").alias("frame_idx"), F.split("f", r"\.")[1].alias("kind"), (F.col("line") + 1).cast("bigint").alias("line"), "value")


_F32 = lambda e: f"CAST(CAST({e} AS FLOAT) AS DOUBLE)"
_DC = lambda c: f"least(greatest(0.5 + {_F32(f'({c} - 0.5) / {C.SH_C0}')} * {C.SH_C0}, 0), 1)"
_SPLAT = [*[f"{c}={_F32(c)}" for c in "xyz"], *[f"{c}={_DC(c)}" for c in ("cr", "cg", "cb")], f"ca=1 / (1 + exp(-{_F32('4 * ca - 2')}))",
          *[f"e{i}=least({_F32(f'e{i}')}, 0)" for i in range(3)], *[f"q{i}={_F32(f'q{i}')}" for i in range(4)]]


@query("read_splat_ply", "splats", f"WITH {_WIRE} SELECT {rnd('; '.join(_SPLAT), 5)} FROM wire")
def _(t):
    """Splats written as one file per frame, then read by ranges of records."""
    path = scratch_path(t.spark, "ply")
    wire = splat_wire_form(t.splats)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        rec = np.zeros(len(pdf), C.SPLAT_DTYPE)
        for c in ("x", "y", "z", "e0", "e1", "e2", "q0", "q1", "q2", "q3"):
            rec[c] = pdf[c]
        for i, c in enumerate(("cr", "cg", "cb")):
            rec[f"dc{i}"] = (pdf[c] - 0.5) / C.SH_C0
        rec["opacity"] = 4 * pdf["ca"] - 2
        where, p = open_fs(path)
        where.create_dir(p, recursive=True)
        with where.open_output_stream(f"{p}/frame_{pdf['frame_idx'].iloc[0]:06d}.ply") as f:
            f.write(b"ply\nformat binary_little_endian 1.0\n" + f"element vertex {len(pdf)}\n".encode() + b"end_header\n" + rec.tobytes())
        return pd.DataFrame({"n": [len(pdf)]})

    wire.groupBy("frame_idx").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    return rounded(C.read_splat_ply(t.spark, path, 300), 5)


def _graph_lines(t):
    images = t.cams.select(F.col("cam_idx").alias("image_idx"), "name", "width", "height")
    kps = t.keypoints.select("image_idx", F.floor(F.col("kp_idx") / 25).alias("kp_idx"), "x", "y", "size")
    ms = t.matches.withColumns({"keypoint_idx1": F.floor(F.col("keypoint_idx1") / 25), "keypoint_idx2": F.floor(F.col("keypoint_idx2") / 25)})
    return M.match_graph_lines(images, kps, ms)


@query("match_graph_lines", "keypoints matches cams", """SELECT 5 AS section, count(*) AS n FROM (SELECT 1 FROM keypoints UNION ALL SELECT 1 FROM cams UNION ALL SELECT 1 FROM cams) q
UNION ALL SELECT 7, count(*) FROM matches UNION ALL SELECT 1, count(*) FROM cams UNION ALL SELECT 3, count(*) FROM cams UNION ALL SELECT 2 * i, 1 FROM range(5) r(i)""")
def _(t):
    return _graph_lines(t).groupBy(F.col("ord.s").cast("bigint").alias("section")).agg(F.count(F.lit(1)).alias("n"))


@query("parse_match_graph", "", f"SELECT o_orderkey // 500 AS g, o_orderkey % 500 AS keypoint_idx1, o_orderkey % 500 + 1 AS keypoint_idx2, {rnd('distance=o_totalprice')} FROM orders")
def _(t):
    """One document per five hundred orders: its matches are the orders in turn."""
    o = t.orders.select(F.floor(F.col("o_orderkey") / 500).alias("g"), (F.col("o_orderkey") % 500).alias("k"), "o_totalprice")
    one = F.struct(F.lit(0).alias("image_idx1"), F.col("k").alias("keypoint_idx1"), F.lit(1).alias("image_idx2"), (F.col("k") + 1).alias("keypoint_idx2"), F.col("o_totalprice").alias("distance"))
    docs = o.groupBy("g").agg(F.to_json(F.struct(F.collect_list(one).alias("matches"))).alias("value"))
    return rounded(M.parse_match_graph(docs, keep=["g"])[2].select("g", "keypoint_idx1", "keypoint_idx2", "distance"))


@query("first_by_name", "views", f"SELECT cam_idx, name FROM views ORDER BY name LIMIT 700")
def _(t):
    return M.first_by_name(t.views, 700).select("cam_idx", "name")


@query("resize_cameras", "views", f"""WITH r AS (SELECT *, 333 / 640.0 AS k FROM views) SELECT cam_idx, CAST(333 AS INTEGER) AS width, CAST(floor(480 * k) AS INTEGER) AS height,
{rnd('fx=fx * k; cx=cx * k; cy=cy * k; radius_at_90=radius_at_90 * k', 9)} FROM r""")
def _(t):
    out = M.resize_cameras(t.views, 333)
    return rounded(out.select("cam_idx", "width", "height", "fx", "cx", "cy", "radius_at_90"), 9)


_FILES = "f AS (SELECT file_id, filename, CASE WHEN regexp_matches(filename, '^ldi3_([0-9]{6})\\.(png|jpg)') THEN CAST(regexp_extract(filename, '^ldi3_([0-9]{6})', 1) AS BIGINT) END AS n FROM files)"


@query("catalog_frames", "files", f"""WITH {_FILES} SELECT file_id % 3 AS g, count(*) AS n_files, min(n) AS first_frame, max(n) AS last_frame,
CASE WHEN min(n) <> 0 THEN 'no frame 0' WHEN count(*) - 1 = max(n) - min(n) THEN 'ok' ELSE 'gap' END AS status FROM f WHERE n IS NOT NULL GROUP BY g""")
def _(t):
    return D.catalog_frames(t.files.withColumn("g", F.col("file_id") % 3), group=["g"])


@query("missing_frames", "files", f"WITH {_FILES} SELECT i AS frame_idx FROM range((SELECT max(n) + 1 FROM f)) r(i) WHERE i NOT IN (SELECT n FROM f WHERE n IS NOT NULL)")
def _(t):
    return D.missing_frames(t.files)


@query("classify_media", "files", f"""WITH p AS (SELECT file_id, lower(regexp_extract(filename, '[^.]*$')) AS ext, CASE WHEN file_id % 3 = 0 THEN file_id % 100 ELSE 0 END AS nb, (file_id % 40) / 4.0 AS dur, CASE WHEN file_id % 2 = 0 THEN 24000 / 1001.0 ELSE 30 END AS fps FROM files),
q AS (SELECT *, CASE WHEN nb > 0 THEN nb WHEN dur > 0 THEN floor(dur * fps + 0.5) END AS fr FROM p)
SELECT file_id, ext, CASE WHEN ext IN ('png', 'jpg') THEN 'image' WHEN ext IN ('mp4', 'mov') THEN 'video' ELSE 'other' END AS kind, CAST(fr AS BIGINT) AS frames, {rnd('seconds=CASE WHEN fr > 0 THEN fr / fps ELSE -1 END')} FROM q""")
def _(t):
    i = F.col("file_id")
    src = t.files.select(
        "file_id", "filename", F.when(i % 3 == 0, i % 100).otherwise(F.lit(0)).alias("nb_frames"), ((i % 40) / 4.0).alias("duration"),
        F.when(i % 2 == 0, F.lit(24000)).otherwise(F.lit(0)).alias("fps_num"), F.lit(1001).alias("fps_den"),
    )
    return rounded(D.classify_media(src).select("file_id", "ext", "kind", "frames", "seconds"))


@query("read_image_pixels", "pixels", f"SELECT {', '.join(['frame_idx', 'y', 'x'])}, {rnd('b=floor(b * 255) / 255; g=floor(g * 255) / 255; r=floor(r * 255) / 255; a=1')} FROM pixels")
def _(t):
    """Every frame written as an uncompressed bitmap, then read back."""
    path = scratch_path(t.spark, "img")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        img = np.zeros((20, 20, 3), "u1")
        img[pdf["y"], pdf["x"]] = np.floor(pdf[["b", "g", "r"]].to_numpy() * 255)
        where, p = open_fs(path)
        where.create_dir(p, recursive=True)
        head = b"BM" + struct.pack("<IHHI", 54 + 1200, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 20, -20, 1, 24, 0, 1200, 0, 0, 0, 0)
        with where.open_output_stream(f"{p}/frame_{pdf['frame_idx'].iloc[0]:06d}.bmp") as f:
            f.write(head + img.tobytes())
        return pd.DataFrame({"n": [len(pdf)]})

    t.pixels.groupBy("frame_idx").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    px = D.read_image_pixels(t.spark, path)
    return rounded(px.select(F.regexp_extract("path", r"frame_(\d+)", 1).cast("bigint").alias("frame_idx"), "y", "x", "b", "g", "r", "a"))


def _raster(pdf: pd.DataFrame) -> tuple[str, bytes]:
    """A frame as PGM of 16 bits, PPM of 16 or 8 bits, PFM or TIFF of floats, by its number."""
    i = int(pdf["frame_idx"].iloc[0])
    px = np.zeros((20, 20, 3))
    px[pdf["y"], pdf["x"]] = pdf[["r", "g", "b"]].to_numpy()
    kind = i % 5
    if kind == 0:
        return f"{i}.pgm", b"P5\n20 20\n65535\n" + np.floor(px[:, :, 0] * 65535).astype(">u2").tobytes()
    if kind == 1:
        return f"{i}.ppm", b"P6 # colours\n20 20\n65535\n" + np.floor(px * 65535).astype(">u2").tobytes()
    if kind == 2:
        return f"{i}.ppm", b"P6\n20 20 255\n" + np.floor(px * 255).astype("u1").tobytes()
    if kind == 3:
        return f"{i}.pfm", b"PF\n20 20\n-1.0\n" + px[::-1].astype("<f4").tobytes()
    data, tags = px.astype("<f4").tobytes(), [(256, 3, 20), (257, 3, 20), (259, 3, 1), (277, 3, 3), (278, 3, 20)]
    longer = [(258, 3, 3, 8), (273, 4, 1, 20), (339, 3, 3, 14)]
    entries = [struct.pack("<HHII", t, k, 1, v) for t, k, v in tags] + [struct.pack("<HHII", t, k, n, at) for t, k, n, at in longer]
    head = b"II" + struct.pack("<HI", 42, 20 + len(data)) + struct.pack("<HHH", 32, 32, 32) + struct.pack("<HHH", 3, 3, 3)
    return f"{i}.tif", head + data + struct.pack("<H", len(entries)) + b"".join(sorted(entries)) + bytes(4)


_SAMPLE = "CASE frame_idx % 5 WHEN 0 THEN floor(r * 65535) / 65535 WHEN 1 THEN floor({c} * 65535) / 65535 WHEN 2 THEN floor({c} * 255) / 255 ELSE CAST(CAST({c} AS FLOAT) AS DOUBLE) END"


def _rasters(t) -> str:
    path = scratch_path(t.spark, "rasters")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        name, data = _raster(pdf)
        where, p = open_fs(path)
        where.create_dir(p, recursive=True)
        with where.open_output_stream(f"{p}/{name}") as f:
            f.write(data)
        return pd.DataFrame({"n": [len(pdf)]})

    t.pixels.groupBy("frame_idx").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    return path


@query("read_raster_pixels", "pixels", f"SELECT frame_idx, y, x, {rnd('; '.join(f'{c}={_SAMPLE.format(c=c)}' for c in 'bgr') + '; a=1')} FROM pixels")
def _(t):
    """Every frame as a picture of 8 or 16 bits or of floats, read by ranges of 1000 bytes."""
    px = R.read_raster_pixels(t.spark, _rasters(t), 1000)
    return rounded(px.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("bigint").alias("frame_idx"), "y", "x", "b", "g", "r", "a"))


_STORED = "CASE frame_idx % 5 WHEN 0 THEN floor(r * 65535) WHEN 1 THEN floor(r * 65535) WHEN 2 THEN floor(r * 255) ELSE CAST(CAST(r AS FLOAT) AS DOUBLE) END"
_KIND = "CASE frame_idx % 5 WHEN 2 THEN 'u1' WHEN 0 THEN 'u2' WHEN 1 THEN 'u2' ELSE 'f4' END"


@query("rescale_rasters", "pixels", f"""WITH s AS (SELECT frame_idx, y, x, {_STORED} AS v, {_KIND} AS kind FROM pixels)
SELECT frame_idx, y, x, kind, CAST(least(round_even(CASE kind WHEN 'u1' THEN v WHEN 'u2' THEN v / 256 ELSE v * 255 END, 0), 255) AS INTEGER) AS r8,
CAST(least(round_even(CASE kind WHEN 'u1' THEN v * 256 WHEN 'u2' THEN v ELSE v * 65535 END, 0), 65535) AS INTEGER) AS r16 FROM s""")
def _(t):
    """The stored samples at 8 and at 16 bits."""
    px = R.read_samples(t.spark, _rasters(t), 5000)
    return px.select(
        F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("bigint").alias("frame_idx"), "y", "x", "kind",
        R.to_depth(F.col("r"), F.col("kind"), "u1").alias("r8"), R.to_depth(F.col("r"), F.col("kind"), "u2").alias("r16"),
    )


_EWMA = """WITH RECURSIVE s AS (SELECT run, step, loss, row_number() OVER (PARTITION BY run ORDER BY step) AS k FROM ({src}) q),
e AS (SELECT run, k, loss AS x FROM s WHERE k = 1 UNION ALL SELECT s.run, s.k, {a} * e.x + {b} * s.loss FROM e JOIN s ON s.run = e.run AND s.k = e.k + 1)"""
_LOSS_SRC = "SELECT event_type AS run, event_id AS step, CAST(value AS DOUBLE) AS loss FROM events"


@query("moving_average", "", f"{_EWMA.format(src=_LOSS_SRC, a='0.9', b='0.1')} SELECT s.run, s.step, {rnd('smooth=x; log_smooth=log10(x)')} FROM e JOIN s USING (run, k)")
def _(t):
    return rounded(E.with_log10(E.moving_average(t.loss, "run", "step", "loss", 0.9)).select("run", "step", "smooth", "log_smooth"))


# Sums of a few short decimals can lie halfway between two six-digit numbers, where the last bit decides. So both sides are
# moved by the same odd bit before they are rounded.
_OFF = 3.1415926e-8


def _average(keep: float):
    def run(t):
        return rounded(E.moving_average(t.loss, "run", "step", "loss", keep).select("run", "step", (F.col("smooth") + F.lit(_OFF)).alias("smooth")))

    return run


for _keep, _rest in (("0.3", "0.7"), ("0.5", "0.5"), ("0.99", "0.01"), ("0.9999", "0.0001")):
    query(f"moving_average_{_keep[2:]}", "", f"{_EWMA.format(src=_LOSS_SRC, a=_keep, b=_rest)} SELECT s.run, s.step, {rnd(f'smooth=x + CAST({_OFF} AS DOUBLE)')} FROM e JOIN s USING (run, k)")(_average(float(_keep)))


@query("brightness_ratio", "pixels", f"""WITH RECURSIVE m AS (SELECT frame_idx, avg((b + g + r) / 3) AS v FROM pixels GROUP BY ALL), e AS (SELECT frame_idx, v AS x FROM m WHERE frame_idx = 0
UNION ALL SELECT m.frame_idx, 0.95 * e.x + 0.05 * m.v FROM e JOIN m ON m.frame_idx = e.frame_idx + 1)
SELECT frame_idx, {rnd('smooth=x; ratio=x / v')} FROM e JOIN m USING (frame_idx)""")
def _(t):
    from scenetab.operators.frames import frame_brightness

    means = frame_brightness(t.pixels).withColumn("video", F.lit(0))
    return rounded(E.brightness_ratio(means).select("frame_idx", "smooth", "ratio"))


def _packets(t):
    e = t.events
    return e.select(F.col("event_type").alias("stream"), F.col("event_id").alias("seq"), (F.col("event_id") % 4 != 0).alias("is_video"), F.col("value").cast("double").alias("value"))


def _double(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.assign(value=pdf["value"] * 2.0)


@query("stream_frames", "", f"SELECT event_type AS stream, event_id AS seq, event_id % 4 <> 0 AS is_video, {rnd('value=CASE WHEN event_id % 4 <> 0 THEN value * 2 ELSE value END')} FROM events")
def _(t):
    src, out = scratch_path(t.spark, "packets"), scratch_path(t.spark, "mapped")
    _packets(t).repartition(4).write.parquet(src)
    SF.stream_frames(t.spark, src, out, _double, files_per_trigger=2).awaitTermination()
    return rounded(t.spark.read.parquet(out).select("stream", "seq", "is_video", "value"))


@query("number_frames", "", """SELECT event_type AS stream, event_id AS seq, CAST(count(*) FILTER (WHERE event_id % 4 <> 0) OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS frame_idx FROM events""")
def _(t):
    return SF.number_frames(_packets(t)).select("stream", "seq", "frame_idx")


_PROG = f"""SELECT job, CASE WHEN s / 100000.0 >= 2 * s / 300000.0 THEN 'batch' ELSE 'points' END AS phase, {rnd('fraction=greatest(s / 100000.0, 2 * s / 300000.0)')}, s AS seq
FROM (SELECT user_id AS job, max(event_id) AS s FROM events GROUP BY user_id) q"""


@query("progress_of_lines", "", _PROG)
def _(t):
    return rounded(SP.stream_progress(t.lines))


@query("stream_progress", "", _PROG)
def _(t):
    src = scratch_path(t.spark, "lines")
    t.lines.repartition(4).write.parquet(src)
    stream = t.spark.readStream.schema(t.lines.schema).option("maxFilesPerTrigger", 2).parquet(src)
    out = scratch_path(t.spark, "progress")
    SP.run_progress(stream, out).awaitTermination()
    return rounded(SP.latest_progress(t.spark.read.parquet(out)))


_STREAMED = f"{_EWMA.format(src=_LOSS_SRC, a='0.9', b='0.1')} SELECT s.run, s.step, {rnd('smooth=x')} FROM e JOIN s USING (run, k)"


def _loss_stream(t) -> DataFrame:
    """The series in four files, which arrive in the order of their steps as four micro-batches."""
    src = scratch_path(t.spark, "loss")
    last = t.loss.agg(F.max("step")).first()[0] or 0
    for quarter in range(4):
        t.loss.where(F.floor(F.col("step") * 4 / (last + 1)) == quarter).coalesce(1).write.mode("append").parquet(src)
    return t.spark.readStream.schema(t.loss.schema).option("maxFilesPerTrigger", 1).parquet(src)


@query("stream_ewma", "", _STREAMED)
def _(t):
    out = scratch_path(t.spark, "ewma")
    spark = t.spark
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = stream_ewma(_loss_stream(t), 0.9).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "ewma-state"))
    try:
        q.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return rounded(spark.read.parquet(out))


@query("stream_ewma_batches", "", _STREAMED)
def _(t):
    """The same averages from batches that are composed of segments."""
    out = scratch_path(t.spark, "ewma-batches")
    run_ewma(_loss_stream(t), out, scratch_path(t.spark, "ewma-offsets"), 0.9).awaitTermination()
    return rounded(t.spark.read.parquet(f"{out}/rows").select("run", "step", "smooth"))
