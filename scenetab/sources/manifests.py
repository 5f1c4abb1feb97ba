"""Camera manifests, time offsets and match graphs as JSON."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetab.functions import geom
from scenetab.functions.session import broadcast_if_small

CAMERA_SCHEMA = """frames_data ARRAY<STRUCT<image_filename STRING, cam_model STRING, width INT, height INT, world_from_cam ARRAY<DOUBLE>,
fx DOUBLE, fy DOUBLE, cx DOUBLE, cy DOUBLE, radial_distortion ARRAY<DOUBLE>, radius_at_90 DOUBLE, useable_radius DOUBLE, k1 DOUBLE, tilt DOUBLE>>"""
GRAPH_SCHEMA = """metadata STRUCT<num_images INT, image_filenames ARRAY<STRING>, image_sizes ARRAY<STRUCT<width INT, height INT>>>,
keypoints ARRAY<ARRAY<STRUCT<x DOUBLE, y DOUBLE, size DOUBLE>>>,
matches ARRAY<STRUCT<image_idx1 BIGINT, keypoint_idx1 BIGINT, image_idx2 BIGINT, keypoint_idx2 BIGINT, distance DOUBLE>>"""


def _inverse(m: Column) -> dict[str, Column]:
    """Pose columns from a column-major world_from_cam, by the general inverse of its upper 3x4."""
    e = lambda i, j: F.get(m, 4 * j + i)
    cof = lambda i, j: e((i + 1) % 3, (j + 1) % 3) * e((i + 2) % 3, (j + 2) % 3) - e((i + 1) % 3, (j + 2) % 3) * e((i + 2) % 3, (j + 1) % 3)
    det = sum((e(0, j) * cof(0, j) for j in range(3)), F.lit(0.0))
    out = {f"r{i}{j}": geom.div(cof(j, i), det) for i in range(3) for j in range(3)}
    return out | {f"t{i}": -sum((geom.div(cof(j, i), det) * e(j, 3) for j in range(3)), F.lit(0.0)) for i in range(3)}


def parse_camera_manifest(docs: DataFrame, doc: str = "value", keep: list[str] | None = None) -> DataFrame:
    """A row per camera of each JSON document; an unknown camera model is an error."""
    keep = keep or []
    rows = docs.select(*keep, F.from_json(doc, CAMERA_SCHEMA).alias("j")).select(*keep, F.posexplode("j.frames_data").alias("cam_idx", "f"))
    known = F.when(F.col("f.cam_model").isin("rectilinear", "equiangular"), F.col("f.cam_model"))
    model = F.coalesce(known, F.raise_error(F.concat(F.lit("unknown camera model: "), F.coalesce("f.cam_model", F.lit("none")))).cast("string"))
    fish = F.col("f.cam_model") == "equiangular"
    k1 = F.when(fish, F.col("f.k1")).otherwise(F.coalesce(F.get("f.radial_distortion", 0), F.lit(0.0)))
    return rows.select(
        *keep, F.col("cam_idx").cast("bigint").alias("cam_idx"), F.col("f.image_filename").alias("name"), model.alias("cam_model"), "f.width", "f.height", "f.fx", "f.fy", "f.cx", "f.cy",
        "f.radius_at_90", "f.useable_radius", k1.alias("k1"), F.when(~fish, F.coalesce(F.get("f.radial_distortion", 1), F.lit(0.0))).alias("k2"), "f.tilt",
        *[c.alias(n) for n, c in _inverse(F.col("f.world_from_cam")).items()],
    )


def read_camera_manifest(spark: SparkSession, glob: str) -> DataFrame:
    docs = spark.read.text(glob, wholetext=True).withColumn("path", F.input_file_name())
    return parse_camera_manifest(docs, keep=["path"])


def world_from_cam(cam: geom.Getter = geom.flat()) -> Column:
    """The sixteen column-major numbers of a rigid pose."""
    px, py, pz = geom.position(cam)
    cols = [[cam(f"r{j}{i}") for i in range(3)] + [F.lit(0.0)] for j in range(3)]
    return F.array(*cols[0], *cols[1], *cols[2], px, py, pz, F.lit(1.0))


def camera_json(cams: DataFrame, keep: list[str]) -> DataFrame:
    """The JSON object of each camera; the two models have different fields."""
    both = lambda *names: [F.col(n) for n in names]
    head = [F.col("name").alias("image_filename"), F.col("cam_model"), *both("width", "height")]
    tail = [world_from_cam().alias("world_from_cam")]
    pin = F.to_json(F.struct(*head, *both("fx", "fy", "cx", "cy"), *tail))
    fish = F.to_json(F.struct(*head, *both("cx", "cy", "radius_at_90", "k1", "tilt", "useable_radius"), *tail))
    return cams.select(*keep, "cam_idx", F.when(F.col("cam_model") == "rectilinear", pin).otherwise(fish).alias("object"))


def manifest_lines(cams: DataFrame, scene: str = "scene_id") -> DataFrame:
    """(scene, ord, value): the lines of one manifest per scene, cameras ordered by index."""
    first = broadcast_if_small(cams.groupBy(scene).agg(F.min("cam_idx").alias("_first")))
    body = camera_json(cams, [scene]).join(first, scene)
    comma = F.when(F.col("cam_idx") == F.col("_first"), F.lit("")).otherwise(F.lit(","))
    body = body.select(scene, F.col("cam_idx").cast("bigint").alias("ord"), F.concat(comma, F.col("object")).alias("value"))
    edge = lambda o, v: first.select(scene, F.lit(o).cast("bigint").alias("ord"), F.lit(v).alias("value"))
    return edge(-1, '{"frames_data":[').unionByName(body).unionByName(edge(2**62, "]}"))


def write_lines(lines: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Write ordered text: part files in order of ``ord``, so that their concatenation is the document."""
    by = by or []
    out = lines.repartitionByRange(*by, "ord").sortWithinPartitions(*by, "ord").select(*by, "value")
    out.write.mode("error").partitionBy(*by).text(path) if by else out.write.mode("error").text(path)


def write_camera_manifest(cams: DataFrame, path: str, scene: str = "scene_id") -> None:
    write_lines(manifest_lines(cams, scene), path, [scene])


def first_by_name(cams: DataFrame, n: int) -> DataFrame:
    """The first n cameras in order of name."""
    return cams.orderBy("name").limit(n)


def resize_cameras(cams: DataFrame, size: int, by: str = "width") -> DataFrame:
    """Intrinsics for pictures of a new width (or height, or larger side); the other side is truncated."""
    w, h = F.col("width"), F.col("height")
    by_width = F.lit(True) if by == "width" else F.lit(False) if by == "height" else w > h
    k = F.lit(float(size)) / F.when(by_width, w).otherwise(h)
    other = lambda c: (c * F.col("_k")).cast("int")
    out = cams.withColumns({"_k": k, "_by_width": by_width})
    new = {"width": F.when(F.col("_by_width"), F.lit(size)).otherwise(other(w)), "height": F.when(F.col("_by_width"), other(h)).otherwise(F.lit(size))}
    new |= {c: F.col(c) * F.col("_k") for c in ("fx", "fy", "cx", "cy", "radius_at_90", "useable_radius") if c in cams.columns}
    return out.withColumns(new).drop("_k", "_by_width")


# fixed values of a calibrated wide action camera
ACTION_CAMERA = {"width": 3840, "k1": 0.06001369441859313, "tilt": 0.0010783222019413348, "radius_at_90": 2662.8540299512697, "useable_radius": 100000.0}


def guess_intrinsics(images: DataFrame, fov_deg: float = 120.0, fisheye: bool = False) -> DataFrame:
    """Start values for pictures of known width and height: a pinhole of the given field of view, or a wide action camera."""
    w, h = F.col("width"), F.col("height")
    center = {"cx": w / 2.0, "cy": h / 2.0}
    if fisheye:
        k = w / F.lit(float(ACTION_CAMERA["width"]))
        lens = {n: F.lit(ACTION_CAMERA[n]) * k for n in ("radius_at_90", "useable_radius")} | {n: F.lit(ACTION_CAMERA[n]) for n in ("k1", "tilt")}
        return images.withColumns({**center, **lens, "cam_model": F.lit("equiangular")})
    focal = F.greatest(w, h) / F.lit(2.0 * math.tan(math.radians(fov_deg) / 2.0))
    return images.withColumns({**center, "fx": focal, "fy": focal, "k1": F.lit(0.0), "k2": F.lit(0.0), "cam_model": F.lit("rectilinear")})


def convert_rotvec_manifest(rows: DataFrame, num_cameras: int) -> DataFrame:
    """First cameras by name: rotation vector to matrix, y mirrored in row and column, pose written column-major."""
    src = first_by_name(rows, num_cameras)
    src = src.withColumns({f"_w{i}": F.get("orientation", i) for i in range(3)} | {f"_p{i}": F.get("position", i) for i in range(3)})
    rot = geom.rotvec_matrix(F.col("_w0"), F.col("_w1"), F.col("_w2"))
    src = src.withColumns({f"_r{i}": c for i, c in enumerate(rot)})
    # the inverse of [R | -R p] is [R^T | p]
    flip = (1.0, -1.0, 1.0)
    cols = [F.col(f"_r{3 * j + i}") * F.lit(flip[i] * flip[j]) for j in range(3) for i in range(3)]
    m = [*cols[0:3], F.lit(0.0), *cols[3:6], F.lit(0.0), *cols[6:9], F.lit(0.0), *[F.col(f"_p{i}") * flip[i] for i in range(3)], F.lit(1.0)]
    return src.select(
        F.col("name").alias("image_filename"), F.lit("rectilinear").alias("cam_model"), F.col("width").cast("int").alias("width"),
        F.col("height").cast("int").alias("height"), F.col("focal_length").alias("fx"), F.col("focal_length").alias("fy"),
        F.get("principal_point", 0).alias("cx"), F.get("principal_point", 1).alias("cy"), "radial_distortion",
        F.lit(0).alias("timestamp"), F.array(*m).alias("world_from_cam"),
    )


def attach_time_offsets(cams: DataFrame, offsets: DataFrame | None, strict: bool = True) -> DataFrame:
    """Offsets by camera name. No table: all 0. A camera missing from the table is an error, or 0 when not strict."""
    if offsets is None:
        return cams.withColumn("time_offset_frames", F.lit(0))
    j = cams.join(broadcast_if_small(offsets.select("name", "time_offset_frames")), "name", "left")
    missing = F.raise_error(F.concat(F.lit("no time offset for camera "), F.col("name"))).cast("int") if strict else F.lit(0)
    return j.withColumn("time_offset_frames", F.coalesce("time_offset_frames", missing))


def default_time_offsets(cams: DataFrame) -> DataFrame:
    """The lines of a JSON object giving every camera 0, in order of name."""
    names = cams.select("name").distinct()
    low, high = names.agg(F.min("name"), F.max("name")).first()
    comma = F.when(F.col("name") == F.lit(low), F.lit("{")).otherwise(F.lit(","))
    end = F.when(F.col("name") == F.lit(high), F.lit(":0}")).otherwise(F.lit(":0"))
    return names.select("name", F.concat(comma, F.expr("substring(to_json(struct(name)), 9)")).alias("v")).select(
        F.col("name").alias("ord"), F.concat(F.expr("substring(v, 1, length(v) - 1)"), end).alias("value")
    )


def parse_match_graph(docs: DataFrame, doc: str = "value", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, keypoints, matches) of JSON documents."""
    keep = keep or []
    j = docs.select(*keep, F.from_json(doc, GRAPH_SCHEMA).alias("j"))
    images = j.select(*keep, F.posexplode(F.arrays_zip("j.metadata.image_filenames", "j.metadata.image_sizes")).alias("image_idx", "m")).select(
        *keep, "image_idx", F.col("m.image_filenames").alias("name"), "m.image_sizes.width", "m.image_sizes.height"
    )
    kps = j.select(*keep, F.posexplode("j.keypoints").alias("image_idx", "k")).select(*keep, "image_idx", F.posexplode("k").alias("kp_idx", "p"))
    return images, kps.select(*keep, "image_idx", "kp_idx", "p.*"), j.select(*keep, F.explode("j.matches").alias("m")).select(*keep, "m.*")


def read_match_graph(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = spark.read.text(glob, wholetext=True).withColumn("path", F.input_file_name())
    return parse_match_graph(docs, keep=["path"])


def match_graph_lines(images: DataFrame, keypoints: DataFrame, matches: DataFrame) -> DataFrame:
    """(ord, value): a match graph as ordered lines. Image and keypoint indices are dense from 0.

    ``ord`` is a struct (section, image, position), so keypoints and matches are never gathered into one value.
    """
    o = lambda s, i, k: F.struct(F.lit(s).alias("s"), i.cast("bigint").alias("i"), k.cast("bigint").alias("k")).alias("ord")
    zero = F.lit(0)
    n = images.count()
    spark = images.sparkSession
    fixed = lambda s, v: spark.range(1).select(o(s, zero, zero), F.lit(v).alias("value"))
    comma = lambda first: F.when(first, F.lit("")).otherwise(F.lit(","))
    no_image = F.col("image_idx") == 0
    names = images.select(o(1, F.col("image_idx"), zero), F.concat(comma(no_image), F.regexp_extract(F.to_json(F.struct("name")), r'^\{"name":(.*)\}$', 1)).alias("value"))
    sizes = images.select(o(3, F.col("image_idx"), zero), F.concat(comma(no_image), F.to_json(F.struct("width", "height"))).alias("value"))
    opens = images.select(o(5, F.col("image_idx"), F.lit(-1)), F.concat(comma(no_image), F.lit("[")).alias("value"))
    closes = images.select(o(5, F.col("image_idx"), F.lit(2**62)), F.lit("]").alias("value"))
    kps = keypoints.select(o(5, F.col("image_idx"), F.col("kp_idx")), F.concat(comma(F.col("kp_idx") == 0), F.to_json(F.struct("x", "y", "size"))).alias("value"))
    key = F.struct("image_idx1", "keypoint_idx1", "image_idx2", "keypoint_idx2")
    low = matches.agg(F.min(key).alias("m")).first()["m"]
    is_low = F.lit(True)
    for c in ("image_idx1", "keypoint_idx1", "image_idx2", "keypoint_idx2"):
        is_low = is_low & (F.col(c) == F.lit(low[c] if low else None))
    fields = ["image_idx1", "keypoint_idx1", "image_idx2", "keypoint_idx2", "distance"]
    ms = matches.select(o(7, F.col("image_idx1"), F.col("keypoint_idx1")), F.concat(comma(is_low), F.to_json(F.struct(*fields))).alias("value"))
    out = fixed(0, f'{{"metadata":{{"num_images":{n},"image_filenames":[').unionByName(names)
    out = out.unionByName(fixed(2, '],"image_sizes":[')).unionByName(sizes).unionByName(fixed(4, ']},"keypoints":['))
    for part in (opens, kps, closes, fixed(6, '],"matches":['), ms, fixed(8, "]}")):
        out = out.unionByName(part)
    return out


def write_match_graph(images: DataFrame, keypoints: DataFrame, matches: DataFrame, path: str) -> None:
    write_lines(match_graph_lines(images, keypoints, matches), path)
