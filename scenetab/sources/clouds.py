"""Point and splat files: CSV, binary, PLY, PCD, OBJ."""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from scenetab.functions import geom
from scenetab.sources.files import in_order, lines_of, write_files
from scenetab.sources.paths import files_of, open_fs, qualified, shared

CSV_SCHEMA = "x DOUBLE, y DOUBLE, z DOUBLE, r INT, g INT, b INT"
BATCH = 65536
SPLIT_RECORDS = 1 << 22


def read_point_csv(spark: SparkSession, path: str) -> DataFrame:
    """Exactly six columns per line; anything else is an error. Colours become fractions."""
    df = spark.read.schema(CSV_SCHEMA).option("mode", "FAILFAST").csv(path)
    return df.select("x", "y", "z", *[(F.col(c) / 255.0).alias(c) for c in "rgb"])


def point_csv_rows(points: DataFrame) -> DataFrame:
    cols = ["r", "g", "b"] + (["a"] if "a" in points.columns else [])
    return points.select("x", "y", "z", *[(F.col(c) * 255).cast("int").alias(c) for c in cols])


def write_point_csv(points: DataFrame, path: str) -> None:
    point_csv_rows(points).write.mode("error").csv(path)


def _header(spark: SparkSession, lines: list[str]) -> DataFrame:
    rows = F.posexplode(F.array(*[F.lit(v) for v in lines])).alias("k", "value")
    return spark.range(1).select(rows).select((F.col("k") - 1000).cast("bigint").alias("ord"), "value")


def _number(c: str) -> Column:
    return F.format_string("%.6f", F.col(c) + 0.0)


def ply_lines(points: DataFrame, key: str = "point_id") -> DataFrame:
    """(ord, value): header with the count, then one line per point in order of its id."""
    head = ["ply", "format ascii 1.0", f"element vertex {points.count()}", *[f"property float {a}" for a in "xyz"],
            *[f"property uint8 {c}" for c in ("red", "green", "blue")], "end_header"]
    ints = [(F.col(c) * 255).cast("int").cast("string") for c in "rgb"]
    body = points.select(F.col(key).alias("ord"), F.concat_ws(" ", *[_number(c) for c in "xyz"], *ints).alias("value"))
    return _header(points.sparkSession, head).unionByName(body)


def pcd_lines(points: DataFrame, key: str = "point_id") -> DataFrame:
    n = points.count()
    head = ["# .PCD v0.7 - Point Cloud Data file format", "VERSION 0.7", "FIELDS x y z rgb", "SIZE 4 4 4 4", "TYPE F F F U", "COUNT 1 1 1 1",
            f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", "DATA ascii"]
    r, g, b = [(F.col(c) * 255).cast("int") for c in "rgb"]
    packed = (F.shiftleft(r, 16) + F.shiftleft(g, 8) + b).cast("string")
    body = points.select(F.col(key).alias("ord"), F.concat_ws(" ", *[_number(c) for c in "xyz"], packed).alias("value"))
    return _header(points.sparkSession, head).unionByName(body)


def obj_lines(vertices: DataFrame, triangles: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """(ord, value) of one mesh: vertices, texture positions, then faces in order of their ids.

    With a ``key`` (a frame): (key, ord, value), one mesh for each of its values that has a vertex or a triangle.
    """
    by = [key] if key else []
    head = [f"mtllib {name}.mtl", f"usemtl {name}"]
    o = lambda s, c: F.struct(F.lit(s).alias("s"), c.cast("bigint").alias("k")).alias("ord")
    top = _header(vertices.sparkSession, head)
    if key:
        top = vertices.select(key).unionByName(triangles.select(key)).distinct().crossJoin(F.broadcast(top))
    top = top.select(*by, o(0, F.col("ord")), "value")
    v = vertices.select(*by, o(1, F.col("vertex_id")), F.concat_ws(" ", F.lit("v"), *[_number(c) for c in ("vx", "vy", "vz")]).alias("value"))
    vt = vertices.select(*by, o(2, F.col("vertex_id")), F.concat_ws(" ", F.lit("vt"), *[_number(c) for c in ("tu", "tv")]).alias("value"))
    corner = lambda c: F.concat_ws("/", F.col(c).cast("string"), F.col(c).cast("string"))
    f = triangles.select(*by, o(3, F.col("cell_id") * 2 + F.col("k")), F.concat_ws(" ", F.lit("f"), *[corner(c) for c in "abc"]).alias("value"))
    return top.unionByName(v).unionByName(vt).unionByName(f)


def mtl_lines(names: DataFrame, key: str, texture: str = ".png") -> DataFrame:
    """(key, ord, value): the material of each mesh ``<key>.obj``, with its colours in ``<key>.png``."""
    name = F.col(key).cast("string")
    lines = [F.concat(F.lit("newmtl "), name), F.lit("Ka 1.0 1.0 1.0"), F.lit("Kd 1.0 1.0 1.0"), F.lit("Ks 0.0 0.0 0.0"), F.concat(F.lit("map_Kd "), name, F.lit(texture))]
    return names.select(key).distinct().select(key, F.posexplode(F.array(*lines)).alias("ord", "value"))


def write_meshes(vertices: DataFrame, triangles: DataFrame, path: str, key: str) -> int:
    """Write ``<key>.obj`` and ``<key>.mtl`` into the new folder ``path`` for every value of ``key``; returns the number of files.

    Lines are sorted by ranges of (key, order), so small meshes share a task and a large one is written by several.
    """
    name = F.col(key).cast("string")
    lines = obj_lines(vertices, triangles, "", key)
    head = F.col("ord.s") == 0
    # a mesh names its own material
    own = F.when(head & (F.col("value") == "mtllib .mtl"), F.concat(F.lit("mtllib "), name, F.lit(".mtl"))).when(head, F.concat(F.lit("usemtl "), name)).otherwise(F.col("value"))
    obj = lines.select(F.concat(name, F.lit(".obj")).alias("_file"), F.col("ord.s").alias("_s"), F.col("ord.k").alias("_k"), own.alias("value"))
    mtl = mtl_lines(lines, key).select(F.concat(name, F.lit(".mtl")).alias("_file"), F.lit(0).alias("_s"), F.col("ord").cast("bigint").alias("_k"), "value")
    return write_files(in_order(obj.unionByName(mtl), "_file", "_s", "_k").select("_file", "value"), path, "_file", lines_of())


# ---- binary files ------------------------------------------------------------------------------------------------


class RecordRanges(InputPartition):
    """Ranges (path, start, end): the records of a file that begin in a range of its bytes."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class RecordReader(DataSourceReader):
    """Fixed-size records after a header; a task reads ranges of bytes, of each the header and then its records in batches."""

    def __init__(self, options, dtype: np.dtype, suffix: str, schema: pa.Schema):
        self.path, self.dtype, self.suffix, self.schema = options["path"], dtype, suffix, schema
        self.per_split = int(options.get("recordsPerPartition", SPLIT_RECORDS))

    def header(self, where: fs.FileSystem, path: str) -> tuple[int, int]:
        """(offset of the first record, number of records)."""
        raise NotImplementedError

    def partitions(self):
        # files are listed, not opened
        step = self.per_split * self.dtype.itemsize
        found = [(path, at, min(at + step, size)) for path, size in files_of(self.path, (self.suffix,)) for at in range(0, size, step)]
        return [RecordRanges(r) for r in shared(found, lambda r: r[2] - r[1])] or [RecordRanges([])]

    def read(self, part: RecordRanges) -> Iterator[pa.RecordBatch]:
        where, _ = open_fs(self.path)
        item = self.dtype.itemsize
        for path, ranges in groupby(part.ranges, lambda r: r[0]):
            start, n = self.header(where, path)
            with where.open_input_file(path) as f:
                if start + n * item > f.size():
                    raise ValueError(f"{path}: {n} records do not fit in {f.size()} bytes")
                for _, begin, end in ranges:
                    lo, hi = (min(max(-(-(at - start) // item), 0), n) for at in (begin, end))
                    f.seek(start + lo * item)
                    for at in range(lo, hi, BATCH):
                        rec = np.frombuffer(f.read(min(hi - at, BATCH) * item), self.dtype)
                        values = [pa.array(np.ascontiguousarray(rec[c]).astype(self.schema.field(c).type.to_pandas_dtype())) for c in self.schema.names if c != "path"]
                        yield pa.RecordBatch.from_arrays([*values, pa.repeat(path, len(rec))], schema=self.schema)


POINT_DTYPE = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1")])
POINT_SCHEMA = pa.schema([(c, pa.float32()) for c in "xyz"] + [(c, pa.int16()) for c in "rgb"] + [("path", pa.string())])


class PointBinReader(RecordReader):
    def header(self, where, path):
        with where.open_input_file(path) as f:
            return 4, struct.unpack("<i", f.read(4))[0]


class PartName(WriterCommitMessage):
    def __init__(self, part: str, final: str):
        self.part, self.final = part, final


def pack_points(batch: pa.RecordBatch) -> bytes:
    """Rows x, y, z and whole r, g, b as 15-byte records."""
    rec = np.empty(batch.num_rows, POINT_DTYPE)
    for c in POINT_DTYPE.names:
        rec[c] = batch.column(c).to_numpy(zero_copy_only=False)
    return rec.tobytes()


def point_count(n: int) -> bytes:
    """What a file of ``n`` points begins with."""
    return struct.pack("<i", n)


class PointBinWriter(DataSourceArrowWriter):
    """Each task writes a whole, valid file (count, then records) under a hidden name; commit makes the names visible."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, batches) -> PartName:
        from pyspark import TaskContext

        where, p = open_fs(self.path)
        where.create_dir(p, recursive=True)
        ctx = TaskContext.get()
        # a name that no other write to the folder has
        final = f"{p}/part-{ctx.partitionId():06d}-{uuid.uuid4().hex[:12]}.bin"
        part, n = f"{p}/_{ctx.taskAttemptId()}.tmp", 0
        with where.open_output_stream(f"{part}.body") as body:
            for batch in batches:
                body.write(pack_points(batch))
                n += batch.num_rows
        with where.open_output_stream(part) as out, where.open_input_stream(f"{part}.body") as body:
            out.write(point_count(n))
            while block := body.read(1 << 24):
                out.write(block)
        where.delete_file(f"{part}.body")
        return PartName(part, final)

    def commit(self, messages):
        where, _ = open_fs(self.path)
        for m in messages:
            if m is not None:
                where.move(m.part, m.final)

    def abort(self, messages):
        where, _ = open_fs(self.path)
        for m in messages:
            if m is not None:
                where.delete_file(m.part)


class PointBinSource(DataSource):
    @classmethod
    def name(cls):
        return "point_bin"

    def schema(self):
        return "x float, y float, z float, r short, g short, b short, path string"

    def reader(self, schema):
        return PointBinReader(self.options, POINT_DTYPE, ".bin", POINT_SCHEMA)

    def writer(self, schema, overwrite):
        return PointBinWriter(self.options)


def read_point_bin(spark: SparkSession, path: str, records_per_partition: int = SPLIT_RECORDS) -> DataFrame:
    """Points of one file or of a folder of files, with their ``path``; colours become fractions."""
    spark.dataSource.register(PointBinSource)
    df = spark.read.format("point_bin").option("recordsPerPartition", str(records_per_partition)).load(qualified(spark, path))
    return df.select(*[F.col(c).cast("double").alias(c) for c in "xyz"], *[(F.col(c) / 255.0).alias(c) for c in "rgb"], "path")


def _point_records(points: DataFrame, *more: Column) -> DataFrame:
    byte = lambda c: geom.clamp(F.col(c) * 255, 0.0, 255.0).cast("short").alias(c)
    return points.select(*[F.col(c).cast("float").alias(c) for c in "xyz"], *[byte(c) for c in "rgb"], *more)


def write_point_bin(points: DataFrame, path: str) -> None:
    """A folder of complete files, one per partition."""
    points.sparkSession.dataSource.register(PointBinSource)
    _point_records(points, F.lit(None).cast("string").alias("path")).write.format("point_bin").mode("append").save(qualified(points.sparkSession, path))


def write_point_files(points: DataFrame, path: str, name: str | None = None) -> int:
    """One complete file ``points.bin`` in the new folder ``path``, or one per value of column ``name``; returns their number.

    A file begins with the count of all its points, which follow in the order of the partitions. All tasks write to it; see
    ``files.write_files``. A file holds fewer than 2^31 points, as its count has 31 bits; more are an error.
    """
    label = F.lit("points.bin") if name is None else F.concat(F.col(name).cast("string"), F.lit(".bin"))
    return write_files(_point_records(points, label.alias("_file")), path, "_file", pack_points, point_count)


SPLAT_FIELDS = ["x", "y", "z", "nx", "ny", "nz", "dc0", "dc1", "dc2", *[f"rest{i}" for i in range(45)], "opacity", "e0", "e1", "e2", "q0", "q1", "q2", "q3"]
SPLAT_DTYPE = np.dtype([(f, "<f4") for f in SPLAT_FIELDS])
SPLAT_USED = ["x", "y", "z", "dc0", "dc1", "dc2", "opacity", "e0", "e1", "e2", "q0", "q1", "q2", "q3"]


class SplatPlyReader(RecordReader):
    def header(self, where, path):
        text, mark = b"", b"end_header\n"
        with where.open_input_file(path) as f:
            while mark not in text:
                more = f.read(1 << 16)
                if not more:
                    raise ValueError(f"{path}: the header has no end")
                text += more
        end = text.index(mark) + len(mark)
        found = re.search(rb"element vertex (\d+)", text[:end])
        n = int(found[1]) if found else 0
        return end, n


class SplatPlySource(DataSource):
    @classmethod
    def name(cls):
        return "splat_ply"

    def schema(self):
        return ", ".join(f"{c} float" for c in SPLAT_USED) + ", path string"

    def reader(self, schema):
        return SplatPlyReader(self.options, SPLAT_DTYPE, ".ply", pa.schema([(c, pa.float32()) for c in SPLAT_USED] + [("path", pa.string())]))


SH_C0 = 0.28209479177387814


def read_splat_ply(spark: SparkSession, path: str, records_per_partition: int = SPLIT_RECORDS) -> DataFrame:
    """Splats of PLY files in wire form: scales clipped to at most 0, colour from the constant term, alpha activated."""
    spark.dataSource.register(SplatPlySource)
    df = spark.read.format("splat_ply").option("recordsPerPartition", str(records_per_partition)).load(qualified(spark, path))
    d = lambda c: F.col(c).cast("double")
    colour = [geom.clamp(0.5 + d(f"dc{i}") * SH_C0, 0.0, 1.0).alias(n) for i, n in enumerate(("cr", "cg", "cb"))]
    return df.select(
        *[d(c).alias(c) for c in "xyz"], *colour, geom.sigmoid(d("opacity")).alias("ca"),
        *[F.least(d(f"e{i}"), F.lit(0.0)).alias(f"e{i}") for i in range(3)], *[d(f"q{i}").alias(f"q{i}") for i in range(4)],
    )
