"""Uncompressed pictures of 8 and 16 bits and of floats, read by ranges of rows: PGM, PPM, PFM and plain TIFF."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scenetab.sources.paths import files_of, open_fs, qualified, shared

SUFFIXES = (".pgm", ".ppm", ".pfm", ".tif", ".tiff")
SPLIT = 32 << 20
BAND = 1 << 16

# fixed values: the largest number of each depth, which stands for 1, and the factors between depths
FULL = {"u1": 255.0, "u2": 65535.0, "f4": 1.0}
BETWEEN = {("u1", "u2"): 256.0, ("u2", "u1"): 1 / 256.0}


class Layout(NamedTuple):
    """Where the rows of a picture are: (first row, rows, offset) of each stored run; PFM stores the last row first."""

    width: int
    height: int
    channels: int
    dtype: np.dtype
    runs: list[tuple[int, int, int]]
    upward: bool = False

    @property
    def row_bytes(self) -> int:
        return self.width * self.channels * self.dtype.itemsize


def _netpbm(f, path: str) -> Layout:
    text = f.read(1 << 12)
    found = re.match(rb"P([56fF])((?:\s+(?:#[^\n]*\n\s*)*[-+.0-9eE]+){3})\s", text)
    if not found:
        raise ValueError(f"{path} is no binary PGM, PPM or PFM file")
    width, height, last = re.sub(rb"#[^\n]*\n", b" ", found[2]).split()
    colour = found[1] in (b"6", b"F")
    if found[1] in (b"5", b"6"):
        if int(last) not in (255, 65535):
            raise ValueError(f"{path}: samples up to {int(last)} are neither 8 nor 16 bits deep")
        dtype = np.dtype("u1") if int(last) == 255 else np.dtype(">u2")
    else:
        dtype = np.dtype("<f4" if float(last) < 0 else ">f4")
    w, h = int(width), int(height)
    return Layout(w, h, 3 if colour else 1, dtype, [(0, h, found.end())], upward=found[1] in (b"f", b"F"))


# fixed values of the format: the tags that are used, and the size and code of each kind of number
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _CHANNELS, _STRIP_ROWS, _PLANAR, _FORMAT = 256, 257, 258, 259, 273, 277, 278, 284, 339
_KINDS = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}


def _tiff(f, path: str) -> Layout:
    start = f.read(8)
    order = "<" if start[:2] == b"II" else ">"
    if struct.unpack(order + "H", start[2:4])[0] != 42:
        raise ValueError(f"{path} is no TIFF file of the common kind")
    f.seek(struct.unpack(order + "I", start[4:])[0])
    entries = f.read(12 * struct.unpack(order + "H", f.read(2))[0])
    tags = {}
    for at in range(0, len(entries), 12):
        tag, kind, n = struct.unpack(order + "HHI", entries[at : at + 8])
        if kind not in _KINDS:
            continue
        size, code = _KINDS[kind]
        data = entries[at + 8 : at + 12]
        if n * size > 4:
            f.seek(struct.unpack(order + "I", data)[0])
            data = f.read(n * size)
        tags[tag] = struct.unpack(f"{order}{n}{code}", data[: n * size])
    w, h, channels = tags[_WIDTH][0], tags[_HEIGHT][0], tags.get(_CHANNELS, (1,))[0]
    bits, form = set(tags.get(_BITS, (1,))), set(tags.get(_FORMAT, (1,)))
    kind = {(8, 1): "u1", (16, 1): "u2", (32, 3): "f4"}.get((*bits, *form)) if len(bits) == len(form) == 1 else None
    if kind is None or tags.get(_COMPRESSION, (1,))[0] != 1 or tags.get(_PLANAR, (1,))[0] != 1 or channels not in (1, 3, 4) or _OFFSETS not in tags:
        raise ValueError(f"{path}: only whole samples of 8 or 16 bits or floats are read, uncompressed and pixel by pixel")
    rows = min(tags.get(_STRIP_ROWS, (h,))[0], h)
    runs = [(k * rows, min(rows, h - k * rows), at) for k, at in enumerate(tags[_OFFSETS])]
    return Layout(w, h, channels, np.dtype(order + kind), runs)


def layout(f, path: str) -> Layout:
    start = f.read(2)
    f.seek(0)
    return _tiff(f, path) if start in (b"II", b"MM") else _netpbm(f, path)


class ByteRanges(InputPartition):
    """Ranges (path, start, end) of bytes."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class RasterReader(DataSourceReader):
    """A task reads ranges of bytes, of each file the header and the rows that begin in a range; ranges of many small files share a task."""

    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("bytesPerPartition", SPLIT))

    def partitions(self):
        found = [(p, at, min(at + self.split, size)) for p, size in files_of(self.path, SUFFIXES) for at in range(0, size, self.split)]
        return [ByteRanges(r) for r in shared(found, lambda r: r[2] - r[1])] or [ByteRanges([])]

    def read(self, part: ByteRanges) -> Iterator[pa.RecordBatch]:
        where, _ = open_fs(self.path)
        for path, ranges in groupby(part.ranges, lambda r: r[0]):
            with where.open_input_file(path) as f:
                size, shape = f.size(), layout(f, path)
                step = shape.row_bytes
                for _, begin, end in ranges:
                    for first, rows, offset in shape.runs:
                        if offset + rows * step > size:
                            raise ValueError(f"{path} ends before its last row")
                        lo, hi = (min(max(-(-(at - offset) // step), 0), rows) for at in (begin, end))
                        band = max(1, BAND // max(shape.width, 1))
                        for at in range(lo, hi, band):
                            n = min(band, hi - at)
                            f.seek(offset + at * step)
                            px = np.frombuffer(f.read(n * step), shape.dtype).reshape(n, shape.width, shape.channels)
                            stored = first + at + np.arange(n)
                            yield self.batch(path, px, shape.height - 1 - stored if shape.upward else stored)

    def batch(self, path: str, px: np.ndarray, ys: np.ndarray) -> pa.RecordBatch:
        n, width, channels = px.shape
        kind = px.dtype.str[1:]
        samples = [px[:, :, min(c, channels - 1)].ravel().astype("f8") for c in range(3)]
        alpha = px[:, :, 3].ravel().astype("f8") if channels == 4 else np.full(n * width, FULL[kind])
        columns = [pa.array(np.repeat(ys, width)), pa.array(np.tile(np.arange(width), n)), *map(pa.array, (samples[2], samples[1], samples[0], alpha))]
        same = lambda v: pa.array([v], pa.string()).dictionary_encode().cast(pa.string()).take(pa.array(np.zeros(n * width, np.int64)))
        return pa.RecordBatch.from_arrays([same(path), *columns, same(kind)], ["path", "y", "x", "b", "g", "r", "a", "kind"])


class RasterSource(DataSource):
    @classmethod
    def name(cls):
        return "raster"

    def schema(self):
        return "path string, y bigint, x bigint, b double, g double, r double, a double, kind string"

    def reader(self, schema):
        return RasterReader(self.options)


def read_samples(spark: SparkSession, path: str, bytes_per_partition: int = SPLIT) -> DataFrame:
    """Samples as they are stored (path, y, x, b, g, r, a, kind) of a picture or a folder of them; kind is u1, u2 or f4.

    One channel gives b, g and r alike; pictures without alpha are opaque. The driver lists the files; headers are read by the
    tasks, and a large picture is read by several of them. Other files are an error, as are compressed ones.
    """
    spark.dataSource.register(RasterSource)
    return spark.read.format("raster").option("bytesPerPartition", str(bytes_per_partition)).load(qualified(spark, path))


def to_fraction(sample: Column, kind: Column) -> Column:
    """Whole samples as shares of their largest value; floats stay."""
    return F.when(kind == "f4", sample).otherwise(sample / F.when(kind == "u1", F.lit(FULL["u1"])).otherwise(F.lit(FULL["u2"])))


def to_depth(sample: Column, kind: Column, depth: str) -> Column:
    """Samples of any kind at another depth: 8 and 16 bits differ by 256, floats by the largest value; rounded to even, cut off at the ends."""
    if depth == "f4":
        return to_fraction(sample, kind)
    other = "u2" if depth == "u1" else "u1"
    factor = F.when(kind == depth, F.lit(1.0)).when(kind == other, F.lit(BETWEEN[other, depth])).otherwise(F.lit(FULL[depth]))
    return F.least(F.greatest(F.rint(sample * factor), F.lit(0.0)), F.lit(FULL[depth])).cast("int")


def read_raster_pixels(spark: SparkSession, path: str, bytes_per_partition: int = SPLIT) -> DataFrame:
    """Pixels as fractions (path, y, x, b, g, r, a), whatever the depth of the picture."""
    px = read_samples(spark, path, bytes_per_partition)
    return px.select("path", "y", "x", *[to_fraction(F.col(c), F.col("kind")).alias(c) for c in "bgra"])
