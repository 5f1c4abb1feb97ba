"""Files of many tasks and pictures of any depth against plain readers and writers."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenetab.sources import clouds, files, rasters


def test_point_files_are_the_bytes_of_all_points(spark, tmp_path):
    n = 10_000
    points = spark.range(n, numPartitions=7).select("id", *[(F.col("id") * k + 0.25).alias(c) for k, c in enumerate("xyz", 1)], *[(F.col("id") % 256 / 255).alias(c) for c in "rgb"])
    assert clouds.write_point_files(points, f"{tmp_path}/one") == 1
    want = b"".join(struct.pack("<fffBBB", i + 0.25, 2 * i + 0.25, 3 * i + 0.25, *[int(i % 256 / 255 * 255)] * 3) for i in range(n))
    assert (tmp_path / "one/points.bin").read_bytes() == struct.pack("<i", n) + want
    assert [p.name for p in (tmp_path / "one").iterdir() if not p.name.startswith(".")] == ["points.bin"]
    back = clouds.read_point_bin(spark, f"{tmp_path}/one", 999)
    assert back.rdd.getNumPartitions() > 1 and back.count() == n and back.select("x").distinct().count() == n
    with pytest.raises(FileExistsError):
        clouds.write_point_files(points, f"{tmp_path}/one")


def test_files_by_key_small_and_large(spark, tmp_path):
    """One key has most of the rows and is written by several tasks, others share a task."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 < 8, F.lit("big")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("f"), "id")
    rows = rows.repartition(5).withColumn("value", F.concat(F.lit("row "), F.col("id").cast("string")))
    ordered = files.in_order(rows, "f", "id")
    assert files.write_files(ordered, f"{tmp_path}/out", "f", files.lines_of(), lambda n: f"# {n}\n".encode()) == 11
    for p in (tmp_path / "out").iterdir():
        if p.name.startswith("."):
            continue
        ids = [i for i in range(20_000) if (p.name == "big") == (i % 10 < 8) and (p.name == "big" or p.name == f"k{i % 50}")]
        assert p.read_text() == f"# {len(ids)}\n" + "".join(f"row {i}\n" for i in ids)


def test_no_rows_make_no_files(spark, tmp_path):
    assert files.write_files(spark.createDataFrame([], "f string, value string"), f"{tmp_path}/none", "f", files.lines_of()) == 0


def _read(spark, path, split):
    rows = rasters.read_samples(spark, str(path), split).collect()
    out = {}
    for r in rows:
        out.setdefault(r["path"].split("/")[-1], {})[r["y"], r["x"]] = (r["b"], r["g"], r["r"], r["a"], r["kind"])
    assert len(rows) == sum(map(len, out.values()))
    return out


def _tiff(px, order, strip):
    """Rows in strips that are not stored in order, tags before the data."""
    h, w, c = px.shape
    kind = {"u1": (8, 1), "u2": (16, 1), "f4": (32, 3)}[px.dtype.str[1:]]
    strips = [px[y : y + strip].tobytes() for y in range(0, h, strip)]
    p = lambda f, *v: struct.pack(order + f, *v)
    n = 9
    at = 8 + 2 + 12 * n + 4
    extra, entries = b"", []
    for tag, code, values in ((256, "I", [w]), (257, "H", [h]), (258, "H", [kind[0]] * c), (259, "H", [1]), (273, "I", None), (277, "H", [c]), (278, "H", [strip]), (284, "H", [1]), (339, "H", [kind[1]] * c)):
        entries.append([tag, code, values])
    sizes = {"H": 2, "I": 4}
    room = sum(sizes[code] * len(v or strips) for _, code, v in entries if sizes[code] * len(v or strips) > 4)
    offsets, pos = [0] * len(strips), at + room
    for k in reversed(range(len(strips))):
        offsets[k], pos = pos, pos + len(strips[k])
    out = b""
    for tag, code, values in entries:
        values = offsets if values is None else values
        data = p(f"{len(values)}{code}", *values)
        if len(data) > 4:
            out += p("HHII", tag, {"H": 3, "I": 4}[code], len(values), at + len(extra))
            extra += data
        else:
            out += p("HHI", tag, {"H": 3, "I": 4}[code], len(values)) + data.ljust(4, b"\0")
    return {"<": b"II", ">": b"MM"}[order] + p("HI", 42, 8) + p("H", n) + out + p("I", 0) + extra + b"".join(strips[::-1])


@pytest.mark.parametrize("split", [1 << 25, 97])
def test_pictures_of_every_depth(spark, tmp_path, split):
    rng = np.random.default_rng(4)
    want = {}

    def put(name, px, head=b"", tail=None, flip=False):
        (tmp_path / name).write_bytes(tail if tail is not None else head + (px[::-1] if flip else px).tobytes())
        kind = px.dtype.str[1:]
        full = {"u1": 255.0, "u2": 65535.0, "f4": 1.0}[kind]
        h, w, c = px.shape
        want[name] = {(y, x): (*[float(px[y, x, min(k, c - 1)]) for k in (2, 1, 0)], float(px[y, x, 3]) if c == 4 else full, kind) for y in range(h) for x in range(w)}

    put("a.pgm", rng.integers(0, 65536, (5, 7, 1)).astype(">u2"), b"P5\n# two\n# remarks\n7 5\n65535\n")
    put("b.ppm", rng.integers(0, 256, (4, 3, 3)).astype("u1"), b"P6 3 4 255\n")
    put("c.pfm", rng.normal(0, 9, (6, 2, 3)).astype("<f4"), b"PF\n2 6\n-1.0\n", flip=True)
    put("d.pfm", rng.normal(0, 9, (3, 5, 1)).astype(">f4"), b"Pf\n5 3\n1.0\n", flip=True)
    for k, (kind, c, order, strip) in enumerate([("u1", 1, "<", 3), ("u2", 3, ">", 2), ("u2", 4, "<", 100), ("f4", 1, ">", 1), ("f4", 3, "<", 4)]):
        values = rng.random((5, 4, c)) if kind == "f4" else rng.integers(0, 256 if kind == "u1" else 65536, (5, 4, c))
        px = values.astype(("" if kind == "u1" else order) + kind)
        put(f"e{k}.{'tif' if k % 2 else 'TIFF'}", px, tail=_tiff(px, order, strip))
    assert _read(spark, tmp_path, split) == want
    assert _read(spark, tmp_path / "a.pgm", split)["a.pgm"] == want["a.pgm"]


@pytest.mark.parametrize(
    "name,data",
    [("a.pgm", b"P2\n1 1\n255\n0"), ("b.pgm", b"P5\n1 1\n1023\n00"), ("c.ppm", b"P6\n9 9\n255\n0"), ("d.tif", b"II" + struct.pack("<HI", 43, 8)), ("e.tif", b"II" + struct.pack("<HIH", 42, 8, 3) + b"".join(struct.pack("<HHII", t, 3, 1, v) for t, v in ((256, 1), (257, 1), (259, 5))))],
)
def test_other_pictures_are_an_error(spark, tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    with pytest.raises(Exception, match=name):
        rasters.read_samples(spark, str(tmp_path)).collect()


def test_conversion_between_depths(spark):
    rows = [(0.0, "u1"), (255.0, "u1"), (128.0, "u1"), (65535.0, "u2"), (128.0, "u2"), (384.0, "u2"), (0.5, "f4"), (2.0, "f4"), (-1.0, "f4")]
    v, k = F.col("v"), F.col("k")
    got = spark.createDataFrame(rows, "v double, k string").select(rasters.to_depth(v, k, "u1").alias("a"), rasters.to_depth(v, k, "u2").alias("b"), rasters.to_fraction(v, k).alias("c"))
    assert [tuple(r)[:2] for r in got.collect()] == [(0, 0), (255, 65280), (128, 32768), (255, 65535), (0, 128), (2, 384), (128, 32768), (255, 65535), (0, 0)]
