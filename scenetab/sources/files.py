"""Whole files of any size written by many tasks: tasks write segments, whose places in the files follow from their sizes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenetab.functions.session import cut_lineage
from scenetab.sources.paths import open_fs, qualified

COPY = 1 << 24
# bytes a task holds before it writes them
HELD = 1 << 24


def lines_of(column: str = "value") -> Callable[[pa.RecordBatch], bytes]:
    """Rows as lines of text."""

    def pack(batch: pa.RecordBatch) -> bytes:
        return "".join(f"{v}\n" for v in batch.column(column).to_pylist()).encode()

    return pack


def _segments(folder: str, name: str, pack: Callable[[pa.RecordBatch], bytes]):
    """Write the rows of a task into one file of segments; pass on where the segments of each file name are.

    Rows of several names may be mixed: a task gathers them by name and writes a segment for each name whenever it holds HELD bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = open_fs(folder)
        task = TaskContext.get()
        part = task.partitionId()
        # a name that no other attempt has
        path = f"{root}/{part}-{task.taskAttemptId()}"
        done, held, size, out, written = [], {}, 0, None, 0

        def flush():
            nonlocal held, size, out, written
            for now, (rows, pieces) in held.items():
                out = out or where.open_output_stream(path)
                data = b"".join(pieces)
                out.write(data)
                done.append((now, part, len(done), path, written, rows, len(data)))
                written += len(data)
            held, size = {}, 0

        for batch in batches:
            if not batch.num_rows:
                continue
            codes, names = pd.factorize(np.array(batch.column(name).to_pylist(), object), use_na_sentinel=False)
            if len(names) > 1:
                batch = batch.take(pa.array(np.argsort(codes, kind="stable")))
            at = 0
            for now, n in zip(names, np.bincount(codes).tolist()):
                data = pack(batch.slice(at, n))
                rows, pieces = held.setdefault(None if pd.isna(now) else now, (0, []))
                pieces.append(data)
                held[None if pd.isna(now) else now] = (rows + n, pieces)
                at, size = at + n, size + len(data)
            if size >= HELD:
                flush()
        flush()
        if out is not None:
            out.close()
        columns = zip(*done) if done else [[]] * 7
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([*c], k) for c, k in zip(columns, kinds)], ["file", "part", "nth", "segment", "start", "rows", "size"])

    return run


def _assemble(folder: str, head: Callable[[int], bytes] | None):
    """Copy segments to their places; the first one of a file brings its head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = open_fs(folder)
        local = isinstance(where, fs.LocalFileSystem)
        n = 0
        for batch in batches:
            for row in batch.to_pylist():
                top = head(row["total"]) if head else b""
                target = f"{root}/{row['file']}"
                segments = sorted(row["segments"], key=lambda s: s["before"])
                if local:
                    out = os.open(target, os.O_CREAT | os.O_WRONLY, 0o644)
                    if segments[0]["before"] == 0:
                        os.pwrite(out, top, 0)
                    put = lambda data, at: os.pwrite(out, data, at)  # noqa: B023, E731
                else:
                    stream = where.open_output_stream(target)
                    stream.write(top)
                    put = lambda data, at: stream.write(data)  # noqa: B023, E731
                for s in segments:
                    at = len(top) + s["before"]
                    left = s["size"]
                    with where.open_input_file(s["segment"]) as f:
                        f.seek(s["start"])
                        while left:
                            data = f.read(min(left, COPY))
                            if not data:
                                raise EOFError(f"{s['segment']} ends before its last segment")
                            put(data, at)
                            at, left = at + len(data), left - len(data)
                os.close(out) if local else stream.close()
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return run


def write_files(rows: DataFrame, path: str, name: str, pack: Callable[[pa.RecordBatch], bytes], head: Callable[[int], bytes] | None = None) -> int:
    """Write one file per value of column ``name`` into folder ``path``; returns the number of files.

    A file holds ``head`` of its number of rows, then its rows packed in the order of the partitions and inside them. So rows that
    are sorted by ranges of (name, order) give ordered files: a task writes many small files, and many tasks write a large one. Names
    may also be mixed in any order.
    Tasks first write their segments under names of their own and report the sizes; running sums give each segment its offset, and
    tasks copy them there. A repeated task writes the same bytes to the same place. Where the file system can't write at an offset, a file is
    streamed by one task. Segments are deleted at the end, and files are complete when the call returns; no rows pass
    through the driver. It is an error if the folder exists.
    """
    spark = rows.sparkSession
    target = qualified(spark, path)
    where, root = open_fs(target)
    if where.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(f"{path} exists")
    parts = f"{target.rstrip('/')}/_segments-{uuid.uuid4().hex[:12]}"
    where.create_dir(open_fs(parts)[1], recursive=True)
    found = cut_lineage(rows.mapInArrow(_segments(parts, name, pack), "file string, part long, nth long, segment string, start long, rows long, size long"))
    # one row per segment; the counts of a file are running sums over its segments
    order = Window.partitionBy("file").orderBy("part", "nth")
    whole = Window.partitionBy("file")
    placed = found.select("file", F.struct((F.sum("size").over(order) - F.col("size")).alias("before"), "segment", "start", "size").alias("segment"), F.sum("rows").over(whole).alias("total"))
    if isinstance(where, fs.LocalFileSystem):
        jobs = placed.select("file", "total", F.array("segment").alias("segments")).repartition("segments")
    else:
        jobs = placed.groupBy("file", "total").agg(F.collect_list("segment").alias("segments"))
    jobs.mapInArrow(_assemble(target, head), "n long").agg(F.sum("n")).first()
    where.delete_dir(open_fs(parts)[1])
    return found.agg(F.countDistinct("file")).first()[0]


def in_order(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` sorted by ranges of (name, order), as ``write_files`` wants them."""
    return rows.repartitionByRange(name, *order).sortWithinPartitions(name, *order)
