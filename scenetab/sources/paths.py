"""File systems and paths as the session sees them, the same in the driver and in every task."""

from __future__ import annotations

import os
import re

from pyarrow import fs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the session's file system, so that tasks don't look for it on their own disk."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(conf).makeQualified(target).toString()
    return re.sub(r"^file:/(?!/)", "file:///", whole)


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"^[a-z0-9+]+:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


# ranges are read by a task each up to this number of tasks; beyond it neighbours share a task up to so many bytes
TASKS, SHARED = 512, 32 << 20


def shared(ranges: list, size_of) -> list[list]:
    """Ranges of bytes in runs, one for each task, so that many small files don't make as many tasks."""
    most, out, held = -(-len(ranges) // TASKS), [], SHARED
    for r in ranges:
        if held + size_of(r) > SHARED or len(out[-1]) >= most:
            out.append([])
            held = 0
        out[-1].append(r)
        held += size_of(r)
    return out


def files_of(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder that end in one of ``suffixes``, by name."""
    where, p = open_fs(path)
    info = where.get_file_info(p)
    if info.type == fs.FileType.File:
        return [(p, info.size)]
    found = where.get_file_info(fs.FileSelector(p))
    return sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.path.lower().endswith(suffixes))
