"""Helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetab.functions.session import scratch_path

# fixed values of the contracts: the white space stripped and split at, and the letters that are lower-cased
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A key with more than this share of all rows is hot; there can be no more hot keys than its inverse.
HOT_SHARE = 4096


def text_of(col: str) -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII takes the engine's fast path."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def key128(*cols: Column, names: tuple[str, str] = ("_k1", "_k2")) -> list[Column]:
    """Two independent 64-bit hashes of the same columns, together a 128-bit key."""
    return [F.xxhash64(*cols).alias(names[0]), F.xxhash64(F.lit(1), *cols).alias(names[1])]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and go on from the files, so that several uses (and retries) see the same rows.

    The files are deleted when the session's file system closes.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    path = scratch_path(spark, name)
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def hot_part(keys: DataFrame, count: str) -> tuple[DataFrame, DataFrame]:
    """Split a table with one row per key and its row count into (hot, rest).

    A key is hot if it has more than 1/HOT_SHARE of all counted rows, so the hot part has fewer than HOT_SHARE rows and
    may be broadcast; no key of the rest is large enough to make a shuffle uneven.
    """
    total = keys.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_SHARE > F.lit(total)
    return keys.where(hot), keys.where(~hot)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
