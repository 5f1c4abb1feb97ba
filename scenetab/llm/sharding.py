"""Sharding: rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetab.functions.session import broadcast_if_small
from scenetab.llm.common import stored, text_of

TOP = float(1 << 52)


def _draw(text: Column) -> Column:
    """The first 52 bits of the text's MD5 as a whole number."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def _cost(key: Column, shard: int, weight: float) -> Column:
    """An exponential waiting time of rate ``weight``; the shard that waits least owns the key."""
    u = (_draw(F.concat(key, F.lit(f":{shard}"))) + F.lit(0.5)) / F.lit(TOP)
    return -F.log(u) / F.lit(float(weight))


def assign_shards(
    docs: DataFrame, weights: list[float], grown: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Per row of ``docs``: (id_col, size, text_crc32, law, shard, slot, grown_shard) and the columns named in ``keep``.

    A row's shard is the one with the least waiting time drawn from (id, shard number) at the shard's weight, so it
    depends on nothing but the id and the weights, and a further shard takes rows only into itself. ``grown_shard`` is the
    shard under ``grown`` (by default the same shards and one more of weight 1). ``slot`` numbers a shard's rows from 0
    without gaps. ``size`` is the text's UTF-8 bytes plus 8. A null text has no bytes and checksum 0; a null id counts as
    the empty key for the shard; repeated rows go to the same shard and take slots of their own; an empty table gives an
    empty result; columns of the input that are not asked for are ignored.

    Slots need no sort of a whole shard: rows are numbered inside 1024 hash ranges of each shard, and the ranges' counts
    (shards x 1024 rows, broadcast) say where each range begins. Null ids are spread over the ranges by their text.
    """
    grown = grown or [*weights, 1.0]
    key = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    costs = {(i, w): F.struct(_cost(key, i, w).alias("c"), F.lit(i).alias("s")) for ws in (weights, grown) for i, w in enumerate(ws)}
    best = lambda ws: F.array_min(F.array(*[costs[i, w] for i, w in enumerate(ws)]))
    extra = [i for i, w in enumerate(grown) if i >= len(weights) or weights[i] != w]
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    placed = base.select(
        F.col("_id"),
        *[f"_keep_{c}" for c in keep],
        (F.octet_length("_text") + 8).cast("bigint").alias("size"),
        F.crc32(F.col("_text").cast("binary")).alias("text_crc32"),
        _draw(F.coalesce(F.col("_id").cast("string"), F.col("_text"))).alias("_place"),
        best(weights).alias("_own"),
        (F.array_min(F.array(*[costs[i, grown[i]] for i in extra])) if grown[: len(weights)] == list(weights) else best(grown)).alias("_new"),
    ).select(
        "_id",
        *[f"_keep_{c}" for c in keep],
        "size",
        "text_crc32",
        "_place",
        F.shiftright("_place", 42).alias("_range"),
        F.col("_own.s").alias("shard"),
        (F.when(F.col("_new") < F.col("_own"), F.col("_new.s")).otherwise(F.col("_own.s")) if grown[: len(weights)] == list(weights) else F.col("_new.s")).alias("grown_shard"),
    )
    placed = stored(placed, "shards")
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n")).select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_range").orderBy("_place", "_id", "text_crc32", "size")
    numbered = placed.withColumn("_nth", F.row_number().over(inside) - 1).join(broadcast_if_small(starts), ["shard", "_range"])
    return numbered.select(
        F.col("_id").alias(id_col),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_start") + F.col("_nth")).cast("bigint").alias("slot"),
        "grown_shard",
    )


def with_shard(docs: DataFrame, weights: list[float], id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the column ``shard`` (in place of one of that name), without moving a row.

    Only the id decides: rows that repeat an id share its shard, and so do all rows without one. Texts are not looked at, null, empty or
    long; an empty table stays empty; other columns are kept. The plan has one hash per shard, so it is meant for some thousand.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.withColumn("shard", F.array_min(F.array(*[F.struct(_cost(key, i, w).alias("c"), F.lit(i).alias("s")) for i, w in enumerate(weights)]))["s"])
