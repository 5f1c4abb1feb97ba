"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetab.functions.session import broadcast_if_small
from scenetab.llm.common import WORD, stored, text_of

MASK = (1 << 52) - 1
SEEDS = 32


def _digest(id_col: str, text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), text_of(text_col))))


def _hex(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 13), 16, 10).cast("bigint")


def _draw(seed: Column | int) -> Column:
    """A number in [0, 1) for each seed: two 52-bit halves of one digest, the second taken as often as the seed says."""
    k = seed if isinstance(seed, Column) else F.lit(seed)
    return (F.col("_mix_a") + F.col("_mix_b") * k.cast("bigint")).bitwiseAND(F.lit(MASK)) / F.lit(float(MASK + 1))


def _copies(base: Column, frac: Column, seed: Column | int, limit: float) -> Column:
    return F.least(base + F.when(_draw(seed) < frac, 1).otherwise(0), F.lit(int(limit)))


def mixing_plan(docs: DataFrame, weights: list[float], share: float = 1.0, limit: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rates, sized): one row per source with its target and repetition rate; one narrow row per document.

    Sources in code-point order, null last, take ``weights`` in turn and share ``share`` of all words by weight; a target
    stops at ``limit`` times its source's words and the rest goes to the others by weight. With sources ordered by the level
    at which they stop, that is the first level which the remaining words can't lift past the next source's limit.

    A document is taken floor(rate) times and once more if its draw is below the rate's fraction. Of 32 seeds each source
    uses the one whose draws bring its words nearest to the target, so that few or very uneven documents do not miss it by
    chance; all seeds are judged in the same pass over narrow rows.
    """
    digest = _digest(id_col, text_col)
    sized = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint").alias("size"), digest.alias("_d")
    ).select("_id", "_source", "size", _hex(F.col("_d"), 1).alias("_mix_a"), _hex(F.col("_d"), 14).alias("_mix_b"))
    sized = stored(sized, "mix")
    # one row per source from here on
    names = Window.partitionBy().orderBy(F.col("_source").asc_nulls_last())
    order = Window.partitionBy().orderBy("_stop", "_nth")
    sources = sized.groupBy("_source").agg(F.sum("size").alias("source_size")).withColumn("_nth", F.row_number().over(names) - 1)
    sources = (
        sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_nth") % len(weights) + 1).cast("int")))
        .withColumn("_stop", F.lit(limit) * F.col("source_size") / F.col("weight"))
        .withColumn("_all", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
        .withColumn("_stopped", F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(limit))
        .withColumn("_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") - F.col("_stopped")) / F.col("_left"))
        .withColumn("_level", F.first(F.when(F.col("_level") * F.col("weight") <= F.lit(limit) * F.col("source_size"), F.col("_level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.least(F.lit(limit) * F.col("source_size"), F.coalesce(F.col("_level") * F.col("weight"), F.lit(limit) * F.col("source_size"))))
        .withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("_base", F.floor("_rate").cast("int"))
        .withColumn("_frac", F.col("_rate") - F.col("_base"))
    )
    sources = stored(sources.select("_source", "weight", "source_size", "target", "_base", "_frac"), "sources")
    tried = sized.join(broadcast_if_small(sources.select(F.col("_source").alias("_s"), "_base", "_frac")), F.col("_source").eqNullSafe(F.col("_s")))
    tried = tried.groupBy("_source").agg(*[F.sum(F.col("size") * _copies(F.col("_base"), F.col("_frac"), k, limit)).alias(f"_t{k}") for k in range(SEEDS)])
    miss = [F.struct(F.abs(F.col(f"_t{k}") - F.col("target")).alias("miss"), F.lit(k).alias("seed")) for k in range(SEEDS)]
    rates = (
        sources.join(tried.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")))
        .withColumn("_seed", F.array_min(F.array(*miss))["seed"])
        .select("_source", "weight", "source_size", "target", "_base", "_frac", "_seed")
    )
    return stored(rates, "rates"), sized


def mix_sizes(docs: DataFrame, weights: list[float], share: float = 1.0, limit: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: (id_col, size, source_size, target, copies, taken), without moving any text.

    Null and empty texts have size 0 and are taken like any other; a null source is a source of its own, the last one;
    rows that repeat an id share its draw (without id: its text's); an empty table gives an empty result; other columns
    are ignored. Sources are one row each and go through one task; the table of rates is broadcast only if counted small.
    """
    rates, sized = mixing_plan(docs, weights, share, limit, id_col, text_col, source_col)
    both = sized.join(broadcast_if_small(rates.withColumnRenamed("_source", "_s")), F.col("_source").eqNullSafe(F.col("_s")))
    copies = _copies(F.col("_base"), F.col("_frac"), F.col("_seed"), limit)
    return both.select(F.col("_id").alias(id_col), "size", "source_size", "target", copies.cast("bigint").alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, weights: list[float], share: float = 1.0, limit: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: every row of ``docs``, with all its columns, as often as the mix takes it.

    Null and empty texts have size 0 and are taken like any other row; a null source is a source of its own, the last one; rows that
    repeat an id share its draw (without id: its text's), equal rows are each taken so often; sizes count whole texts; an empty table
    stays empty; columns that are named like those of this module are kept.
    """
    rates, _ = mixing_plan(docs, weights, share, limit, id_col, text_col, source_col)
    rates = rates.select(F.col("_source").alias("_s"), "_base", "_frac", "_seed")
    # the row travels as one column, so its names can't clash with these
    rows = docs.select(F.struct("*").alias("_row"), F.col(source_col).alias("_source"), _digest(id_col, text_col).alias("_d"))
    rows = rows.select("_row", "_source", _hex(F.col("_d"), 1).alias("_mix_a"), _hex(F.col("_d"), 14).alias("_mix_b"))
    both = rows.join(broadcast_if_small(rates), F.col("_source").eqNullSafe(F.col("_s"))).drop("_source", "_s")
    copies = _copies(F.col("_base"), F.col("_frac"), F.col("_seed"), limit)
    return both.select("_row", F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy")).select("_row.*")
