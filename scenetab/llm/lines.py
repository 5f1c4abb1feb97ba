"""Line dedup: lines that occur in many documents are removed everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetab.llm.common import SPACE, ascii_lower, hot_part, key128, stored, text_of


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Per row of ``docs``: (id_col, n_lines, n_dropped, kept).

    Lines are the parts between ``\\n``; a line's key is the line stripped of ASCII white space and with A-Z lowered. A
    key of at least ``min_chars`` code points that occurs in at least ``min_docs`` rows is dropped wherever it stands.
    Each row counts as one document, however often its id or text repeats. A null text is one empty line; an empty table
    gives an empty result; other columns are ignored. Keys are compared by a 128-bit hash.

    One shuffle counts the documents of each key, after a count inside each task. Lines are then looked up: keys with
    more than 1/4096 of the rows by broadcast, the others by a shuffle in which no key is large; lines already decided
    travel under their document's key. Texts move once, to meet the positions they lose.
    """
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    low = F.split(ascii_lower(F.col("_text")), "\n", -1)
    counts = (
        base.select(F.explode(F.array_distinct(F.transform(low, _key))).alias("_key"))
        .where(F.length("_key") >= min_chars)
        .groupBy(*key128(F.col("_key"), names=("_h1", "_h2")))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_docs)
    )
    hot, rest = hot_part(stored(counts, "lines"), "_n")
    lines = (
        base.select(*key128(F.col("_id"), F.col("_text")), F.posexplode(low).alias("_pos", "_line"))
        .select("_k1", "_k2", "_pos", _key(F.col("_line")).alias("_key"))
        .where(F.length("_key") >= min_chars)
        .select("_k1", "_k2", "_pos", *key128(F.col("_key"), names=("_h1", "_h2")))
    )
    flagged = lines.join(F.broadcast(hot.select("_h1", "_h2", F.lit(True).alias("_hot"))), ["_h1", "_h2"], "left")
    flagged = flagged.select(
        "_k1",
        "_k2",
        "_pos",
        "_hot",
        F.when(F.col("_hot"), F.col("_k1")).otherwise(F.col("_h1")).alias("_h1"),
        F.when(F.col("_hot"), F.col("_k2")).otherwise(F.col("_h2")).alias("_h2"),
    )
    lost = (
        flagged.join(rest.select("_h1", "_h2", F.lit(True).alias("_rest")), ["_h1", "_h2"], "left")
        .where(F.col("_hot") | F.col("_rest"))
        .groupBy("_k1", "_k2")
        .agg(F.collect_set("_pos").alias("_lost"))
    )
    whole = base.select("_id", "_text", *key128(F.col("_id"), F.col("_text"))).join(lost, ["_k1", "_k2"], "left")
    whole = whole.withColumn("_lines", F.split("_text", "\n", -1))
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost"))
    kept = F.array_join(F.transform(places, lambda i: F.col("_lines")[i]), "\n")
    return whole.select(
        F.col("_id").alias(id_col),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_lost"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("_lost").isNull(), F.col("_text")).otherwise(kept).alias("kept"),
    )
