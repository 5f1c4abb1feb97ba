"""Benchmark decontamination: winnowed fingerprints find shared spans, which are then extended word by word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetab.functions.session import broadcast_if_small
from scenetab.llm.common import ascii_lower, fresh, key128, stored, text_of

# fixed value of the contract: what is a word, after A-Z are lowered
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A window of SPAN words holds SPINE grams of GRAM words; the least of them is the window's fingerprint.
SPAN, GRAM = 13, 8
SPINE = SPAN - GRAM + 1


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORDS), F.lit(0))


def _chain(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _low(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _head(a: Column, n: Column) -> Column:
    return F.slice(a, 1, F.greatest(n, F.lit(0)))


def _tail(a: Column, shift: int, n: Column) -> Column:
    return F.slice(a, shift + 1, F.greatest(n, F.lit(0)))


def _marked(length: int):
    return lambda x, i: F.struct(F.xxhash64(x, F.lit(length)).alias("_fp"), i.alias("_at"))


def _pair(a: str, b: str, shift: int, fn) -> Column:
    """fn(a[i], b[i + shift]) for every i where both exist; a is at least as long as that."""
    n = F.size(b) - shift
    return F.zip_with(_head(F.col(a), n), _tail(F.col(b), shift, n), fn)


def _short(length: int) -> Column:
    """Hashes of all grams of ``length`` words, from grams of 1, 2, 4 and 8 words."""
    top = 1 << (length.bit_length() - 1)
    if top == length:
        return F.col(f"_g{top}")
    rest = _short(length - top)
    n = F.size(rest) - top
    return F.zip_with(_head(F.col(f"_g{top}"), n), _tail(rest, top, n), _chain)


def _fingerprints(df: DataFrame, keys: list[str], lengths: list[int], whole: bool) -> DataFrame:
    """(keys, _n, _fp, _at): winnowed grams of texts of SPAN words or more, and grams of the given shorter lengths.

    ``whole`` takes a shorter gram only where it is the whole text. Each step is a column of its own, since the next one
    reads it more than once.
    """
    df = df.select(*keys, F.size("_w").alias("_n"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_g1"))
    grams = ["_g1"]
    for k in (1, 2, 4):
        df = df.select(*keys, "_n", *(grams if lengths else grams[-1:]), _pair(f"_g{k}", f"_g{k}", k, _chain).alias(f"_g{2 * k}"))
        grams.append(f"_g{2 * k}")
    shorter = grams[:-1] if lengths else []
    rest = [*keys, "_n", *shorter, "_g8"]
    df = df.select(*rest, _pair("_g8", "_g8", 1, _low).alias("_m2"))
    df = df.select(*rest, "_m2", _pair("_m2", "_m2", 2, _low).alias("_m4"))
    df = df.select(*rest, _pair("_m4", "_m2", 4, _low).alias("_m"))

    # a window counts if its least gram differs from the last window's, or the last window's has just left
    def begins(i):
        return (i == 0) | (F.get("_m", i) != F.get("_m", i - 1)) | (F.get("_g8", i - 1) == F.get("_m", i - 1))

    def least_gram(i):
        at = i + F.array_position(F.slice("_g8", i + 1, SPINE), F.get("_m", i)).cast("int") - 1
        return F.struct(F.get("_m", i).alias("_fp"), at.alias("_at"))

    starts = F.when(F.size("_m") > 0, F.filter(F.sequence(F.lit(0), F.size("_m") - 1), begins)).otherwise(F.array().cast("array<int>"))
    found = [F.transform(starts, least_gram)]
    for length in lengths:
        some = F.transform(_short(length), _marked(length))
        empty = F.array().cast("array<struct<_fp:bigint,_at:int>>")
        found.append(F.when(F.col("_n") == length, some).otherwise(empty) if whole else some)
    return df.select(*keys, "_n", F.inline(F.concat(*found) if lengths else found[0]))


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: (id_col, n_words, n_hit, item_ids, contaminated).

    A word is hit if it lies in any 13 consecutive words of an item (or the whole of a shorter item) that occur in the
    document; ``item_ids`` are those items' ids as strings, sorted; a document is contaminated if a twentieth of its words
    or more is hit. Null and empty texts have no words and are clean; items without words never occur; an item without id
    hits but isn't named; repeated items count once and repeated documents get the same answer; with no items every
    document is clean; other columns are ignored.

    Winnowing keeps, of every 13-word window, the least of its six 8-word grams, so whatever 13 words two texts share, they
    share a fingerprint at the same place in it. Items shorter than that are looked up by the hash of the whole item. A
    hit is only a candidate: the texts are compared word by word along its diagonal, and runs of 13 equal words count.
    Fingerprints of items are broadcast if counted small. Only documents with a hit are read again.
    """
    items = bench.select(F.col(item_col).alias("_item"), _words(text_of(item_text_col)).alias("_w")).where(F.size("_w") > 0).dropDuplicates()
    items = stored(items.select(F.xxhash64("_item", "_w").alias("_ik"), "_item", "_w"), "items")
    lengths = sorted(r[0] for r in items.select(F.size("_w").alias("n")).where(F.col("n") < SPAN).distinct().collect())  # at most 12 numbers
    marks = stored(_fingerprints(items, ["_ik"], lengths, True).withColumnRenamed("_at", "_iat").withColumnRenamed("_n", "_in"), "marks")
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    keyed = base.select("_id", *key128(F.col("_id"), F.col("_text")), _words(F.col("_text")).alias("_w"))
    hits = (
        _fingerprints(keyed, ["_k1", "_k2"], lengths, False)
        .join(broadcast_if_small(marks), "_fp")
        .select("_k1", "_k2", "_ik", "_in", (F.col("_at") - F.col("_iat")).alias("_shift"))
        .distinct()
    )
    hits = stored(hits, "hits")
    wanted = hits.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("_ik", "_in", "_shift")).alias("_hits"))
    found = keyed.drop("_id").join(broadcast_if_small(wanted), ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])

    def segment(h):
        lo = F.greatest(h["_shift"], F.lit(0))
        n = F.least(h["_shift"] + h["_in"], F.size("_w")) - lo
        return F.struct(h["_ik"].alias("_ik"), (lo - h["_shift"]).alias("_from"), lo.alias("_lo"), F.least(h["_in"], F.lit(SPAN)).alias("_need"), F.slice("_w", lo + 1, n).alias("_seg"))

    parts = found.select("_k1", "_k2", F.inline(F.transform("_hits", segment)))
    sides = parts.join(broadcast_if_small(items.withColumnRenamed("_w", "_iw")), "_ik")
    equal = F.zip_with("_seg", F.slice("_iw", F.col("_from") + 1, F.size("_seg")), lambda a, b: a == b)
    breaks = F.filter(F.transform(equal, lambda x, i: F.when(~x, i)), lambda i: i.isNotNull())
    ends = sides.select("_k1", "_k2", "_item", "_lo", "_need", F.concat(F.array(F.lit(-1)), breaks, F.array(F.size("_seg"))).alias("_b"))
    runs = F.zip_with(_head(F.col("_b"), F.size("_b") - 1), _tail(F.col("_b"), 1, F.size("_b") - 1), lambda p, q: F.struct((p + 1).alias("s"), q.alias("e")))
    runs = ends.select("_k1", "_k2", "_item", "_lo", F.inline(F.filter(runs, lambda r: r["e"] - r["s"] >= F.col("_need"))))
    runs = runs.select("_k1", "_k2", "_item", (F.col("_lo") + F.col("s")).alias("s"), (F.col("_lo") + F.col("e")).alias("e"))
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("s", "e"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, r: F.struct(F.greatest(a["end"], r["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(r["s"], a["end"]))).alias("n")),
        lambda a: a["n"],
    )
    per_doc = runs.groupBy("_k1", "_k2").agg(covered.alias("_hit"), F.array_sort(F.collect_set(F.col("_item").cast("string"))).alias("_items"))
    counted = base.select("_id", *key128(F.col("_id"), F.col("_text")), F.size(_words(F.col("_text"))).cast("bigint").alias("n_words"))
    n_hit = F.coalesce(F.col("_hit"), F.lit(0)).cast("bigint")
    return counted.join(per_doc, ["_k1", "_k2"], "left").select(
        F.col("_id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated.

    Null and empty texts are clean and stay, whatever their id; repeated rows stay or go together; texts of any length are compared as a
    whole; without items all rows stay; an empty table stays empty; columns that are named like those of this module are kept.
    """
    names, row = docs.columns, fresh(docs, "_row")
    keyed = docs.withColumn(row, F.struct(*key128(F.col(id_col), text_of(text_col))))
    verdict = contamination(keyed, bench, row, text_col, item_col, item_text_col)
    bad = stored(verdict.where("contaminated").select(row).distinct(), "contaminated")
    return keyed.join(broadcast_if_small(bad), row, "left_anti").select(*names)
