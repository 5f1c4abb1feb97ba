"""Phrase collocation mining: pairs of frequency-ranked ids are counted in tiles, frequent pairs are ranked again and extended."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenetab.functions.session import broadcast_if_small
from scenetab.llm.common import stored
from scenetab.llm.tokens import byte_table, runs, texts_of

# the most frequent words or phrases, whose ids every task holds; the others are looked up by a join
HEAD = 1 << 20
# ids along a side of a tile; a tile is counted cell by cell if it has one occurrence for two cells or more
SIDE = 256
# words a task counts before it passes them on, positions of a stream, and positions that are counted together
WORDS, STREAM, TOGETHER = 1 << 19, 1 << 18, 1 << 20
# bytes of streams that pass between the engine and Python at a time; the engine's own bound has a task hold several times 64 MB
BATCH = 8 << 20
# fixed values of the contract: what ends a piece becomes a full stop, a tab a blank
END = b"."
_PIECES = byte_table(b"\t").translate(bytes(46 if b in b".,;:!?\n\v\f\r" else b for b in range(256)))


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of BATCH bytes for the plans that run inside; all that read streams do, since their results are stored."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, BATCH)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)

    def out():
        for lang, found in counts.items():
            del found[END]
            if found:
                words = pa.array([*found], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, pa.array(found.values(), pa.int64())], ["lang", "phrase", "n"])
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
            for words in runs(text, _PIECES, END):
                counts[lang].update(words)
            if sum(map(len, counts.values())) > WORDS:
                yield from out()
    yield from out()


def ranked(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with ``id``: its rank from 0 by falling ``n``, then by keys; stored. Ranges are ranked each for itself."""
    order = [F.desc("n"), *keys]
    dealt = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # one row per range
    offsets = broadcast_if_small(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return stored(dealt.withColumn("_place", place).join(offsets, "_part").withColumn("id", F.col("_before") + F.col("_place") - 1).drop("_part", "_place", "_before"), "ranked")


def tile_counts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x << 31 | y, n) of the different pairs. Crowded tiles have a counter for each cell, the pairs of all others are sorted."""
    cells = SIDE * SIDE
    wide = int(y.max(initial=0)) // SIDE + 1
    tile = (x // SIDE).astype(np.int64) * wide + y // SIDE
    numbers, where, held = np.unique(tile, return_inverse=True, return_counts=True)
    dense = np.flatnonzero(held * 2 >= cells)
    slot = np.full(len(numbers), -1)
    slot[dense] = np.arange(len(dense))
    slot = slot[where]
    inside = slot >= 0
    count = np.bincount(slot[inside] * cells + (x[inside] % SIDE) * SIDE + y[inside] % SIDE, minlength=0)
    cell = np.flatnonzero(count)
    corner, at = numbers[dense][cell // cells], cell % cells
    code = np.sort((x[~inside].astype(np.int64) << 31) | y[~inside])
    begins = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    rest = code[begins]
    found = ((corner // wide * SIDE + at // SIDE) << 31) | (corner % wide * SIDE + at % SIDE)
    return np.r_[found, rest], np.r_[count[cell], np.diff(np.r_[begins, len(code)])]


def _arrays(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    for row in batch.column(name):
        yield row.values.to_numpy()


def _after(w: np.ndarray, k: int) -> np.ndarray:
    """The word k places on, -1 beyond the end."""
    return np.r_[w[k:], np.full(min(k, len(w)), -1, w.dtype)]


def _count_pairs(k: int):
    """Counts of (phrase of k words, next word), as many streams at a time as make TOGETHER positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, size = [], [], 0

        def out():
            found = tile_counts(np.concatenate(xs), np.concatenate(ys))
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1].astype(np.int32))], ["code", "n"])

        for batch in batches:
            for w, s in zip(_arrays(batch, "w"), _arrays(batch, "s" if k > 1 else "w")):
                y = _after(w, k)
                both = (s >= 0) & (y >= 0)
                xs.append(s[both]), ys.append(y[both])
                size += len(xs[-1])
                if size >= TOGETHER:
                    yield out()
                    xs, ys, size = [], [], 0
        if size:
            yield out()

    return run


def _gist(w: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """The positions that longer phrases need: those of known phrases of k words and the k words behind."""
    known = s >= 0
    keep = known.copy()
    for j in range(1, k + 1):
        keep[j:] |= known[:-j]
    return keep


def _row(key: int, w: np.ndarray, s: np.ndarray | None, opened: list | None, kind: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array([key], pa.int64()), pa.array([w.astype(np.int32)], pa.list_(pa.int32()))]
    names = ["key", "w"]
    if s is not None:
        columns.append(pa.array([s.astype(np.int32)], pa.list_(pa.int32())))
        names.append("s")
    return pa.RecordBatch.from_arrays([*columns, pa.array([opened], pa.list_(kind))], [*names, "open"])


_WORD_OPEN = pa.struct([("at", pa.int32()), ("lang", pa.string()), ("phrase", pa.binary())])
_PAIR_OPEN = pa.struct([("at", pa.int32()), ("x", pa.int64()), ("y", pa.int64())])


def _streams(head: Broadcast, tail: bool):
    """Texts as streams of word ids: -1 at ends of pieces and at words without id. ``open``: words that the tail may know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, opened, size = head.value, [], [], 0
        key = TaskContext.get().partitionId() << 31

        def out():
            w = np.concatenate(held)
            if not tail:
                w = w[np.r_[True, (w[1:] >= 0) | (w[:-1] >= 0)]]
            return _row(key, w, None, opened, _WORD_OPEN)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
                get = ids.get(lang, {}).get
                for words in runs(text, _PIECES, END):
                    w = np.array([get(x, -1) for x in words], np.int32)
                    if tail:
                        opened += [{"at": size + i, "lang": lang, "phrase": words[i]} for i in np.flatnonzero(w < 0).tolist() if words[i] != END]
                    held.append(w)
                    size += len(w)
                held.append(np.full(1, -1, np.int32))
                size += 1
                if size >= STREAM:
                    yield out()
                    held, opened, size, key = [], [], 0, key + 1
        if held:
            yield out()

    return run


def _extend(head: Broadcast, k: int, tail: bool):
    """Streams with the id of the phrase of k + 1 words at every position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, ids = head.value
        for batch in batches:
            for key, w, s in zip(batch.column("key").to_pylist(), _arrays(batch, "w"), _arrays(batch, "s" if k > 1 else "w")):
                y = _after(w, k)
                code = np.where((s >= 0) & (y >= 0), (s.astype(np.int64) << 31) | y, -1)
                at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
                hit = (code >= 0) & (codes[at] == code) if len(codes) else code < -1
                found = np.where(hit, ids[at] if len(codes) else -1, -1).astype(np.int32)
                opened = None
                if tail:
                    opened = [{"at": i, "x": int(s[i]), "y": int(y[i])} for i in np.flatnonzero((code >= 0) & ~hit).tolist()]
                else:
                    keep = _gist(w, found, k + 1)
                    w, found = w[keep], found[keep]
                yield _row(key, w, found, opened, _PAIR_OPEN)

    return run


def _fill(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled = []
            for values, found in zip(_arrays(batch, column), batch.column("found").to_pylist()):
                values = values.copy()
                for f in found or ():
                    values[f["at"]] = f["id"]
                filled.append(values)
            rest = [n for n in batch.schema.names if n not in (column, "found")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(filled, pa.list_(pa.int32()))], [*rest, column])

    return run


def _looked_up(rows: DataFrame, tail: DataFrame, on: list[str], column: str) -> DataFrame:
    """Give the open places of each stream their ids, by a join with the ids that tasks don't hold."""
    rows = stored(rows, "open")
    places = rows.select("key", F.inline("open")).join(tail.select(*on, "id"), on)
    found = places.groupBy("key").agg(F.collect_list(F.struct("at", F.col("id").cast("int").alias("id"))).alias("found"))
    rest = rows.drop("open").join(found, "key", "left")
    kept = [c for c in rows.columns if c not in ("open", column)]
    schema = ", ".join("key long" if c == "key" else f"{c} array<int>" for c in [*kept, column])
    return rest.select(*kept, column, "found").mapInArrow(_fill(column), schema)


def _longer(counts: DataFrame, level: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of the next level from its counted pairs: (lang, id, phrase, rest, a, heads, tails).

    ``heads`` are the counts of the first 1, 2, ... words, ``tails`` those of what follows them. What follows the first word is
    as frequent as the whole at least, so it is a phrase of the level before.
    """
    one = level.select(F.col("id").alias("x"), "lang", "phrase", "rest", "heads", "a")
    two = words.select(F.col("id").alias("y"), F.col("phrase").alias("word"))
    rows = counts.join(broadcast_if_small(one), "x").join(broadcast_if_small(two), "y")
    rows = rows.select(
        "lang", "id", F.concat_ws(" ", "phrase", "word").alias("phrase"),
        F.concat_ws(" ", "rest", "word").alias("rest"), F.col("n").alias("a"), F.concat("heads", F.array("a")).alias("heads"),
    )
    behind = level.select("lang", F.col("phrase").alias("rest"), F.concat(F.array("a"), "tails").alias("tails"))
    return stored(rows.join(broadcast_if_small(behind), ["lang", "rest"]), "phrases")


# products may pass 64 bits, so they are decimals of up to 38 digits
_CUT = """array_min(transform(heads, (l, i) -> struct(
CAST((2000000 * CAST(a AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) + CAST(tails[i] AS DECIMAL(19, 0))) AS BIGINT) AS score, i AS cut, l AS l, tails[i] AS r)))"""
_COVERED = "100 * CAST(most AS DECIMAL(19, 0)) >= {} * CAST(a AS DECIMAL(19, 0))"


def _levels(docs: DataFrame, longest: int, least: int, lang_col: str, text_col: str, head: int) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases of 2, 3, ... words, and the words of each language; all of it stored."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    context = docs.sparkSession.sparkContext
    counted = stored(rows.mapInArrow(_count_words, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "words")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    symbols = ranked(counted.where(F.col("n") >= least), "lang", "phrase")
    none = F.array().cast("array<bigint>")
    words = level = symbols.select("lang", "id", "phrase", F.lit(None).cast("string").alias("rest"), F.col("n").alias("a"), none.alias("heads"), none.alias("tails"))
    known: dict = defaultdict(dict)
    found = symbols.where(F.col("id") < head).select("lang", F.col("phrase").cast("binary").alias("phrase"), "id").toArrow()
    for lang, word, i in zip(*(found.column(c).to_pylist() for c in ("lang", "phrase", "id"))):
        known[lang][word] = i
    tail = symbols.where(F.col("id") >= head)
    more = not tail.isEmpty()
    streams = rows.mapInArrow(_streams(context.broadcast(dict(known)), more), "key long, w array<int>, open array<struct<at: int, lang: string, phrase: binary>>")
    if more:
        streams = _looked_up(streams, tail.withColumn("phrase", F.col("phrase").cast("binary")), ["lang", "phrase"], "w")
    streams = stored(streams, "streams")
    levels = []
    for k in range(1, longest):
        pairs = streams.mapInArrow(_count_pairs(k), "code long, n int").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        pairs = pairs.select(F.shiftright("code", 31).alias("x"), F.col("code").bitwiseAND((1 << 31) - 1).alias("y"), "n")
        symbols = ranked(pairs, "x", "y")
        level = _longer(symbols, level, words)
        levels.append(level.withColumn("k", F.lit(k + 1)))
        if k + 1 < longest:
            few = symbols.where(F.col("id") < head).select((F.shiftleft("x", 31) + F.col("y")).alias("code"), "id").toArrow()
            codes, ids = (few.column(c).to_numpy() for c in ("code", "id"))
            order = np.argsort(codes)
            tail = symbols.where(F.col("id") >= head)
            more = not tail.isEmpty()
            symbol = context.broadcast((codes[order], ids[order].astype(np.int32)))
            streams = streams.mapInArrow(_extend(symbol, k, more), "key long, w array<int>, s array<int>, open array<struct<at: int, x: long, y: long>>")
            streams = stored(_looked_up(streams, tail, ["x", "y"], "s") if more else streams, "streams")
    return levels, totals


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, cover: int = 80, top: int = 2000, lang_col: str = "lang", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Per language its first ``top`` phrases of 2 to ``longest`` words: (lang, rank, phrase, a, l, r, n, score).

    ``a`` is the number of times the phrase stands inside a piece of text, ``least`` or more; ``n`` the language's words. The
    score of a cut into two parts that stand l and r times is floor(2000000 * a / (l + r)); the lowest-scoring cut counts, of equal
    ones the first. Phrases inside a longer one that has ``cover`` percent of their number or more are dropped. Order: score,
    a, then the phrase's bytes. A null language is ``und``, a null or empty text has no words; repeated rows count each time;
    an empty table gives an empty result; other columns are ignored.

    A part of a frequent phrase is frequent, so level after level grows from the one before: words are counted and ranked by
    frequency, texts become streams of ids, and pairs of (phrase, next word) are counted in tiles of ids, first in each task.
    Frequent pairs are ranked and become the symbols of the next level. Tasks hold the ids of the ``head`` most frequent
    symbols; beyond these, open places of the streams are looked up by a join. Every level is stored.
    """
    with _small_batches(docs.sparkSession):
        levels, totals = _levels(docs, longest, least, lang_col, text_col, head)
    phrases = levels[0]
    for other in levels[1:]:
        phrases = phrases.unionByName(other)
    phrases = phrases.withColumn("cut", F.expr(_CUT)).select("lang", "phrase", "k", "a", "cut.score", "cut.l", "cut.r")
    parts = [F.struct(F.lit(at).alias("at"), F.lit(size).alias("size"), F.lit(k).alias("of")) for k in range(3, longest + 1) for size in range(2, k) for at in range(1, k - size + 2)]
    if parts:
        spans = F.filter(F.array(*parts), lambda p: p["of"] == F.col("k"))
        inner = phrases.where("k > 2").select("lang", F.split("phrase", " ").alias("w"), "a", F.explode(spans).alias("p"))
        inner = inner.select("lang", F.array_join(F.slice("w", F.col("p.at"), F.col("p.size")), " ").alias("phrase"), "a")
        longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
        phrases = phrases.join(longer, ["lang", "phrase"], "left").where(f"most IS NULL OR NOT ({_COVERED.format(cover)})")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    few = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    first = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
