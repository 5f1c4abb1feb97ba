"""Suffix-array dedup: every byte of a long enough string that occurs earlier in the corpus is removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenetab.llm.common import stored, text_of
from scenetab.llm.jaccard import _mix
from scenetab.llm.suffixes import Shards

WIDTH = 100
GRAM = 24
PIECE = 1 << 20
# an anchor with more strings than this has its windows dealt out one by one
CROWD = 4096

_SPOT = np.uint64((1 << 22) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class Anchors:
    """Cuts texts into runs of windows that share their anchor, the gram of 24 bytes with the least hash in a window."""

    def __init__(self, width: int):
        self.width = width
        n = 2 * PIECE + 2 * width + GRAM
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, windows, anchor hash, string hash) of each run; ``ends``: for each byte, where its text ends."""
        width, n = self.width, len(data)
        if n < width:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.up[:n], out=sums[1:], dtype=np.uint64)
        gram = _mix((sums[GRAM:] - sums[:-GRAM]) * self.down[: n - GRAM + 1])
        least = (gram & ~_SPOT) | np.arange(len(gram), dtype=np.uint64)
        span = width - GRAM + 1
        step = 1
        while 2 * step <= span:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if span > step:
            least = np.minimum(least[: n - width + 1], least[span - step : span - step + n - width + 1])
        anchor = (least & _SPOT).astype(np.int64)
        fits = np.arange(n - width + 1) + width <= ends[: n - width + 1]
        cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (fits[1:] != fits[:-1])])
        length = np.diff(np.r_[cut, len(anchor)])
        ok = fits[cut]
        start, length = cut[ok], length[ok]
        anchor = anchor[start]
        whole = (sums[start + length + width - 1] - sums[start]) * self.down[start]
        whole = _mix(whole + _mix((length * 4096 + anchor - start).astype(np.uint64)))
        return start, length, gram[anchor].view(np.int64), whole.view(np.int64)


def _runs(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(width)

        def cut(parts):
            sizes = [len(p[2]) for p in parts]
            data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
            base = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(parts)), sizes)
            start, n, gram, whole = anchors(data, (base + sizes)[owner])
            k = owner[start]
            doc = np.array([p[0] for p in parts])[k]
            offset = start - base[k] + np.array([p[1] for p in parts])[k]
            return doc, offset, n, gram, whole

        for batch in batches:
            found, parts, size = [], [], 0
            ids, ties, texts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tie", "text"))
            for d in np.lexsort((ties, ids)):
                text = texts[d]
                for at in range(0, len(text) - width + 1, PIECE):
                    parts.append((d, at, text[at : at + PIECE + width - 1]))
                    size += len(parts[-1][2])
                    if size >= PIECE:
                        found.append(cut(parts))
                        parts, size = [], 0
            if parts:
                found.append(cut(parts))
            if found:
                doc, offset, n, gram, whole = (np.concatenate(x) for x in zip(*found))
                # documents came in order, so of equal runs in this batch the first is the earliest
                order = np.argsort(_mix(gram.view(np.uint64)) ^ whole.view(np.uint64), kind="stable")
                g, w = gram[order], whole[order]
                copy = np.zeros(len(doc), bool)
                copy[order[1:]] = (g[1:] == g[:-1]) & (w[1:] == w[:-1])
                key = np.where(copy, _mix(whole.view(np.uint64) + _mix(ids[doc].view(np.uint64) + _mix(offset.view(np.uint64)))).view(np.int64), gram)
                span = (offset * 128 + n) * 2 + copy
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, whole, ids[doc], ties[doc], span)], ["gram", "whole", "id", "tie", "span"])

    return run


STRINGS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("string", pa.binary()), ("n", pa.int64())])
SPANS = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])


def _strings(width: int):
    """Cut the asked-for strings out of their texts; windows of crowded anchors one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, tie, text, asked in zip(*(batch.column(c).to_pylist() for c in ("id", "tie", "text", "asked"))):
                for a in asked:
                    s, n = a["start"], a["n"]
                    if a["times"] <= CROWD:
                        rows.append((a["gram"], doc, tie, s, text[s : s + n + width - 1], n))
                    else:
                        for p in range(s, s + n):
                            one = text[p : p + width]
                            rows.append((int(np.uint64(xxhash.xxh3_64_intdigest(one)).astype(np.int64)), doc, tie, p, one, 1))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), STRINGS)], schema=STRINGS)

    return run


def _search(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, places = Shards(width), []

        def close():
            owner, at, n = shards.close_runs()
            doc, tie, start = np.array(places, np.int64).T
            places.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (doc[owner], tie[owner], start[owner] + at, n)], schema=SPANS)

        size = 0
        for batch in batches:
            for key, doc, tie, start, string in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "tie", "start", "string"))):
                shards.add(key, string)
                places.append((doc, tie, start))
                size += len(string)
                if size >= shards.size:
                    yield close()
                    size = 0
        if places:
            yield close()

    return run


def _remove(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, spans, kept = [], [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                sizes.append(len(text))
                if not runs:
                    gone.append(0), spans.append(0), kept.append(text)
                    continue
                edge = np.zeros(len(text) + 1, np.int64)
                s, n = np.array([r["start"] for r in runs]), np.array([r["n"] for r in runs])
                np.add.at(edge, s, 1)
                np.add.at(edge, s + n + width - 1, -1)
                covered = np.cumsum(edge[:-1]) > 0
                gone.append(int(covered.sum()))
                spans.append(int((covered & ~np.r_[False, covered[:-1]]).sum()))
                kept.append(np.frombuffer(text, np.uint8)[~covered].tobytes())
            kinds = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("own"), *[pa.array(c, k) for c, k in zip((sizes, gone, spans, kept), kinds)]], ["own", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row of ``docs``: (id_col, n_bytes, n_removed, n_spans, kept), ``kept`` being bytes.

    Every byte goes that lies in a string of ``width`` bytes which also starts earlier in the corpus: in a document with a
    smaller id, or earlier in the same document. Overlapping occurrences count, strings never cross documents, and all are
    judged on the input. Ids are whole numbers; a null id comes after all others. Rows with one id are ordered by a hash of
    their text, and rows equal in id and text are one document: they get the same answer, counted once. A null text is
    empty; texts shorter than ``width`` lose nothing; an empty table gives an empty result; other columns are ignored.

    1. Each window of ``width`` bytes has an anchor, the least-hashed gram of 24 bytes in it. Equal windows have equal anchors
       at the same place, and the windows of one anchor are a run, so one row per run (about one for 39 bytes) stands for
       all windows. A run whose anchor occurs once has no repeats.
    2. Runs that are equal as a whole need no more work: all but the first are repeats. A task settles that for its own rows
       before they are shuffled, and such rows no longer travel by anchor. Of anchors with different runs, one of each is
       cut out of its text.
    3. These strings go to shards by anchor. A shard's suffix array (groups still equal are refined by doubling) and common
       prefixes give its equal windows; an anchor that goes on in the next shard is looked up there by binary search.
       Windows of anchors with more than 4096 strings are dealt out by themselves, so that no shard has to hold them all.

    Shards hold about 1 MB, whatever the corpus size. Texts move once; that shuffle serves both to cut the strings and to remove the
    repeats (where ids repeat, texts move twice).
    """
    doc = F.col(id_col).cast("bigint")
    single = docs.groupBy(doc.alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").isEmpty()
    text = text_of(text_col).cast("binary")
    zero = F.lit(0).cast("bigint").alias("tie")
    tie = zero if single else F.xxhash64(doc.isNull(), text)
    keys = ["id"] if single else ["id", "tie"]
    own = docs.select(F.col(id_col).alias("own"), F.coalesce(doc, F.lit((1 << 63) - 1)).alias("id"), *([] if single else [tie.alias("tie")]), text.alias("text"))
    once = own if single else own.dropDuplicates(keys)
    long = once.where(F.octet_length("text") >= width).select("id", zero if single else "tie", "text")
    runs = long.mapInArrow(_runs(width), "gram long, whole long, id long, tie long, span long").select("gram", "whole", *keys, "span").repartition("gram")
    order, group = Window.partitionBy("gram").orderBy("whole", *keys, "span"), Window.partitionBy("gram")
    runs = runs.withColumn("copy", (F.col("span") % 2 == 1) | F.coalesce(F.lag("whole").over(order) == F.col("whole"), F.lit(False)))
    runs = runs.withColumn("other", F.min("whole").over(group) != F.max("whole").over(group)).withColumn("times", F.count(F.lit(1)).over(group))
    start, n = F.shiftright("span", 8).alias("start"), (F.shiftright("span", 1) % 128).alias("n")
    runs = stored(runs.where("copy or other").select("gram", "id", zero if single else "tie", start, n, "times", "copy"), "runs")

    asked = runs.where("not copy").groupBy(*keys).agg(F.collect_list(F.struct("gram", "start", "n", "times")).alias("asked"))
    # the same rows and columns of texts as below, so that both joins read one shuffle
    cut = once.join(asked.hint("merge"), keys).select("own", "id", zero if single else "tie", "text", "asked")
    cut = cut.mapInArrow(_strings(width), "key long, id long, tie long, start long, string binary, n long")
    dealt = cut.repartition("key").sortWithinPartitions("key", "id", "tie", "start")
    repeats = dealt.mapInArrow(_search(width), "id long, tie long, start long, n long")
    gone = runs.where("copy").select("id", "tie", "start", "n").unionByName(repeats)
    gone = gone.groupBy(*keys).agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    out = own.join(gone.hint("merge"), keys, "left").select("own", "text", "runs")
    kind = dict(docs.dtypes)[id_col]
    return out.mapInArrow(_remove(width), f"own {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("own", id_col)
