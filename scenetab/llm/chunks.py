"""Substring dedup by content-defined chunks: a gear rolling hash cuts texts, equal chunks stay once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenetab.llm.common import stored, text_of
from scenetab.llm.jaccard import _mix
from scenetab.llm.substrings import _remove

LEAST, MOST, BITS = 16, 1024, 4
# bytes that a chain of adjacent chunks needs to be told a copy
CHAIN = 100
# digests whose first place a task remembers from batch to batch
REPEATED = 1 << 16
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(text: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Ends of the chunks of ``text``.

    The gear hash of a place shifts in one byte at a time, so its 32 bits hold the last 32 bytes; the top ``bits`` of them being 0
    ends a chunk of at least ``least`` bytes, and ``most`` bytes end one anyway. A rest shorter than ``least`` joins the chunk
    before it. Inserted bytes therefore change the chunks around them and no others.
    """
    n = len(text)
    if n <= least:
        return [n] if n else []
    gear = _GEAR[np.frombuffer(text, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        gear[step:] = gear[step:] + (gear[:-step] << np.uint32(step))
    ends, last = [], 0
    for p in (np.flatnonzero(gear >> np.uint32(32 - bits) == 0) + 1).tolist():
        while p - last > most:
            last += most
            ends.append(last)
        if p - last >= least:
            ends.append(p)
            last = p
    while n - last > most:
        last += most
        ends.append(last)
    if n - last >= least or not ends:
        ends.append(n)
    else:
        ends[-1] = n
    return ends


def chains(ends: list[int], least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the shortest chain of ``least`` bytes from every chunk on; a shorter text is one chain."""
    starts, j = [0, *ends[:-1]], 0
    if ends and ends[-1] < least:
        yield 0, ends[-1]
        return
    for s in starts:
        while j < len(ends) and ends[j] - s < least:
            j += 1
        if j == len(ends):
            return
        yield s, ends[j]


def _chains(least: int, most: int, bits: int, chain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], tuple[int, int, int]] = {}
        for batch in batches:
            ids, ties, texts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tie", "text"))
            doc, start, size, high, low = [], [], [], [], []
            for d in np.lexsort((ties, ids)).tolist():
                text = texts[d]
                # a whole text shorter than a chain is a copy of whole texts only
                seed = 1 if len(text) < chain else 0
                for at, end in chains(cuts(text, least, most, bits), chain):
                    digest = xxhash.xxh3_128_digest(text[at:end], seed)
                    doc.append(d), start.append(at), size.append(end - at), high.append(digest[:8]), low.append(digest[8:])
            if not doc:
                continue
            doc, start, size = np.array(doc), np.array(start, np.int64), np.array(size, np.int64)
            h, k = (np.frombuffer(b"".join(x), np.int64) for x in (high, low))
            # documents came in order: of equal chains in this batch the first is the earliest, the others need no shuffle by digest
            order = np.lexsort((np.arange(len(h)), k, h))
            copy = np.zeros(len(h), bool)
            copy[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (k[order[1:]] == k[order[:-1]])
            # nor does the first, if an earlier batch of the task has passed on an earlier one
            firsts = order[np.flatnonzero(~copy[order] & np.r_[copy[order][1:], False])]
            for i in firsts.tolist():
                key, place = (int(h[i]), int(k[i])), (int(ids[doc[i]]), int(ties[doc[i]]), int(start[i]))
                if key in known and known[key] < place:
                    copy[i] = True
                elif key in known or len(known) < REPEATED:
                    known[key] = place
            own = _mix(h.view(np.uint64) + _mix(ids[doc].view(np.uint64) + _mix(start.view(np.uint64)))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.where(copy, own, h), np.where(copy, 0, k), ids[doc], ties[doc], start, size, copy)], ["high", "low", "id", "tie", "start", "n", "copy"])

    return run


def chunk_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, most: int = MOST, bits: int = BITS, chain: int = CHAIN) -> DataFrame:
    """Per row of ``docs``: (id_col, n_bytes, n_removed, n_spans, kept), ``kept`` being bytes.

    A chain is a run of adjacent chunks, from any chunk on, that is ``chain`` bytes long or more. Of equal chains (by a 128-bit
    digest) that in the document with the smallest id stays, within a document the first; the bytes of all others are removed. So
    text that repeats nothing of that length is left alone, however many of its chunks occur elsewhere. Of a copied passage in
    other surroundings go the chunks between the first and the last cut that both places share. Chunks have ``least`` to about
    ``most`` bytes. A text shorter than ``chain`` is a chain as a whole, equal only to whole texts.

    Ids are whole numbers, a null id comes last; rows of one id are ordered by a hash of their text, and rows equal in both are
    one document. A null text is empty and loses nothing; texts of any length are cut as a whole; an empty table gives an empty
    result; other columns are ignored.

    A task settles equal chains among its own rows, and remembers the first place of REPEATED digests that its batches repeat, so a chain
    that is everywhere meets the others of its digest once per task. One shuffle finds the first of each digest, one brings the spans to
    the texts.
    """
    doc = F.col(id_col).cast("bigint")
    text = text_of(text_col).cast("binary")
    single = docs.groupBy(doc.alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").isEmpty()
    # where ids differ there are no ties, and the column weighs nothing in a shuffle
    tie = F.lit(0).cast("bigint") if single else F.xxhash64(doc.isNull(), text)
    own = docs.select(F.col(id_col).alias("own"), F.coalesce(doc, F.lit((1 << 63) - 1)).alias("id"), tie.alias("tie"), text.alias("text"))
    rows = own.select("id", "tie", "text") if single else own.select("id", "tie", "text").dropDuplicates(["id", "tie"])
    found = rows.mapInArrow(_chains(least, most, bits, chain), "high long, low long, id long, tie long, start long, n long, copy boolean").repartition("high")
    first = F.row_number().over(Window.partitionBy("high", "low").orderBy("id", "tie", "start")) == 1
    gone = found.withColumn("first", first).where("copy or not first").groupBy("id", "tie").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    out = own.join(stored(gone, "chains"), ["id", "tie"], "left").select("own", "text", "runs")
    kind = dict(docs.dtypes)[id_col]
    return out.mapInArrow(_remove(1), f"own {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("own", id_col)
