"""Ranked lexical search over an index whose documents are grouped by equal length normaliser."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenetab.functions.session import broadcast_if_small
from scenetab.llm.common import ascii_lower, stored, text_of
from scenetab.llm.tokens import TERMS, runs, texts_of

# fixed value of the contract: a term, after A-Z are lowered
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# postings of a block of documents (a longer document is a block of its own), and items that are ranked together
BLOCK, ITEMS = 1 << 21, 256
# blocks whose hits are cut together before all blocks meet
TOGETHER = 1024
# strata of a block that are visited first; each later visit takes twice as many
FIRST = 16


class Index(NamedTuple):
    """``table``: rows (block, term, m, tf, at) with the postings of a term in a block by m, then tf, then place; and per block
    one row without term that has the ids of its documents by place. ``n`` documents have terms, ``total`` of them."""

    table: DataFrame
    n: int
    total: int


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [sum(map(len, runs(t, TERMS))) for t in texts_of(batch)]
        yield pa.RecordBatch.from_pydict({"n": [sum(s > 0 for s in sizes)], "total": [sum(sizes)]})


def normaliser(size: int, n: int, total: int) -> int:
    return 50 + 50 * size * n // total


class _Block:
    """Postings of some documents, gathered one document at a time."""

    def __init__(self):
        self.terms, self.ids, self.m, self.counts = {}, [], [], []
        self.term, self.tf = [], []

    def add(self, key, text: bytes | None, n: int, total: int) -> None:
        counts: Counter = Counter()
        for words in runs(text, TERMS):
            counts.update(words)
        known = self.terms
        self.term.extend([known.setdefault(t, len(known)) for t in counts])
        self.tf.extend(counts.values())
        self.ids.append(key)
        self.m.append(normaliser(counts.total(), n, total) if counts else 0)
        self.counts.append(len(counts))

    def table(self, block: int, kind: pa.DataType) -> pa.RecordBatch:
        # the place of a document is its rank by id, so that ties are broken by place
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, 0 if self.ids[k] is None else self.ids[k]))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        at = np.repeat(place, self.counts)
        m = np.repeat(np.array(self.m, np.int64), self.counts)
        term, tf = np.array(self.term, np.int64), np.array(self.tf, np.int32)
        by = np.lexsort((at, tf, m, term))
        cuts = pa.array(np.r_[0, np.cumsum(np.bincount(term, minlength=len(self.terms)))].astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x[by])) for x in (m, tf, at)]
        names = pa.array([*self.terms], pa.binary()).cast(pa.string())
        ids = pa.array([[self.ids[k] for k in order]], pa.list_(kind))
        one, rows = pa.nulls(1), len(names)
        columns = [pa.concat_arrays([x, one.cast(x.type)]) for x in (names, *lists)]
        return pa.RecordBatch.from_arrays([pa.array([block] * (rows + 1), pa.int64()), *columns, pa.concat_arrays([pa.nulls(rows, ids.type), ids])], ["block", "term", "m", "tf", "at", "ids"])


def _blocks(n: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, block, kind = TaskContext.get().partitionId() << 31, _Block(), None
        for batch in batches:
            kind = batch.column("id").type
            for key, text in zip(batch.column("id").to_pylist(), texts_of(batch)):
                block.add(key, text, n, total)
                if len(block.term) >= BLOCK:
                    yield block.table(made, kind)
                    made, block = made + 1, _Block()
        if block.ids:
            yield block.table(made, kind)

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """An index of every term of every row of ``docs``, stored in the shared folder.

    Documents are dealt to blocks of bounded size where they are read, so nothing is shuffled. Within a block, documents of
    equal normaliser m are a stratum; a term's postings are ordered by stratum, and by tf inside it. Null and empty texts have
    no terms; each row is a document of its own, also if its id or text repeats; an empty table gives an empty index.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    n, total = rows.mapInArrow(_lengths, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    n, total = n or 0, total or 0
    schema = f"block long, term string, m array<long>, tf array<int>, at array<int>, ids array<{kind}>"
    return Index(stored(rows.mapInArrow(_blocks(n, max(total, 1)), schema), "index"), n, total)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """(places of the k best scores above 0, equal ones by place; the least score that a further document needs)."""
    found = np.flatnonzero(scores)
    if len(found) > k:
        least = np.partition(scores[found], len(found) - k)[len(found) - k]
        found = found[scores[found] >= least]
    found = found[np.lexsort((found, -scores[found]))][:k]
    return found, int(scores[found[-1]]) if len(found) == k else 1


def _ranker(k: int):
    """Rank the documents of one block for some items: strata are visited by falling bound, until none can add a document."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        postings = {}
        for name in ("m", "tf", "at"):
            column = table.column(name).chunk(0)
            postings[name], ends = column.flatten().to_numpy(), np.r_[0, np.cumsum(column.value_lengths().to_numpy())]
        m, tf, at = postings["m"], postings["tf"], postings["at"]
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        levels, stratum = np.unique(m, return_inverse=True)
        # runs of equal (term, stratum, tf): their impact is computed once
        begins = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (m[1:] != m[:-1]) | (tf[1:] != tf[:-1])])
        impact = 1_000_000_000 * tf[begins].astype(np.int64) // (1000 * tf[begins].astype(np.int64) + 20 * m[begins])
        # the last run of a stratum has its largest tf, which bounds what the term adds to any document there
        r, s = row[begins], stratum[begins]
        last = np.flatnonzero(np.r_[(r[1:] != r[:-1]) | (s[1:] != s[:-1]), True])
        impact_of = np.repeat(impact, np.diff(np.r_[begins, len(m)]))
        bound_row, bound_stratum, bound = r[last], s[last], impact[last]
        bound_ends = np.searchsorted(bound_row, np.arange(len(ends)))

        wanted: dict[int, list[tuple[int, int]]] = {}
        for i, some in enumerate(table.column("items").to_pylist()):
            for item in some:
                wanted.setdefault(item["q"], []).append((i, item["w"]))
        out = {"q": [], "at": [], "score": []}
        size = int(at.max()) + 1
        for q, terms in wanted.items():
            most = np.zeros(len(levels), np.int64)
            for i, w in terms:
                x = slice(bound_ends[i], bound_ends[i + 1])
                most[bound_stratum[x]] += w * bound[x]
            order = np.argsort(-most, kind="stable")
            scores, seen, step, need = np.zeros(size, np.int64), 0, FIRST, 1
            found = np.zeros(0, np.int64)
            while seen < len(order) and most[order[seen]] >= need:
                visit = np.zeros(len(levels), bool)
                some = order[seen : seen + step]
                visit[some[most[some] >= need]] = True
                for i, w in terms:
                    x = slice(ends[i], ends[i + 1])
                    hit = visit[stratum[x]]
                    scores[at[x][hit]] += w * impact_of[x][hit]
                seen, step = seen + step, 2 * step
                found, need = _best(scores, k)
            out["q"].append(np.full(len(found), q, np.int64))
            out["at"].append(found.astype(np.int32))
            out["score"].append(scores[found])
        columns = {name: np.concatenate(parts) for name, parts in out.items()}
        return pa.table({"block": np.full(len(columns["q"]), key[0].as_py(), np.int64), **columns})

    return run


def search(index: Index, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """For every item the ``k`` documents with the highest score above 0: (item_col, rank, id, score).

    Equal scores are ordered by ascending document id, a null id last; ranks are unique, from 1. Rows of ``items`` with equal id
    and text are one item; rows of one id with different texts are items of their own. Null and empty items find nothing;
    other columns are ignored.

    Only the postings of the items' terms leave the index. They meet by block and group of items, so a task holds one block;
    it passes on at most ``k`` documents an item. These are cut once among every TOGETHER blocks and then for good.
    """
    texts = items.select(F.col(item_col).alias("item"), text_of(text_col).alias("text")).distinct()
    texts = stored(texts.withColumn("q", F.monotonically_increasing_id()), "items")
    groups = max(1, -(-texts.count() // ITEMS))
    terms = texts.select("q", F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)))).alias("term"))
    terms = stored(terms.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int")), "terms")
    postings = index.table.where("term is not null").drop("ids")
    held = postings.select("term", F.size("at").alias("n")).join(broadcast_if_small(terms.select("term").distinct()), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weighed = terms.join(held, "term").select("term", "part", F.struct("q", weight.alias("w")).alias("item"))
    weighed = stored(weighed.groupBy("term", "part").agg(F.collect_list("item").alias("items")), "weights")
    met = postings.join(broadcast_if_small(weighed), "term").select("block", "part", "items", "m", "tf", "at")
    hits = met.groupBy("block", "part").applyInArrow(_ranker(k), "block long, q long, at int, score long")
    places = index.table.where("term is null").select("block", F.posexplode("ids").alias("at", "id"))
    hits = hits.join(places, ["block", "at"])
    # two cuts, so that no task gets the hits of all blocks
    best = [F.desc("score"), F.asc_nulls_last("id")]
    few = hits.withColumn("some", F.xxhash64(F.floor(F.shiftright("block", 31) / TOGETHER)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("q", "some").orderBy(*best))).where(F.col("rank") <= k)
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*best))).where(F.col("rank") <= k)
    return top.join(texts.select("q", "item"), "q").select(F.col("item").alias(item_col), "rank", F.col("id"), "score")
