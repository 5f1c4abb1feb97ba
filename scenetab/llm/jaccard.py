"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetab.functions.session import broadcast_if_small
from scenetab.llm.common import fresh, key128, stored, text_of
from scenetab.llm.components import components

# words whose hash a task remembers
CACHE = 200_000
# parts of the columns in which a set's shingles are counted, and rows of a block of the product
SKETCH, BLOCK = 128, 512

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's n-word shingles."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # of bytes: A-Z, and ASCII white space
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        hashes = np.array([known[w] for w in words], np.uint64)
        width = min(self.n, len(words))
        h = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            h = _mix(h) + hashes[k : k + len(h)]
        return np.unique(_mix(h))


def _sign(shingles: np.ndarray) -> int:
    """One signed 64-bit number for the set."""
    both = np.array([_mix(shingles ^ _M2).sum(dtype=np.uint64) + np.uint64(len(shingles))])
    return int(_mix(both).view(np.int64)[0])


def least_overlap(size: int | Column, percent: int):
    """Shingles that a set shares at least with any set it links with, which follows from its size alone."""
    if isinstance(size, Column):
        return F.floor((size * percent + 99) / 100).cast("bigint")
    return (size * percent + 99) // 100


def _lead(size: int, percent: int) -> tuple[int, int]:
    """(how many of its first shingles a set shows, how many beyond the fewest that linked sets need to meet at all)."""
    short = size - least_overlap(size, percent) + 1
    more = min(short - 1, max(short // 4, size // 5 - short), least_overlap(size, percent) - 1)
    return short + max(more, 0), max(more, 0)


def _need(size: int, percent: int) -> int:
    """Shown shingles that a set has in common with any set it links with, which may be the smaller one."""
    return max(1, _lead(least_overlap(size, percent), percent)[1])


def _sets(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = Shingler(n), set()
        for batch in batches:
            sizes, signs, heads, needs = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle(text)
                sign = _sign(s)
                head = None
                if len(s) and sign not in seen:  # a task shows a set once
                    seen.add(sign)
                    head = s[: _lead(len(s), percent)[0]].view(np.int64)
                sizes.append(len(s))
                signs.append(sign)
                heads.append(head)
                needs.append(_need(len(s), percent) if len(s) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(signs, pa.int64()), pa.array(needs, pa.int64()), pa.array(heads, pa.list_(pa.int64()))],
                ["id", "row", "size", "sign", "need", "head"],
            )

    return run


def _whole_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            for k, text in enumerate(batch.column("text").to_pylist()):
                s = shingle(text)
                yield pa.RecordBatch.from_arrays([batch.column("sign")[k : k + 1], pa.array([s.view(np.int64)], pa.list_(pa.int64()))], ["sign", "tokens"])

    return run


def _prefixes(percent: int):
    """For each set: the shingles that have to meet another set's, and the counts of all its shingles in SKETCH parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, sketches = [], []
            for size, tokens in zip(batch.column("size").to_pylist(), batch.column("tokens")):
                t = tokens.values.to_numpy()
                heads.append(t[: len(t) - least_overlap(size, percent) + 1])
                counts = np.bincount(t & (SKETCH - 1), minlength=SKETCH)
                sketches.append((counts if counts.max() < 1 << 16 else counts * 0).astype(np.uint16).tobytes())
            n = pa.array([len(t) for t in batch.column("tokens")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("sign"), batch.column("size"), n, pa.array(heads, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["sign", "size", "n", "head", "sketch"])

    return run


def _column_product(cells: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of one column, of different components, whose overlap may be large enough, block by block."""
    sign, root, size = cells["sign"], cells["root"], cells["size"]
    ahead = cells["n"] - cells["at"]
    sketch = np.frombuffer(b"".join(cells["sketch"]), np.uint16).reshape(-1, SKETCH).astype(np.int32)
    known = sketch.sum(1) == cells["n"]
    a, b = [], []
    for i in range(0, len(sign), BLOCK):
        for j in range(i, len(sign), BLOCK):
            x, y = slice(i, i + BLOCK), slice(j, j + BLOCK)
            need = (size[x, None] + size[None, y]) * percent
            small, large = np.minimum(size[x, None], size[None, y]), np.maximum(size[x, None], size[None, y])
            ok = (root[x, None] != root[None, y]) & (small * 100 >= large * percent) & (np.minimum(ahead[x, None], ahead[None, y]) * (100 + percent) >= need)
            if i == j:
                ok &= np.tri(*ok.shape, -1, dtype=bool)
            p, q = np.nonzero(ok)
            for at in range(0, len(p), 1 << 14):  # at most 16 MB of counts at once
                u, v = p[at : at + (1 << 14)] + i, q[at : at + (1 << 14)] + j
                most = np.minimum(sketch[u], sketch[v]).sum(1)
                fits = (most * (100 + percent) >= (size[u] + size[v]) * percent) | ~known[u] | ~known[v]
                a.append(np.minimum(sign[u[fits]], sign[v[fits]]))
                b.append(np.maximum(sign[u[fits]], sign[v[fits]]))
    return (np.concatenate(a), np.concatenate(b)) if a else (sign[:0], sign[:0])


def _products(percent: int):
    """Multiply the columns of a task, which come one after another; what each batch finds is passed on once."""
    names = ["token", "sign", "root", "size", "n", "at", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def product(cells):
            cuts = np.flatnonzero(np.r_[True, cells["token"][1:] != cells["token"][:-1], True])
            found = [_column_product({c: v[s:e] for c, v in cells.items()}, percent) for s, e in zip(cuts[:-1], cuts[1:]) if e - s > 1]
            pairs = np.unique(np.concatenate([np.stack(f, 1) for f in found]), axis=0) if found else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in names})
            last = held[-1]["token"][-1]
            if held[0]["token"][0] == last:
                continue  # one column so far
            cells = {c: np.concatenate([h[c] for h in held]) for c in names}
            done = int(np.searchsorted(cells["token"], last))
            yield product({c: v[:done] for c, v in cells.items()})
            held = [{c: v[done:] for c, v in cells.items()}]
        if held:
            yield product({c: np.concatenate([h[c] for h in held]) for c in names})

    return run


def _linked(pairs: DataFrame, cores: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by the exact size of the overlap."""
    one = cores.select(F.col("sign").alias("a"), F.col("size").alias("sa"), F.col("tokens").alias("ta"))
    two = cores.select(F.col("sign").alias("b"), F.col("size").alias("sb"), F.col("tokens").alias("tb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("n", F.size(F.array_intersect("ta", "tb")))
    return both.where(F.col("n") * 100 >= F.lit(percent) * (F.col("sa") + F.col("sb") - F.col("n"))).select("a", "b")


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits from a row's id and text."""
    return F.struct(*key128(F.col(id_col), text_of(text_col), names=("h", "l")))


def classes(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: (id_col, row, n_shingles, component_id, class_id), stored.

    Two rows link if the Jaccard similarity of their sets of ``n``-word shingles is ``percent`` / 100 or more; classes are
    the components of that relation. ``component_id`` is the least id in the class, ``class_id`` a number of the class,
    ``row`` a hash of the row's id and text. A text of fewer words than ``n`` has one shingle, all its words; a null or empty
    text has none, links with nothing and has class null. Null ids take part (the least id is null only if all are);
    repeated rows are in one class; an empty table gives an empty result; other columns are ignored. Shingles and sets are
    told apart by 64-bit hashes.

    Rows with equal sets are one row of the incidence matrix. Which sets can link at all is settled by bounds on their size:

    1. Under any order of the shingles, linked sets share a known number of their first ones (a fifth of a set at 0.9, a
       quarter at 0.8). Sets that share fewer of them with all others together can't link; that leaves copies and near copies.
    2. For those, all columns are counted. A shingle that no other set has adds nothing to any product, so a set with too few
       others is dropped, and of the rest only a short prefix, rarest first, has to meet another's.
    3. The prefix columns are multiplied: first only neighbours by size within each column, then, once those links have been
       contracted, all entries between different components, block by block. The sizes, the place in the prefix and counts
       over 128 parts of all columns bound each entry's overlap; entries below the bound are discarded where they arise. For
       the others the overlap is counted over all columns.

    So a group of copies costs a number of products in proportion to its size, and no link is lost. Texts of any length are one set,
    whatever columns stand beside them.
    """
    text = text_of(text_col)
    kind = dict(docs.dtypes)[id_col]
    keyed = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), text.cast("binary").alias("text"))
    sets = stored(keyed.mapInArrow(_sets(n, percent), f"id {kind}, row struct<h: long, l: long>, size long, sign long, need long, head array<long>"), "sets")
    some = sets.where("size > 0")
    nodes = stored(some.groupBy("sign").agg(F.min("id").alias("first_id"), F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("need").alias("need")), "nodes")

    # 1: first shingles that at least two different sets show
    shown = some.where("head is not null").select("sign", F.explode("head").alias("token")).repartition("token")
    near = Window.partitionBy("token").orderBy("sign")
    met = (F.lag("sign").over(near) != F.col("sign")) | (F.lead("sign").over(near) != F.col("sign"))
    met = shown.select("sign", "token", met.alias("met")).where("met").dropDuplicates(["token", "sign"]).groupBy("sign").agg(F.count(F.lit(1)).alias("met"))
    wanted = stored(met.join(nodes, "sign").where("met >= need").select("sign", "size", "row"), "wanted")

    # 2: whole sets of those, without the shingles that only one of them has
    # the same plan at every size: texts are shuffled to meet the wanted rows, never the other way round by a broadcast
    texts = keyed.join(wanted.select("sign", "row").hint("merge"), "row").select("sign", "text")
    cells = texts.mapInArrow(_whole_sets(n), "sign long, tokens array<long>").select("sign", F.explode("tokens").alias("token"))
    cells = cells.repartition("token").dropDuplicates(["token", "sign"]).withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1")
    cores = cells.groupBy("sign").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("tokens")).join(wanted.select("sign", "size"), "sign")
    cores = stored(cores.where(F.size("tokens") >= least_overlap(F.col("size"), percent)), "cores")

    # 3: products of the prefix columns
    heads = cores.mapInArrow(_prefixes(percent), "sign long, size long, n long, head array<long>, sketch binary")
    prefix = heads.select("sign", "size", "n", "sketch", F.posexplode("head").alias("at", "token"))
    order = Window.partitionBy("token").orderBy("size", "sign")
    beside = prefix.select(F.lag("sign").over(order).alias("a"), F.col("sign").alias("b"), F.lag("size").over(order).alias("s"), "size")
    beside = beside.where((F.col("s") * 100 >= F.col("size") * percent) & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = stored(_linked(beside, cores, percent), "links")
    found = components(first, "a", "b")

    rooted = prefix.join(found.withColumnRenamed("node", "sign"), "sign", "left").withColumn("root", F.coalesce("root", "sign"))
    column = Window.partitionBy("token")
    rooted = rooted.withColumn("mixed", F.min("root").over(column) != F.max("root").over(column)).where("mixed").drop("mixed")
    rooted = rooted.select("token", "sign", "root", "size", "n", F.col("at").cast("bigint").alias("at"), "sketch").sortWithinPartitions("token", "size")
    across = rooted.mapInArrow(_products(percent), "a long, b long").distinct()
    second = stored(_linked(across, cores, percent), "links")
    found = components(first.unionByName(second), "a", "b") if not second.isEmpty() else found

    linked = nodes.join(found.withColumnRenamed("node", "sign"), "sign")
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = linked.select("sign", "root").join(least, "root").select("sign", "root", "least_id")
    known = nodes.where("copies > 1").select("sign", "first_id").join(linked, "sign", "full").select("sign", F.coalesce("root", "sign").alias("root"), F.when(F.col("root").isNotNull(), F.col("least_id")).otherwise(F.col("first_id")).alias("least_id"))
    known = stored(known, "classes")
    out = sets.select("id", "row", "size", "sign").join(known.withColumn("known", F.lit(True)), "sign", "left")
    grouped = F.col("known") & (F.col("size") > 0)
    return out.select(
        F.col("id").alias(id_col),
        "row",
        F.col("size").alias("n_shingles"),
        F.when(grouped, F.col("least_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("size") > 0, F.coalesce("root", "sign")).alias("class_id"),
    )


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each class: that with the least id.

    Of rows that have the least id in common one stays, and of equal rows one; a null id comes after all others. Null and empty texts and
    others without words are in no class, and all their rows stay. Texts of any length count as a whole; an empty table stays
    empty; columns that are named like those of this module are kept as they are.
    """
    names, key = docs.columns, fresh(docs, "_row")
    found = stored(classes(docs, n, percent, id_col, text_col).select(F.col(id_col).alias("id"), "row", "class_id"), "members")
    winners = found.where("class_id is not null").groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row")))["row"].alias("row"))
    times = found.groupBy("row").agg(F.count(F.lit(1)).alias("times"))
    kept = stored(winners.join(times, "row").select(F.col("row").alias(key), "times"), "winners")
    wordless = stored(found.where("class_id is null").select(F.col("row").alias(key)).distinct(), "wordless")
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    single = kept.where("times = 1").select(key).unionByName(wordless)
    # a winner that is there several times over stays once
    repeated = keyed.join(broadcast_if_small(kept.where("times > 1").select(key)), key, "left_semi").dropDuplicates([key])
    return keyed.join(single.hint("merge"), key, "left_semi").unionByName(repeated).select(*names)
