"""Connected components by contraction, with every step written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenetab.llm.common import stored


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links``: the least node of its component.

    Each round every node points at its least neighbour, pointers are followed to their ends, and the links are redrawn
    between those ends. A round at least halves the nodes that still have links, so the number of rounds is logarithmic
    however long a chain is. Each side of a join is a stored table: a hub's rows can be split when the join runs.
    """
    edges = stored(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")), "up")
        while True:
            top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            moved = stored(up.join(top, "up").select("node", "up", "top"), "up")
            if moved.where("top <> up").isEmpty():
                break
            up = moved.select("node", F.col("top").alias("up"))
        if labels is None:
            labels = up.select("node", F.col("up").alias("root"))
        else:
            over = up.select(F.col("node").alias("root"), "up")
            labels = stored(labels.join(over, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        redrawn = edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("ra")), "a")
        redrawn = redrawn.join(up.select(F.col("node").alias("b"), F.col("up").alias("rb")), "b")
        edges = stored(redrawn.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
