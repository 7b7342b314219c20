"""Connected components of a list of links, by contraction; nothing goes to the driver.

Each round lets every node point to its smallest neighbour (if that is smaller),
follows these pointers once more, and moves the links to where their ends point.  Links
inside one node vanish.  Nodes that are not smaller than all neighbours disappear in
each round, so the links shrink at least by half and usually much faster.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import giving_back, materialize, release


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node of its part) for each node but the smallest ones."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != x:
            parent[x] = top
            x = up
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in parent]


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = forest(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
        a, b = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every node in ``links``, two columns of node ids.

    The component is the smallest id that can be reached.  Nulls and links of a node
    with itself count for nothing; an empty table gives an empty one.
    """
    a, b = links.columns[:2]
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = materialize(edges.mapInArrow(giving_back(_thinned), "a long, b long").distinct(), "links", large=True)
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("up")).withColumnRenamed("a", "v"), "up")
        far = up.select(F.col("v").alias("up"), F.col("up").alias("far"))
        jump = materialize(up.join(far, "up").select("v", F.least("up", "far").alias("up")), "jump")
        if labels is None:
            new_labels = jump.select("v", F.col("up").alias("label"))
        else:
            to = jump.select(F.col("v").alias("label"), "up")
            new_labels = labels.join(to, "label", "left").select("v", F.coalesce("up", "label").alias("label"))
        new_labels = materialize(new_labels, "labels")
        one, two = jump.select(F.col("v").alias("a"), F.col("up").alias("x")), jump.select(F.col("v").alias("b"), F.col("up").alias("y"))
        moved = edges.join(one, "a").join(two, "b").where("x <> y")
        moved = moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        moved = materialize(moved.mapInArrow(giving_back(_thinned), "a long, b long").distinct(), "links")
        for old in (edges, up, jump, labels):
            if old is not None:
                release(old)
        edges, labels = moved, new_labels
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels.select(F.col("v").alias("id"), F.col("label").alias("component"))
