"""Connected components of a graph of links, as Spark joins.

Each step first contracts what a task holds by union-find, which keeps a
spanning forest of its links, and then joins links on the vertices: alternately
every vertex's larger neighbours, and all its smaller ones, move to the
smallest vertex that it knows. The labels do not change any more after a number
of steps that grows with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


class Forest:
    """Union-find over dense numbers; the smaller root wins."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each batch as stars around the smallest vertex of its components there."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        names, dense = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(names))
        for x, y in zip(dense[: len(a)].tolist(), dense[len(a) :].tolist(), strict=True):
            forest.link(x, y)
        root = np.array([forest.root(i) for i in range(len(names))], np.int64)
        far = np.flatnonzero(root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[root[far]]), pa.array(names[far])], ["a", "b"])


def components(links: DataFrame, most_steps: int = 60) -> DataFrame:
    """(vertex, label) of every vertex that has a link; the label is its component's smallest vertex.

    links has two long columns a and b; loops and repeats are allowed.
    """
    def contracted(df: DataFrame) -> DataFrame:
        return df.mapInArrow(_forest, "a long, b long").distinct()

    links = common.stored(contracted(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")), "links")
    for _ in range(most_steps):
        # every vertex points to its smallest smaller neighbour; its other smaller neighbours are linked to that one
        least = links.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        if least.where("n > 1").limit(1).count() == 0:
            roots = least.select(F.col("b").alias("vertex"), F.col("m").alias("label"))
            # each vertex has one smaller neighbour: follow the pointers, twice as far in each step
            while True:
                up = roots.select(F.col("vertex").alias("v"), F.col("label").alias("above"))
                longer = common.stored(roots.join(up, roots["label"] == up["v"], "left").select("vertex", F.coalesce("above", "label").alias("label"), F.col("above").isNotNull().alias("moved")), "roots")
                roots = longer.select("vertex", "label")
                if longer.where("moved").limit(1).count() == 0:
                    own = roots.select("label").distinct().select(F.col("label").alias("vertex"), "label")
                    return roots.unionByName(own)
        near = links.join(least.select("b", "m"), "b")
        moved = near.select(F.least("a", "m").alias("a"), F.greatest("a", "m").alias("b")).where("a <> b")
        kept = least.select(F.col("m").alias("a"), "b")
        links = common.stored(contracted(kept.unionByName(moved)), "links")
    raise RuntimeError(f"no components after {most_steps} steps")
