"""Connected components of a link table, by alternating star contraction.

Links never meet on the driver. Each round hangs every node's neighbours on the smallest of them, first
from the larger side, then from the smaller, until all that is left are stars around the smallest node of
each component. The smallest neighbours are written out before they are joined back, so that a node with
very many links is split by the optimizer (or the table is broadcast where it is small enough).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import discard, materialize, ship


def local_forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """(node, smallest node of its tree) for all nodes of these links that are not the smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for x, y in zip(a, b):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in list(parent) if root(x) != x]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = local_forest(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], names=["a", "b"])


def _smallest(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``u``, ``v`` plus ``m``, the smallest ``v`` of each ``u``; and the table that it reads besides."""
    least = materialize(links.groupBy("u").agg(F.min("v").alias("m")), "star-least")
    return links.join(least, "u"), least


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links ``a``, ``b`` (long); component is the smallest node.

    Rounds go on until one changes nothing.
    """
    ship(links.sparkSession)
    apart = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = materialize(apart.mapInArrow(_contract, "a long, b long").distinct(), "star")
    before = None
    while True:
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        # large stars: every larger neighbour of u hangs on the smallest of u and its neighbours
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).union(stars.select("b", "a"))
        near, least = _smallest(both)
        hung = near.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = materialize(hung.where("u <> v").distinct(), "star-large")
        discard(stars, least)
        # small stars: u and its smaller neighbours hang on the smallest of them
        near, least = _smallest(large)
        hung = near.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(near.select("u", "m"))
        stars = materialize(hung.where("a <> b").distinct(), "star")
        discard(large, least)
    roots = stars.groupBy(F.col("b").alias("node")).agg(F.min("b").alias("component"))
    return stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(roots)
