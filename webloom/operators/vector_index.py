"""An index of vectors for exact nearest neighbours: cells with radii, written as a table and read by any number of queries.

Every vector lies in the cell of its nearest centre. No vector of a cell is nearer to a query than the centre's angle less
the cell's radius, so a query reads its most promising cells first, and then only those that could still hold one of its
``k`` nearest: what is left out is proven to hold none. Centres are fitted on a bounded sample of vectors and set the speed
alone. Where vectors have no structure, all cells can hold a neighbour and the search is quadratic, as any exact one is.

Vectors without components are left out; a zero vector has cosine 0 with every other. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom import views as V
from webloom.operators import blocks as B
from webloom.session import materialize, ship, work_path

#: Angles are widened by this much, for the rounding of the arc cosine.
SLACK = 1e-6
#: The cell of zero vectors, which have no direction.
NOWHERE = -1
FOUND = "id long, neighbour long, page long, score double"


def fitted_centres(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means on unit vectors: centres of unit length, at most ``cells`` of them."""
    sample = sample[np.abs(sample).sum(1) > 0]
    if not len(sample):
        return np.zeros((0, sample.shape[1] if sample.ndim > 1 else 0))
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:cells]]
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        length = np.sqrt((sums**2).sum(1, keepdims=True))
        centres = np.where(length > 0, sums / np.where(length == 0, 1, length), centres)
    return centres


class VectorIndex:
    """An index that was written to ``path``."""

    def __init__(self, spark: SparkSession, path: str, part_rows: int = 32_768):
        self.spark, self.path, self.part_rows = spark, path, part_rows
        self.vectors = spark.read.parquet(f"{path}/vectors")
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # one row a cell
        self.cells = np.array([r["cell"] for r in rows], np.int64)
        self.counts = np.array([r["n"] for r in rows], np.int64)
        self.radii = np.array([r["radius"] for r in rows])
        self.centres = np.array([r["centre"] for r in rows], np.float64).reshape(len(rows), len(rows[0]["centre"]) if rows else 0)

    @classmethod
    def build(cls, paragraphs: DataFrame, path: str, cells: int | None = None, sample: int = 20_000, most_cells: int = 1024) -> VectorIndex:
        """Index all vectors of a table (id, expression_id, embedding) below ``path``."""
        spark = paragraphs.sparkSession
        ship(spark)
        rows = paragraphs.where(F.size("embedding") > 0).select(F.col("id").cast("long").alias("id"), F.col("expression_id").cast("long").alias("page"), F.col("embedding").cast("array<double>").alias("v"))
        total = rows.count()
        some = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, total // sample))) == 0).select("v").toArrow()
        wanted = min(most_cells, cells or max(1, int(total**0.5)))
        centres = fitted_centres(B.units(some.column("v")) if some.num_rows else np.zeros((0, 1)), wanted)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = B.units(batch.column("v"))
                directed = np.abs(x).sum(1) > 0
                cell, angle = np.full(len(x), NOWHERE), np.zeros(len(x))
                if len(centres):
                    dots = x @ centres.T
                    near = np.argmax(dots, axis=1)
                    cell = np.where(directed, near, NOWHERE)
                    angle = np.where(directed, np.arccos(np.clip(dots[np.arange(len(x)), near], -1, 1)), 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("page"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), pa.array(cell, pa.int64()), pa.array(angle)], names=["id", "page", "v", "cell", "angle"]
                )

        rows.mapInArrow(assign, "id long, page long, v array<double>, cell long, angle double").write.parquet(f"{path}/vectors")
        facts = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"), F.max(F.size("v")).alias("width"))
        known = spark.createDataFrame([(i, [float(y) for y in c]) for i, c in enumerate(centres)] or [(NOWHERE - 1, [])], "cell long, centre array<double>")
        facts.join(F.broadcast(known), "cell", "left").withColumn("centre", F.coalesce("centre", F.array_repeat(F.lit(0.0), F.col("width")))).drop("width").write.parquet(f"{path}/cells")
        return cls(spark, path)

    def _bounds(self, x: np.ndarray) -> np.ndarray:
        """The highest cosine that each cell may hold for each query."""
        angle = np.arccos(np.clip(x @ self.centres.T, -1, 1)) - self.radii - SLACK
        bounds = np.cos(np.maximum(angle, 0))
        bounds[:, self.cells == NOWHERE] = 0
        bounds[np.abs(x).sum(1) == 0] = 0
        return bounds

    def _shards(self) -> tuple[np.ndarray, np.ndarray]:
        """For each shard a cell that lies in it, shards in order: cells are laid together up to ``part_rows``, larger ones cut."""
        cell, shard, used, filled = [], [], 0, 0
        for c, n in enumerate(self.counts.tolist()):
            parts = -(-n // self.part_rows)
            if parts > 1 or filled + n > self.part_rows:
                used, filled = used + bool(filled), 0
            cell += [c] * parts
            shard += range(used, used + parts)
            used, filled = (used + parts, 0) if parts > 1 else (used, filled + n)
        return np.array(cell, np.int64), np.array(shard, np.int64)

    def _visits(self, queries: DataFrame, k: int, later: bool) -> DataFrame:
        """(id, page, v, least, shard, cells): what to read first, or what remains once ``least`` is what there is to beat.

        A query goes to a shard once, with the cells that it reads there.
        """
        spread = type(self)._bounds
        facts = {"cells": self.cells, "radii": self.radii, "centres": self.centres}
        counts, enough, (cell_of, shard_of) = self.counts, 4 * k, self._shards()
        held = [(int(s), cell_of[shard_of == s]) for s in np.unique(shard_of)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here = object.__new__(VectorIndex)
            here.__dict__.update(facts)
            for whole in batches:
                for begin in range(0, whole.num_rows if len(counts) else 0, 1024):
                    batch = whole.slice(begin, 1024)
                    bounds = spread(here, B.units(batch.column("v")))
                    order = np.argsort(-bounds, axis=1, kind="stable")
                    reached = np.cumsum(counts[order], axis=1)
                    first = np.zeros_like(bounds, bool)
                    np.put_along_axis(first, order, np.column_stack([np.ones(len(order), bool), reached[:, :-1] < enough]), axis=1)
                    least = np.full(len(bounds), B.NOT)
                    if later:
                        least = np.array([B.NOT if t is None else t for t in batch.column("least").to_pylist()])
                        first = ~first & (bounds >= least[:, None] - 1e-9)
                    for shard, inside in held:
                        row, at = np.nonzero(first[:, inside])
                        if len(row):
                            some, n = np.unique(row, return_counts=True)
                            cells = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(facts["cells"][inside[at]]))
                            taken = batch.select(["id", "page", "v"]).take(pa.array(some))
                            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(least[some]), pa.array([shard] * len(some), pa.int64()), cells], names=["id", "page", "v", "least", "shard", "cells"])

        return queries.mapInArrow(run, "id long, page long, v array<double>, least double, shard long, cells array<long>")

    def _search(self, visits: DataFrame, k: int, other_pages: bool) -> DataFrame:
        """The best ``k`` of the cells that a query reads in each shard. Shards and queries are dealt in parts of bounded size."""
        rows, spark = self.part_rows, self.spark
        ship(spark)
        cell_of, shard_of = self._shards()
        read = visits.groupBy("shard").agg(F.ceil(F.count("*") / rows).alias("q_parts"))
        first, parts = np.unique(cell_of, return_index=True)[1], np.bincount(cell_of, minlength=len(self.cells))
        laid = spark.createDataFrame([(int(c), int(shard_of[f]), int(n)) for c, f, n in zip(self.cells, first, parts)] or [(NOWHERE - 1, 0, 1)], "cell long, from_shard long, parts long")
        asked = visits.join(F.broadcast(read), "shard").withColumn("q", F.pmod(F.xxhash64("id"), F.col("q_parts")))  # one row a shard
        held = self.vectors.join(F.broadcast(laid), "cell").withColumn("shard", F.col("from_shard") + F.pmod(F.xxhash64("id"), F.col("parts")))
        held = held.join(F.broadcast(read), "shard").withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_parts") - 1)))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            best = B.Best(left.num_rows, k, left.column("least").to_numpy()) if left.num_rows and right.num_rows else B.Best(0, k)
            a_id, a_page = left.column("id").to_numpy(), B.numbers(left.column("page"))
            if len(best.bound):
                lists = left.column("cells").combine_chunks()
                n = lists.value_lengths().to_numpy()
                wanted = lists.flatten().to_numpy()
                order = np.argsort(wanted, kind="stable")
                wanted, asking = wanted[order], np.repeat(np.arange(len(n)), n)[order]
                x = B.units(left.column("v"))
                right = right.sort_by([("cell", "ascending"), ("page", "ascending"), ("id", "ascending")])
                y, b_id, b_page, cell = B.units(right.column("v")), right.column("id").to_numpy(), B.numbers(right.column("page")), right.column("cell").to_numpy()
                for c in np.unique(cell):
                    near = slice(*np.searchsorted(cell, [c, c + 1]))
                    mine = asking[slice(*np.searchsorted(wanted, [c, c + 1]))]
                    for some in B.spans(len(mine), near.stop - near.start):
                        score = x[mine[some]] @ y[near].T
                        B.mask_equal(score, a_id[mine[some]], b_id[near])
                        if other_pages:
                            B.mask_equal(score, a_page[mine[some]], b_page[near])
                        best.add(mine[some], b_id[near], score, b_page[near])
            row, other, score, page = best.found()
            return pa.table({"id": a_id[row], "neighbour": other, "page": page, "score": score})

        keys = ["shard", "q"]
        return asked.select(*keys, "id", "page", "v", "least", "cells").groupBy(*keys).cogroup(held.select(*keys, "id", "page", "v", "cell").groupBy(*keys)).applyInArrow(meet, FOUND)

    def nearest(self, queries: DataFrame, k: int, other_pages: bool = True) -> DataFrame:
        """(id, rank, neighbour, page, score): the ``k`` nearest vectors of each query (id, expression_id, embedding).

        A query is no neighbour of its own id, nor, with ``other_pages``, of vectors of its page.
        """
        rows = queries.where(F.size("embedding") > 0).select(F.col("id").cast("long").alias("id"), F.col("expression_id").cast("long").alias("page"), F.col("embedding").cast("array<double>").alias("v"))
        best = Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")
        ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        first = materialize(ranked(self._search(self._visits(rows, k, False), k, other_pages)), "nearest-first")
        least = first.where(F.col("rank") == k).select(F.col("id").alias("_id"), F.col("score").alias("least"))
        again = self._visits(rows.join(least, F.col("id") == F.col("_id"), "left").drop("_id"), k, True)
        return ranked(first.drop("rank").unionByName(self._search(again, k, other_pages))).select("id", "rank", "neighbour", "page", "score")

    def read_share(self, queries: DataFrame, k: int) -> float:
        """The part of all pairs of queries and vectors that a search compares; tells how much the index saves."""
        n, total = queries.count(), int(self.counts.sum())
        rows = queries.select(F.col("id").cast("long").alias("id"), F.col("expression_id").cast("long").alias("page"), F.col("embedding").cast("array<double>").alias("v"))
        first = materialize(self._visits(rows, k, False), "visits")
        found = self._search(first, k, True)
        best = Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")
        least = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("id").alias("_id"), F.col("score").alias("least"))
        visits = first.unionByName(self._visits(rows.join(least, F.col("id") == F.col("_id"), "left").drop("_id"), k, True))
        size = self.spark.createDataFrame([(int(c), int(m)) for c, m in zip(self.cells, self.counts)], "cell long, m long")
        visits = visits.select("id", F.explode("cells").alias("cell")).distinct()
        compared = visits.join(F.broadcast(size), "cell").agg(F.sum("m")).first()[0] or 0
        return compared / max(1, n * total)


def recalled_pairs(index: VectorIndex, paragraphs: DataFrame, k: int) -> DataFrame:
    """Pairs of paragraphs of different pages of which one is among the other's ``k`` nearest, each pair once.

    Neighbours of the same page take up places but make no pair.
    """
    found = index.nearest(paragraphs, k, other_pages=False)
    own = paragraphs.select(F.col("id").cast("long").alias("_own"), F.col("expression_id").cast("long").alias("_page"))
    apart = found.join(own, F.col("id") == F.col("_own")).where(~F.col("page").eqNullSafe(F.col("_page")))
    pair = apart.select(F.least("id", "neighbour").alias("source_id"), F.greatest("id", "neighbour").alias("target_id"), "score")
    return pair.groupBy("source_id", "target_id").agg(F.max("score").alias("score"))


def _indexed(s, d):
    paragraphs = V.paragraphs(s, d)
    return VectorIndex.build(paragraphs, work_path(s, "vector-index")), paragraphs


def _nearest(s, d):
    index, paragraphs = _indexed(s, d)
    return index.nearest(paragraphs, 5).select("id", "rank", "neighbour", F.round("score", 6).alias("score"))


def _recalled(s, d):
    index, paragraphs = _indexed(s, d)
    return recalled_pairs(index, paragraphs, 4).select("source_id", "target_id", F.round("score", 6).alias("score"))


_UNIT = "unit AS (SELECT id, expression_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM paragraphs)"
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour) AS rank FROM (SELECT a.id, b.id AS neighbour, a.expression_id AS pa, b.expression_id AS pb, round(list_dot_product(a.v, b.v), 12) AS score FROM unit a JOIN unit b ON {}))"
QUERIES = {"indexed_neighbours": _nearest, "recalled_pairs": _recalled}
ORACLES = {
    "indexed_neighbours": V.with_views(V.PARAGRAPHS, _UNIT, _RANKED.format("a.expression_id <> b.expression_id")) + "SELECT id, rank, neighbour, round(score, 6) AS score FROM ranked WHERE rank <= 5",
    "recalled_pairs": V.with_views(V.PARAGRAPHS, _UNIT, _RANKED.format("a.id <> b.id"))
    + "SELECT least(id, neighbour) AS source_id, greatest(id, neighbour) AS target_id, round(max(score), 6) AS score FROM ranked WHERE rank <= 4 AND pa <> pb GROUP BY 1, 2",
}
