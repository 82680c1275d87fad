"""Neighbours by the index against all pairs."""

import numpy as np
import pytest

from webloom.operators.vector_index import VectorIndex, recalled_pairs
from webloom.session import work_path

SCHEMA = "id long, expression_id long, embedding array<float>"


def brute(vectors, queries, k, other_pages):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    out = {}
    for i, page, v in queries:
        if not v:
            continue
        each = [(-round(float(unit(v) @ unit(w)), 12), j) for j, other, w in vectors if w and j != i and not (other_pages and other == page)]
        out[i] = [(j, round(-s, 9)) for s, j in sorted(each)[:k]]
    return {i: f for i, f in out.items() if f}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 6)) * 4
    rows = [(i, i % 40, [float(x) for x in np.float32(centres[i % 12] + rng.normal(size=6) * 0.3)]) for i in range(600)]
    rows += [(1000 + i, 50 + i, rows[0][2]) for i in range(30)] + [(2000, 1, [0.0] * 6), (2001, 2, [0.0] * 6), (2002, 3, []), (2003, 3, None)]
    return rows


@pytest.mark.parametrize("other_pages", [True, False])
def test_same_neighbours_as_all_pairs(spark, vectors, other_pages):
    frame = spark.createDataFrame(vectors, SCHEMA).repartition(3)
    built = VectorIndex.build(frame, work_path(spark, "index"))
    for index, k in ((built, 3), (VectorIndex(spark, built.path, part_rows=50), 7)):  # written once, read by both
        got = {}
        for r in index.nearest(frame, k, other_pages).collect():
            got.setdefault(r["id"], {})[r["rank"]] = (r["neighbour"], round(r["score"], 9))
        assert {i: [f[n] for n in sorted(f)] for i, f in got.items()} == brute(vectors, vectors, k, other_pages)


def test_cells_that_hold_no_neighbour_are_not_read(spark, vectors):
    some = [v for v in vectors if v[0] < 600]
    frame = spark.createDataFrame(some, SCHEMA)
    assert VectorIndex.build(frame, work_path(spark, "index")).read_share(frame, 3) < 0.4


def test_pairs_of_neighbours_once_each(spark, vectors):
    frame = spark.createDataFrame(vectors, SCHEMA)
    index = VectorIndex.build(frame, work_path(spark, "index"), cells=5)
    page = {i: p for i, p, _ in vectors}
    wanted = {(min(i, j), max(i, j)) for i, f in brute(vectors, vectors, 4, False).items() for j, _ in f if page[i] != page[j]}
    assert sorted((r["source_id"], r["target_id"]) for r in recalled_pairs(index, frame, 4).collect()) == sorted(wanted)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    index = VectorIndex.build(empty, work_path(spark, "index"))
    assert index.nearest(empty, 3).count() == 0
    some = spark.createDataFrame([(1, 1, [1.0, 0.0])], SCHEMA)
    assert index.nearest(some, 3).count() == 0
    zero = spark.createDataFrame([(1, 1, [0.0, 0.0]), (2, 2, [0.0, 0.0])], SCHEMA)
    found = VectorIndex.build(zero, work_path(spark, "index")).nearest(spark.createDataFrame([(9, 9, [1.0, 0.0])], SCHEMA).unionByName(zero), 3).collect()
    assert sorted((r["id"], r["neighbour"], r["score"]) for r in found) == [(1, 2, 0.0), (2, 1, 0.0), (9, 1, 0.0), (9, 2, 0.0)]
