"""Pairs and neighbours in blocks against all pairs, and how much they hold."""

import numpy as np
import pyarrow as pa
import pytest

from webloom.operators import blocks as B
from webloom.operators.pairs import _pairs_from, cosine_pairs, nearest, signature_pairs


def group(x, p=0, q=0, tile=None):
    n = len(x)
    return pa.RecordBatch.from_pydict({"p": [p] * n, "q": [q] * n, "tile": tile or [p] * n, "id": list(range(n)), "expression_id": [i % 9 for i in range(n)], "embedding": x.tolist()})


def test_pairs_come_in_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    wanted = {(i, j) for i in range(300) for j in range(i + 1, 300) if i % 9 != j % 9 and u[i] @ u[j] >= 0.3}
    monkeypatch.setattr(B, "CELLS", 3000)
    out = list(_pairs_from(0.3)(iter([group(x)])))
    assert len(out) > 20 and max(b.num_rows for b in out) <= 3000
    assert {(r["source_id"], r["target_id"]) for b in out for r in b.to_pylist()} == wanted


def test_best_of_blocks_with_ties(monkeypatch):
    monkeypatch.setattr(B, "CELLS", 500)
    rng = np.random.default_rng(4)
    score = np.round(rng.normal(size=(40, 3000)), 1)  # many ties
    score[3] = B.NOT
    score[4, 1:] = B.NOT
    best = B.Best(40, 7)
    order = rng.permutation(3000)
    for some in np.array_split(order, 11):
        best.add(np.arange(40), some, score[:, some], some * 2)
    row, ids, value, keys = best.found()
    wanted = [(r, c, score[r, c], 2 * c) for r in range(40) for c in sorted(range(3000), key=lambda c: (-score[r, c], c))[:7] if score[r, c] > B.NOT]
    assert list(zip(row.tolist(), ids.tolist(), value.tolist(), keys.tolist())) == wanted


def test_pairs_of_a_signature_meet_in_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 9, [float(v) for v in np.float32(rng.normal(size=6))]) for i in range(400)] + [(900, 1, [0.0] * 6), (901, 2, None), (902, 2, [])]
    frame = spark.createDataFrame(rows, "id long, expression_id long, embedding array<float>")
    key = lambda df: sorted((r["source_id"], r["target_id"], round(r["score"], 9)) for r in df.collect())
    whole = signature_pairs(frame, 0.4, planes=3)
    assert "Join" not in whole._jdf.queryExecution().analyzed().toString().split("FlatMapGroupsInArrow")[0]
    assert key(whole) == key(signature_pairs(frame, 0.4, planes=3, bucket_rows=20))
    every = key(cosine_pairs(frame, 0.4, tile_bytes=4000))
    assert every == key(cosine_pairs(frame, 0.4)) and set(key(whole)) < set(every)
    near = lambda t: sorted(map(tuple, nearest(frame, 3, t).collect()))
    assert near(4000) == near(1 << 24) and len(near(4000)) == 3 * 401


def test_vectors_of_different_lengths_are_refused():
    with pytest.raises(ValueError):
        B.units(pa.array([[1.0], [1.0, 2.0]]))
    assert B.units(pa.array([[3.0, 4.0], [0.0, 0.0]])).tolist() == [[0.6, 0.8], [0.0, 0.0]]


def test_nearest_of_copies_and_close_scores():
    """Copies in a page are scored once, single precision decides nothing, and other pages' ties go by id."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 8))
    near = base[rng.integers(0, 30, 300)] + 1e-6 * rng.normal(size=(300, 8))  # apart by less than single precision tells
    x = np.concatenate([np.repeat(base[:1], 900, 0), near, np.zeros((5, 8)), np.full((1, 8), np.nan)])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    ids, pages = rng.permutation(len(x)), rng.integers(0, 4, len(x))
    order = np.argsort(ids)
    whole = B.Side(x[order], ids[order], pages[order])
    some, more, of = whole.firsts(3)
    assert len(more) > 800 and len(some.x) + len(more) == len(x) and (some.pages[of] == whole.pages[more]).all()
    assert (some.x[of] == whole.x[more]).all() and (some.ids[of] < whole.ids[more]).all()
    score = np.round(np.einsum("id,jd->ij", whole.x, whole.x), 12)
    for left, right in ((whole, whole), (some, some)):
        row, found, value = B.nearest_of(left, right, 3, True)[0].found()
        got = {i: [] for i in left.ids}
        for r, i, v in zip(row, found, value):
            got[left.ids[r]].append((-v, i))
        for n, i in enumerate(whole.ids):
            if i in got:
                wanted = sorted((-score[n, j], whole.ids[j]) for j in range(len(x)) if whole.pages[j] != whole.pages[n] and not np.isnan(score[n, j]))[:3]
                assert [w[1] for w in wanted] == [g[1] for g in got[i]] and np.allclose([w[0] for w in wanted], [g[0] for g in got[i]], atol=1e-11)
