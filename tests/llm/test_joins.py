"""Joins of documents and vectors, and line de-duplication, against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import components, jaccard, line_dedup, shingles, vectors


def closed(nodes, links):
    """node -> smallest node that it reaches"""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_jaccard(rows, size, num, den):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    links = [
        (a, b)
        for a, b in itertools.combinations(sorted(sets), 2)
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    ]
    root = closed(sets, links)
    return {i: (len(s), root[i], sum(i in link for link in links)) for i, s in sets.items()}


def corpus(seed, families, copies, edits):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(words) for _ in range(40)]
    rows, i = [], 0
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.randint(20, 160))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((i, " ".join(own if rng.random() < 0.8 else own + passage)))
            i += 1
    rows += [(i + k, t) for k, t in enumerate([None, "", "  \t", "one", "ONE", "one two", "a b c d", "A b\nc d", "x" * 900 + " y z q"])]
    rows += [(i + 20 + k, rows[0][1]) for k in range(5)]
    return rows


@pytest.mark.parametrize("seed, families, copies, edits", [(1, 30, 4, 6), (2, 2, 150, 5)])
def test_jaccard_join(spark, seed, families, copies, edits):
    rows = corpus(seed, families, copies, edits)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, component string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.jaccard_join(docs, small_group=32).collect()}
    assert got == brute_jaccard(rows, 4, 85, 100)


def test_jaccard_join_keeps_texts_of_one_id_apart(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    near = " ".join([*base[:30], "other", *base[31:]])
    rows = [(5, " ".join(base)), (5, "quite another text of its own words"), (5, " ".join(base)), (7, near), (8, "  ".join(base)), (9, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h int")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.jaccard_join(docs).collect())
    assert got == [(5, 4, 5, 0), (5, 57, 5, 3), (5, 57, 5, 3), (7, 57, 5, 3), (8, 57, 5, 3), (9, 0, 9, 0)]


@pytest.mark.parametrize("common", [0, 60])
def test_large_groups_are_split_again(spark, common):
    """Clusters that share a passage are one group at first; with small groups of 8, all steps take part."""
    rng = random.Random(common)
    passage = [f"p{rng.randrange(400)}" for _ in range(common)]
    rows, i = [], 0
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(40)] + passage
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(5000)}"
            rows.append((i, " ".join(own)))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.jaccard_join(docs, small_group=8, tile_bytes=4000).collect()}
    assert got == brute_jaccard(rows, 4, 85, 100)


def test_cells_meet_every_pair_once():
    rng = np.random.default_rng(3)
    points = rng.random((150, 2)) * 2
    distance = lambda x, y: np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    d = distance(points, points[:6])
    places = {}
    for i, cell, bit in jaccard.cells_of(d, 0.15, 0.5, 1):
        places.setdefault(cell, []).append((i, bit))
    met = [tuple(sorted((a, b))) for cell in places.values() for (a, x), (b, y) in itertools.combinations(cell, 2) if not x & y]
    near = distance(points, points) <= 0.15
    assert len(set(met)) == len(met) < 150 * 149 / 2 * 0.7
    assert {(a, b) for a, b in itertools.combinations(range(150), 2) if near[a, b]} <= set(met)


def test_jaccard_join_without_rows_or_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_join(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["n_links"]) for r in jaccard.jaccard_join(odd).collect())
    assert got == [(-1, -1, 0), (-1, -1, 0), (3, 3, 0)]


def test_prefix_meets_every_partner():
    rng = np.random.default_rng(4)
    order = rng.integers(0, 40, 1 << jaccard.TABLE_BITS).astype(np.uint8)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.08], rng.integers(0, 1 << 63, 2, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert len(np.intersect1d(jaccard.prefix_of(a, order, 85, 100), jaccard.prefix_of(b, order, 85, 100)))


def test_shared_counts():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 200, rng.integers(0, 90)).astype(np.uint64)) for _ in range(50)]
    got = jaccard.shared_counts(sets[:20], sets[20:], dense_from=6, width=7)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[20:]] for a in sets[:20]]


def test_shingles_follow_words():
    assert [len(s) for s in shingles.shingle_sets([b"", b" ", b"a", b"a b c", b"a b c d", b"a b c d a b c d"], 4)] == [0, 0, 1, 1, 1, 4]
    x, y, z = shingles.shingle_sets([b"A b\tc\x0bd", b"a B c d", "É b c d".encode()], 4)
    assert np.array_equal(x, y) and not np.array_equal(x, z)


def test_components(spark):
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(0, 60)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(45)] + [(500, k) for k in range(501, 600)] + [(9, 9)]
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    nodes = {x for link in links for x in link if link[0] != link[1]}
    assert {r["node"]: r["component"] for r in components.connected_components(df).collect()} == closed(nodes, [x for x in links if x[0] != x[1]])
    assert components.connected_components(df.limit(0)).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(12, 16))
    rows = [(i, (centers[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.3, 1.0])).astype(np.float32)) for i in range(400)]
    rows += [(1000 + i, rows[3][1] * np.float32(2)) for i in range(3)] + [(2000 + i, rows[5][1]) for i in range(4)]
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    root = closed(ids.tolist(), [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] + [1.0] * 15), (5004, [None] + [1.0] * 15), (5005, [1.0] * 8), (5006, [float("inf")] * 16)]
    table = [(int(i), [float(c) for c in v], 0) for i, v in rows] + [(i, v, 1) for i, v in odd]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, copies int").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df, tile_rows=(64, 64)).collect()}
    wanted = {int(i): (int(near[k].sum()), int(root[i]), bool(root[i] == i)) for k, i in enumerate(ids)} | {i: (0, i, True) for i, _ in odd}
    assert got == wanted
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_in_double_precision(spark):
    t = 0.9
    edge = [t, float(np.sqrt(1 - t * t))]
    rows = [(1, [1e39, 0.0]), (2, [2e39, 0.0]), (3, [1e-50, 0.0]), (4, [0.0, 1e300]), (5, [0.0, 2e-300]), (6, edge), (7, [-1.0, 0.0]), (8, [0.0, 1e300]), (1, [-2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect())
    near = lambda x: int(np.dot(edge, x) / np.linalg.norm(edge) >= t)
    own = near([1.0, 0.0])
    assert got == sorted(
        [(1, 2 + own, 1), (2, 2 + own, 1), (3, 2 + own, 1), (4, 2, 4), (5, 2, 4), (6, 3 * own, 1 if own else 6), (7, 1, 1), (8, 2, 4), (1, 1, 1)]
    )


def test_boxes_part_clusters_and_lose_no_pair(spark):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(40, 12))
    x = centers[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 12)) * 0.12
    unit = x / np.sqrt((x**2).sum(1, keepdims=True))
    boxes = vectors.Boxes(x, vectors.principal_axes(unit), 5, 8)
    placed = boxes.place(x)
    box = boxes.box(placed)
    low, high = (np.array([f(placed[box == b], 0) for b in range(32)]) for f in (np.min, np.max))
    meet = vectors.meeting_boxes(low, high, 0.9)
    i, j = np.nonzero(unit @ unit.T >= 0.9)
    assert meet[box[i], box[j]].all() and meet.mean() < 0.7


def test_line_dedup(spark):
    rng = random.Random(8)
    lines = [f"Common line number {k}" for k in range(30)] + ["short", "", "  Padded COMMON line\t", "padded common line", "Ünïcode Line Éé", "ünïcode line Éé"]
    rows = [(i, "\n".join(rng.choice(lines) + ("" if rng.random() < 0.5 else f" {i} unique") for _ in range(rng.randint(0, 12)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (3, rows[3][1]), (None, "Common line number 1")]
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    wanted = []
    for i, text in rows:
        own = (text or "").split("\n")
        keep = [x for x in own if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        wanted.append((i, len(own), len(own) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    docs = spark.createDataFrame([(*r, "x", 9) for r in rows], "doc_id long, text string, _lines string, n_dropped int").repartition(4)
    deduped = line_dedup.line_dedup(docs)
    assert set(deduped.columns) == {"doc_id", "text", "_lines", "n_dropped", "n_lines"}
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in line_dedup.digest_columns(deduped).collect()), key=order) == sorted(wanted, key=order)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0
    clash = docs.withColumnsRenamed({"_lines": "__ld_text"}).withColumns({"_gone": F.lit(1), "_old": F.lit(2), "_did": F.lit(3), "N_LINES": F.lit(4), "a.b": F.lit(5)})
    kept = line_dedup.line_dedup(clash)
    assert {"__ld_text", "_gone", "_old", "_did", "a.b", "n_lines"} <= set(kept.columns) and {(r["__ld_text"], r["_gone"], r["_did"]) for r in kept.collect()} == {("x", 1, 3)}
    long = spark.createDataFrame([(1, "\n".join(f"line of number {k % 70000}" for k in range(140_000))), (2, "line of number 3\nmine alone, mine")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup(long).collect()) == [(1, 140_000, 0), (2, 2, 1)]
    three = {k for k, v in holders.items() if len(v) >= 3}
    for r in line_dedup.line_dedup(docs, min_docs=3).where("doc_id < 80").collect():
        assert all(min(holders[key(x)]) == r["doc_id"] for x in (r["text"] or "").split("\n") if key(x) in three)
