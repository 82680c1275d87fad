"""Exact Jaccard self-join of documents on word shingles, as a join in the Jaccard metric space.

Distance is 1 - similarity; documents link within the radius 1 - threshold. Unrelated documents all have
distance exactly 1 from each other, so pivots drawn from the documents separate nothing at first. The join
therefore goes on in levels, each of which splits what the one before has left together:

1. Single shingles are the first pivots. A document lies equally near to all of its own shingles; ties go to
   the rarest, and the triangle inequality bounds how far down its own order a document has to be copied
   into further regions so that it meets all documents within the radius ``k`` times (its boundary window:
   the first ``n - ceil(t * n) + k`` shingles). How common shingles are comes from a fixed-size table of
   counts, which only sets the order, not the result. Small regions give pairs. Large regions matter only to
   documents with so many of them that partners may meet nowhere else; these are windowed once more.
2. Documents that may link are joined to groups. Groups larger than ``small_group`` go through step 1 again by
   themselves, with counts of their own shingles only, for as long as that halves the pairs to compare.
3. Where distances spread, documents are pivots: each goes to the Voronoi cell of its nearest pivot, and is
   copied to the cells whose documents may lie within the radius by the triangle inequality. Cells are split
   again for as long as that halves the pairs to compare.
4. Regions of up to ``small_group`` documents are compared whole. Dense larger ones are cut to tiles, bounded
   by rows and by bytes, and a tile meets just those tiles whose distance windows to all pivots come within the
   radius. All comparisons are exact counts of shared shingles.

Documents with equal shingle sets are joined beforehand and counted, so copies cost one comparison. A
region returns link counts and a spanning forest, not its links. Nothing is capped or sampled.

Null handling: null and empty texts, and texts without words, have an empty set and link with nothing. Rows
without id link with nothing and have no component. Rows that repeat an id stand each for itself: links belong
to shingle sets, and the id only names them. Other columns, whatever their names, are not looked at. A very
long text is one row of 8 bytes a word; ties at the threshold link.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.components import connected_components, local_forest
from webloom.llm.shingles import mix, shingle_hashes, shingle_sets
from webloom.llm.skew import id_bits, join_hot, likely, often
from webloom.llm.tokens import slices
from webloom.session import discard, materialize, ship

#: Size of the table of counts: a power of two; its blocks are what tasks exchange.
TABLE_BITS, BLOCKS = 20, 64
_A, _B = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in column.to_pylist()]


def _table_rows(total: np.ndarray) -> pa.RecordBatch:
    parts = total.astype("<u4").reshape(BLOCKS, -1)
    task = TaskContext.get().partitionId()
    return pa.RecordBatch.from_pydict(
        {"block": list(range(BLOCKS)), "task": [task] * BLOCKS, "counts": [zlib.compress(p.tobytes(), 1) for p in parts]},
        schema=pa.schema([("block", pa.int32()), ("task", pa.int32()), ("counts", pa.binary())]),
    )


def _count_texts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << TABLE_BITS, np.int64)
        for batch in batches:
            texts = _texts(batch.column(0))
            for begin, end in slices(texts, 1_000_000):
                h, _ = shingle_hashes(texts[begin:end], size)
                total += np.bincount((h >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=len(total))
        if total.any():
            yield _table_rows(total)

    return run


def _count_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << TABLE_BITS, np.int64)
    for batch in batches:
        h = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8")
        total += np.bincount((h >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=len(total))
    if total.any():
        yield _table_rows(total)


def shingle_order(rows: DataFrame, count) -> np.ndarray:
    """For each slot of the table, how common its shingles are in all rows (coarse, one byte).

    The tables of the tasks are added in a tree, 64 at a time.
    """

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(c), "<u4").astype(np.int64) for c in table.column("counts").to_pylist())
        packed = zlib.compress(np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes(), 1)
        return pa.table({"block": table.column("block")[:1], "task": table.column("task")[:1], "counts": pa.array([packed], pa.binary())})

    kind = "block int, task int, counts binary"
    counts, width = rows.mapInArrow(count, kind), rows.rdd.getNumPartitions()
    while width > 64:
        width = -(-width // 64)
        counts = counts.withColumn("task", F.col("task") % width).groupBy("block", "task").applyInArrow(add, kind)
    counts = counts.groupBy("block").applyInArrow(add, kind)
    order = np.zeros(1 << TABLE_BITS, np.uint8)
    step = (1 << TABLE_BITS) // BLOCKS
    for r in counts.collect():  # BLOCKS rows, 4 MB in all
        found = np.frombuffer(zlib.decompress(r["counts"]), "<u4")
        order[r["block"] * step : (r["block"] + 1) * step] = np.minimum(4 * np.log2(found + 1.0), 255)
    return order


def least_shared(n):
    """How many shingles of their windows two documents share at least, by the smaller one's size."""
    return 1 + n // 32


def _in_order(shingles: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A key by which rarer shingles come first, the same for every document."""
    common = order[(shingles >> np.uint64(64 - TABLE_BITS)).astype(np.int64)].astype(np.uint64)
    return (common << np.uint64(56)) | (mix(shingles) >> np.uint64(8))


def prefix_of(own: np.ndarray, order: np.ndarray, num: int, den: int) -> np.ndarray:
    """The rarest shingles of a set: any set within the radius shares ``least_shared`` of them at least."""
    n = len(own)
    p = n + (-num * n) // den + least_shared(n)  # n - ceil(t * n) + k
    if p >= n:
        return own
    return own[np.argpartition(_in_order(own, order), p - 1)[:p]]


def window_of_large(large: np.ndarray, n: int, order: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of a document's large regions, those in which it meets every partner that it meets in no small one.

    Such partners share as many large regions as the smaller document must share at least; so a document with
    fewer has none, and of the others the first ones do.
    """
    k = least_shared(-(-num * n // den))
    if len(large) < k:
        return large[:0]
    return large[np.argsort(_in_order(large, order))[: len(large) - k + 1]]


def _fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    sums = [(mix(s ^ _A).sum(dtype=np.uint64), mix(s ^ _B).sum(dtype=np.uint64)) for s in sets]
    return np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)


def _set_rows(shared, size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            texts = _texts(batch.column(2))
            for begin, end in slices(texts, 1_000_000):
                sets = shingle_sets(texts[begin:end], size)
                f = _fingerprints(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin),
                        batch.column(1).slice(begin, end - begin),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(f[:, 0]),
                        pa.array(f[:, 1]),
                        pa.array([prefix_of(s, order, num, den).tobytes() for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "h", "n", "f1", "f2", "prefix"],
                )

    return run


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each region that a document is copied to."""
    for batch in batches:
        prefix = [np.frombuffer(p, "<i8") for p in batch.column(2).to_pylist()]
        counts = [len(p) for p in prefix]
        for begin in range(0, len(prefix), 1000):
            part = slice(begin, begin + 1000)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(prefix[part])),
                    pa.array(np.repeat(batch.column(1).to_numpy()[part], counts[part])),
                    pa.array(np.repeat(batch.column(0).to_numpy()[part], counts[part])),
                ],
                names=["s", "n", "doc"],
            )


FOUND = "a long, b long, k long, s long, part int"


def _meetings(num: int, den: int, small_region: int, chain: bool):
    """What regions in order give: all pairs of a small region, and of a larger one its neighbours or its rows.

    With ``chain``, neighbours in larger regions are pairs as well (k = 0); without, each row of a larger region
    comes back as (a, k = size, s). A region at either end of a partition may go on in the next one and counts as
    large; with ``chain`` the partition's first and last rows are passed on for stitching.
    """
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("k", pa.int64()), ("s", pa.int64()), ("part", pa.int32())])

    def batch_of(a, b, k, s, part):
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (a, b, k, s, part)], schema=kinds)

    def pairs_of(s, n, doc, large):
        found = []
        for gap in range(1, small_region):
            same = s[gap:] == s[:-gap]
            if not same.any():
                break
            keep = same if chain and gap == 1 else same & ~large[gap:]
            at = np.flatnonzero(keep & (den * n[:-gap] >= num * n[gap:]) & (doc[gap:] != doc[:-gap]))
            if len(at):
                k = np.where(large[at], 0, least_shared(n[at]))
                found.append(np.stack([np.minimum(doc[at], doc[at + gap]), np.maximum(doc[at], doc[at + gap]), k], 1))
        pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        loose = pairs[:, 2] == 0  # neighbours in large regions are often the same pair
        pairs = np.concatenate([pairs[~loose], np.unique(pairs[loose], axis=0)])
        nothing = pa.nulls(len(pairs))
        return batch_of(pairs[:, 0], pairs[:, 1], pairs[:, 2], nothing.cast(pa.int64()), nothing.cast(pa.int32()))

    def rows_of(s, n, doc):
        nothing = pa.nulls(len(s))
        return batch_of(doc, nothing.cast(pa.int64()), n, s, nothing.cast(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        s = n = doc = np.zeros(0, np.int64)
        first, opening, told = None, True, 0  # opening: the first kept row belongs to a large region, and was told of
        for batch in batches:
            s, n, doc = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((s, n, doc)))
            if not len(s):
                continue
            first = first or (int(s[0]), int(n[0]), int(doc[0]))
            head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            size = np.diff(np.concatenate([head, [len(s)]]))
            large = size > small_region
            large[0] |= opening
            rows = np.repeat(large, size)
            cut = int(head[-1])  # the last region waits for its other rows
            yield pairs_of(s[:cut], n[:cut], doc[:cut], rows[:cut])
            if large[-1] and chain:
                yield pairs_of(s[cut:], n[cut:], doc[cut:], rows[cut:])
            if not chain:
                tell = rows.copy()
                tell[:told] = False
                tell[cut:] &= large[-1]
                yield rows_of(s[tell], n[tell], doc[tell])
            cut = len(s) - 1 if large[-1] else cut
            s, n, doc, opening, told = s[cut:], n[cut:], doc[cut:], bool(large[-1]), int(large[-1])
        if first and not chain:
            yield rows_of(s[told:], n[told:], doc[told:])
        elif first:
            yield pairs_of(s, n, doc, np.ones(len(s), bool))
            last = (int(s[-1]), int(n[-1]), int(doc[-1]))
            yield batch_of([first[2], last[2]], [0, 1], [first[1], last[1]], [first[0], last[0]], pa.array([part] * 2, pa.int32()))

    return run


def _in_regions(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartitionByRange(parts, "s", "n", "doc").sortWithinPartitions("s", "n", "doc")


def candidate_groups(reps: DataFrame, order, num: int, den: int, small_region: int = 12, rows_a_part: int = 4_000_000) -> DataFrame:
    """(node, component): groups of documents that may link, over ``reps`` (node, n, prefix).

    Two documents within the radius share ``least_shared`` regions. They are a pair of so many small regions,
    less the large ones that both have; or they meet in the windows of their large ones (``window_of_large``).
    Pairs that are met less often cannot link and are left out before groups are formed.
    """
    spark = reps.sparkSession
    total = reps.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0] // 8
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // rows_a_part))
    rows = reps.select("node", "n", "prefix").mapInArrow(_regions, "s long, n long, doc long")
    found = materialize(_in_regions(rows, parts).mapInArrow(_meetings(num, den, small_region, False), FOUND), "jaccard-regions")
    large = found.where("b IS NULL").groupBy("a").agg(F.max("k").alias("n"), F.collect_list("s").alias("regions"))
    large = materialize(large, "jaccard-common")
    met = found.where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("times"), F.max("k").alias("k"))
    of = lambda name: large.select(F.col("a").alias(f"_{name}"), F.size("regions").alias(f"_n{name}"))
    met = met.join(of("x"), F.col("a") == F.col("_x"), "left").join(of("y"), F.col("b") == F.col("_y"), "left")
    besides = F.least(F.coalesce("_nx", F.lit(0)), F.coalesce("_ny", F.lit(0)))
    links = met.where(F.col("times") >= F.col("k") - besides).select("a", "b")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [
                window_of_large(np.array(regions, np.int64).view(np.uint64), n, order.value, num, den).view(np.int64)
                for n, regions in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            count = [len(x) for x in kept]
            if sum(count):
                columns = [np.concatenate(kept), np.repeat(batch.column(1).to_numpy(), count), np.repeat(batch.column(0).to_numpy(), count)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["s", "n", "doc"])

    again = large.select("a", "n", "regions").mapInArrow(windows, "s long, n long, doc long")
    again = materialize(_in_regions(again, parts).mapInArrow(_meetings(num, den, small_region, True), FOUND), "jaccard-chains")
    links = links.union(again.where("part IS NULL").select("a", "b").distinct())
    ends = sorted((r["part"], r["b"], r["s"], r["k"], r["a"]) for r in again.where("part IS NOT NULL").collect())  # two rows a partition
    stitched = [(x[4], y[4]) for x, y in zip(ends[1::2], ends[2::2]) if x[2] == y[2] and den * x[3] >= num * y[3] and x[4] != y[4]]
    if stitched:
        links = links.union(spark.createDataFrame(stitched, "a long, b long"))
    groups = materialize(connected_components(links), "jaccard-groups")
    discard(found, large, again)
    return groups


def shared_counts(x: list[np.ndarray], y: list[np.ndarray], dense_from: int = 16, width: int = 2048) -> np.ndarray:
    """How many shingles each set of ``x`` shares with each of ``y``."""
    flat = np.concatenate([*x, *y])
    owner = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([head, [len(flat)]]))
    out = np.zeros((len(x), len(y)), np.float32)
    few = (size > 1) & (size <= dense_from)
    for k in np.unique(size[few]).tolist():
        members = owner[head[few & (size == k)][:, None] + np.arange(k)]
        for i in range(k):
            for j in range(k):
                a, b = members[:, i], members[:, j] - len(x)
                good = (a < len(x)) & (b >= 0)
                if good.any():
                    cell = np.bincount(a[good] * len(y) + b[good], minlength=0)
                    out.ravel()[: len(cell)] += cell
    many = np.flatnonzero(size > dense_from)
    for begin in range(0, len(many), width):
        block = many[begin : begin + width]
        at = np.repeat(head[block], size[block]) + (np.arange(size[block].sum()) - np.repeat(np.cumsum(size[block]) - size[block], size[block]))
        column, row = np.repeat(np.arange(len(block)), size[block]), owner[at]
        has = np.zeros((len(x) + len(y), len(block)), np.float32)
        has[row, column] = 1
        out += has[: len(x)] @ has[len(x) :].T
    return np.rint(out).astype(np.int64)


def join_region(ids, copies, sets, tile, mask, num: int, den: int, block: int = 512):
    """Link counts and a spanning forest of all pairs in one tile, or between two.

    Rows with a bit of ``mask`` in common meet elsewhere.
    """
    tiles = [np.flatnonzero(tile == t) for t in np.unique(tile)]
    links, forest = np.zeros(len(ids), np.int64), []
    same = len(tiles) == 1
    left, right = tiles[0], tiles[-1]
    for a in range(0, len(left), block):
        rows = left[a : a + block]
        for b in range(a if same else 0, len(right), block):
            cols = right[b : b + block]
            n_rows, n_cols = (np.array([len(sets[i]) for i in c]) for c in (rows, cols))
            both = shared_counts([sets[i] for i in rows], [sets[i] for i in cols])
            near = den * both >= num * (n_rows[:, None] + n_cols[None, :] - both)
            near &= (mask[rows][:, None] & mask[cols][None, :]) == 0
            i, j = np.nonzero(near)
            i, j = rows[i], cols[j]
            if same and a == b:
                i, j = i[i < j], j[i < j]
            if len(i):
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                new = local_forest(ids[i].tolist(), ids[j].tolist())
                forest = local_forest(*map(list, zip(*forest, *new))) if forest else new
    return links, forest


RESULT = "id long, other long, links long"


def _join_regions(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        ids, copies, group, tile, mask = (table.column(c).to_numpy() for c in ("node", "copies", "component", "tile", "mask"))
        sets = [np.frombuffer(s, "<u8") for s in table.column("set").to_pylist()]
        out: list[tuple] = []
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            at = at[np.argsort(ids[at], kind="stable")]
            p, q = (table.column(c).to_numpy()[at[0]] for c in ("p", "q"))
            if p != q and len(np.unique(tile[at])) == 1:
                continue
            links, forest = join_region(ids[at], copies[at], [sets[i] for i in at], tile[at], mask[at], num, den)
            hit = np.flatnonzero(links)
            out += [(i, None, n) for i, n in zip(ids[at][hit].tolist(), links[hit].tolist())] + [(a, b, 0) for a, b in forest]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({k: pa.array(list(c), pa.int64()) for k, c in zip(("id", "other", "links"), columns)})

    return run


MEMBERS = "component long, node long, copies long, n long, set binary, mask long"


def _distances(pivots: int):
    """Each member's distances to the pivots of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            known: dict[bytes, np.ndarray] = {}
            for own, others in zip(batch.column(4).to_pylist(), batch.column(6).to_pylist()):
                own, d = np.frombuffer(own, "<u8"), []
                for other in others:
                    pivot = known.setdefault(other, np.frombuffer(other, "<u8"))
                    both = len(np.intersect1d(own, pivot, assume_unique=True))
                    d.append(1 - both / (len(own) + len(pivot) - both))
                rows.append(d)
            d = np.array(rows).reshape(-1, pivots)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(6)), pa.array(d.argmin(1), pa.int32()), pa.array(d.tolist(), pa.list_(pa.float64()))],
                names=["component", "node", "copies", "n", "set", "mask", "near", "d"],
            )

    return run


def cells_of(d: np.ndarray, radius: float, core: float, bit: int) -> list[tuple[int, int, int]]:
    """(row, cell, bit to set): a document's own cell and those that it is copied to, by its distances.

    A cell holds what is nearest to its pivot and at most ``core`` away; the rest is one more cell. A pair meets
    in the earlier of its two cells, so copies go to earlier cells only: to those whose documents, by the
    triangle inequality, may be within the radius.
    """
    out = []
    for i, row in enumerate(d):
        near = int(row.argmin())
        own, reach = (near, min(core, row[near] + radius)) if row[near] <= core else (len(row), core)
        out.append((i, own, 0))
        out += [(i, p, bit) for p in np.flatnonzero(row[:own] <= reach + radius + 1e-9).tolist()]
    return out


def _to_cells(radius: float, core: float, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.array(batch.column(6).to_pylist(), np.float64)
            if not len(d):
                continue
            row, cell, bit = (np.array(c, np.int64) for c in zip(*cells_of(d, radius, core, 1 << level)))
            kept = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(i) for i in range(5)), pa.array(kept.column(5).to_numpy() | bit), pa.array(cell)],
                names=["component", "node", "copies", "n", "set", "mask", "cell"],
            )

    return run


def _place(members: DataFrame, pivots: int) -> DataFrame:
    pick = [F.min_by("set", F.xxhash64(F.lit(k), "node")).alias(f"_p{k}") for k in range(pivots)]
    chosen = members.groupBy("component").agg(*pick).select("component", F.array(*[f"_p{k}" for k in range(pivots)]).alias("pivots"))
    chosen = materialize(chosen, "jaccard-pivots")
    rows = members.join(chosen, "component").select("component", "node", "copies", "n", "set", "mask", "pivots")
    placed = materialize(rows.mapInArrow(_distances(pivots), f"{MEMBERS}, near int, d array<double>"), "jaccard-placed")
    discard(chosen)
    return placed


def _sizes(members: DataFrame, *by: str) -> DataFrame:
    return members.groupBy(*by).agg(F.count("*").alias("size"))


def _tile_pairs(placed: DataFrame, num: int, den: int, pivots: int, small_group: int, tile_bytes: int) -> DataFrame:
    """Tile pairs of dense groups: rows of (component, node, copies, set, mask, tile, p, q)."""
    radius = 1 - num / den
    placed = placed.withColumn("shell", F.floor(F.element_at("d", F.col("near") + 1) / F.lit(radius)).cast("int"))
    cells = (
        placed.groupBy("component", "near", "shell")
        .agg(F.count("*").alias("count"), F.sum("n").alias("bytes"))
        .join(_sizes(placed, "component"), "component")
        .withColumn("rows", F.least(F.lit(20_000), F.greatest(F.lit(small_group), F.ceil(F.col("size") / 16))))
        .select("component", "near", "shell", F.greatest(F.ceil(F.col("count") / F.col("rows")), F.ceil(8 * F.col("bytes") / F.lit(tile_bytes))).alias("cuts"))
    )
    cells = materialize(cells, "jaccard-cuts")
    tile = F.xxhash64("near", "shell", F.pmod(F.xxhash64(F.lit(23), "node"), F.col("cuts")))
    tiled = placed.join(cells, ["component", "near", "shell"]).withColumn("tile", tile)
    tiled = materialize(tiled.select("component", "node", "copies", "n", "set", "mask", "d", "tile"), "jaccard-tiles")
    window = [f(F.element_at("d", k + 1)).alias(f"{name}{k}") for k in range(pivots) for name, f in (("lo", F.min), ("hi", F.max))]
    tiles = materialize(tiled.groupBy("component", "tile").agg(F.min("n").alias("lon"), F.max("n").alias("hin"), *window), "jaccard-windows")
    a, b = tiles.alias("a"), tiles.alias("b")
    slack = radius + 1e-9
    meet = (F.col("a.component") == F.col("b.component")) & (F.col("a.tile") <= F.col("b.tile"))
    meet &= (den * F.col("a.hin") >= num * F.col("b.lon")) & (den * F.col("b.hin") >= num * F.col("a.lon"))
    for k in range(pivots):
        meet &= (F.col(f"a.lo{k}") - F.col(f"b.hi{k}") <= slack) & (F.col(f"b.lo{k}") - F.col(f"a.hi{k}") <= slack)
    pairs = materialize(a.join(b, meet).select("a.component", F.col("a.tile").alias("p"), F.col("b.tile").alias("q")), "jaccard-meet")
    sides = pairs.select("component", "p", "q", F.col("p").alias("tile")).union(
        pairs.where("p <> q").select("component", "p", "q", F.col("q").alias("tile"))
    )
    return tiled.join(sides, ["component", "tile"]).select("component", "node", "copies", "set", "mask", "tile", "p", "q")


def _split_regions(open_: DataFrame, num: int, den: int, small_group: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Step 2: groups by regions of their own shingles. Regions that are small now, and what is left."""
    spark, ready = open_.sparkSession, []
    while True:
        work = _sizes(open_, "component").agg(F.sum(F.col("size").cast("double") ** 2)).first()[0]
        order = spark.sparkContext.broadcast(shingle_order(open_.select("set"), _count_sets))  # 1 MB

        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [prefix_of(np.frombuffer(s, "<u8"), order.value, num, den) for s in batch.column(2).to_pylist()]
                salt = mix(batch.column(3).to_numpy().view(np.uint64))
                kept = pa.array([mix(p ^ x).tobytes() for p, x in zip(own, salt)], pa.binary())  # regions do not reach over groups
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept], names=["node", "n", "prefix"])

        reps = materialize(open_.select("node", "n", "set", "component").mapInArrow(prefixes, "node long, n long, prefix binary"), "jaccard-prefixes")
        groups = candidate_groups(reps, order, num, den)
        sized = groups.join(_sizes(groups, "component"), "component").select(F.col("node").alias("_node"), F.col("component").alias("_group"), "size")
        split = open_.join(sized, F.col("node") == F.col("_node")).select(F.col("_group").alias("component"), "node", "copies", "n", "set", "mask", "size")
        split = materialize(split, "jaccard-split")
        discard(reps)
        ready.append(split.where(F.col("size") <= small_group).drop("size"))
        open_ = split.where(F.col("size") > small_group).drop("size")
        left = _sizes(open_, "component").agg(F.coalesce(F.sum(F.col("size").cast("double") ** 2), F.lit(0.0))).first()[0]
        if not left:
            return ready, None
        if 2 * left > work:
            return ready, open_


def _split_cells(open_: DataFrame, num: int, den: int, pivots: int, core: float, small_group: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Step 3: Voronoi cells again and again. Regions that are small now, and dense ones with their distances."""
    ready, dense, radius = [], [], 1 - num / den
    for level in range(62):
        placed = _place(open_, pivots)
        cells = placed.select("component", "node", "copies", "n", "set", "mask", "d")
        cells = materialize(cells.mapInArrow(_to_cells(radius, core, level), f"{MEMBERS}, cell long"), "jaccard-cells")
        counts = materialize(_sizes(cells, "component", "cell"), "jaccard-cell-sizes")
        whole = _sizes(placed, "component").withColumnRenamed("size", "whole")
        works = counts.groupBy("component").agg(F.sum(F.col("size").cast("double") ** 2).alias("work")).join(whole, "component")
        halved = materialize(works.where(2 * F.col("work") <= F.col("whole").cast("double") ** 2).select("component"), "jaccard-halved")
        dense.append(placed.join(halved, "component", "left_anti"))
        split = cells.join(halved, "component").join(counts, ["component", "cell"])
        split = split.select(F.xxhash64("component", "cell").alias("component"), "node", "copies", "n", "set", "mask", "size")
        split = materialize(split, "jaccard-split")
        discard(cells, counts)
        ready.append(split.where(F.col("size") <= small_group).drop("size"))
        open_ = split.where(F.col("size") > small_group).drop("size")
        if open_.isEmpty():
            return ready, dense
    return ready, [*dense, _place(open_, pivots)]


def _link_groups(narrow, groups, nodes, size, num, den, pivots, core, small_group, group_rows, tile_bytes) -> DataFrame:
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(6))
            for begin, end in slices(texts, 1_000_000):
                part = batch.slice(begin, end - begin)
                sets = shingle_sets(texts[begin:end], size)
                own = np.array([len(s) for s in sets], np.int64), *_fingerprints(sets).T
                same = np.logical_and.reduce([x == part.column(i).to_numpy() for x, i in zip(own, (3, 4, 5))])
                made = [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(np.zeros(len(sets), np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(4)), *made], names=["component", "node", "copies", "n", "set", "mask"]
                ).filter(pa.array(same))

    wanted = groups.join(nodes.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"))
    wanted = materialize(wanted.select("component", "node", "copies", "n", "f1", "f2", F.col("doc_id").alias("_id"), F.col("h").alias("_h")), "jaccard-wanted")
    bits = materialize(id_bits(wanted, "_h"), "jaccard-bits")
    some = likely(narrow, "h", bits)
    texts = some.join(wanted, (F.col("doc_id") == F.col("_id")) & (F.col("h") == F.col("_h")))
    # repeated rows go before the sets are made: that needs no other partitioning than the join's
    texts = texts.dropDuplicates(["doc_id", "h", "node"]).select("component", "node", "copies", "n", "f1", "f2", "text")
    members = materialize(texts.mapInArrow(sets_of, MEMBERS), "jaccard-members")
    sizes = materialize(_sizes(members, "component"), "jaccard-sizes")
    large = sizes.agg(F.count(F.when(F.col("size") > small_group, 1))).first()[0]
    ready, dense = [members], []
    if large:
        keyed = members.join(sizes, "component")
        ready = [keyed.where(F.col("size") <= small_group).drop("size")]
        open_ = materialize(keyed.where(F.col("size") > small_group).drop("size"), "jaccard-large")
        more, open_ = _split_regions(open_, num, den, small_group)
        ready += more
        if open_ is not None:
            more, dense = _split_cells(open_, num, den, pivots, core, small_group)
            ready += more
    none = F.lit(0).cast("long")
    kind = ("component", "node", "copies", "set", "mask")
    small = _together(ready).select(*kind, none.alias("tile"), none.alias("p"), none.alias("q"))
    total = sum(t.count() for t in ready)
    region = F.pmod(F.xxhash64(F.lit(29), "component"), F.lit(max(1, total // group_rows)))
    found = small.withColumn("region", region).groupBy("region").applyInArrow(_join_regions(num, den), RESULT)
    if dense:
        tiles = _tile_pairs(_together(dense), num, den, pivots, small_group, tile_bytes)
        found = found.union(tiles.groupBy("component", "p", "q").applyInArrow(_join_regions(num, den), RESULT))
    return found


def _together(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def linked_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4,
    threshold: tuple[int, int] = (85, 100),
    pivots: int = 8,
    core: float = 0.5,
    small_group: int = 64,
    group_rows: int = 128,
    tile_bytes: int = 1 << 25,
) -> DataFrame:
    """Per row: doc_id, h (``text_hash``), n, component_id, n_links, and first_h, by which the first text of a component is known.

    The first text of a component is that of its smallest id; of several with that id, the one with the smallest hash.
    """
    spark = docs.sparkSession
    ship(spark)
    num, den = threshold
    text = F.col(f"`{text_col}`")
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_hash(text).alias("h"), text.alias("text"))
    order = shingle_order(narrow.where("doc_id IS NOT NULL").select("text"), _count_texts(size))
    order = spark.sparkContext.broadcast(order)  # 1 MB
    kind = "doc_id long, h long, n long, f1 long, f2 long, prefix binary"
    rows = materialize(narrow.mapInArrow(_set_rows(order, size, num, den), kind), "jaccard-sets")
    some = rows.where("doc_id IS NOT NULL AND n > 0")
    nodes = some.groupBy("f1", "f2", "n").agg(
        F.min(F.struct("doc_id", "h")).alias("of"), F.count("*").alias("copies"), F.first("prefix").alias("prefix")
    )
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "of.doc_id", "of.h", "n", "f1", "f2", "copies", "prefix")
    nodes = materialize(nodes, "jaccard-nodes")
    groups = candidate_groups(nodes, order, num, den)
    found = _link_groups(narrow, groups, nodes.drop("prefix"), size, num, den, pivots, core, small_group, group_rows, tile_bytes)
    found = materialize(found, "jaccard-links")
    parts = connected_components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    parts = materialize(parts, "jaccard-parts")
    named = parts.join(nodes.select(F.col("node").alias("_node"), "doc_id", "h"), F.col("node") == F.col("_node"))
    named = named.groupBy(F.col("component").alias("_part")).agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count("*").alias("_of"))
    named = materialize(named, "jaccard-named")
    whole = named.agg(F.coalesce(F.sum("_of"), F.lit(0))).first()[0]
    named = join_hot(parts, named, F.col("component") == F.col("_part"), often("_of", whole)).select("node", "first")
    counts = found.where("other IS NULL").groupBy("id").agg(F.sum("links").alias("links"))
    facts = (
        nodes.withColumnRenamed("node", "rep")
        .join(counts, F.col("rep") == F.col("id"), "left")
        .join(named, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("f1").alias("_a"), F.col("f2").alias("_b"), F.col("n").alias("_n"), F.col("copies").alias("_copies"),
            F.coalesce("first", F.struct("doc_id", "h")).alias("_first"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"),
        )
    )
    facts = materialize(facts, "jaccard-facts")
    same = (F.col("f1") == F.col("_a")) & (F.col("f2") == F.col("_b")) & (F.col("n") == F.col("_n")) & F.col("doc_id").isNotNull()
    joined = join_hot(rows.select("doc_id", "h", "n", "f1", "f2"), facts, same, often("_copies", rows.count()))
    return joined.select(
        "doc_id", "h", "n",
        F.coalesce("_first.doc_id", "doc_id").alias("component_id"),
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_first.h", "h").alias("first_h"),
    )


def text_hash(text):
    """The hash by which ``linked_rows`` tells the texts of a repeated id apart."""
    return F.xxhash64(text)


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row; options as for ``linked_rows``."""
    return linked_rows(docs, **options).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
