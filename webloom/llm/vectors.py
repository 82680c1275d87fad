"""Near-duplicate vectors by tiled comparison along principal axes.

Vectors are rotated to their principal axes, so that the leading coordinates hold most of each product.
Tiles are ordered by them: boxes of a tree that halves a sample along the leading axes again and again. Two tiles
meet where their boxes come within the distance that the threshold allows, the norms of what is behind the leading
axes included; the others are never shuffled to each other. A tile product first takes the leading coordinates only; what the rest
can add at most is the product of the two suffix norms, which is carried as one more coordinate. Pairs that
cannot reach the threshold stop there, the others take more coordinates, and those that are left are
decided by their cosine in double precision.

The comparison is exact and covers all pairs of different vectors; copies are joined beforehand and counted.
A tile pair returns link counts and a spanning forest, not its links, so a dense group costs no more rows
than it has vectors. Where vectors have no structure all boxes come near each other, and the work is quadratic in
the number of different vectors, as an exact comparison of such vectors is.

Null handling: a vector that is null, empty, zero, or holds a null or a non-finite component links with
nothing. Vectors of different dimension link with nothing. Rows without id are left out; of rows
that repeat an id with different vectors, each counts as a copy of its own vector. Vectors are compared as
doubles whatever their type; a cosine equal to the threshold links. An empty table gives an empty one; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.components import connected_components, local_forest
from webloom.llm.skew import join_hot, often
from webloom.session import materialize, ship

#: How much a bound in single precision may fall short.
SLACK = 1e-4


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns, the direction of most energy first."""
    _, axes = np.linalg.eigh(sample.T @ sample)
    return axes[:, ::-1]


def scaled(raw: np.ndarray) -> np.ndarray:
    """The vectors, those multiplied by a power of two whose squares a double would not hold."""
    most = np.abs(raw).max(1, keepdims=True)
    far = (most > 1e100) | (most < 1e-100)
    return np.where(far, np.ldexp(raw, -np.frexp(most)[1]), raw) if far.any() else raw


class Tile:
    """Unit vectors of a tile along the axes, with their leading coordinates and suffix norms."""

    def __init__(self, ids, copies, raw: np.ndarray, axes: np.ndarray, steps: list[int]):
        self.ids, self.copies = ids, copies
        self.raw = scaled(raw)
        self.norm = np.sqrt((self.raw**2).sum(1))
        turned = (self.raw / self.norm[:, None]) @ axes
        self.parts, at = [], 0
        for step in steps:
            rest = np.sqrt(np.maximum((turned[:, step:] ** 2).sum(1), 0))
            self.parts.append((turned[:, at:step].astype(np.float32), rest.astype(np.float32)))
            at = step
        self.lead = np.column_stack([self.parts[0][0], self.parts[0][1]])


class Boxes:
    """A tree over the leading axes: ``2 ** depth`` boxes, each half of its parent's sample along its widest axis."""

    def __init__(self, sample: np.ndarray, axes: np.ndarray, depth: int, lead: int):
        self.axes, self.depth = axes[:, :lead], depth
        self.axis, self.at = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        self._halve(self.place(sample)[:, :-1], 1)

    def _halve(self, y: np.ndarray, node: int):
        if node < 1 << self.depth:
            self.axis[node] = y.var(0).argmax() if len(y) else 0
            own = y[:, self.axis[node]]
            self.at[node] = np.median(own) if len(y) else 0.0
            self._halve(y[own <= self.at[node]], 2 * node)
            self._halve(y[own > self.at[node]], 2 * node + 1)

    def place(self, raw: np.ndarray) -> np.ndarray:
        """Leading coordinates of unit vectors, and the norm of the rest."""
        raw = scaled(raw)
        y = (raw / np.sqrt((raw**2).sum(1, keepdims=True))) @ self.axes
        return np.column_stack([y, np.sqrt(np.maximum(1 - (y**2).sum(1), 0))])

    def box(self, placed: np.ndarray) -> np.ndarray:
        node = np.ones(len(placed), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (placed[np.arange(len(placed)), self.axis[node]] > self.at[node])
        return node - (1 << self.depth)


def meeting_boxes(low: np.ndarray, high: np.ndarray, threshold: float) -> np.ndarray:
    """Which boxes (rows: their bounds on each leading axis and on the rest's norm) may hold a linked pair."""
    far = np.zeros((len(low), len(low)))
    for lo, hi in zip(low.T, high.T):
        far += np.maximum(0, np.maximum(lo[:, None] - hi[None], lo[None] - hi[:, None])) ** 2
    return far <= 2 - 2 * threshold + SLACK


def linked_pairs(x: Tile, y: Tile, same: bool, threshold: float, rows: int = 512, chunk: int = 1 << 16):
    """Index pairs (i, j) of two tiles with cosine at or above ``threshold``, block by block."""
    for begin in range(0, len(x.ids), rows):
        bound = x.lead[begin : begin + rows] @ y.lead.T
        i, j = np.nonzero(bound >= threshold - SLACK)
        partial = bound[i, j]
        i += begin
        if same:
            keep = i < j
            i, j, partial = i[keep], j[keep], partial[keep]
        for at in range(0, len(i), chunk):
            a, b, sum_ = i[at : at + chunk], j[at : at + chunk], partial[at : at + chunk]
            for (cx, rx), (cy, ry), (px, py) in zip(x.parts[1:], y.parts[1:], [(p[1], q[1]) for p, q in zip(x.parts, y.parts)]):
                sum_ = sum_ - px[a] * py[b] + np.einsum("ij,ij->i", cx[a], cy[b]) + rx[a] * ry[b]
                keep = sum_ >= threshold - SLACK
                a, b, sum_ = a[keep], b[keep], sum_[keep]
            cosine = np.einsum("ij,ij->i", x.raw[a], y.raw[b]) / (x.norm[a] * y.norm[b])
            keep = cosine >= threshold
            if keep.any():
                yield a[keep], b[keep]


def _tile_links(threshold: float, axes: np.ndarray, steps: list[int]):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("tile").to_numpy()
        ids, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        raw = np.frombuffer(b"".join(table.column("bytes").to_pylist()), "<f8").reshape(len(ids), -1)
        tiles = []
        for t in np.unique(side):
            at = np.flatnonzero(side == t)
            at = at[np.argsort(ids[at])]
            tiles.append(Tile(ids[at], copies[at], raw[at], axes, steps))
        same = table.column("p").to_numpy()[0] == table.column("q").to_numpy()[0]
        out_id, out_other, out_count = [], [], []
        if same or len(tiles) == 2:
            x, y = tiles[0], tiles[-1]
            count_x, count_y = np.zeros(len(x.ids), np.int64), np.zeros(len(y.ids), np.int64)
            forest: list[tuple[int, int]] = []
            for i, j in linked_pairs(x, y, same, threshold):
                np.add.at(count_x, i, y.copies[j])
                np.add.at(count_x if same else count_y, j, x.copies[i])
                new = local_forest(x.ids[i].tolist(), y.ids[j].tolist())
                forest = local_forest(*map(list, zip(*forest, *new))) if forest else new
            for tile, count in ((x, count_x), (y, count_y)):
                at = np.flatnonzero(count)
                out_id += tile.ids[at].tolist()
                out_count += count[at].tolist()
            out_other = [None] * len(out_id)
            out_id += [a for a, _ in forest]
            out_other += [b for _, b in forest]
            out_count += [0] * len(forest)
        return pa.table({"id": pa.array(out_id, pa.int64()), "other": pa.array(out_other, pa.int64()), "links": pa.array(out_count, pa.int64())})

    return run


def near_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    axes_sample: int = 10_000,
    tiles_at_least: int = 16,
    tile_rows: tuple[int, int] = (512, 32_768),
    tile_bytes: int = 1 << 26,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row with an id.

    ``axes_sample`` bounds the vectors that axes and boxes are fitted on; they set the speed, not the result.
    """
    spark = rows.sparkSession
    ship(spark)
    vector = F.col("_v")
    fine = F.size(vector) > 0
    fine = fine & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    fine = fine & F.exists(vector, lambda c: c != F.lit(0.0))
    keyed = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("_v"))
    keyed = keyed.where("vec_id IS NOT NULL").select(
        "vec_id",
        F.when(fine, vector).alias("_v"),
        F.when(fine, F.size(vector)).alias("_dim"),
        F.xxhash64(vector).alias("_h1"),
        F.xxhash64(F.lit(13), vector).alias("_h2"),
    )
    keyed = materialize(keyed, "vector-keys")
    one = keyed.where("_dim IS NOT NULL").groupBy("_dim", "_h1", "_h2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("_v").alias("_v")
    )
    one = materialize(one.withColumn("node", F.monotonically_increasing_id()), "vector-distinct")
    found = None
    for dim, n in sorted((r["_dim"], r["count"]) for r in one.groupBy("_dim").count().collect()):
        of_dim = one.where(F.col("_dim") == dim).select("node", "copies", "_v")
        most = max(1, min(tile_rows[1], tile_bytes // (8 * dim)))
        size = min(max(math.ceil(n / tiles_at_least), tile_rows[0]), most)
        part = _compare(of_dim, dim, n, threshold, axes_sample, size)
        found = part if found is None else found.union(part)
    empty = spark.createDataFrame([], LINKS)
    found = materialize(found, "vector-links") if found is not None else empty
    parts = connected_components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    parts = materialize(parts, "vector-parts")
    least = parts.join(one.select(F.col("node").alias("_n"), "rep"), F.col("node") == F.col("_n"))
    least = least.groupBy(F.col("component").alias("_part")).agg(F.min("rep").alias("component_id"), F.count("*").alias("_of"))
    least = materialize(least, "vector-components")
    whole = least.agg(F.coalesce(F.sum("_of"), F.lit(0))).first()[0]
    named = join_hot(parts, least, F.col("component") == F.col("_part"), often("_of", whole)).select("node", "component_id")
    counts = found.where("other IS NULL").groupBy("id").agg(F.sum("links").alias("links"))
    facts = materialize(
        one.select("_dim", "_h1", "_h2", "rep", "copies", F.col("node").alias("_n"))
        .join(counts, F.col("_n") == F.col("id"), "left")
        .join(named, F.col("_n") == F.col("node"), "left")
        .select(
            F.col("_dim").alias("_d"), F.col("_h1").alias("_a"), F.col("_h2").alias("_b"), "copies",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "rep").alias("component_id"),
        ),
        "vector-facts",
    )
    same = (F.col("_dim") == F.col("_d")) & (F.col("_h1") == F.col("_a")) & (F.col("_h2") == F.col("_b"))
    joined = join_hot(keyed.select("vec_id", "_dim", "_h1", "_h2"), facts, same, often("copies", keyed.count()))
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )


LINKS = "id long, other long, links long"


def _compare(one: DataFrame, dim: int, n: int, threshold: float, axes_sample: int, size: int, lead: int = 8, most_boxes: int = 1024):
    spark = one.sparkSession
    chance = F.pmod(F.xxhash64(F.lit(17), "node"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = one.where(chance < min(1.0, axes_sample / n)).select("_v").limit(2 * axes_sample).toArrow().column("_v")
    matrix = scaled(sample.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
    axes = principal_axes(matrix / np.maximum(np.sqrt((matrix**2).sum(1, keepdims=True)), 1e-300))
    steps = sorted({max(1, dim // 4), max(1, dim // 2), dim})
    depth = max(0, math.ceil(math.log2(n / size)))
    depth = min(depth, int(math.log2(most_boxes)), int(math.log2(max(1, len(matrix) / 8))))
    boxes = Boxes(matrix, axes, depth, min(lead, dim))
    cuts = math.ceil(n / (size << depth))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, dim)
            box = boxes.box(boxes.place(flat)) if len(flat) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([v.tobytes() for v in flat], pa.binary()), pa.array(box)],
                names=["node", "copies", "bytes", "box"],
            )

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            box = batch.column(1).to_numpy()
            if len(box):
                placed = boxes.place(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<f8").reshape(-1, dim))
                for b in np.unique(box).tolist():
                    own = placed[box == b]
                    n_axes = own.shape[1]
                    yield pa.RecordBatch.from_pydict({"box": [b] * n_axes, "axis": list(range(n_axes)), "lo": own.min(0), "hi": own.max(0)})

    packed = materialize(one.mapInArrow(pack, "node long, copies long, bytes binary, box long"), "vector-boxes")
    kind = "box long, axis long, lo double, hi double"
    edges = packed.select("bytes", "box").mapInArrow(bounds, kind).groupBy("box", "axis").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    edges = edges.orderBy("box", "axis").toArrow().to_pandas()  # a few numbers for each of ``most_boxes``
    known = sorted(set(edges["box"]))
    near = meeting_boxes(*(edges[c].to_numpy().reshape(len(known), -1) for c in ("lo", "hi")), threshold)
    partners = [(known[i], [known[j] for j in np.flatnonzero(near[i]).tolist()]) for i in range(len(known))]
    meet = F.broadcast(spark.createDataFrame(partners, "box long, others array<long>"))  # at most most_boxes squared numbers
    tile = F.col("box") * cuts + F.pmod(F.xxhash64("node"), F.lit(cuts))
    meeting = (
        packed.join(meet, "box")
        .select("node", "copies", "bytes", tile.alias("tile"), F.explode("others").alias("_box"))
        .withColumn("_with", F.explode(F.sequence(F.col("_box") * cuts, F.col("_box") * cuts + (cuts - 1))))
        .withColumns({"p": F.least("tile", "_with"), "q": F.greatest("tile", "_with")})
    )
    return meeting.drop("_with", "_box").groupBy("p", "q").applyInArrow(_tile_links(threshold, axes, steps), LINKS)
