"""Packing documents into sequences: dominance reduction, then best fit, on the histogram of lengths.

A document is its token ids with an end id. Longer ones are cut into pieces of ``capacity`` tokens,
of which the first may be shorter. How the pieces are packed depends on their lengths alone, and there
are at most ``capacity`` different lengths: so the driver plans with a histogram of that size, however
many documents there are, and the plan is a short table of runs that is joined to the ranked pieces.

The plan first fixes sets of pieces that dominate every other set with the same largest piece (the
reduction of Martello and Toth): a piece that nothing else fits beside, a pair that fills a sequence, a
largest partner where at most one piece fits besides, or one at least as long as any two that fit
together. What is left is packed best fit, longest first.

Null handling: a null text is empty, and an empty document is the end id alone. Repeated rows are
packed each for itself. Rows without ``doc_id`` are packed like others.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.columns import give_back, text_list, text_parts
from webloom.llm.tokens import encoder
from webloom.session import materialize, ship

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than ``capacity``."""
    if n_tokens <= capacity:
        return [(0, n_tokens)]
    head = n_tokens % capacity
    starts = ([0] if head else []) + list(range(head, n_tokens, capacity))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n_tokens])]


def token_pieces(
    docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, capacity: int
) -> DataFrame:
    """One row per piece; ids are computed from whole texts inside the scan and never shuffled."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        closing = np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            for part in text_parts(batch, 1, 4_000_000):
                ids, ends = encode(text_list(part.column(1)), closing)
                ids = ids.astype("<u4", copy=False)
                rows, at = [], 0
                for doc_id, to in zip(part.column(0).to_pylist(), ends.tolist()):
                    own = ids[at:to]
                    at = to
                    for k, (a, n) in enumerate(cut(len(own), capacity)):
                        rows.append((doc_id, k, a, n, zlib.crc32(own[a : a + n].tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        encoder(vocabulary).rest_between_tasks()
        give_back()

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, PIECES)


class Plan:
    """Runs of equal sequences: (length, rank from, rank to, in each sequence, first sequence, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {n: c for n, c in histogram.items() if c}
        self.rank = dict.fromkeys(self.left, 0)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0
        self._reduce()
        self._best_fit()

    def _take(self, length: int, count: int, each: int, first: int, offset: int):
        at = self.rank[length]
        self.runs.append((length, at, at + count, each, first, offset))
        self.rank[length] = at + count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def _fix(self, lengths: list[int], count: int):
        offset = 0
        for n in lengths:
            self._take(n, count, 1, self.sequences, offset)
            offset += n
        self.sequences += count
        self.fixed += count

    def _smallest(self, but: int, sizes: list[int], k: int) -> list[int]:
        """The k smallest pieces besides one of length ``but``."""
        out: list[int] = []
        for n in sizes:
            out += [n] * min(k - len(out), self.left[n] - (n == but))
            if len(out) == k:
                break
        return out

    def _dominant(self, s: int, sizes: list[int]) -> list[int] | None:
        room = self.capacity - s
        few = self._smallest(s, sizes, 3)
        if not few or few[0] > room:
            return [s]
        at = bisect.bisect_right(sizes, room) - 1
        while sizes[at] == s and self.left[s] == 1:
            at -= 1
        k = sizes[at]
        if k == room or len(few) < 2 or few[0] + few[1] > room:
            return [s, k]
        if len(few) < 3 or sum(few) > room:  # two more fit at most: is one of them as good as any two?
            best = 0
            for i, a in enumerate(sizes):
                j = bisect.bisect_right(sizes, room - a) - 1
                while j > i and sizes[j] == s and self.left[s] == 1:
                    j -= 1
                if j > i or (j == i and self.left[a] - (a == s) > 1):
                    best = max(best, a + sizes[j])
            if k >= best:
                return [s, k]
        return None

    def _reduce(self):
        changed = True
        while changed:
            changed = False
            for s in sorted(self.left, reverse=True):
                while self.left.get(s):
                    found = self._dominant(s, sorted(self.left))
                    if found is None:
                        break
                    count = self.left[s]
                    if len(found) == 2:
                        count = count // 2 if found[1] == s else min(count, self.left[found[1]])
                    self._fix(found, count)
                    changed = True

    def _best_fit(self):
        open_: list[tuple[int, int, int]] = []  # (room, first sequence, how many), sorted
        for s in sorted(self.left, reverse=True):
            while self.left.get(s):
                count = self.left[s]
                at = bisect.bisect_left(open_, (s, -1, -1))
                if at < len(open_):
                    room, first, n = open_.pop(at)
                else:
                    each = self.capacity // s
                    room, first, n = self.capacity, self.sequences, -(-count // each)
                    self.sequences += n
                each = room // s
                used = min(n, count // each)
                if used:
                    self._take(s, used * each, each, first, self.capacity - room)
                    if room - each * s:
                        bisect.insort(open_, (room - each * s, first, used))
                else:
                    each, used = count, 1
                    self._take(s, count, count, first, self.capacity - room)
                    bisect.insort(open_, (room - count * s, first, 1))
                if n > used:
                    bisect.insort(open_, (room, first + used, n - used))


RUNS = "length long, rank_from long, rank_to long, in_each long, first_sequence long, first_offset long"


def best_fit_packing(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    end_id: int = 2,
    capacity: int = 1024,
    rows_per_bucket: int = 20_000,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces of one length are ranked bucket by bucket (a hash of the document id), so that a length
    which a third of all pieces share is not ranked in one task.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, id_col, text_col, vocabulary, end_id, capacity), "pieces")
    counted = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    histogram = {r["length"]: r["count"] for r in counted}
    plan = Plan(histogram, capacity)
    buckets = max(64, sum(histogram.values()) // rows_per_bucket)
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        keyed.groupBy("length", "_bucket")
        .agg(F.count("*").alias("_n"))
        .select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = (
        keyed.withColumn("_in", F.row_number().over(inside) - 1)
        .join(bases, ["length", "_bucket"])
        .withColumn("_rank", F.col("_base") + F.col("_in"))
    )
    runs = spark.createDataFrame(plan.runs, RUNS).withColumnRenamed("length", "_length")
    nth = F.col("_rank") - F.col("rank_from")
    return ranked.join(
        F.broadcast(runs),  # its size depends on the capacity only
        (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to")),
    ).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("in_each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(nth, F.col("in_each")) * F.col("length")).cast("long").alias("offset"),
    )
