"""Packing in order: a dynamic programme chooses where the stream of documents is cut into windows.

Documents follow each other as they are stored, each its token ids with an end id. A window holds at most ``capacity``
ids; it is filled up to ``capacity``, unless it holds a power of two. Windows end at ends of documents, at a price at
ends of sentences, and at a higher price inside a sentence that is longer than ``stride`` ids. The cuts minimise what is
filled up plus these prices and one for each window, so that short windows are rare.

A window that ends at ``p`` and begins at ``b`` costs ``capacity - p + b`` or, where ``p - b`` is a power of two,
nothing. For the first the best ``b`` within reach is the head of a monotone queue of cost plus place, so that every
place enters and leaves once; for the second there are as many places to look at as powers of two.

Every task packs the stream of its own split of the scan: nothing is shuffled, and no order of the whole table is made.
It holds about ``block_ids`` ids at once. The last window of a block stays open and begins the next one, and only the
last window of a split has to end where it does. A split that is read again gives the same windows.

Null handling: a null text is empty, and an empty document is the end id alone. Rows without id and rows that repeat an
id are packed each for itself. A very long text is cut into as many windows as it needs; it makes its block larger. An
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.columns import give_back, text_list
from webloom.llm.tokens import byte_alphabet, encoder, slices
from webloom.session import ship

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Marks that end a sentence before white space, those that end one anywhere, and what may stand between.
ENDS = (b".", b"!", b"?", b"\xe2\x80\xa6")
FULL_ENDS = tuple(c.encode() for c in "。！？")
CLOSERS = b"\"')]}"
#: Sequences of one split lie below this many.
SEQUENCES = 1 << 33


@cache
def sentence_tables(tokenizer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By token id: ends a sentence if white space follows, ends one whatever follows, begins with white space."""
    back = {c: b for b, c in enumerate(byte_alphabet())}
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    ends, always, blank = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        if not all(c in back for c in token):
            continue
        raw = bytes(back[c] for c in token)
        ends[i] = raw.rstrip(CLOSERS).endswith(ENDS)
        always[i] = raw.endswith((b"\n", *FULL_ENDS))
        blank[i] = raw[:1] in (b" ", b"\n", b"\t", b"\r")
    return ends, always, blank


class Prices:
    """What cuts cost, in ids that a window is filled up with."""

    def __init__(self, capacity: int = 2048, sentence: int = 4, inside: int = 16, window: int = 128, stride: int = 64):
        self.capacity, self.sentence, self.inside, self.window = capacity, sentence, inside, window
        self.stride = min(stride, capacity)


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, tables, prices: Prices) -> tuple[np.ndarray, np.ndarray]:
    """(places where a window may end, what a cut there costs), in order, up to the end of the stream."""
    ends, always, blank = tables
    after = np.append(blank[ids[1:]], True)
    cost = np.full(len(ids) + 1, -1, np.int32)
    cost[1:][always[ids] | (ends[ids] & after)] = prices.sentence
    cost[doc_ends] = 0
    cost[0] = -1
    places = np.concatenate([[0], np.flatnonzero(cost >= 0)])
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > prices.stride)
    for begin, gap in zip(places[wide].tolist(), gaps[wide].tolist()):
        cost[begin + prices.stride : begin + gap : prices.stride] = prices.inside
    places = np.flatnonzero(cost >= 0)
    return places, cost[places]


def exact_starts(places: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(end, start) as indexes of ``places`` behind a first 0, of windows that hold a power of two; sorted by end."""
    at = np.full(int(places[-1]) + 1, -1, np.int32)
    at[0] = 0
    at[places] = np.arange(1, len(places) + 1)
    end, start = [], []
    size = 1
    while size <= capacity:
        reach = np.flatnonzero(places >= size)
        found = at[places[reach] - size]
        hit = found >= 0
        end.append(reach[hit] + 1)
        start.append(found[hit])
        size *= 2
    end, start = np.concatenate(end), np.concatenate(start)
    order = np.argsort(end, kind="stable")
    return end[order], start[order]


def best_cuts(places: np.ndarray, costs: np.ndarray, prices: Prices) -> list[int]:
    """The places where windows end, the last of them that of the stream; the cost of the whole is the least there is."""
    capacity = prices.capacity
    at = [0, *places.tolist()]
    price = [0, *(costs + prices.window).tolist()]
    ends, starts = exact_starts(places, capacity)
    edge = np.searchsorted(ends, np.arange(len(at) + 1)).tolist()
    starts = starts.tolist()
    least, came, keys = [0] * len(at), [0] * len(at), [0] * len(at)
    queue, head = [0], 0  # places by rising cost plus place (their keys); those before ``head`` are out of reach
    for j in range(1, len(at)):
        here = at[j]
        while here - at[queue[head]] > capacity:
            head += 1
        source = queue[head]
        cost = keys[source] + capacity - here
        for i in starts[edge[j] : edge[j + 1]]:
            if least[i] < cost:
                cost, source = least[i], i
        cost += price[j]
        least[j], came[j], keys[j] = cost, source, cost + here
        while len(queue) > head and keys[queue[-1]] > cost + here:
            queue.pop()
        queue.append(j)
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = came[j]
    return out[::-1]


class Stream:
    """The documents of one split: ids come in, windows that are settled go out as pieces."""

    def __init__(self, prices: Prices, tables, first_sequence: int):
        self.prices, self.tables, self.sequence = prices, tables, first_sequence
        self.held: list[np.ndarray] = []
        self.size = 0
        self.docs: list[tuple[int | None, int, int]] = []  # (id, where it begins here, its ids); the first may have begun before

    def add(self, doc_ids: list, ids: np.ndarray, ends: np.ndarray):
        begins = (np.concatenate([[0], ends[:-1]]) + self.size).tolist()
        self.docs += zip(doc_ids, begins, np.diff(ends, prepend=0).tolist())
        self.held.append(ids)
        self.size += len(ids)

    def settle(self, last: bool) -> list[tuple]:
        """Pieces of all windows, or of all but the last one unless this is the end."""
        if not self.size:
            return []
        ids = np.concatenate(self.held).astype("<u4", copy=False)
        begins = np.array([d[1] for d in self.docs], np.int64)
        sizes = np.array([d[2] for d in self.docs], np.int64)
        places, costs = cut_places(ids, begins + sizes, self.tables, self.prices)
        cuts = best_cuts(places, costs, self.prices)
        settled = cuts if last else cuts[:-1]
        if not settled:
            return []
        stop = settled[-1]
        windows = np.array([0, *settled], np.int64)
        marks = np.unique(np.concatenate([windows, np.maximum(begins[begins < stop], 0)]))
        to = np.append(marks[1:], stop)
        marks, to = marks[marks < stop], to[marks < stop]
        doc = np.searchsorted(begins, marks, side="right") - 1
        window = np.searchsorted(windows, marks, side="right") - 1
        raw = memoryview(ids).cast("B")
        out = []
        for a, b, d, w in zip(marks.tolist(), to.tolist(), doc.tolist(), window.tolist()):
            doc_id, begin, n = self.docs[d]
            out.append((doc_id, a - begin, b - a, zlib.crc32(raw[4 * a : 4 * b]), n, self.sequence + w, a - int(windows[w])))
        self.sequence += len(settled)
        kept = int(np.searchsorted(begins + sizes, stop, side="right"))
        self.docs = [(i, begin - stop, n) for i, begin, n in self.docs[kept:]]
        self.held, self.size = [ids[stop:].copy()], len(ids) - stop
        return out


def window_packing(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    end_id: int = 1,
    prices: Prices | None = None,
    block_ids: int = 1_000_000,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)
    chosen = prices or Prices()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        stream = Stream(chosen, sentence_tables(coder.tokenizer), TaskContext.get().partitionId() * SEQUENCES)
        closing = np.array([end_id], np.uint32).tobytes()
        kinds = [pa.int64()] * 7
        names = [c.strip().split(" ")[0] for c in PIECES.split(",")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), text_list(batch.column(1))
            for begin, end in slices(texts):
                stream.add(doc_ids[begin:end], *coder.encode(texts[begin:end], closing))
                if stream.size >= block_ids:
                    rows = stream.settle(False)
                    if rows:
                        yield made(rows)
        rows = stream.settle(True)
        if rows:
            yield made(rows)
        coder.rest_between_tasks()
        give_back()

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, PIECES)
