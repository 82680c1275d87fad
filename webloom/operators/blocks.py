"""Vectors in blocks inside a task: matrices of Arrow lists, and the best of a block of scores, in memory of a fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores that are held at once.
CELLS = 1 << 21
#: Scores are compared rounded to 12 digits; what is within this of the bound is looked at.
NEAR = 1e-9
#: What stands for a pair that does not count, below any cosine.
NOT = -2.0
#: Columns of a block of scores in single precision; with ``ROWS`` of them it stays in the cache of a core.
COLUMNS, ROWS = 2048, 512


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix; null components are not numbers."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(array):
        return np.zeros((0, 0))
    if len(pc.unique(pc.list_value_length(array))) > 1:
        raise ValueError("vectors of different lengths")
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), -1)


def units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length; a zero vector stays as it is."""
    x = matrix(column)
    length = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    x /= np.where(length == 0, 1, length)
    return x


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers, -1 for null."""
    return pc.fill_null(column, -1).to_numpy().astype(np.int64)


def spans(rows: int, columns: int) -> Iterator[slice]:
    """Rows in runs whose scores with all columns fit ``CELLS``."""
    step = max(1, CELLS // max(1, columns))
    for begin in range(0, rows, step):
        yield slice(begin, min(rows, begin + step))


class Best:
    """The best ``k`` of each row (by score rounded to 12 digits, then by id) of blocks of scores that come one after the other."""

    def __init__(self, rows: int, k: int, least: np.ndarray | None = None):
        self.k, self.bound = k, np.full(rows, NOT) if least is None else least.astype(float).copy()
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray, keys: np.ndarray) -> None:
        """``score``: of each of ``rows`` with each of ``ids``; ``keys`` come back for the ids. ``NOT`` marks what does not count."""
        n = score.shape[1]
        bound = self.bound[rows]
        if n >= self.k and (bound <= NOT).any():
            some = score[:, : max(1024, self.k)]
            bound = np.maximum(bound, np.partition(some, some.shape[1] - self.k, axis=1)[:, some.shape[1] - self.k])
        hit = np.flatnonzero((score >= (bound - NEAR)[:, None]) & (score > NOT))
        if not len(hit):
            return
        row, col = hit // n, hit % n
        part = self._cut(rows[row], ids[col], np.round(score.ravel()[hit], 12), keys[col])
        self.parts.append(part)
        self.held += len(part[0])
        if self.held > CELLS:
            self.parts = [self.found()]
            self.held = len(self.parts[0][0])

    def _cut(self, row, ids, score, keys):
        order = np.lexsort((ids, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        full = place == self.k - 1
        score = score[order]
        self.bound[row[full]] = np.maximum(self.bound[row[full]], score[full])
        order = order[kept]
        return row[kept], ids[order], score[kept], keys[order]

    def found(self) -> tuple[np.ndarray, ...]:
        """(row, id, score, key), sorted by row and rank."""
        if not self.parts:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0), none
        return self._cut(*(np.concatenate(c) for c in zip(*self.parts)))


def mask_equal(score: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Scores whose row in ``left`` equals their column in ``right`` do not count."""
    order = np.argsort(right, kind="stable")
    ordered = right[order]
    first, last = np.searchsorted(ordered, left, "left"), np.searchsorted(ordered, left, "right")
    whole = bool((np.diff(order) == 1).all())
    for r in np.flatnonzero(last > first):
        score[r, slice(first[r], last[r]) if whole else order[first[r] : last[r]]] = NOT


def slack(size: int) -> float:
    """Twice what a dot product of unit vectors of ``size`` components may be off in single precision, and ``NEAR``."""
    return (size + 8) * 2.0**-23 + NEAR


def grid(rows: int, columns: int, upper: bool = False) -> Iterator[tuple[slice, slice]]:
    """Blocks that cover all scores, or those on and above the diagonal."""
    wide = max(1, min(columns, COLUMNS, CELLS))
    step = max(1, min(ROWS, CELLS // wide))
    for a in range(0, rows, step):
        for b in range(a if upper else 0, columns, wide):
            yield slice(a, min(rows, a + step)), slice(b, min(columns, b + wide))


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what a mask marks; where little is marked, eight places are passed over at a time."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        at = np.flatnonzero(flat)
    else:
        at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
        at = at[flat[at]]
    return at // mask.shape[1], at % mask.shape[1]


def exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of some pairs of rows in double precision: pair by pair where they are few, else by a product of all."""
    if len(i) * 50 > len(x) * len(y):
        return (x @ y.T)[i, j]
    out = np.empty(len(i))
    for begin in range(0, len(i), 1 << 14):
        some = slice(begin, begin + (1 << 14))
        out[some] = np.einsum("ij,ij->i", x[i[some]], y[j[some]])
    return out


class Side:
    """The vectors of a tile, in both precisions, with ids and pages, sorted by id."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, pages: np.ndarray):
        self.x, self.ids, self.pages = x, ids, pages
        self.single = np.ascontiguousarray(x, np.float32)

    def firsts(self, k: int) -> tuple["Side", np.ndarray, np.ndarray]:
        """Of copies of a vector in a page the first ``k``; then the places of the others, and of the kept one for each.

        Copies in a page have the same neighbours, and of those no more than ``k`` can be among the best of another vector.
        """
        seen = np.ascontiguousarray(self.x).view(np.dtype((np.void, max(1, self.x.shape[1]) * 8))).ravel()
        _, vector = np.unique(seen, return_inverse=True)
        order = np.lexsort((self.ids, self.pages, vector))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(vector[order]) != 0) | (np.diff(self.pages[order]) != 0)
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        more = np.arange(len(order)) - first >= k
        if not more.any():
            return self, np.zeros(0, np.int64), np.zeros(0, np.int64)
        kept = np.sort(order[~more])
        return Side(self.x[kept], self.ids[kept], self.pages[kept]), order[more], np.searchsorted(kept, order[first[more]])


class Nearest:
    """The best ``k`` of each row, by score rounded to 12 digits, then by id, of pairs that come one block after the other."""

    def __init__(self, of: Side, among: Side, k: int, sample: int = 512):
        self.pages, self.k, self.slack = of.pages, k, slack(of.x.shape[1])
        self.score, self.ids = np.full((len(of.x), k), NOT), np.full((len(of.x), k), np.iinfo(np.int64).max)
        #: Scores in single precision below this cannot be among the best.
        self.least = np.full(len(of.x), NOT, np.float32)
        some = np.unique(np.linspace(0, len(among.x) - 1, min(sample, len(among.x))).astype(np.int64))
        for rows, columns in grid(len(of.x), len(some)) if len(some) >= k else ():
            score = of.single[rows] @ among.single[some[columns]].T
            score[(of.pages[rows, None] == among.pages[None, some[columns]]) | np.isnan(score)] = NOT
            if score.shape[1] >= k:
                best = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] - np.float32(self.slack)
                self.least[rows] = np.maximum(self.least[rows], np.where(best > -1.5, best, np.float32(NOT)))
        if len(among.pages) and (among.pages == among.pages[0]).all():
            self.least[of.pages == among.pages[0]] = np.inf  # all of them are of the row's own page
        self.least -= np.float32(self.slack)

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        score = np.round(score, 12)
        kept = score >= self.score[row, -1]
        row, ids, score = row[kept], ids[kept], score[kept]
        if not len(row):
            return
        own = np.unique(row)
        row, ids, score = (np.concatenate(c) for c in ((row, np.repeat(own, self.k)), (ids, self.ids[own].ravel()), (score, self.score[own].ravel())))
        order = np.lexsort((ids, -score, row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
        self.score[own], self.ids[own] = score[order].reshape(-1, self.k), ids[order].reshape(-1, self.k)
        self.least[own] = np.maximum(self.least[own], (self.score[own, -1] - self.slack).astype(np.float32))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, score), by row and rank."""
        row, rank = np.nonzero(self.score > NOT)
        return row, self.ids[row, rank], self.score[row, rank]


def nearest_of(left: Side, right: Side, k: int, same: bool) -> list[Nearest]:
    """The best ``k`` of other pages for each vector of ``left`` in ``right`` and, unless they are the ``same``, the other way.

    Scores are made once for both, in single precision; what may be among the best is then scored in double precision.
    """
    best = [Nearest(left, right, k)] + ([] if same else [Nearest(right, left, k)])
    for rows, columns in grid(len(left.x), len(right.x)):
        score = left.single[rows] @ right.single[columns].T
        mask = score >= best[0].least[rows, None]
        if not same:
            mask |= score >= best[1].least[columns]
        i, j = places(mask)
        other = left.pages[rows][i] != right.pages[columns][j]
        i, j = i[other], j[other]
        if not len(i):
            continue
        value = exact(left.x[rows], right.x[columns], i, j)
        i, j = i + rows.start, j + columns.start
        best[0].add(i, right.ids[j], value)
        if not same:
            best[1].add(j, left.ids[i], value)
    return best
