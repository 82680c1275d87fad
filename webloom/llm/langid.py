"""Language identification by a byte-level convolutional network in numpy.

Filters of several widths slide over the UTF-8 bytes of fixed-length windows; each keeps its maximum, and
a softmax over these maxima gives the language of a window. A text's probabilities are those of all its
windows, weighted by their bytes. The network is trained on the driver from a bounded sample: at most
about ``per_label`` windows of each label, drawn in the scan from all windows of all labelled texts. Every text
is scored whole, inside the scan.

Null handling: a text that is null or has no letter is ``und`` with score 0. Rows without a label or
an id are not learned from. With no labelled row at all, every text is ``und``. Other columns pass through; those
named as the results give way. A very long text is scored in blocks of windows. Equal texts get equal results; of
languages with equal probability the first in order wins. Rows of one id and text are drawn together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.columns import text_list, with_computed
from webloom.llm.tokens import forget_encoders
from webloom.session import materialize, ship

UNDECIDED = "und"


def windows_of(data: bytes, size: int) -> np.ndarray:
    """The bytes in windows of ``size``, the last one filled up with zeros."""
    n = max(1, -(-len(data) // size))
    return np.frombuffer(data.ljust(n * size, b"\0"), np.uint8).reshape(n, size)


class ByteNet:
    """Embedding-free convolution: a filter of width w is a table of weights for each of w bytes."""

    def __init__(self, labels: list[str], size: int = 192, widths=(2, 3, 4), filters: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.size, self.widths, self.filters = labels, size, widths, filters
        self.tables = [rng.normal(0, 0.5, (w, 256, filters)).astype(np.float32) for w in widths]
        self.weights = rng.normal(0, 0.1, (len(widths) * filters, len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima (and where they are) of all filters over windows ``x``."""
        best, where = [], []
        for table in self.tables:
            n = x.shape[1] - len(table) + 1
            total = table[0][x[:, :n]]
            for k in range(1, len(table)):
                total += table[k][x[:, k : k + n]]
            at = total.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(total, at[:, None, :], 1)[:, 0])
        return np.concatenate(best, 1), np.concatenate(where, 1)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 11):
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.weights, self.bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for begin in range(0, len(order), batch):
                rows = order[begin : begin + batch]
                xb, yb = x[rows], y[rows]
                best, where = self._pooled(xb)
                active = np.maximum(best, 0)
                delta = self._softmax(active @ self.weights + self.bias)
                delta[np.arange(len(rows)), yb] -= 1
                delta /= len(rows)
                back = (delta @ self.weights.T) * (best > 0)
                grads = []
                for t, table in enumerate(self.tables):
                    part = slice(t * self.filters, (t + 1) * self.filters)
                    grad = np.zeros_like(table)
                    column = np.broadcast_to(np.arange(self.filters), (len(rows), self.filters))
                    for k in range(len(table)):
                        bytes_ = np.take_along_axis(xb, where[:, part] + k, 1)
                        np.add.at(grad[k], (bytes_, column), back[:, part])
                    grads.append(grad)
                grads += [active.T @ delta + 1e-4 * self.weights, delta.sum(0)]
                step += 1
                for p, g, (m, v) in zip(params, grads, moments):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
        return self

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def compile(self) -> "ByteNet":
        """Tables over byte pairs, so that scoring needs half the lookups."""
        pair = np.arange(65536)
        self.pairs = []
        for table in self.tables:
            parts = [table[k][pair & 255] + table[k + 1][pair >> 8] for k in range(0, len(table) - 1, 2)]
            self.pairs.append((parts, table[-1] if len(table) % 2 else None))
        return self

    def probabilities(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        out = []
        for begin in range(0, len(x), block):
            xb = x[begin : begin + block]
            pair = xb[:, :-1].astype(np.int32) | (xb[:, 1:].astype(np.int32) << 8)
            best = []
            for table, (parts, single) in zip(self.tables, self.pairs):
                n = xb.shape[1] - len(table) + 1
                total = parts[0].take(pair[:, :n], 0)
                for k, part in enumerate(parts[1:], 1):
                    total += part.take(pair[:, 2 * k : 2 * k + n], 0)
                if single is not None:
                    total += single.take(xb[:, len(table) - 1 :], 0)
                best.append(total.max(1))
            out.append(self._softmax(np.maximum(np.concatenate(best, 1), 0) @ self.weights + self.bias))
        return np.concatenate(out)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        lettered = [any(map(str.isalpha, t)) for t in texts]
        data = [t.encode() for t, ok in zip(texts, lettered) if ok]
        names, scores = [UNDECIDED] * len(texts), np.zeros(len(texts))
        if not data or not self.labels:
            return names, scores
        parts = [windows_of(d, self.size) for d in data]
        counts = np.array([len(p) for p in parts])
        weight = np.full(counts.sum(), float(self.size))
        ends = np.cumsum(counts)
        weight[ends - 1] = [len(d) - (n - 1) * self.size for d, n in zip(data, counts)]
        p = self.probabilities(np.concatenate(parts)) * weight[:, None]
        total = np.add.reduceat(p, ends - counts, axis=0) / np.array([[len(d)] for d in data])
        at = np.flatnonzero(lettered)
        for i, k in zip(at, total.argmax(1)):
            names[i] = self.labels[k]
        scores[at] = np.clip(total.max(1), 0, 1)
        return names, scores


def train(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    per_label: int = 2_500,
    size: int = 192,
) -> ByteNet:
    """Fit a network on at most about ``per_label`` windows of each label, drawn from all windows of its texts.

    A window is drawn by a hash of its row's id and its place, so that every part of every labelled text may be
    drawn. A label with fewer windows gives all of them, so no label is left out.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(
        F.col(f"`{id_col}`").cast("string").alias("id"),
        F.encode(F.col(f"`{text_col}`"), "UTF-8").alias("bytes"),
        F.col(f"`{label_col}`").cast("string").alias("label"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col(f"`{text_col}`").rlike(r"\p{L}"))
    windows = F.ceil(F.octet_length("bytes") / size)
    counts = materialize(rows.groupBy("label").agg(F.sum(windows).alias("windows")), "label-windows")
    share = F.least(F.lit(1.0), F.lit(float(per_label)) / F.col("windows"))
    drawn = F.filter(
        F.sequence(F.lit(0), (windows - 1).cast("int")),
        lambda k: F.pmod(F.xxhash64(F.lit(3), "id", k), F.lit(1_000_003)) < F.col("share") * 1_000_003,
    )
    kept = (
        rows.join(counts.select("label", share.alias("share")), "label")  # one small row a label
        .select("id", "label", "bytes", F.explode(drawn).alias("at"))
        .select("id", "at", "label", F.substring("bytes", F.col("at") * size + 1, F.lit(size)).alias("bytes"))
    )
    sample = sorted(tuple(r) for r in kept.collect())  # bounded by the parameter
    labels = sorted({r[2] for r in sample})
    if not sample:
        return ByteNet([], size).compile()
    x = np.stack([windows_of(bytes(r[3]), size)[0] for r in sample])
    y = np.array([labels.index(r[2]) for r in sample])
    return ByteNet(labels, size).fit(x, y).compile()


def identify(docs: DataFrame, net: ByteNet, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` plus ``names``: the likeliest language and its probability."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few MB, whatever the data

    def make():
        forget_encoders()
        own = shared.value

        def compute(texts):
            return list(own.predict(text_list(texts)))

        return compute

    output = T.StructType([T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return with_computed(docs, [text_col], output, make, max_chars=1_000_000)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2


def language_id(docs: DataFrame) -> DataFrame:
    """Train on the labelled rows that are not held out, then identify every row."""
    net = train(docs.where(~held_out()))
    return identify(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
