"""Toxicity by class-conditional Kneser-Ney word models.

Two Kneser-Ney models, one of toxic and one of ordinary documents, give each word a probability behind the word
before it. The pairs of a class are counted by the different words that stand before them, so that a passage
that is copied a thousand times counts once; pairs met behind one word only are cut off. A pair's discounted count
is interpolated with the class's continuation counts of single words (in how many different contexts a word is met),
and these with the same counts over both classes, so that a rare expression weighs little either way.

The difference of the log-likelihoods is normalised by length for the whole text. Two local figures use the single
words, where labelled words stand in unlabelled company: the best stretch of ``STRETCH`` words, and the two most
telling words. A logistic fit on rows that the counts have not seen turns the three figures into a score.

Spark counts the words of all labelled rows. A row of the shuffle is a pair of words, as two hashes of 32 bits, and the hash
of the word before them, so words of one hash count as one. Words with fewer than ``least_word`` contexts are left to the
backoff, and so are pairs with fewer than ``least_pair``; nothing else is. Log-ratios of all other words and pairs are
computed in Spark. Workers hold up to ``most_words`` and ``most_pairs`` of them, those with the largest share of a class's
contexts in the class where it is larger. The rest stays a table: a scan of the texts finds what they need of it, with a
bitmap asked first, and joins bring it to them. A word that no class has met in more than ``discount`` contexts tells
nothing by itself. The logistic fit sees all rows kept for it, counted in cells of like figures.

Null handling: a null text is empty; an empty text gets the score of a text without evidence. Rows
without a label or an id are not learned from. Equal texts are learned from once, under their smallest id, and as toxic
if one of them is labelled so. If a class has no row, every score is 0; if it has none among the
rows kept for the fit, or only such rows, another fifth of its rows is kept. Equal texts get equal scores, however
long. Other columns pass through; those named as the results give way.
"""

from __future__ import annotations

import re
import zlib
from copy import copy
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.columns import give_back, text_list, text_parts, with_computed
from webloom.llm.skew import free, id_bits, likely, quoted
from webloom.llm.tokens import forget_encoders
from webloom.session import materialize, ship

WORD = re.compile(r"\w+")
STRETCH = 8
#: Triples of words that a task holds before it sends them on, each once.
TRIPLES = 1 << 20
#: Figures of rows kept for the fit: cells of this width, and what their sums are counted in.
CELLS, UNITS = (16, 4, 4), 1_000_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Hashes(dict):
    """Hash of a word, 1 to 2 ** 32 - 1; 0 stands for what is before the first word."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) or 1
        return found


class Shares:
    """What the counts of all words say of one: how likely either class makes a word met in so many contexts.

    ``discount`` is what absolute discounting takes from a word's continuation count where the estimate from the
    counts of counts is lower: expressions met no more often are left to the shared counts.
    """

    def __init__(self, words: DataFrame, discount: float):
        """``words``: (h, toxic, ordinary), every word once with its continuation counts."""
        both = F.col("toxic") + F.col("ordinary")
        many = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
        self.size, self.total, once, twice = words.agg(F.count("*"), F.coalesce(F.sum(both), F.lit(0)), many(both == 1), many(both == 2)).first()
        self.discount = d = max(discount, estimate(once, twice))
        # whole numbers first, the same in any order
        above = lambda c: (F.coalesce(F.sum(F.when(c > d, c)), F.lit(0)), many(c > d))
        sums = words.agg(*above(F.col("toxic")), *above(F.col("ordinary")), *above(both)).first()
        self.own = [float(sums[i] - d * sums[i + 1]) for i in (0, 2)]
        self.total = float(max(self.total, 1))
        rest = (self.total - sums[4] + d * sums[5]) / self.total
        self.weights = [rest if own else 1.0 for own in self.own]
        self.unknown = float(np.log(self.weights[0]) - np.log(self.weights[1]))

    def logs(self, *counts: Column) -> list[Column]:
        """Log-probabilities in both classes of a word with these counts (toxic, ordinary)."""
        small = self.size / self.total
        shared = (1 - small) * (counts[0] + counts[1]) / self.total + small / (self.size + 1)
        own = [F.greatest(c - F.lit(self.discount), F.lit(0.0)) / max(n, 1.0) for c, n in zip(counts, self.own)]
        return [F.log((1 - w) * o + w * shared) for o, w in zip(own, self.weights)]

    def ratio(self, *counts: Column) -> Column:
        first, second = self.logs(*counts)
        return F.when((counts[0] <= self.discount) & (counts[1] <= self.discount), F.lit(self.unknown)).otherwise(first - second)


def estimate(once: int, twice: int) -> float:
    """The Kneser-Ney discount from the counts of counts."""
    return float(once / (once + 2 * twice)) if once and twice else 0.75


class Values:
    """Sorted keys and what stands at them."""

    def __init__(self, keys: np.ndarray, *columns: np.ndarray):
        self.keys, self.columns = keys.astype(np.int64, copy=False), columns

    @classmethod
    def read(cls, rows: DataFrame) -> Values:
        """Of (code, …), each code once, column by column, so that the driver holds little twice."""
        table = rows.toArrow()
        keys = table.column(0).to_numpy()
        order = np.argsort(keys)
        keys = keys[order]
        found = cls(keys, *(c.to_numpy()[order] for c in table.columns[1:]))
        del table, order
        give_back()
        return found

    def __len__(self):
        return len(self.keys)

    def put(self, keys: np.ndarray, *out: np.ndarray) -> np.ndarray:
        """Writes the values of ``keys`` into ``out`` where there are any; which keys have some."""
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        order = np.argsort(keys)  # in order, searches stay in the processor's cache
        at = np.empty(len(keys), np.int64)
        at[order] = np.minimum(np.searchsorted(self.keys, keys[order]), len(self.keys) - 1)
        hit = self.keys[at] == keys
        for own, to in zip(self.columns, out):
            to[hit] = own[at[hit]]
        return hit


class Evidence:
    """What scoring needs: the models of both classes as log-ratios by hash, and the logistic fit.

    Workers hold the strongest ``words`` (ratio; backoff of a pair that begins with it) and ``pairs`` (ratio). ``rest`` is a
    table of all others, which ``score`` joins to the texts that hold them; ``bits`` marks them, and a few more.
    """

    def __init__(self, shares: Shares, words: Values, pairs: Values, start: float, rest: DataFrame | None, bits: np.ndarray | None, spell):
        self.unknown, self.start, self.words, self.pairs, self.rest, self.bits, self._spell = shares.unknown, start, words, pairs, rest, bits, spell
        self.center, self.spread = np.zeros(3), np.ones(3)
        self.weights = np.array([0.0, 0.0, 0.0, -20.0])
        self.hashes = Hashes()

    def __getstate__(self):
        """What goes to the workers: no table."""
        return {k: v for k, v in self.__dict__.items() if k != "vocabulary"} | {"rest": None, "_spell": None, "hashes": Hashes()}

    def own(self) -> Evidence:
        """For one task: hashes that go with it."""
        out = copy(self)
        out.hashes = Hashes()
        return out

    @property
    def size(self) -> int:
        return len(self.words)

    @cached_property
    def vocabulary(self) -> dict[str, int]:
        """The spellings of the held words and their hashes, read off the texts anew."""
        return self._spell()

    def hashed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words end to end, and how many each text has."""
        split = [words_of(t) for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        return np.fromiter(map(self.hashes.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum())), counts

    @staticmethod
    def before(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
        out = np.concatenate([np.zeros(1, np.int64), words[:-1]])
        out[begins[begins < len(words)]] = 0
        return out

    def needs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair or word, code), each once, of the words and pairs in these texts that the rest may hold."""
        words, counts = self.hashed(texts)
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        codes = (self.before(words, np.cumsum(counts) - counts) << 32) | words
        out = []
        for pair, keys, held in ((False, words, self.words), (True, codes, self.pairs)):
            own = np.flatnonzero(self._marked(keys))
            own = own[~held.put(keys[own])]
            at = own[np.lexsort((keys[own], owner[own]))]
            new = np.ones(len(at), bool)
            new[1:] = (keys[at[1:]] != keys[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
            out.append((owner[at[new]], np.full(int(new.sum()), pair), keys[at[new]]))
        return tuple(np.concatenate(c) for c in zip(*out))

    def _marked(self, keys: np.ndarray) -> np.ndarray:
        at = (keys ^ (keys.view(np.uint64) >> np.uint64(27)).view(np.int64)) & (64 * len(self.bits) - 1)
        return (self.bits[at >> 6] >> (at & 63)) & 1 == 1

    def ratios(self, words: np.ndarray, begins: np.ndarray, more: tuple[Values, Values] | None = None) -> np.ndarray:
        """log P(word | word before, toxic) - log P(word | word before, ordinary) of words end to end."""
        return self._ratios(words, begins, more)[0]

    def _ratios(self, words, begins, more):
        """``ratios``, and the same without the word before."""
        single, back = np.full(len(words), self.unknown), np.zeros(len(words) + 1)
        for own in (self.words, *(more[:1] if more else ())):
            own.put(words, single, back[1:])
        back = back[:-1]
        back[begins[begins < len(words)]] = self.start
        out = back + single
        codes = (self.before(words, begins) << 32) | words
        for own in (self.pairs, *(more[1:] if more else ())):
            own.put(codes, out)
        return out, single

    def features(self, texts: list[str], more: tuple[Values, Values] | None = None) -> np.ndarray:
        """Three figures of each text; ``more``: of the rest, the words and pairs in these texts."""
        words, counts = self.hashed(texts)
        out = np.zeros((len(texts), 3))
        total = len(words)
        if not total:
            return out
        ends = np.cumsum(counts)
        begins = ends - counts
        some = np.flatnonzero(counts)
        pairs, ratio = self._ratios(words, begins[some], more)
        run = np.concatenate([[0.0], np.cumsum(pairs)])
        out[:, 0] = (run[ends] - run[begins]) / np.maximum(counts, 1)
        run = np.concatenate([[0.0], np.cumsum(ratio)])
        owner_end = np.repeat(ends, counts)
        to = np.minimum(np.arange(total) + STRETCH, owner_end)
        stretch = (run[to] - run[:-1]) / STRETCH
        out[some, 1] = np.maximum.reduceat(stretch, begins[some])
        for i in some.tolist():
            own = ratio[begins[i] : ends[i]]
            out[i, 2] = (np.partition(own, -2)[-2:].sum() if len(own) > 1 else own[0]) / 2
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, ridge: float = 0.02):
        """Weighted logistic regression by Newton steps."""
        self.center = np.average(x, axis=0, weights=weight)
        self.spread = np.sqrt(np.average((x - self.center) ** 2, axis=0, weights=weight)) + 1e-9
        z = np.column_stack([(x - self.center) / self.spread, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        weight = weight / weight.mean()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (weight * (p - y)) / len(x) + ridge * np.append(w[:-1], 0) / 10
            hess = (z * (weight * p * (1 - p))[:, None]).T @ z / len(x) + ridge / 10 * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        return self

    def scores(self, texts: list[str], more: tuple[Values, Values] | None = None) -> np.ndarray:
        if self.rest is not None and more is None:  # a few texts on the driver
            _, pair, code = self.needs(texts)
            few = self.rest.sparkSession.createDataFrame(pa.table({"pair": pa.array(pair, pa.bool_()), "code": pa.array(code, pa.int64())}))
            more = _values(*self.rest.join(F.broadcast(few.distinct()), ["pair", "code"]).select("pair", "code", "x", "y").toArrow().columns)
        z = (self.features(texts, more) - self.center) / self.spread
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _values(pair, code, x, y) -> tuple[Values, Values]:
    """Words and pairs of the rest from rows in any order, repeats among them."""
    pair, code, x, y = (c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy() for c in (pair, code, x, y))
    out = []
    for side in (False, True):
        own = np.flatnonzero(pair.astype(bool) == side)
        keys, first = np.unique(code[own].astype(np.int64), return_index=True)
        out.append(Values(keys, x[own][first], y[own][first]))
    return tuple(out)


def _strongest(rows: DataFrame, most: int, discount: float) -> Column:
    """Of counts (toxic, ordinary): has a row one of the largest shares of a class's contexts? In whole levels; all, where they fit."""
    sums = rows.agg(F.count("*"), F.sum("toxic"), F.sum("ordinary")).first()
    if sums[0] <= most:
        return F.lit(True)
    share = F.greatest(*[(F.col(c) - F.lit(discount)) / F.lit(float(max(n, 1))) for c, n in (("toxic", sums[1]), ("ordinary", sums[2]))])
    level = F.when(share > 0, F.floor(F.log2(share) * 8).cast("int")).otherwise(F.lit(-10_000))
    room, least = most, 10_000
    for r in sorted(rows.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    return level >= least


def _both_sides(rows: DataFrame) -> DataFrame | None:
    """``rows`` (id, h, toxic, late) plus ``early``, with early and late rows of both classes; None if one has no row.

    A class that lacks one of them is split by a hash of the id; a single row is both.
    """
    by = F.hash(F.lit(7), "id")  # percentiles go through doubles, which hold 32 bits
    sides = rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.col("late").cast("long")).alias("late"), F.percentile_approx(by, 0.2).alias("fifth")).collect()
    if len(sides) < 2:
        return None
    late, early = F.col("late"), ~F.col("late")
    for r in sides:
        if not 0 < r["late"] < r["n"]:
            own, first = F.col("toxic") == r["toxic"], by <= r["fifth"]
            late = F.when(own, first).otherwise(late)
            early = F.when(own, ~first | F.lit(r["n"] == 1)).otherwise(early)
    return rows.select("id", "h", "toxic", late.alias("late"), early.alias("early"))


def _hashed(batches):
    """Of the texts of each batch, some at a time: hashes of all words end to end, where each text begins, and its rows."""
    forget_encoders()
    hashes = Hashes()
    for batch in batches:
        for part in text_parts(batch, 0, 1_000_000):
            split = [words_of(t) for t in text_list(part.column(0))]
            counts = np.array([len(w) for w in split], np.int64)
            words = np.fromiter(map(hashes.__getitem__, chain.from_iterable(split)), np.uint64, int(counts.sum()))
            yield words, counts, part, split


def _triples(batches):
    """(pair, first, toxic) of all words; nothing stands before the first word. The pair: both hashes, the word's in the lower half."""

    def distinct(parts):
        pair, mark = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((mark, pair))
        pair, mark = pair[order], mark[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (mark[1:] != mark[:-1])
        pair, mark = pair[new], mark[new]
        arrays = [pair.view(np.int64), (mark >> np.uint64(1)).astype(np.uint32).view(np.int32), (mark & np.uint64(1)).astype(bool)]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["pair", "first", "toxic"])

    parts, held = [], 0
    for words, counts, rows, _ in _hashed(batches):
        if not len(words):
            continue
        begins = (np.cumsum(counts) - counts)[counts > 0]
        before = np.concatenate([np.zeros(1, np.uint64), words[:-1]])
        before[begins] = 0
        first = np.concatenate([np.zeros(1, np.uint64), before[:-1]])
        first[begins] = 0
        toxic = np.repeat(rows.column(1).to_numpy().astype(np.uint64), counts)
        parts.append(((before << np.uint64(32)) | words, (first << np.uint64(1)) | toxic))
        held += len(words)
        if held >= TRIPLES:
            yield distinct(parts)
            parts, held = [], 0
    if parts:
        yield distinct(parts)
    give_back()


def _spellings(docs: DataFrame, hashes: np.ndarray) -> dict[str, int]:
    """The words of the texts whose hash is among ``hashes``, sorted, with it."""
    shared = docs.sparkSession.sparkContext.broadcast(hashes)

    def spell(batches):
        own, found = shared.value, set()
        for words, _, _, split in _hashed(batches):
            at = np.minimum(np.searchsorted(own, words.view(np.int64)), len(own) - 1)
            hit = iter((own[at] == words.view(np.int64)).tolist())
            found.update(w for text in split for w in text if next(hit))
        hashes = Hashes()
        yield pa.RecordBatch.from_arrays([pa.array([hashes[w] for w in found], pa.int64()), pa.array(list(found), pa.string())], names=["h", "word"])
        give_back()

    table = docs.select("text").mapInArrow(spell, "h long, word string").distinct().toArrow().sort_by("word")
    shared.unpersist()
    return dict(zip(table.column("word").to_pylist(), table.column("h").to_pylist()))


def _marks(rest: DataFrame, rows: int) -> np.ndarray:
    """A bitmap of the codes of ``rest``, of 32 MB at most: as ``Evidence.needs`` asks it."""
    bits = min(max(int(8 * rows).bit_length(), 10), 28)
    at = F.col("code").bitwiseXOR(F.shiftrightunsigned("code", 27)).bitwiseAND(F.lit((1 << bits) - 1)).alias("at")
    one = F.expr("shiftleft(1L, cast(at % 64 as int))")
    found = rest.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def _with_rest(docs: DataFrame, evidence: Evidence, shared, text_col: str, name: str) -> DataFrame:
    """``docs`` plus ``name``: of each text the words and pairs that the rest of the models holds. Texts go by their hashes."""
    a, b = free(docs, "_a", "_b")
    text = F.col(f"`{text_col}`")
    keyed = docs.select(*quoted(docs.columns), F.xxhash64(text).alias(a), F.xxhash64(F.lit(7), text).alias(b))

    def needs(batches):
        forget_encoders()
        own = shared.value.own()
        for batch in batches:
            for part in text_parts(batch, 0, 1_000_000):
                at, pair, code = own.needs(text_list(part.column(0)))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(at)) for k in (1, 2)), pa.array(pair), pa.array(code)], names=["a", "b", "pair", "code"])
        give_back()

    wanted = keyed.select(text.alias("t"), F.col(a).alias("a"), F.col(b).alias("b")).mapInArrow(needs, "a long, b long, pair boolean, code long")
    found = wanted.join(evidence.rest, ["pair", "code"]).groupBy(F.col("a").alias(a), F.col("b").alias(b))
    found = found.agg(F.collect_set(F.struct("pair", "code", "x", "y")).alias(name))
    return keyed.join(found, [a, b], "left").select(*quoted(docs.columns), name)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_words: int = 1_000_000,
    most_pairs: int = 4_000_000,
    least_word: int = 2,
    least_pair: int = 2,
    discount: float = 3.0,
    calibrate: Column | None = None,
) -> Evidence | None:
    """Fit both models on all labelled rows; ``calibrate`` marks the rows kept for the logistic fit.

    ``most_words`` and ``most_pairs`` say what a worker holds (24 and 16 bytes each); they change no score.
    """
    spark = docs.sparkSession
    ship(spark)
    label = F.col(f"`{label_col}`")
    known = labels.where(label.isin(0, 1) & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(label).cast("int").alias("toxic"))
    known = materialize(known, "toxicity-labels")
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    hashed = text.withColumn("h", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b")))
    of = lambda ids: likely(hashed, "id", materialize(id_bits(ids, "id"), "toxicity-bits"))  # noqa: E731  few other texts are read on
    # equal texts are one row, found by their hashes; the texts themselves move once, each to the counts or to the fit
    rows = of(known).select("id", "h").join(known, "id").groupBy("h").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic"))
    part = calibrate if calibrate is not None else F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 4
    rows = _both_sides(materialize(rows.withColumn("late", F.coalesce(part, F.lit(False))), "toxicity-rows"))
    if rows is None:
        return None
    side = lambda ids: of(ids).join(ids.withColumnRenamed("h", "_h"), "id").where("h = _h").drop("_h")
    early = rows.where("early").select("id", "h", "toxic")
    grams = side(early).select("text", "toxic").mapInArrow(_triples, "pair long, first int, toxic boolean")
    triples = grams.repartition("pair").groupBy("pair", "first").agg(F.max("toxic").alias("t"), F.max(~F.col("toxic")).alias("o"))
    one = lambda c: F.sum(F.col(c).cast("int")).cast("int")
    pairs = materialize(triples.groupBy("pair").agg(one("t").alias("toxic"), one("o").alias("ordinary")), "toxicity-pairs")
    types = [F.sum((F.col(c) > 0).cast("long")).alias(c) for c in ("toxic", "ordinary")]
    word, before = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("pair", 32)
    contexts = pairs.groupBy(word.alias("h")).agg(*types).where(F.col("toxic") + F.col("ordinary") >= least_word)
    words = materialize(contexts, "toxicity-words")
    shares = Shares(words, discount)
    if not shares.size:
        return None
    times = F.col("toxic") + F.col("ordinary")
    few = {r["n"]: r["count"] for r in pairs.where(times <= 2).groupBy(times.alias("n")).count().collect()}
    lower = estimate(few.get(1, 0), few.get(2, 0))
    # pairs of known words, or of the beginning and one; nothing is known of the rest but its backoff
    befores = words.select(F.col("h").alias("v")).unionByName(spark.range(1).select(F.col("id").alias("v")))
    counted = words.select(F.col("h").alias("w"), F.col("toxic").alias("wt"), F.col("ordinary").alias("wo"))
    kept = pairs.where(times >= least_pair).withColumn("v", before).join(befores, "v", "left_semi").withColumn("w", word).join(counted, "w")
    kept = materialize(kept.select("pair", "v", "toxic", "ordinary", "wt", "wo"), "toxicity-kept")
    sides = ("toxic", "ordinary")
    behind = kept.groupBy("v").agg(*[f(c) for c in sides for f in (lambda c: F.sum(c).alias(f"{c}_all"), lambda c: F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds"))])
    behind = materialize(behind, "toxicity-behind")
    share = {c: F.when(F.col(f"{c}_all") > 0, lower * F.col(f"{c}_kinds") / F.col(f"{c}_all")).otherwise(F.lit(1.0)) for c in sides}
    backoff = F.log(share["toxic"]) - F.log(share["ordinary"])
    # what workers hold comes to the driver, as columns; the rest stays a table
    strong = F.coalesce(_strongest(words, most_words, discount), F.lit(False))
    singles = words.join(behind, words["h"] == behind["v"], "left").select(
        strong.alias("held"), F.col("h").alias("code"), shares.ratio(F.col("toxic"), F.col("ordinary")).alias("x"), F.coalesce(backoff, F.lit(0.0)).alias("y")
    )
    likely_in = [
        F.greatest(F.col(c) - F.lit(lower), F.lit(0.0)) / F.greatest(F.col(f"{c}_all"), F.lit(1)) + share[c] * F.exp(log) for c, log in zip(sides, shares.logs(F.col("wt"), F.col("wo")))
    ]
    strong = F.coalesce(_strongest(kept, most_pairs, lower), F.lit(False))
    doubles = kept.join(behind, "v").select(strong.alias("held"), F.col("pair").alias("code"), (F.log(likely_in[0]) - F.log(likely_in[1])).alias("x"), F.lit(0.0).alias("y"))
    held_words, held_pairs = (Values.read(df.where("held").drop("held")) for df in (singles, doubles.drop("y")))
    told = (F.col("x") != F.lit(shares.unknown)) | (F.col("y") != 0)
    rest, bits = singles.where(~F.col("held") & told).select(F.lit(False).alias("pair"), "code", "x", "y"), None
    rest = materialize(rest.unionByName(doubles.where("NOT held").select(F.lit(True).alias("pair"), "code", "x", "y")), "toxicity-rest")
    others = rest.count()
    if others:
        bits = _marks(rest, others)
    start = behind.where("v = 0").select(backoff).first()
    evidence = Evidence(shares, held_words, held_pairs, start[0] if start else 0.0, rest if others else None, bits, lambda: _spellings(of(early), held_words.keys))
    shared = spark.sparkContext.broadcast(evidence)

    late = side(rows.where("late").select("id", "h", "toxic")).select("text", F.xxhash64("h").alias("h"), "toxic")
    if evidence.rest is not None:
        late = _with_rest(late, evidence, shared, "text", "more")

    def measure(batches):
        forget_encoders()
        own = shared.value.own()
        for batch in batches:
            for part in text_parts(batch, 0, 1_000_000):
                x = own.features(text_list(part.column(0)), *map(_more, part.columns[3:]))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), *(pa.array(x[:, k]) for k in range(3))], names=["h", "toxic", "a", "b", "c"])
        give_back()

    late = late.mapInArrow(measure, "h long, toxic int, a double, b double, c double")
    late = late.groupBy("h").agg(F.max("toxic").alias("toxic"), F.min(F.struct("a", "b", "c")).alias("x")).select("toxic", "x.*")
    cells = [F.greatest(F.lit(-32), F.least(F.lit(31), F.floor(F.col(c) * n))).alias(f"_{c}") for c, n in zip("abc", CELLS)]
    sums = [F.sum(F.round(F.col(c) * UNITS).cast("long")).alias(c) for c in "abc"]  # whole numbers: the same in any order
    late = late.groupBy("toxic", *cells).agg(F.count("*").alias("n"), *sums).toArrow().to_pandas().sort_values(["toxic", "_a", "_b", "_c"])
    shared.destroy()
    y, n = late["toxic"].to_numpy(), late["n"].to_numpy().astype(float)
    if not (0 < y.sum() < len(y)):
        return None
    return evidence.fit(late[["a", "b", "c"]].to_numpy() / n[:, None] / UNITS, y, n)


def score(docs: DataFrame, evidence: Evidence | None, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` plus ``names``: the score (0 to 1) and the prediction (1 from 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(evidence)  # of bounded size
    given, more = docs, []
    if evidence is not None and evidence.rest is not None:
        more = free(docs, "_more")
        given = _with_rest(docs, evidence, shared, text_col, *more)

    def make():
        forget_encoders()
        own = shared.value and shared.value.own()

        def compute(texts, *more):
            found = own.scores(text_list(texts), *map(_more, more)) if own else np.zeros(len(texts))
            return [found, (found >= 0.5).astype(np.int32)]

        return compute

    output = T.StructType([T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return with_computed(given, [text_col, *more], output, make, max_chars=1_000_000, left_out=more)


def _more(found: pa.Array) -> tuple[Values, Values]:
    """The rest's words and pairs in a batch of texts. What a code stands for is the same in each of them."""
    return _values(*found.flatten().flatten())


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows that are not held out, then score every row."""
    return score(docs, train(docs, labels.where(~held_out())))


def digest_columns(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
