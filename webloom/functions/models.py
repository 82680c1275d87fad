"""Models of the caller's choice, run on columns: loaded once a worker, asked in batches, tried again, and never fatal.

A model is a function without arguments that loads it and gives the function to ask: for pairs, a list of (text, text) in
and a list of (relation, confidence) out; for texts, a list of texts in and a list of numbers out. Batches come from Spark's
partitions and are cut to ``batch`` rows, so memory is bounded by the batch and not by the partition.

A batch that fails ``tries`` times, or that comes back with another number of answers, gets the answer for "don't know": a
pair is neutral with even confidence, a text has no score. The same holds for all rows where the model cannot be loaded.
Null texts of a pair are asked as empty ones.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from webloom.session import ship

log = logging.getLogger(__name__)
Pairs = list[tuple[str, str]]
#: What is said of a pair when nothing is known: fixed values.
UNKNOWN = (0, 0.5)
RELATION = "relation int, confidence double"


def asked(ask: Callable | None, items: list, batch: int, tries: int, unknown) -> list:
    """The model's answers for ``items``, ``unknown`` for the batches that fail each time."""
    out = []
    for a in range(0, len(items), batch):
        some = items[a : a + batch]
        for attempt in range(tries if ask is not None else 0):
            try:
                got = list(ask(some))
                if len(got) != len(some):
                    raise ValueError(f"{len(got)} answers for {len(some)} rows")
                out += got
                break
            except Exception as e:  # a model may raise anything
                log.warning("batch of %d, attempt %d: %s", len(some), attempt + 1, e)
        else:
            out += [unknown] * len(some)
    return out


def _loaded(load: Callable[[], Callable]) -> Callable | None:
    try:
        return load()
    except Exception as e:
        log.warning("the model cannot be loaded: %s", e)
        return None


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def _by(batch: int, *columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """Columns cut to ``batch`` rows without a copy: only these become Python strings at a time."""
    for begin in range(0, len(columns[0]), batch):
        yield tuple(c.slice(begin, batch) for c in columns)


def pair_model(spark: SparkSession, load: Callable[[], Callable[[Pairs], list[tuple[int, float]]]], batch: int = 64, tries: int = 2) -> Callable[[Column, Column], Column]:
    """(text, text) -> struct of relation (1 follows, 0 neutral, -1 contradicts) and confidence, by a model."""
    ship(spark)

    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ask = _loaded(load)
        for whole in parts:
            said = [x for a, b in _by(batch, *whole) for x in asked(ask, list(zip(_texts(a), _texts(b), strict=True)), batch, tries, UNKNOWN)]
            relation, confidence = pa.array([int(r) for r, _ in said], pa.int32()), pa.array([float(c) for _, c in said], pa.float64())
            yield pa.StructArray.from_arrays([relation, confidence], names=["relation", "confidence"])

    return F.arrow_udf(run, RELATION)


def text_model(spark: SparkSession, load: Callable[[], Callable[[list[str]], list[float | None]]], batch: int = 64, tries: int = 2) -> Callable[[Column], Column]:
    """text -> a number by a model; null where it has none. Null texts are not asked."""
    ship(spark)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ask = _loaded(load)
        for whole in parts:
            answers = iter([x for (some,) in _by(batch, whole.drop_null()) for x in asked(ask, some.to_pylist(), batch, tries, None)])
            yield pa.array([next(answers) if known else None for known in whole.is_valid().to_pylist()], pa.float64())

    return F.arrow_udf(run, "double")


#: Words that turn a sentence round: fixed values.
TURNING = ("no", "not", "never", "none", "ne", "pas", "jamais", "sans")


def overlap_judge(least: float = 0.5, opposed: float = 0.2) -> Callable[[Pairs], list[tuple[int, float]]]:
    """A stand-in for a language model: of the shorter text's words, how many does the other hold?

    ``least`` of them and it follows; ``opposed`` of them, with a turning word in one text only, and it contradicts.
    """
    words = lambda t: {w.lower() for w in re.findall("[A-Za-z]+", t)}

    def ask(pairs: Pairs) -> list[tuple[int, float]]:
        said = []
        for a, b in ((words(a), words(b)) for a, b in pairs):
            share = len(a & b) / min(len(a), len(b)) if a and b else 0.0
            turned = bool(a.intersection(TURNING)) != bool(b.intersection(TURNING))
            said.append((-1 if turned and share >= opposed else 1 if share >= least and not turned else 0, 0.5 + share / 2))
        return said

    return ask
