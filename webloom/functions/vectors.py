"""Vector measures as column expressions."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from webloom.functions.text import bound
from webloom.session import ship


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """A zero vector counts as one of length 1."""
    safe = lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n)
    return dot(a, b) / (safe(norm(a)) * safe(norm(b)))


def normalized(a: Column) -> Column:
    """Of unit length; a zero vector stays as it is."""
    unit = lambda v: bound(norm(v), lambda length: F.transform(v, lambda x: F.when(length == 0, x.cast("double")).otherwise(x.cast("double") / length)))
    return bound(a, unit)


@F.arrow_udf(ArrayType(DoubleType()))
def _character_counts(text: pa.Array, size: pa.Array) -> pa.Array:
    """Characters of lower-case texts in bins, of unit length, a text at a time."""
    bins = size[0].as_py() if len(size) else 1
    step, out = 1315423911 % bins, np.zeros((len(text), bins))
    for i, t in enumerate(text.to_pylist()):
        if t:
            codes = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64)
            out[i] = np.bincount(codes * step % bins, minlength=bins)
    length = np.sqrt((out**2).sum(1, keepdims=True))
    out /= np.where(length == 0, 1, length)
    offsets = pa.array(np.arange(len(text) + 1) * bins, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=text.is_null())


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """Character counts in ``size`` bins, of unit length; the same text gives the same vector anywhere."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)
    return _character_counts(F.lower(text), F.lit(size))


def sign_planes(size: int, planes: int, seed: int = 42) -> list[list[int]]:
    rng = random.Random(seed)
    return [[1 if rng.random() >= 0.5 else -1 for _ in range(size)] for _ in range(planes)]


def signature(vector: Column, planes: list[list[int]]) -> Column:
    """One bit per plane: set where the vector lies on its positive side."""
    bits = [F.when(dot(vector, F.array(*[F.lit(float(x)) for x in plane])) >= 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, plane in enumerate(planes)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total
