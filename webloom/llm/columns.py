"""Adding columns computed from texts, Arrow batch by Arrow batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from webloom.llm.tokens import spans
from webloom.session import ship


def text_list(column: pa.Array) -> list[str]:
    """The texts of a column; null counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def text_parts(batch: pa.RecordBatch, column: int, max_chars: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts hold about ``max_chars`` together; no text becomes a Python string for that."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
    for begin, end in spans(sizes, max_chars):
        yield batch.slice(begin, end - begin)


def give_back() -> None:
    """Memory that a task no longer uses goes back to the system, for a worker stays for the tasks of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def with_computed(
    df: DataFrame,
    inputs: list[str],
    outputs: T.StructType,
    make: Callable[[], Callable[..., list]],
    max_chars: int = 4_000_000,
    left_out: Iterable[str] = (),
) -> DataFrame:
    """``df`` plus the columns ``outputs``, without ``left_out``; an input column of the same name gives way.

    ``make`` is called once in a task and returns a function from Arrow arrays (one for each of
    ``inputs``, the first of them the text that sets how many rows are handled at once) to one
    sequence for each output.
    """
    ship(df.sparkSession)
    new = {c.lower() for c in (*outputs.names, *left_out)}  # Spark's column names ignore case
    kept = [i for i, f in enumerate(df.schema) if f.name.lower() not in new]
    # columns go by number while they are away, since a name may hold anything
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    fields = [T.StructField(f"c{i}", df.schema[i].dataType) for i in kept] + [T.StructField(f"o{i}", f.dataType) for i, f in enumerate(outputs)]
    sources = [df.columns.index(c) for c in inputs]
    kinds = [to_arrow_type(f.dataType) for f in outputs]

    def run(batches):
        compute = make()
        for batch in batches:
            for part in text_parts(batch, sources[0], max_chars):
                made = compute(*(part.column(i) for i in sources))
                arrays = [part.column(i) for i in kept]
                arrays += [a if isinstance(a, pa.Array) else pa.array(a, k) for a, k in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])
        give_back()

    made = plain.mapInArrow(run, T.StructType(fields))
    return made.toDF(*(df.columns[i] for i in kept), *(f.name for f in outputs))
