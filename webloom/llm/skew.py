"""Joins where one key may belong to a large part of all rows, bitmaps of ids, and names that a table leaves free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.session import materialize

#: Size of the bitmap of ids whose texts are fetched: 2 MB.
ID_BITS = 24


def join_hot(rows: DataFrame, facts: DataFrame, on: Column, hot: Column, how: str = "left") -> DataFrame:
    """``rows`` joined to ``facts`` (left or inner), where one fact may belong to a large part of all rows.

    Facts marked ``hot`` go to every executor and their rows stay where they are; the caller sees to it that a mark
    stands for a share of the rows (see ``often``), so that the marked facts are few whatever the data. All other
    rows are shuffled. ``on`` names different columns of both sides, and no row has two facts.
    """
    few = F.broadcast(materialize(facts.where(hot), "hot-facts"))
    others = rows.join(few, on, "left_anti")
    return rows.join(few, on).unionByName(others.join(facts.where(~hot), on, how))


def often(count: str, rows: int, share: int = 1000) -> Column:
    """Does a fact belong to at least a thousandth of all rows? At most a thousand facts do."""
    return F.col(count) * share >= max(rows, share)


def free(df: DataFrame, *wanted: str) -> list[str]:
    """These names, with underscores put before them until ``df`` has no such column; Spark ignores case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(columns: list[str]) -> list[Column]:
    """Columns by their names, whatever these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def _slot(column: str):
    return F.pmod(F.xxhash64(F.lit(31), column), F.lit(1 << ID_BITS))


def id_bits(ids: DataFrame, column: str) -> DataFrame:
    """(word, bits): a bitmap of hashed ids, of 2 ** (ID_BITS - 6) rows at most, however many ids there are."""
    at = _slot(column)
    one = F.expr("shiftleft(1L, cast(at % 64 as int))")
    return ids.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits"))


def likely(rows: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """Rows whose id the bitmap holds, and a few more; the bitmap is small by its making, so that it can be broadcast."""
    at = _slot(column)
    held = F.getbit(F.col("bits"), (at % 64).cast("int")) == 1
    return rows.join(F.broadcast(bits), (F.shiftright(at, 6) == F.col("word")) & held, "left_semi")
