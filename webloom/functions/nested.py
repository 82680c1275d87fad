"""JSON columns whose keys are not known beforehand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_map(text: Column) -> Column:
    """Keys and values as text; malformed JSON is an empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def widened(df: DataFrame, column: str, missing: str = "na", most_keys: int = 500) -> DataFrame:
    """One column per key of a JSON column, in order of name; a first pass collects the keys.

    Tables with more than ``most_keys`` keys are refused: such keys are data, not columns.
    """
    keys = [r[0] for r in df.select(F.explode(F.map_keys(as_map(F.col(column))))).distinct().limit(most_keys + 1).collect()]
    if len(keys) > most_keys:
        raise ValueError(f"{column} has more than {most_keys} keys")
    values = as_map(F.col(column))
    cell = lambda k: F.coalesce(F.nullif(values[k], F.lit("")), F.lit(missing)).alias(k)
    return df.select(*[c for c in df.columns if c != column], *[cell(k) for k in sorted(keys)])
