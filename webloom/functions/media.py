"""Measures of images and their colours, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(F.coalesce(height, F.lit(0)) == 0, 0.0).otherwise(F.round(width / height, 2))


def web_safe(channel: Column) -> Column:
    """The nearest of the six web-safe levels (multiples of 51)."""
    return (F.floor((channel + 25) / 51) * 51).cast("int")


def web_safe_colour(rgb: Column) -> Column:
    """The nearest web-safe colour; the channels are independent of each other."""
    return F.transform(rgb, web_safe)


def colour_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0), lambda s, x: s + x)


def analysed(error: Column, width: Column) -> dict[str, Column]:
    """State columns of an analysed medium."""
    done = error.isNull() & width.isNotNull()
    return {"is_processed": done, "state": F.when(done, "done").when(error.isNotNull(), "failed").otherwise("open")}
