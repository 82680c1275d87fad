"""Tables that enter the system: address lists, and what fetching pages gave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def address_list(spark: SparkSession, path: str) -> DataFrame:
    """(url): the lines of text files that are addresses, each once; blank lines and lines with # are left out."""
    line = F.btrim("value", F.lit(" \t\r"))
    return spark.read.text(path).select(line.alias("url")).where(F.col("url").rlike(r"^https?://[^/?#\s]+")).distinct()


def fetched(results: DataFrame) -> DataFrame:
    """Results of fetches as a table of pages.

    ``results``: url, status (null where the request failed), headers (map of names in any case to values), body.
    """
    names = F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    h = results.withColumn("_h", names)
    return h.select(
        "url",
        F.coalesce(F.col("status").cast("int"), F.lit(0)).alias("http_status"),
        F.nullif(F.btrim(F.substring_index(F.lower(F.col("_h")["content-type"]), ";", 1)), F.lit("")).alias("content_type"),
        F.coalesce(F.col("_h")["content-length"].try_cast("long"), F.octet_length("body").cast("long")).alias("content_length"),
        F.col("_h")["last-modified"].alias("last_modified"),
        F.col("_h")["etag"].alias("etag"),
        F.col("body").alias("html"),
    )


def with_archive(pages: DataFrame, archived: DataFrame) -> DataFrame:
    """Pages whose fetch gave nothing take the newest snapshot of an archive: url, taken_at, html."""
    newest = archived.groupBy(F.col("url").alias("_url")).agg(F.max_by("html", "taken_at").alias("_html"))
    empty = F.coalesce(F.col("html"), F.lit("")) == ""
    both = pages.join(newest, F.col("url") == F.col("_url"), "left")
    return both.withColumn("source", F.when(~empty, "fetch").when(F.col("_html").isNotNull(), "archive").otherwise("none")).withColumn("html", F.when(empty, F.col("_html")).otherwise(F.col("html"))).drop("_url", "_html")
