"""Exports by name: what each writes, runs of several, and how long files are kept."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import views as V
from webloom.functions import text as X
from webloom.operators import export as E
from webloom.operators import texts
from webloom.sinks import files


def _pages(spark: SparkSession, sf_dir: str, land_id: int, least: float) -> DataFrame:
    return V.expressions(spark, sf_dir).where((F.col("land_id") == land_id) & (F.col("relevance") >= least)).orderBy("id")


def _csv(query: Callable[[SparkSession, str, int, float], DataFrame]):
    return lambda spark, d, land, least, path: files.write_csv(query(spark, d, land, least), path)


def _graph(spark, d, land, least, path):
    nodes = _pages(spark, d, land, least).select("id", "title", "relevance", "depth", "url")
    inside = nodes.select(F.col("id").alias("source_id"))
    edges = V.links(spark, d).join(inside, "source_id", "left_semi").join(inside.withColumnRenamed("source_id", "target_id"), "target_id", "left_semi")
    files.write_gexf(path, nodes, edges.orderBy("source_id", "target_id"), "title", "relevance", {"depth": "integer", "url": "string"})


def _corpus(spark, d, land, least, path):
    pages = _pages(spark, d, land, least)
    named = texts.corpus_files(pages).join(pages.select("id", "readable"), "id").orderBy("id")
    files.write_corpus(named, path.removesuffix(".zip"))


def _media(spark, d, land, least):
    pages = _pages(spark, d, land, least).select(F.col("id").alias("expression_id"))
    return V.media(spark, d).join(pages, "expression_id", "left_semi").orderBy("id")


#: name -> (ending, writer): what can be asked for.
EXPORTS: dict[str, tuple[str, Callable]] = {
    "pagecsv": ("csv", _csv(lambda s, d, land, least: _pages(s, d, land, least).select("id", "url", "title", "lang", "relevance", "depth"))),
    "fullpagecsv": ("csv", _csv(lambda s, d, land, least: _pages(s, d, land, least).select("id", "url", "title", X.export_value(F.col("lang")).alias("lang"), "relevance", "depth", "readable"))),
    "nodecsv": ("csv", _csv(lambda s, d, land, least: _pages(s, d, land, least).groupBy("domain_name").agg(F.count("*").alias("pages"), F.round(F.avg("relevance"), 4).alias("relevance")).orderBy("domain_name"))),
    "mediacsv": ("csv", _csv(_media)),
    "pagegexf": ("gexf", _graph),
    "corpus": ("zip", _corpus),
}


def file_name(kind: str, folder: str, land: int, stamp: str) -> str:
    """Where an export goes; an unknown kind raises."""
    if kind not in EXPORTS:
        raise ValueError(f"unknown export {kind}; known are {', '.join(sorted(EXPORTS))}")
    return os.path.join(folder, f"land_{land}_{kind}_{stamp}.{EXPORTS[kind][0]}")


def run(spark: SparkSession, sf_dir: str, kind: str, folder: str, land: int = 1, least: float = 0.0, stamp: str = "") -> str:
    path = file_name(kind, folder, land, stamp or time.strftime("%Y%m%d%H%M%S"))
    EXPORTS[kind][1](spark, sf_dir, land, least, path)
    return path


def run_all(spark: SparkSession, sf_dir: str, requests: list[dict], folder: str) -> list[dict]:
    """Each request with where its file is, or why there is none; one that fails stops no other."""
    out = []
    for request in requests:
        try:
            out.append(request | {"status": "done", "path": run(spark, sf_dir, folder=folder, **request)})
        except Exception as problem:  # the caller reads it
            out.append(request | {"status": "failed", "error": str(problem)})
    return out


def expired(folder: str, days: float, now: float | None = None) -> list[str]:
    """Files of a folder older than so many days; ``clean`` deletes them."""
    limit = (time.time() if now is None else now) - days * 86_400
    return sorted(p for name in os.listdir(folder) if os.path.isfile(p := os.path.join(folder, name)) and os.path.getmtime(p) < limit)


def clean(folder: str, days: float, now: float | None = None) -> list[str]:
    gone = expired(folder, days, now)
    for path in gone:
        os.remove(path)
    return gone
