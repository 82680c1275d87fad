"""Registry of the queries that this library offers, with their DuckDB counterparts."""

from __future__ import annotations

from webloom.operators import browse, crawl, dictionaries, export, more, pairs, sentiment, stats, tags, texts, vector_index, worklists
from webloom.plans import corpus, crawl_loop, lifecycle
from webloom.streaming import timeline

MODULES = (export, browse, stats, tags, texts, more, worklists, crawl, dictionaries, pairs, vector_index, sentiment, lifecycle, corpus, crawl_loop, timeline)

#: Date columns leave as ISO text, so that every client reads them alike.
DATES = {
    "domain_nodes": ("first_page", "last_page"),
    "frontier": ("created_at",),
    "event_timeline": ("day",),
    "page_timeline": ("day",),
    "readable_stats": ("last",),
    "pipeline_repair": ("approved_at",),
    "merge_smart": ("published_at",),
    "merge_keep": ("published_at",),
    "merge_new_first": ("published_at",),
    "search_result_merge": ("published_at",),
    "calendar_weeks": ("window_start", "window_end"),
    "calendar_months": ("window_start", "window_end"),
    "daily_events": ("day",),
}


def _as_text(query, columns):
    def run(spark, sf_dir):
        found = query(spark, sf_dir)
        return found.withColumns({c: found[c].cast("string") for c in columns})

    return run


def _as_text_sql(sql: str, columns) -> str:
    casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({casts}) FROM ({sql})"


QUERIES = {n: _as_text(q, DATES[n]) if n in DATES else q for m in MODULES for n, q in m.QUERIES.items()}
ORACLES = {n: _as_text_sql(q, DATES[n]) if n in DATES else q for m in MODULES for n, q in m.ORACLES.items()}
