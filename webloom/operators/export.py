"""Tables that leave the system: pages, media, links, hosts, and the graphs between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom import views as V


def relevant(pages: DataFrame, land_id: int, least: float) -> DataFrame:
    """The pages of a project from a relevance on; pages without relevance are left out."""
    return pages.where((F.col("land_id") == land_id) & (F.col("relevance") >= least))


def template(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A scan that names its output columns by SQL expressions."""
    return df.select(*[F.expr(e).alias(name) for name, e in columns.items()])


PAGE_COLUMNS = {
    "id": "e.id", "url": "e.url", "title": "e.title", "relevance": "e.relevance", "depth": "e.depth",
    "domain_id": "d.id", "domain_name": "d.name", "domain_description": "d.description",
}


def page_table(pages: DataFrame, domains: DataFrame, land_id: int, least: float, full: bool = False) -> DataFrame:
    joined = relevant(pages, land_id, least).alias("e").join(domains.alias("d"), F.col("e.domain_name") == F.col("d.name"))
    return template(joined, PAGE_COLUMNS | ({"readable": "e.readable"} if full else {}))


def domain_nodes(pages: DataFrame, domains: DataFrame, land_id: int, least: float) -> DataFrame:
    """Hosts with their number of pages and average relevance."""
    by_host = relevant(pages, land_id, least).groupBy("domain_name").agg(
        F.count("*").alias("expressions"), F.round(F.avg("relevance"), 2).alias("average_relevance"),
        F.min("created_at").alias("first_page"), F.max("created_at").alias("last_page"),
    )
    return by_host.join(domains, by_host.domain_name == domains.name).select("id", "name", "description", "expressions", "average_relevance", "first_page", "last_page")


def media_table(media: DataFrame, pages: DataFrame, land_id: int, least: float) -> DataFrame:
    kept = relevant(pages, land_id, least).select(F.col("id").alias("_page"))
    return media.join(kept, F.col("expression_id") == F.col("_page")).select("id", "expression_id", "url", "type")


def conforming_media(media: DataFrame, min_width: int = 0, min_height: int = 0, max_size: int = 0) -> DataFrame:
    """Media of sufficient size; 0 is no limit, and a missing figure counts as 0."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    ok = (n("width") >= min_width) & (n("height") >= min_height)
    return media.where(ok & (n("file_size") <= max_size) if max_size else ok)


def page_links(pages: DataFrame, links: DataFrame, land_id: int, least: float) -> DataFrame:
    """Links from the relevant pages, with both addresses; only the source is filtered."""
    s = relevant(pages, land_id, least).select(F.col("id").alias("source_id"), F.col("url").alias("source_url"))
    t = pages.select(F.col("id").alias("target_id"), F.col("url").alias("target_url"))
    return links.join(s, "source_id").join(t, "target_id").select("source_id", "source_url", "target_id", "target_url")


def domain_links(pages: DataFrame, links: DataFrame, land_id: int, least: float) -> DataFrame:
    """How many links lead from one host to another."""
    s = relevant(pages, land_id, least).select(F.col("id").alias("source_id"), F.col("domain_name").alias("source_domain"))
    t = pages.select(F.col("id").alias("target_id"), F.col("domain_name").alias("target_domain"))
    return (
        links.join(s, "source_id").join(t, "target_id").where("source_domain <> target_domain")
        .groupBy("source_domain", "target_domain").agg(F.count("*").alias("link_count"))
    )


def graph_edges(pages: DataFrame, links: DataFrame, land_id: int, least: float) -> DataFrame:
    """Links of which both ends are relevant pages, on different hosts."""
    kept = relevant(pages, land_id, least)
    s = kept.select(F.col("id").alias("source_id"), F.col("domain_name").alias("_s"))
    t = kept.select(F.col("id").alias("target_id"), F.col("domain_name").alias("_t"))
    return links.join(s, "source_id").join(t, "target_id").where("_s <> _t").select("source_id", "target_id")


E, D, L, M = V.EXPRESSIONS, V.DOMAINS, V.LINKS, V.MEDIA


def _pages(spark, d):
    return V.expressions(spark, d), V.domains(spark, d)


QUERIES = {
    "page_table": lambda s, d: page_table(*_pages(s, d), 1, 1.0),
    "full_page_table": lambda s, d: page_table(*_pages(s, d), 2, 0.0, full=True),
    "domain_nodes": lambda s, d: domain_nodes(*_pages(s, d), 1, 1.0),
    "media_table": lambda s, d: media_table(V.media(s, d), V.expressions(s, d), 1, 2.0),
    "conforming_media": lambda s, d: conforming_media(V.media(s, d), 200, 100, 1_500_000),
    "page_links": lambda s, d: page_links(V.expressions(s, d), V.links(s, d), 1, 3.0),
    "domain_links": lambda s, d: domain_links(V.expressions(s, d), V.links(s, d), 1, 1.0),
    "graph_edges": lambda s, d: graph_edges(V.expressions(s, d), V.links(s, d), 2, 2.0),
}
_R = "e.land_id = {0} AND e.relevance >= {1}"
_PAGE = "e.id, e.url, e.title, e.relevance, e.depth, d.id AS domain_id, d.name AS domain_name, d.description AS domain_description"
ORACLES = {
    "page_table": V.with_views(E, D) + f"SELECT {_PAGE} FROM expressions e JOIN domains d ON d.name = e.domain_name WHERE " + _R.format(1, 1),
    "full_page_table": V.with_views(E, D) + f"SELECT {_PAGE}, e.readable FROM expressions e JOIN domains d ON d.name = e.domain_name WHERE " + _R.format(2, 0),
    "domain_nodes": V.with_views(E, D)
    + "SELECT d.id, d.name, d.description, count(*) AS expressions, round(avg(e.relevance), 2) AS average_relevance, min(e.created_at) AS first_page, "
    "max(e.created_at) AS last_page FROM domains d JOIN expressions e ON e.domain_name = d.name WHERE " + _R.format(1, 1) + " GROUP BY 1, 2, 3",
    "media_table": V.with_views(E, M) + "SELECT m.id, m.expression_id, m.url, m.type FROM media m JOIN expressions e ON e.id = m.expression_id WHERE " + _R.format(1, 2),
    "conforming_media": V.with_views(M) + "SELECT * FROM media WHERE coalesce(width, 0) >= 200 AND coalesce(height, 0) >= 100 AND coalesce(file_size, 0) <= 1500000",
    "page_links": V.with_views(E, L)
    + "SELECT l.source_id, e.url AS source_url, l.target_id, t.url AS target_url FROM links l JOIN expressions e ON e.id = l.source_id "
    "JOIN expressions t ON t.id = l.target_id WHERE " + _R.format(1, 3),
    "domain_links": V.with_views(E, L)
    + "SELECT e.domain_name AS source_domain, t.domain_name AS target_domain, count(*) AS link_count FROM links l JOIN expressions e ON e.id = l.source_id "
    "JOIN expressions t ON t.id = l.target_id WHERE e.domain_name <> t.domain_name AND " + _R.format(1, 1) + " GROUP BY 1, 2",
    "graph_edges": V.with_views(E, L)
    + ", idx AS (SELECT id, domain_name FROM expressions e WHERE " + _R.format(2, 2) + ") SELECT l.source_id, l.target_id FROM links l JOIN idx a ON a.id = l.source_id "
    "JOIN idx b ON b.id = l.target_id WHERE a.domain_name <> b.domain_name",
}
