"""Counts and rates that tell how far a project has come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom import views as V
from webloom.functions.quality import with_quality
from webloom.functions.text import reading_minutes, word_count


def _n(cond) -> F.Column:
    return F.count(F.when(cond, 1))


def pipeline_stats(pages: DataFrame) -> DataFrame:
    """Per project: pages in each state, average and highest relevance, share that is approved."""
    done = {c: F.col(f"{c}_at").isNotNull() for c in ("crawled", "readable", "approved")}
    return pages.groupBy("land_id").agg(
        F.count("*").alias("total"),
        *[_n(ok).alias(c) for c, ok in done.items()],
        _n(F.col("relevance") > 0).alias("relevant"),
        _n(F.col("http_status") == 200).alias("status_ok"),
        F.round(F.avg("relevance"), 4).alias("avg_relevance"),
        F.max("relevance").alias("max_relevance"),
        F.max("depth").alias("max_depth"),
        F.round(100 * _n(done["approved"]) / F.count("*"), 2).alias("completion_rate"),
    )


def by_depth(pages: DataFrame) -> DataFrame:
    return pages.groupBy("land_id", "depth").agg(
        F.count("*").alias("total"), _n(F.col("approved_at").isNotNull()).alias("approved"), F.round(F.avg("relevance"), 4).alias("avg_relevance")
    )


def unprocessed(pages: DataFrame) -> DataFrame:
    """Why pages are not approved yet."""
    fetched, relevant, approved = F.col("crawled_at").isNotNull(), F.coalesce(F.col("relevance") > 0, F.lit(False)), F.col("approved_at").isNotNull()
    return pages.groupBy("land_id").agg(
        _n(~fetched).alias("not_fetched"), _n(fetched & ~relevant).alias("fetched_not_relevant"), _n(relevant & ~approved).alias("relevant_not_approved")
    )


def inconsistent(pages: DataFrame) -> DataFrame:
    """Is a project free of approved pages of no relevance?"""
    wrong = F.col("approved_at").isNotNull() & (F.col("relevance") == 0)
    return pages.groupBy("land_id").agg(_n(wrong).alias("wrong"), (_n(wrong) == 0).alias("healthy"))


def timeline(events: DataFrame, days: int = 10) -> DataFrame:
    """The newest days with their number of events, views and purchases."""
    daily = events.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("value")
    )
    return daily.orderBy(F.desc("day")).limit(days)


def status_histogram(pages: DataFrame) -> DataFrame:
    return pages.groupBy("land_id", "http_status").agg(F.count("*").alias("n"))


def domain_stats(domains: DataFrame) -> DataFrame:
    """Hosts fetched and not, and their average status; a status that is no number does not count."""
    fetched = F.col("source_method").isNotNull()
    return domains.agg(
        F.count("*").alias("total"), _n(fetched).alias("fetched"), _n(~fetched).alias("unfetched"),
        F.round(F.avg(F.col("http_status").try_cast("int")), 2).alias("avg_http_status"),
    )


def by_source(domains: DataFrame, sources: tuple[str, ...] = ("crawl", "archive", "direct", "manual")) -> DataFrame:
    """Hosts by the way they were fetched, ways without a host included."""
    known = domains.sparkSession.createDataFrame([(x,) for x in sources], "source_method string")
    return known.join(domains.groupBy("source_method").count(), "source_method", "left").select("source_method", F.coalesce("count", F.lit(0)).alias("n"))


def paragraph_stats(paragraphs: DataFrame) -> DataFrame:
    """Per page: paragraphs, and how many of them have a vector."""
    has = F.size(F.coalesce("embedding", F.array().cast("array<float>"))) > 0
    return paragraphs.groupBy("expression_id").agg(
        F.count("*").alias("paragraphs"), _n(has).alias("embedded"), F.round(100 * _n(has) / F.count("*"), 2).alias("coverage"), F.min("id").alias("first_id")
    )


def readable_stats(pages: DataFrame) -> DataFrame:
    eligible = F.col("crawled_at").isNotNull() & (F.col("http_status") == 200)
    return pages.groupBy("land_id").agg(
        F.count("*").alias("total"), F.count("readable_at").alias("readable"), F.max("readable_at").alias("last"), _n(eligible).alias("eligible"),
        F.round(100 * F.count("readable_at") / F.nullif(_n(eligible), F.lit(0)), 2).alias("coverage"),
    )


def project_totals(pages: DataFrame, paragraphs: DataFrame, tagged: DataFrame) -> DataFrame:
    """One row per project; each side is counted before it is joined, so that nothing is counted twice."""
    p = pages.groupBy("land_id").agg(F.count("*").alias("pages"), F.countDistinct("domain_name").alias("hosts"))
    of = pages.select(F.col("id").alias("expression_id"), "land_id")
    g = paragraphs.join(of, "expression_id").groupBy("land_id").agg(F.count("*").alias("paragraphs"))
    t = tagged.join(of, "expression_id").groupBy("land_id").agg(F.countDistinct("tag_id").alias("tags"))
    return p.join(g, "land_id", "left").join(t, "land_id", "left").na.fill(0, ["paragraphs", "tags"])


def quality_table(pages: DataFrame) -> DataFrame:
    """Quality of every page on a fixed day."""
    words = word_count(F.col("readable"))
    measured = pages.withColumns({"word_count": words, "reading_time": reading_minutes(F.col("readable")), "published_at": F.col("created_at")})
    scored = with_quality(measured, F.array(F.lit("en"), F.lit("fr")), F.lit("2025-06-01").cast("date"))
    return scored.select("id", F.round("q_richness", 6).alias("richness"), F.round("q_coherence", 6).alias("coherence"), "quality", "quality_category")


def quality_histogram(pages: DataFrame) -> DataFrame:
    names = ("Excellent", "Bon", "Moyen", "Faible", "Très faible")
    known = pages.sparkSession.createDataFrame([(x,) for x in names], "quality_category string")
    return known.join(quality_table(pages).groupBy("quality_category").count(), "quality_category", "left").select("quality_category", F.coalesce("count", F.lit(0)).alias("n"))


E, D, P, G = V.EXPRESSIONS, V.DOMAINS, V.PARAGRAPHS, V.TAGGED
_WORDS = r"len(list_filter(string_split_regex(readable, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))"
QUALITY = f"""m AS (SELECT *, {_WORDS} AS wc FROM expressions),
 b AS (SELECT *,
  CASE WHEN crawled_at IS NULL THEN 0 WHEN http_status BETWEEN 200 AND 299 THEN 1.0 WHEN http_status BETWEEN 300 AND 399 THEN 0.5 ELSE 0 END AS qa,
  CASE WHEN trim(title) <> '' THEN 0.4 ELSE 0 END AS qs,
  CASE WHEN wc = 0 THEN 0 ELSE
    0.5 * (CASE WHEN wc < 80 THEN 0.1 WHEN wc < 150 THEN 0.3 WHEN wc <= 5000 THEN exp(-pow(wc - 1500, 2) / (2 * 1500.0 * 1500.0)) ELSE greatest(0.5, 0.8 - (wc - 5000) / 50000.0) END)
    + 0.3 * (CASE WHEN content_length = 0 THEN 0.5 WHEN wc / content_length < 0.05 THEN 0.2 WHEN wc / content_length < 0.1 THEN 0.5 WHEN wc / content_length <= 0.3 THEN 1.0 ELSE 0.9 END)
    + 0.2 * (CASE WHEN greatest(1, wc // 200) <= 15 THEN 1.0 WHEN greatest(1, wc // 200) <= 25 THEN 0.8 ELSE 0.3 END) END AS qr,
  0.4 * (CASE WHEN lang = '' THEN 0.5 WHEN lang IN ('en', 'fr') THEN 1.0 ELSE 0.0 END) + 0.4 * (CASE WHEN relevance IS NULL THEN 0.5 ELSE least(relevance / 5.0, 1.0) END)
    + 0.2 * (CASE WHEN date_diff('day', created_at, DATE '2025-06-01') < 365 THEN 1.0 ELSE 0.9 END) AS qc,
  (CASE WHEN validllm = 'oui' THEN 0.4 WHEN validllm = 'non' THEN 0.0 ELSE 0.2 END)
    + (CASE WHEN readable_at IS NULL OR readable = '' THEN 0.0 WHEN length(readable) > 100 THEN 0.4 ELSE 0.2 END) + (CASE WHEN approved_at IS NOT NULL THEN 0.2 ELSE 0.0 END) AS qi FROM m),
 q AS (SELECT *, CASE WHEN qa = 0 THEN 0.0::DOUBLE ELSE (qa * 0.30 + qs * 0.15 + qr * 0.25 + qc * 0.20 + qi * 0.10)::DOUBLE END AS total FROM b),
 quality AS (SELECT id, round(qr::DOUBLE, 6) AS richness, round(qc::DOUBLE, 6) AS coherence, round(total + 1e-9, 3) AS quality,
  CASE WHEN total >= 0.8 THEN 'Excellent' WHEN total >= 0.6 THEN 'Bon' WHEN total >= 0.4 THEN 'Moyen' WHEN total >= 0.2 THEN 'Faible' ELSE 'Très faible' END AS quality_category FROM q)"""
QUERIES = {
    "pipeline_stats": lambda s, d: pipeline_stats(V.expressions(s, d)),
    "depth_stats": lambda s, d: by_depth(V.expressions(s, d)),
    "unprocessed_stats": lambda s, d: unprocessed(V.expressions(s, d)),
    "health_check": lambda s, d: inconsistent(V.expressions(s, d)),
    "event_timeline": lambda s, d: timeline(s.read.parquet(f"{d}/events.parquet")),
    "status_histogram": lambda s, d: status_histogram(V.expressions(s, d)),
    "domain_stats": lambda s, d: domain_stats(V.domains(s, d)),
    "domains_by_source": lambda s, d: by_source(V.domains(s, d)),
    "paragraph_stats": lambda s, d: paragraph_stats(V.paragraphs(s, d)),
    "readable_stats": lambda s, d: readable_stats(V.expressions(s, d)),
    "project_totals": lambda s, d: project_totals(V.expressions(s, d), V.paragraphs(s, d), V.tagged_content(s, d)),
    "quality_table": lambda s, d: quality_table(V.expressions(s, d, even=True)),
    "quality_histogram": lambda s, d: quality_histogram(V.expressions(s, d)),
}
ORACLES = {
    "pipeline_stats": V.with_views(E)
    + "SELECT land_id, count(*) AS total, count(crawled_at) AS crawled, count(readable_at) AS readable, count(approved_at) AS approved, count(*) FILTER (WHERE relevance > 0) AS relevant, "
    "count(*) FILTER (WHERE http_status = 200) AS status_ok, round(avg(relevance), 4) AS avg_relevance, max(relevance) AS max_relevance, max(depth) AS max_depth, "
    "round(100.0 * count(approved_at) / count(*), 2)::DOUBLE AS completion_rate FROM expressions GROUP BY 1",
    "depth_stats": V.with_views(E) + "SELECT land_id, depth, count(*) AS total, count(approved_at) AS approved, round(avg(relevance), 4) AS avg_relevance FROM expressions GROUP BY 1, 2",
    "unprocessed_stats": V.with_views(E)
    + "SELECT land_id, count(*) FILTER (WHERE crawled_at IS NULL) AS not_fetched, count(*) FILTER (WHERE crawled_at IS NOT NULL AND coalesce(relevance, 0) <= 0) AS fetched_not_relevant, "
    "count(*) FILTER (WHERE relevance > 0 AND approved_at IS NULL) AS relevant_not_approved FROM expressions GROUP BY 1",
    "health_check": V.with_views(E)
    + "SELECT land_id, count(*) FILTER (WHERE approved_at IS NOT NULL AND relevance = 0) AS wrong, count(*) FILTER (WHERE approved_at IS NOT NULL AND relevance = 0) = 0 AS healthy FROM expressions GROUP BY 1",
    "event_timeline": "SELECT ts::DATE AS day, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 2) AS value FROM events GROUP BY 1 ORDER BY day DESC LIMIT 10",
    "status_histogram": V.with_views(E) + "SELECT land_id, http_status, count(*) AS n FROM expressions GROUP BY 1, 2",
    "domain_stats": V.with_views(E, D)
    + "SELECT count(*) AS total, count(source_method) AS fetched, count(*) - count(source_method) AS unfetched, round(avg(try_cast(http_status AS INT)), 2) AS avg_http_status FROM domains",
    "domains_by_source": V.with_views(E, D)
    + "SELECT k.s AS source_method, count(d.id) AS n FROM (VALUES ('crawl'), ('archive'), ('direct'), ('manual')) k(s) LEFT JOIN domains d ON d.source_method = k.s GROUP BY 1",
    "paragraph_stats": V.with_views(P)
    + "SELECT expression_id, count(*) AS paragraphs, count(*) FILTER (WHERE len(embedding) > 0) AS embedded, round(100.0 * count(*) FILTER (WHERE len(embedding) > 0) / count(*), 2)::DOUBLE AS coverage, min(id) AS first_id FROM paragraphs GROUP BY 1",
    "readable_stats": V.with_views(E)
    + "SELECT land_id, count(*) AS total, count(readable_at) AS readable, max(readable_at) AS last, count(*) FILTER (WHERE crawled_at IS NOT NULL AND http_status = 200) AS eligible, "
    "round(100.0 * count(readable_at) / count(*) FILTER (WHERE crawled_at IS NOT NULL AND http_status = 200), 2)::DOUBLE AS coverage FROM expressions GROUP BY 1",
    "project_totals": V.with_views(E, P, G)
    + "SELECT e.land_id, count(DISTINCT e.id) AS pages, count(DISTINCT e.domain_name) AS hosts, count(DISTINCT p.id) AS paragraphs, count(DISTINCT g.tag_id) AS tags FROM expressions e "
    "LEFT JOIN paragraphs p ON p.expression_id = e.id LEFT JOIN tagged g ON g.expression_id = e.id GROUP BY 1",
    "quality_table": V.with_views(E, QUALITY) + "SELECT * FROM quality",
    "quality_histogram": V.with_views(E, QUALITY)
    + "SELECT k.c AS quality_category, count(q.id) AS n FROM (VALUES ('Excellent'), ('Bon'), ('Moyen'), ('Faible'), ('Très faible')) k(c) LEFT JOIN quality q ON q.quality_category = k.c GROUP BY 1",
}
