"""Steps that change the corpus: each takes tables and returns the tables after the step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import views as V
from webloom.functions import text as X
from webloom.functions import url as U
from webloom.session import materialize, table


def expand_frontier(links: DataFrame, seeds: DataFrame, most_depth: int, every: int = 2) -> DataFrame:
    """(id, depth): pages that can be reached from the seeds, at their smallest depth.

    One join per depth; what is known is written out after ``every`` second one, so plans stay short and a lost
    executor costs few steps.
    """
    known = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    newest = known
    for depth in range(1, most_depth + 1):
        step = links.join(newest.select(F.col("id").alias("source_id")), "source_id").select(F.col("target_id").alias("id")).distinct()
        newest = step.join(known, "id", "left_anti").withColumn("depth", F.lit(depth))
        known = known.union(newest)
        if depth % every == 0 and depth < most_depth:
            known = materialize(known, "frontier")
            newest = known.where(F.col("depth") == depth)
            if newest.isEmpty():
                break
    return known


def new_rows(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Get or create: the incoming rows whose key is not there yet, once each."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def repaired(pages: DataFrame) -> DataFrame:
    """Relevant pages that were fetched become approved, approved pages of no relevance lose approval."""
    fetched = F.col("crawled_at").isNotNull()
    approved = (
        F.when(F.col("relevance") == 0, F.lit(None).cast("date")).when((F.col("relevance") > 0) & fetched, F.coalesce("approved_at", "crawled_at")).otherwise(F.col("approved_at"))
    )
    return pages.withColumn("approved_at", approved)


def _longer(old: Column, new: Column) -> Column:
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    return F.when(size(new) > size(old), new).otherwise(old)


def merged(old: DataFrame, new: DataFrame, strategy: str = "smart") -> DataFrame:
    """Fields of extracted pages joined with new extractions.

    ``new_first`` takes what is new, ``keep`` fills gaps only, ``smart`` keeps the longer title and text, fills
    the language, and keeps the earlier date.
    """
    fields = ("title", "readable", "lang", "published_at")
    both = old.join(new.select("id", *[F.col(f).alias(f"new_{f}") for f in fields]), "id", "left")
    blank = lambda c: F.nullif(c, F.lit("")) if c is not None else c
    o = {f: F.col(f) if f == "published_at" else blank(F.col(f)) for f in fields}
    n = {f: F.col(f"new_{f}") if f == "published_at" else blank(F.col(f"new_{f}")) for f in fields}
    rules = {
        "new_first": {f: F.coalesce(n[f], o[f]) for f in fields},
        "keep": {f: F.coalesce(o[f], n[f]) for f in fields},
        "smart": {
            "title": _longer(o["title"], n["title"]),
            "readable": _longer(o["readable"], n["readable"]),
            "lang": F.coalesce(o["lang"], n["lang"]),
            "published_at": F.least(o["published_at"], n["published_at"]),
        },
    }[strategy]
    return both.select("id", *[rules[f].alias(f) for f in fields])


def merged_results(known: DataFrame, results: DataFrame) -> DataFrame:
    """Search results joined to known pages by address: titles fill gaps, the earlier date stays."""
    k = known.select("url", F.col("title").alias("_t"), F.col("published_at").alias("_p"), F.lit(True).alias("_known"))
    r = results.groupBy("url").agg(F.min("title").alias("title"), F.min("published_at").alias("published_at"))
    return k.join(r, "url", "full_outer").select(
        "url",
        F.coalesce(F.nullif("_t", F.lit("")), "title").alias("title"),
        F.least("_p", "published_at").alias("published_at"),
        F.coalesce("_known", F.lit(False)).alias("was_known"),
    )


def without_irrelevant(pages: DataFrame, links: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Fetched pages below a relevance go, and with them the links at either end."""
    gone = pages.where((F.col("relevance") < least) & F.col("crawled_at").isNotNull()).select("id")
    kept = pages.join(gone, "id", "left_anti")
    for end in ("source_id", "target_id"):
        links = links.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return kept, links


def calendar_windows(span: DataFrame, step: str) -> DataFrame:
    """[window_start, window_end] that cover the days ``first`` to ``last`` of each row; the last is cut.

    A month that is too short for its day ends it earlier, and the months after carry that on.
    """
    if step in ("day", "week"):
        n = 1 if step == "day" else 7
        starts = F.sequence("first", "last", F.expr(f"interval {n} days"))
        after = lambda d: F.date_add(d, n)
    else:
        months = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.months_between("last", "first")).cast("int") + 1))
        walked = F.aggregate(months, F.array("first"), lambda found, _: F.array_append(found, F.add_months(F.element_at(found, -1), 1)))
        starts = F.filter(walked, lambda d: d <= F.col("last"))
        after = lambda d: F.add_months(d, 1)
    each = span.select("last", F.explode(starts).alias("window_start"))
    return each.select("window_start", F.least(F.date_sub(after(F.col("window_start")), 1), "last").alias("window_end"))


def ordered_days(orders: DataFrame) -> DataFrame:
    """The first and the last day of a table of orders."""
    day = F.to_date("o_orderdate")
    return orders.agg(F.min(day).alias("first"), F.max(day).alias("last"))


def redomained(pages: DataFrame, heuristics: dict[str, str]) -> DataFrame:
    """Hosts by the heuristics, and whether a page moves."""
    host = U.domain_name(F.col("url"), heuristics)
    return pages.select("id", host.alias("domain"), (host != F.col("domain_name")).alias("moved"))


def dictionary_terms(terms: DataFrame) -> DataFrame:
    """The terms of a dictionary (term, lang) with their variations, once each."""
    return terms.select("lang", F.explode(X.term_variations(F.col("term"), F.col("lang"))).alias("variation")).distinct()


def consolidated(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Per page of a rebuild: links out and in, and whether it is approved afterwards."""
    out = links.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("links_out"))
    into = links.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("links_in"))
    fixed = repaired(pages).select("id", F.col("approved_at").isNotNull().alias("approved"))
    return fixed.join(out, "id", "left").join(into, "id", "left").na.fill(0, ["links_out", "links_in"])


E, D, L = V.EXPRESSIONS, V.DOMAINS, V.LINKS
HEURISTICS = {"example.com": r"^https?://(?:www\.|m\.)?([^/?#]+)", "example.org": r"^https?://([^./]+)\."}


def _old(s, d):
    p = V.expressions(s, d)
    return p.select("id", F.when(F.col("id") % 3 != 0, F.col("title")).alias("title"), F.when(F.col("id") % 7 != 0, F.col("readable")).alias("readable"), F.when(F.col("id") % 2 == 0, F.col("lang")).alias("lang"), F.col("created_at").alias("published_at"))


def _new(s, d):
    p = V.expressions(s, d).where("id % 5 <> 0")
    return p.select("id", F.regexp_replace("title", " [^ ]*$", "").alias("title"), F.when(F.col("id") % 2 == 0, F.concat("title", F.lit(" "), "readable")).otherwise(F.regexp_replace("readable", "the ", "")).alias("readable"), F.lit("xx").alias("lang"), F.date_sub("created_at", 3).alias("published_at"))


def _results(s, d):
    p = V.expressions(s, d)
    again = p.where("id % 4 = 0").select("url", F.lit("Found").alias("title"), F.date_sub("created_at", 1).alias("published_at"))
    return again.union(p.where("id % 10 = 1").select(F.concat("url", F.lit("/new")), F.lit("New"), F.col("created_at")))


def _known(s, d):
    p = V.expressions(s, d)
    return p.where("id % 6 <> 5").groupBy("url").agg(F.min(F.when(F.col("id") % 3 != 0, F.col("title")).otherwise("")).alias("title"), F.min("created_at").alias("published_at"))


_OLD = "o AS (SELECT id, CASE WHEN id % 3 <> 0 THEN nullif(title, '') END AS title, CASE WHEN id % 7 <> 0 THEN nullif(readable, '') END AS readable, CASE WHEN id % 2 = 0 THEN nullif(lang, '') END AS lang, created_at AS published_at FROM expressions)"
_NEW = "n AS (SELECT id, nullif(regexp_replace(title, ' [^ ]*$', ''), '') AS title, nullif(CASE WHEN id % 2 = 0 THEN title || ' ' || readable ELSE regexp_replace(readable, 'the ', '', 'g') END, '') AS readable, 'xx' AS lang, created_at - 3 AS published_at FROM expressions WHERE id % 5 <> 0)"
_FIELDS = ("title", "readable", "lang", "published_at")
_APPROVED = "CASE WHEN relevance = 0 THEN NULL WHEN relevance > 0 AND crawled_at IS NOT NULL THEN coalesce(approved_at, crawled_at) ELSE approved_at END"


def _smart(f: str) -> str:
    longer = f"CASE WHEN length(coalesce(n.{f}, '')) > length(coalesce(o.{f}, '')) THEN n.{f} ELSE o.{f} END"
    return {"lang": "coalesce(o.lang, n.lang)", "published_at": "least(o.published_at, n.published_at)"}.get(f, longer)


def _merge_sql(rule) -> str:
    return V.with_views(E, _OLD, _NEW) + "SELECT o.id, " + ", ".join(f"{rule(f)} AS {f}" for f in _FIELDS) + " FROM o LEFT JOIN n ON n.id = o.id"


_DAYS = "WITH RECURSIVE days AS (SELECT min(o_orderdate)::DATE AS f, max(o_orderdate)::DATE AS l FROM orders)"
QUERIES = {
    "frontier_expansion": lambda s, d: expand_frontier(V.links(s, d), V.expressions(s, d).where("id % 97 = 0"), 3),
    "new_pages": lambda s, d: new_rows(_known(s, d).select("url"), _results(s, d).select("url"), "url"),
    "pipeline_repair": lambda s, d: repaired(V.expressions(s, d)).select("id", "approved_at"),
    "merge_smart": lambda s, d: merged(_old(s, d), _new(s, d), "smart"),
    "merge_keep": lambda s, d: merged(_old(s, d), _new(s, d), "keep"),
    "merge_new_first": lambda s, d: merged(_old(s, d), _new(s, d), "new_first"),
    "search_result_merge": lambda s, d: merged_results(_known(s, d), _results(s, d)),
    "delete_irrelevant_pages": lambda s, d: without_irrelevant(V.expressions(s, d), V.links(s, d), 2.0)[0].select("id"),
    "delete_irrelevant_links": lambda s, d: without_irrelevant(V.expressions(s, d), V.links(s, d), 2.0)[1].select("source_id", "target_id"),
    "calendar_weeks": lambda s, d: calendar_windows(ordered_days(table(s, d, "orders")), "week"),
    "calendar_months": lambda s, d: calendar_windows(ordered_days(table(s, d, "orders")).withColumn("first", F.date_add("first", 30)), "month"),
    "redomained_pages": lambda s, d: redomained(V.expressions(s, d), HEURISTICS),
    "dictionary_terms": lambda s, d: dictionary_terms(V.project_terms(s, d)),
    "consolidation": lambda s, d: consolidated(V.expressions(s, d), V.links(s, d)),
}
ORACLES = {
    "frontier_expansion": "WITH RECURSIVE " + ", ".join((E, L))
    + ", r AS (SELECT id, 0 AS depth FROM expressions WHERE id % 97 = 0 UNION SELECT l.target_id, r.depth + 1 FROM r JOIN links l ON l.source_id = r.id WHERE r.depth < 3) SELECT id, min(depth) AS depth FROM r GROUP BY 1",
    "new_pages": V.with_views(E) + "SELECT DISTINCT url FROM (SELECT url FROM expressions WHERE id % 4 = 0 UNION ALL SELECT url || '/new' FROM expressions WHERE id % 10 = 1) WHERE url NOT IN (SELECT url FROM expressions WHERE id % 6 <> 5)",
    "pipeline_repair": V.with_views(E) + f"SELECT id, {_APPROVED} AS approved_at FROM expressions",
    "merge_smart": _merge_sql(_smart),
    "merge_keep": _merge_sql(lambda f: f"coalesce(o.{f}, n.{f})"),
    "merge_new_first": _merge_sql(lambda f: f"coalesce(n.{f}, o.{f})"),
    "search_result_merge": V.with_views(E)
    + ", k AS (SELECT url, min(CASE WHEN id % 3 <> 0 THEN title ELSE '' END) AS t, min(created_at) AS p FROM expressions WHERE id % 6 <> 5 GROUP BY 1), "
    "r AS (SELECT url, min(title) AS t, min(p) AS p FROM (SELECT url, 'Found' AS title, created_at - 1 AS p FROM expressions WHERE id % 4 = 0 UNION ALL SELECT url || '/new', 'New', created_at FROM expressions WHERE id % 10 = 1) GROUP BY 1) "
    "SELECT coalesce(k.url, r.url) AS url, coalesce(nullif(k.t, ''), r.t) AS title, least(k.p, r.p) AS published_at, k.url IS NOT NULL AS was_known FROM k FULL JOIN r ON k.url = r.url",
    "delete_irrelevant_pages": V.with_views(E) + "SELECT id FROM expressions WHERE NOT coalesce(relevance < 2 AND crawled_at IS NOT NULL, false)",
    "delete_irrelevant_links": V.with_views(E, L)
    + ", g AS (SELECT id FROM expressions WHERE relevance < 2 AND crawled_at IS NOT NULL) SELECT source_id, target_id FROM links WHERE source_id NOT IN (SELECT id FROM g) AND target_id NOT IN (SELECT id FROM g)",
    "calendar_weeks": f"{_DAYS} SELECT d::DATE AS window_start, least(d::DATE + 6, l) AS window_end FROM days, range(f, l + 1, INTERVAL 7 DAY) t(d)",
    "calendar_months": f"{_DAYS}, w AS (SELECT f + 30 AS window_start, l FROM days UNION ALL SELECT (window_start + INTERVAL 1 MONTH)::DATE, l FROM w WHERE window_start + INTERVAL 1 MONTH <= l) "
    "SELECT window_start, least((window_start + INTERVAL 1 MONTH)::DATE - 1, l) AS window_end FROM w",
    "redomained_pages": V.with_views(E)
    + r", h AS (SELECT id, domain_name, CASE WHEN suffix(domain_name, 'example.com') THEN coalesce(nullif(regexp_extract(url, '^https?://(?:www\.|m\.)?([^/?#]+)', 1), ''), domain_name) "
    r"WHEN suffix(domain_name, 'example.org') THEN coalesce(nullif(regexp_extract(url, '^https?://([^./]+)\.', 1), ''), domain_name) ELSE domain_name END AS domain FROM expressions) SELECT id, domain, domain <> domain_name AS moved FROM h",
    "dictionary_terms": V.with_views(E, V.PROJECT_TERMS) + "SELECT DISTINCT lang, variation FROM spelled",
    "consolidation": V.with_views(E, L)
    + f"SELECT e.id, ({_APPROVED}) IS NOT NULL AS approved, (SELECT count(*) FROM links l WHERE l.source_id = e.id) AS links_out, (SELECT count(*) FROM links l WHERE l.target_id = e.id) AS links_in FROM expressions e",
}
