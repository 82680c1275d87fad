"""Lists that people browse: filtered, paged and ordered pages, neighbours in an order, searches, tags of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom import views as V
from webloom.operators.order import numbered

#: Columns that a caller may order by.
ORDERS = {"id", "title", "domain_name", "relevance", "depth"}


def ordering(column: str, descending: bool = False) -> list:
    """An order with the id as the last key; an unknown column means the id."""
    c = F.col(column if column in ORDERS else "id")
    return [c.desc() if descending else c.asc(), F.col("id").desc() if descending else F.col("id").asc()]


def reachable(pages: DataFrame, land_id: int, least: float = 0, depth: int = 3) -> DataFrame:
    return pages.where((F.col("land_id") == land_id) & (F.col("http_status") == 200) & (F.col("relevance") >= least) & (F.col("depth") <= (depth or 3)))


def page_list(pages: DataFrame, tagged: DataFrame, land_id: int, least: float, depth: int, order: str, descending: bool, offset: int, limit: int) -> DataFrame:
    """One page of the list, with the number of tagged passages of each page."""
    counts = tagged.groupBy("expression_id").agg(F.count("tag_id").alias("tag_count"))
    kept = reachable(pages, land_id, least, depth).select("id", "url", "title", "domain_name", "relevance", "depth")
    top = kept.orderBy(*ordering(order, descending)).offset(offset).limit(limit)
    return top.join(counts, top.id == counts.expression_id, "left").select(top["*"], F.coalesce("tag_count", F.lit(0)).alias("tag_count"))


def neighbours(pages: DataFrame, land_id: int, order: str, descending: bool = False) -> DataFrame:
    """The page before and after each page of a project."""
    kept = reachable(pages, land_id).select("land_id", "id", "title", "relevance", "depth", "domain_name")
    placed = numbered(kept, "land_id", ordering(order, descending)).select("id", "place")
    beside = lambda step, name: placed.select(F.col("id").alias(name), (F.col("place") + step).alias("place"))
    return placed.join(beside(1, "prev_id"), "place", "left").join(beside(-1, "next_id"), "place", "left").select("id", "prev_id", "next_id")


def frontier(pages: DataFrame, land_id: int, status: int | None = None, depth: int | None = None, limit: int = 0) -> DataFrame:
    """Pages that still wait for approval, shallow and old ones first; limit 0 means all."""
    kept = pages.where((F.col("land_id") == land_id) & F.col("approved_at").isNull())
    if status is not None:
        kept = kept.where(F.col("http_status") == status)
    if depth is not None:
        kept = kept.where(F.col("depth") == depth)
    kept = kept.select("id", "url", "depth", "created_at")
    return kept.orderBy("depth", "created_at", "id").limit(limit) if limit else kept


def consolidation_candidates(pages: DataFrame) -> DataFrame:
    return pages.where("approved_at IS NOT NULL OR readable_at IS NOT NULL").select("id", "depth")


def verdict_candidates(pages: DataFrame, least_length: int, force: bool = False) -> DataFrame:
    """Pages without a verdict; forced, also those once refused."""
    open_ = F.col("validllm").isNull() | ~F.col("validllm").isin("oui", "non")
    if force:
        open_ = open_ | (F.col("validllm") == "non")
    return pages.where(open_ & (F.length("readable") >= least_length)).select("id", "validllm")


def search(docs: DataFrame, needle: str, limit: int) -> DataFrame:
    """Texts that contain the needle in any case, longest first."""
    from webloom.functions.text import word_count

    found = docs.where(F.contains(F.lower("text"), F.lit(needle.lower()))).select("doc_id", word_count(F.col("text")).alias("word_count"))
    return found.orderBy(F.desc("word_count"), "doc_id").limit(limit)


def in_order_of(pages: DataFrame, ids: list[int]) -> DataFrame:
    """The pages of a list of ids, with their place in it."""
    wanted = pages.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, position int")
    return pages.join(F.broadcast(wanted), "id").select("id", "position", "url")  # the caller's own list


def domain_list(pages: DataFrame, domains: DataFrame) -> DataFrame:
    """All hosts with their number of approved pages, 0 included."""
    n = pages.where("approved_at IS NOT NULL").groupBy("domain_name").count()
    return domains.join(n, domains.name == n.domain_name, "left").select("id", "name", F.coalesce("count", F.lit(0)).alias("expression_count"))


def page_images(pages: DataFrame, media: DataFrame) -> DataFrame:
    """Every page with the addresses of its images, in order."""
    images = media.where("type = 'img'").groupBy("expression_id").agg(F.array_join(F.array_sort(F.collect_set("url")), ",").alias("images"))
    return pages.join(images, pages.id == images.expression_id, "left").select("id", "images")


def passages(tagged: DataFrame, pages: DataFrame, tags: DataFrame, land_id: int) -> DataFrame:
    """Tagged passages of a project with their text, tag and page."""
    p = pages.where(F.col("land_id") == land_id).select(F.col("id").alias("expression_id"), "url", "readable")
    t = tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag"))
    cut = F.substring(F.col("readable"), F.col("from_char") + 1, F.col("to_char") - F.col("from_char"))
    return tagged.join(p, "expression_id").join(t, "tag_id").select("id", "expression_id", "url", "tag", cut.alias("passage"))


E, D, M, T, G = V.EXPRESSIONS, V.DOMAINS, V.MEDIA, V.TAGS, V.TAGGED
_OK = "land_id = 1 AND http_status = 200 AND relevance >= 0 AND depth <= 3"
QUERIES = {
    "page_list": lambda s, d: page_list(V.expressions(s, d), V.tagged_content(s, d), 1, 1.0, 2, "relevance", True, 5, 20),
    "neighbours": lambda s, d: neighbours(V.expressions(s, d), 1, "relevance", True),
    "frontier": lambda s, d: frontier(V.expressions(s, d), 1, status=200),
    "consolidation_candidates": lambda s, d: consolidation_candidates(V.expressions(s, d)),
    "verdict_candidates": lambda s, d: verdict_candidates(V.expressions(s, d), 500, force=True),
    "text_search": lambda s, d: search(s.read.parquet(f"{d}/documents.parquet"), "THE", 20),
    "in_order_of": lambda s, d: in_order_of(V.expressions(s, d), [7, 3, 11, 2]),
    "domain_list": lambda s, d: domain_list(V.expressions(s, d), V.domains(s, d)),
    "page_images": lambda s, d: page_images(V.expressions(s, d), V.media(s, d)),
    "tagged_passages": lambda s, d: passages(V.tagged_content(s, d), V.expressions(s, d), V.tags(s, d), 1),
}
ORACLES = {
    "page_list": V.with_views(E, G)
    + "SELECT id, url, title, domain_name, relevance, depth, (SELECT count(tag_id) FROM tagged t WHERE t.expression_id = e.id) AS tag_count FROM expressions e "
    "WHERE land_id = 1 AND http_status = 200 AND relevance >= 1 AND depth <= 2 ORDER BY relevance DESC, id DESC LIMIT 20 OFFSET 5",
    "neighbours": V.with_views(E)
    + f"SELECT id, lag(id) OVER (ORDER BY relevance DESC, id DESC) AS prev_id, lead(id) OVER (ORDER BY relevance DESC, id DESC) AS next_id FROM expressions WHERE {_OK}",
    "frontier": V.with_views(E) + "SELECT id, url, depth, created_at FROM expressions WHERE land_id = 1 AND approved_at IS NULL AND http_status = 200",
    "consolidation_candidates": V.with_views(E) + "SELECT id, depth FROM expressions WHERE approved_at IS NOT NULL OR readable_at IS NOT NULL",
    "verdict_candidates": V.with_views(E) + "SELECT id, validllm FROM expressions WHERE (validllm IS NULL OR validllm <> 'oui') AND length(readable) >= 500",
    "text_search": r"SELECT doc_id, len(list_filter(string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))::INT AS word_count "
    "FROM documents WHERE contains(lower(text), 'the') ORDER BY word_count DESC, doc_id LIMIT 20",
    "in_order_of": V.with_views(E) + "SELECT e.id, p.position, e.url FROM expressions e JOIN (VALUES (7,0),(3,1),(11,2),(2,3)) p(id, position) ON p.id = e.id",
    "domain_list": V.with_views(E, D)
    + "SELECT d.id, d.name, count(e.id) AS expression_count FROM domains d LEFT JOIN expressions e ON e.domain_name = d.name AND e.approved_at IS NOT NULL GROUP BY 1, 2",
    "page_images": V.with_views(E, M)
    + "SELECT e.id, string_agg(DISTINCT m.url, ',' ORDER BY m.url) AS images FROM expressions e LEFT JOIN media m ON m.expression_id = e.id AND m.type = 'img' GROUP BY 1",
    "tagged_passages": V.with_views(E, T, G)
    + "SELECT g.id, g.expression_id, e.url, t.name AS tag, substring(e.readable, g.from_char + 1, g.to_char - g.from_char) AS passage FROM tagged g "
    "JOIN expressions e ON e.id = g.expression_id JOIN tags t ON t.id = g.tag_id WHERE e.land_id = 1",
}
