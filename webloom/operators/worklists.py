"""What is still to be done, and figures for those who run the system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom import views as V
from webloom.functions import dates as D
from webloom.functions import text as X
from webloom.functions import vectors as W
from webloom.session import table


def unfetched(pages: DataFrame, depth: int | None = None, status: int | None = None) -> DataFrame:
    """Pages never fetched, of one depth if given; or, to fetch again, those of one status."""
    kept = pages.where(F.col("http_status") == status) if status is not None else pages.where("crawled_at IS NULL")
    return (kept if depth is None else kept.where(F.col("depth") == depth)).select("id", "depth")


def unread(pages: DataFrame, approved: bool = True) -> DataFrame:
    """Pages whose text is to be extracted: approved ones without a text, or fetched ones never extracted.

    Those without a relevance come first.
    """
    if approved:
        kept = pages.where("approved_at IS NOT NULL AND http_status = 200 AND coalesce(readable, '') = ''")
    else:
        kept = pages.where("crawled_at IS NOT NULL AND readable_at IS NULL")
    return kept.select("id", "relevance", "depth").orderBy(F.col("relevance").asc_nulls_first(), "id")


def verdict_worklist(pages: DataFrame, least_length: int) -> DataFrame:
    """Relevant pages without a verdict, of a least length."""
    open_ = F.col("validllm").isNull() | ~F.col("validllm").isin("oui", "non")
    return pages.where(open_ & (F.col("relevance") > 0) & (F.length("readable") >= least_length)).select("id")


def previews(paragraphs: DataFrame, texts: DataFrame, pairs: DataFrame, size: int = 200) -> DataFrame:
    """Pairs with the beginnings of both texts and the raw score, or the score where that is missing."""
    side = lambda n: texts.select(F.col("id").alias(f"{n}_id"), F.left("text", F.lit(size)).alias(f"{n}_text"))
    return pairs.join(side("source"), "source_id").join(side("target"), "target_id").select(
        "source_id", "target_id", "source_text", "target_text", F.coalesce("score_raw", "score").alias("score")
    )


def tagged_of(tagged: DataFrame, pages: DataFrame, page: int | None = None, land: int | None = None, tag: int | None = None) -> DataFrame:
    """Tagged passages of a page or of a project, of one tag if given."""
    kept = tagged if tag is None else tagged.where(F.col("tag_id") == tag)
    if page is not None:
        kept = kept.where(F.col("expression_id") == page)
    elif land is not None:
        kept = kept.join(pages.where(F.col("land_id") == land).select(F.col("id").alias("expression_id")), "expression_id", "left_semi")
    return kept.select("id", "expression_id", "tag_id")


def recent_domains(domains: DataFrame, limit: int) -> DataFrame:
    """The hosts fetched last."""
    return domains.where("fetched_at IS NOT NULL").orderBy(F.desc("fetched_at"), "id").limit(limit).select("id", "name", "fetched_at")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts, taken from the customers; some are blocked."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), (F.col("c_custkey") % 10 != 0).alias("is_active"), (F.col("c_custkey") % 10 == 0).alias("is_blocked"))


def user_search(accounts: DataFrame, needle: str, blocked: bool | None = None) -> DataFrame:
    found = accounts.where(F.contains(F.lower("username"), F.lit(needle.lower())))
    return (found if blocked is None else found.where(F.col("is_blocked") == blocked)).select("id", "username", "is_blocked")


def admin_counts(accounts: DataFrame, pages: DataFrame, domains: DataFrame) -> DataFrame:
    """One row of totals; each table is counted by itself."""
    a = accounts.agg(F.count("*").alias("users"), F.count_if("is_active").alias("active"), F.count_if("is_blocked").alias("blocked"))
    p = pages.agg(F.countDistinct("land_id").alias("lands"), F.count("*").alias("pages"))
    return a.join(p).join(domains.agg(F.count("*").alias("domains")))  # three tables of one row each


def first_pairs(pairs: DataFrame, most: int) -> DataFrame:
    """The first pairs in order of source and target: a cap that the caller asks for."""
    return pairs.orderBy("source_id", "target_id").limit(most)


def _histogram(rows: DataFrame, by: str, of: str, name: str) -> DataFrame:
    """Per ``by`` a map from the values of ``of`` to their number."""
    counts = rows.where(F.col(of).isNotNull()).groupBy(by, of).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(of, "n")))).alias(name))


def paragraph_profile(paragraphs: DataFrame) -> DataFrame:
    """Per page: paragraphs, embedded ones, their lengths, and histograms of language and provider."""
    has = F.coalesce(F.size("embedding") > 0, F.lit(False))
    facts = paragraphs.groupBy("expression_id").agg(
        F.count("*").alias("paragraphs"), F.count_if(has).alias("embedded"), F.round(F.avg("n_words"), 4).alias("avg_words"),
        F.sum("n_words").alias("words"), F.min("n_words").alias("min_words"), F.max("n_words").alias("max_words"),
    )
    for of, name in (("lang", "languages"), ("provider", "providers")):
        facts = facts.join(_histogram(paragraphs, "expression_id", of, name), "expression_id", "left")
    return facts


def map_text(column: str) -> Column:
    """A histogram as text, for clients that know no maps."""
    return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


def paragraph_summary(paragraphs: DataFrame, pages: DataFrame) -> DataFrame:
    """Per project: pages with paragraphs, and paragraphs and words a page; a project without any has zeros."""
    of = pages.select(F.col("id").alias("expression_id"), "land_id")
    joined = of.join(paragraphs, "expression_id", "left")
    with_any = F.countDistinct(F.when(F.col("n_words").isNotNull(), F.col("expression_id")))
    per = lambda total: F.coalesce(F.round(total / F.nullif(with_any, F.lit(0)), 4), F.lit(0.0))
    return joined.groupBy("land_id").agg(
        F.countDistinct("expression_id").alias("pages"), with_any.alias("pages_with_paragraphs"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"),
        per(F.count("n_words")).alias("paragraphs_a_page"), per(F.sum("n_words")).alias("words_a_page"),
    )


def page_timeline(pages: DataFrame, days: int = 10) -> DataFrame:
    """The newest days with pages created, fetched and approved."""
    done = lambda c: F.count(F.col(c)).alias(c.removesuffix("_at"))
    return pages.groupBy(F.col("created_at").alias("day")).agg(F.count("*").alias("created"), done("crawled_at"), done("approved_at")).orderBy(F.desc("day")).limit(days)


def project_health(pages: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Per project: has it a dictionary, and is it free of approved pages of no relevance?"""
    wrong = F.count_if(F.col("approved_at").isNotNull() & (F.col("relevance") == 0))
    facts = pages.groupBy("land_id").agg(wrong.alias("wrong"))
    terms = dictionary.groupBy("land_id").agg(F.count("*").alias("terms"))
    n = F.coalesce("terms", F.lit(0))
    return facts.join(terms, "land_id", "left").select("land_id", "wrong", n.alias("terms"), ((n > 0) & (F.col("wrong") == 0)).alias("healthy"))


def sources_with_total(domains: DataFrame, sources: tuple[str, ...] = ("crawl", "archive", "direct", "manual")) -> DataFrame:
    """Hosts by the way they were fetched, ways without a host and the total included."""
    known = domains.sparkSession.createDataFrame([(x,) for x in sources], "source_method string")
    counts = known.join(domains.groupBy("source_method").count(), "source_method", "left").select("source_method", F.coalesce("count", F.lit(0)).alias("n"))
    return counts.union(counts.agg(F.lit("total"), F.coalesce(F.sum("n"), F.lit(0))))


def run_statistics(pages: DataFrame) -> DataFrame:
    """What a crawl run did, status by status: processed and failed pages."""
    failed = (F.col("http_status") >= 400) | (F.col("http_status") == 0)
    ran = pages.where("crawled_at IS NOT NULL")
    return ran.groupBy("http_status").agg(F.count("*").alias("processed"), F.count_if(failed).alias("errors"))


def remaining(pages: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Per project: pages still to fetch, paragraphs, and vectors."""
    p = pages.groupBy("land_id").agg(F.count_if(F.col("crawled_at").isNull()).alias("to_crawl"))
    of = pages.select(F.col("id").alias("expression_id"), "land_id")
    g = paragraphs.join(of, "expression_id").groupBy("land_id").agg(F.count("*").alias("paragraphs"), F.count_if(F.size("embedding") > 0).alias("vectors"))
    return p.join(g, "land_id", "left").na.fill(0, ["paragraphs", "vectors"])


def home_pages(attempts: DataFrame, tiers: tuple[str, ...] = ("extractor", "archive", "direct")) -> DataFrame:
    """Per host the first tier that gave its home page, how many tiers failed before, and the time of all tried.

    ``attempts``: domain, tier, content (null where the tier failed), duration.
    """
    rank = F.array_position(F.lit(list(tiers)), F.col("tier"))
    first = F.min(F.when(F.col("content").isNotNull(), F.struct(rank.alias("rank"), "tier", "content")))
    found = attempts.groupBy("domain").agg(first.alias("_f"), F.collect_list(F.struct(rank.alias("rank"), "duration")).alias("_all"))
    tried = F.filter("_all", lambda a: F.col("_f").isNull() | (a["rank"] <= F.col("_f.rank")))
    took = F.aggregate(tried, F.lit(0).cast("bigint"), lambda s, a: s + a["duration"])
    return found.select("domain", F.col("_f.tier").alias("source_method"), F.col("_f.content").alias("content"), F.size(F.filter(tried, lambda a: F.col("_f").isNull() | (a["rank"] < F.col("_f.rank")))).alias("retry_count"), took.alias("duration"))


def seeds(lands: DataFrame, pages: DataFrame) -> DataFrame:
    """The start addresses of projects in which nothing is pending, as pages of depth 0, unless they are there."""
    pending = pages.where("crawled_at IS NULL").select("land_id").distinct()
    wanted = lands.join(pending, "land_id", "left_anti").select("land_id", F.explode("start_urls").alias("url")).distinct()
    return wanted.join(pages.select("land_id", "url"), ["land_id", "url"], "left_anti").withColumn("depth", F.lit(0))


def merged_lists(lands: DataFrame, more: DataFrame) -> DataFrame:
    """Start addresses of projects with more of them behind, in order, each once."""
    both = lands.join(more.select("land_id", F.col("start_urls").alias("_more")), "land_id", "left")
    return both.select("land_id", F.array_distinct(F.concat("start_urls", F.coalesce("_more", F.array().cast("array<string>")))).alias("start_urls"))


def languages(text: Column) -> Column:
    """Languages of a project, written as one or as a JSON list."""
    return F.when(F.btrim(text).startswith("["), F.from_json(text, "array<string>")).when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(text))


def lands_of(pages: DataFrame) -> DataFrame:
    """Example projects: their start addresses are those of their first pages, and one that is new."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("id", "url"))), 1, 3)
    new = F.concat(F.lit("https://start.example.org/"), F.col("land_id").cast("string"))
    return pages.where("id < 12").groupBy("land_id").agg(first.alias("_f")).select("land_id", F.array_append(F.transform("_f", lambda x: x["url"]), new).alias("start_urls"))


def _profiled(s, d):
    p = V.paragraphs(s, d)
    n = F.col("id")
    return p.withColumns({"n_words": (n * 13 % 97 + 5).cast("int"), "lang": F.when(n % 3 == 0, "fr").when(n % 3 == 1, "en"), "provider": F.when(n % 4 == 0, "old").otherwise("new")})


def _attempts(s, d):
    at = V.domains(s, d).select(F.col("name").alias("domain"), "id", F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(k).alias("k")) for k, t in enumerate(("extractor", "archive", "direct"))])).alias("t"))
    ok = (F.col("id") + F.col("t.k")) % 3 == 0
    return at.select("domain", "t.tier", F.when(ok & (F.col("id") % 5 != 4), F.concat("domain", F.lit("#"), "t.tier")).alias("content"), (10 * (F.col("t.k") + 1) + F.col("id") % 7).alias("duration"))


E, DM, P, G, T = V.EXPRESSIONS, V.DOMAINS, V.PARAGRAPHS, V.TAGGED, V.TAGS
_USERS = "accounts AS (SELECT c_custkey AS id, c_name AS username, c_custkey % 10 <> 0 AS is_active, c_custkey % 10 = 0 AS is_blocked FROM customer)"
_PROFILED = "profiled AS (SELECT *, CAST(id * 13 % 97 + 5 AS INT) AS n_words, CASE WHEN id % 3 = 0 THEN 'fr' WHEN id % 3 = 1 THEN 'en' END AS lang, CASE WHEN id % 4 = 0 THEN 'old' ELSE 'new' END AS provider FROM paragraphs)"
_ATTEMPTS = """tiers AS (SELECT * FROM (VALUES ('extractor', 0), ('archive', 1), ('direct', 2)) v(tier, k)),
 attempts AS (SELECT d.name AS domain, tier, k, CASE WHEN (d.id + k) % 3 = 0 AND d.id % 5 <> 4 THEN d.name || '#' || tier END AS content, 10 * (k + 1) + d.id % 7 AS duration FROM domains d, tiers),
 firsts AS (SELECT domain, min(k) FILTER (WHERE content IS NOT NULL) AS k FROM attempts GROUP BY 1)"""
_LANDS = "lands AS (SELECT land_id, list_append(list_slice(list(url ORDER BY id), 1, 3), 'https://start.example.org/' || land_id) AS start_urls FROM expressions WHERE id < 12 GROUP BY 1)"
_PAIRS = "pairs AS (SELECT doc_id AS source_id, doc_id + 1 AS target_id, doc_id % 9 / 10.0::DOUBLE AS score, CASE WHEN doc_id % 2 = 0 THEN doc_id % 7 / 10.0::DOUBLE END AS score_raw FROM documents)"


def _pairs(s, d):
    n = F.col("doc_id")
    return table(s, d, "documents").select(n.alias("source_id"), (n + 1).alias("target_id"), (n % 9 / F.lit(10.0)).alias("score"), F.when(n % 2 == 0, n % 7 / F.lit(10.0)).alias("score_raw"))


def _terms(s):
    return s.createDataFrame([(1, "the", 1.0), (1, "und", 2.0)], "land_id int, term string, weight double")


QUERIES = {
    "unfetched_pages": lambda s, d: unfetched(V.expressions(s, d), depth=2),
    "refetch_pages": lambda s, d: unfetched(V.expressions(s, d), status=404),
    "unread_approved": lambda s, d: unread(V.expressions(s, d).withColumn("readable", F.when(F.col("id") % 4 != 0, F.col("readable")))),
    "unread_fetched": lambda s, d: unread(V.expressions(s, d), approved=False),
    "verdict_worklist": lambda s, d: verdict_worklist(V.expressions(s, d), 500),
    "pair_previews": lambda s, d: previews(None, table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), _pairs(s, d)),
    "tagged_of_project": lambda s, d: tagged_of(V.tagged_content(s, d), V.expressions(s, d), land=2, tag=107),
    "tagged_of_page": lambda s, d: tagged_of(V.tagged_content(s, d), V.expressions(s, d), page=5),
    "recent_domains": lambda s, d: recent_domains(V.domains(s, d).withColumn("fetched_at", F.when(F.col("id") % 5 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")))), 15).withColumn("fetched_at", F.col("fetched_at").cast("string")),
    "user_search": lambda s, d: user_search(users(s, d), "CUSTOMER", blocked=True),
    "admin_counts": lambda s, d: admin_counts(users(s, d), V.expressions(s, d), V.domains(s, d)),
    "first_pairs": lambda s, d: first_pairs(_pairs(s, d).select("source_id", "target_id"), 50),
    "paragraph_profile": lambda s, d: paragraph_profile(_profiled(s, d)).withColumns({"languages": map_text("languages"), "providers": map_text("providers")}),
    "paragraph_summary": lambda s, d: paragraph_summary(_profiled(s, d), V.expressions(s, d)),
    "page_timeline": lambda s, d: page_timeline(V.expressions(s, d)),
    "project_health": lambda s, d: project_health(V.expressions(s, d), _terms(s)),
    "sources_with_total": lambda s, d: sources_with_total(V.domains(s, d)),
    "run_statistics": lambda s, d: run_statistics(V.expressions(s, d)),
    "remaining_work": lambda s, d: remaining(V.expressions(s, d), V.paragraphs(s, d)),
    "home_pages": lambda s, d: home_pages(_attempts(s, d)),
    "seed_pages": lambda s, d: seeds(lands_of(V.expressions(s, d)), V.expressions(s, d).withColumn("crawled_at", F.when(F.col("land_id") == 2, F.coalesce("crawled_at", "created_at")).otherwise(F.col("crawled_at")))),
    "merged_lists": lambda s, d: merged_lists(lands_of(V.expressions(s, d)), V.expressions(s, d).where("id IN (0, 1)").select("land_id", F.array("url", F.lit("https://more.example.org/")).alias("start_urls"))).withColumn("start_urls", F.array_join("start_urls", " ")),
    "project_languages": lambda s, d: V.expressions(s, d).select("id", F.array_join(languages(F.when(F.col("id") % 3 == 0, F.lit('["fr","en"]')).when(F.col("id") % 3 == 1, F.col("lang"))), "+").alias("languages")),
    "simple_dates": lambda s, d: table(s, d, "events").select("event_id", D.simple_date(F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).otherwise("May 3")).cast("string").alias("at")),
    "search_ranges": lambda s, d: V.expressions(s, d).select("id", D.search_range(F.col("created_at"), F.date_add("created_at", 6)).alias("range")),
    "unit_vectors": lambda s, d: V.paragraphs(s, d).select("id", F.round(W.norm(W.normalized(F.col("embedding"))), 9).alias("norm"), F.round(W.normalized(F.col("embedding"))[0], 9).alias("first")),
    "hashed_embeddings": lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(W.hashed_embedding(F.col("text"))).alias("bin", "v")).where("v > 0").select("doc_id", "bin", F.round("v", 9).alias("v")),
}
ORACLES = {
    "unfetched_pages": V.with_views(E) + "SELECT id, depth FROM expressions WHERE crawled_at IS NULL AND depth = 2",
    "refetch_pages": V.with_views(E) + "SELECT id, depth FROM expressions WHERE http_status = 404",
    "unread_approved": V.with_views(E) + "SELECT id, relevance, depth FROM expressions WHERE approved_at IS NOT NULL AND http_status = 200 AND (id % 4 = 0 OR readable = '') ORDER BY relevance NULLS FIRST, id",
    "unread_fetched": V.with_views(E) + "SELECT id, relevance, depth FROM expressions WHERE crawled_at IS NOT NULL AND readable_at IS NULL",
    "verdict_worklist": V.with_views(E) + "SELECT id FROM expressions WHERE validllm IS NULL AND relevance > 0 AND length(readable) >= 500",
    "pair_previews": f"WITH {_PAIRS} SELECT source_id, target_id, left(a.text, 200) AS source_text, left(b.text, 200) AS target_text, coalesce(score_raw, score) AS score FROM pairs JOIN documents a ON a.doc_id = source_id JOIN documents b ON b.doc_id = target_id",
    "tagged_of_project": V.with_views(E, G) + "SELECT g.id, g.expression_id, g.tag_id FROM tagged g JOIN expressions e ON e.id = g.expression_id WHERE e.land_id = 2 AND tag_id = 107",
    "tagged_of_page": V.with_views(G) + "SELECT id, expression_id, tag_id FROM tagged WHERE expression_id = 5",
    "recent_domains": V.with_views(E, DM) + "SELECT id, name, CAST(DATE '2024-01-01' + CAST(id % 40 AS INT) AS VARCHAR) AS fetched_at FROM domains WHERE id % 5 <> 0 ORDER BY id % 40 DESC, id LIMIT 15",
    "user_search": f"WITH {_USERS} SELECT id, username, is_blocked FROM accounts WHERE username ILIKE '%customer%' AND is_blocked",
    "admin_counts": V.with_views(E, DM, _USERS) + "SELECT (SELECT count(*) FROM accounts) AS users, (SELECT count(*) FROM accounts WHERE is_active) AS active, (SELECT count(*) FROM accounts WHERE is_blocked) AS blocked, "
    "(SELECT count(DISTINCT land_id) FROM expressions) AS lands, (SELECT count(*) FROM expressions) AS pages, (SELECT count(*) FROM domains) AS domains",
    "first_pairs": f"WITH {_PAIRS} SELECT source_id, target_id FROM pairs ORDER BY 1, 2 LIMIT 50",
    "paragraph_profile": V.with_views(P, _PROFILED) + """, h AS (SELECT expression_id, lang, count(*) AS n FROM profiled GROUP BY 1, 2), r AS (SELECT expression_id, provider, count(*) AS n FROM profiled GROUP BY 1, 2)
      SELECT expression_id, count(*) AS paragraphs, count(*) FILTER (WHERE len(embedding) > 0) AS embedded, round(avg(n_words), 4) AS avg_words, sum(n_words)::BIGINT AS words, min(n_words) AS min_words, max(n_words) AS max_words,
      (SELECT string_agg(lang || '=' || n, ',' ORDER BY lang) FROM h WHERE h.expression_id = p.expression_id AND lang IS NOT NULL) AS languages,
      (SELECT string_agg(provider || '=' || n, ',' ORDER BY provider) FROM r WHERE r.expression_id = p.expression_id) AS providers FROM profiled p GROUP BY 1""",
    "paragraph_summary": V.with_views(E, P, _PROFILED) + """SELECT e.land_id, count(DISTINCT e.id) AS pages, count(DISTINCT p.expression_id) AS pages_with_paragraphs, coalesce(sum(n_words), 0)::BIGINT AS words,
      coalesce(round(count(p.id) / nullif(count(DISTINCT p.expression_id), 0), 4), 0) AS paragraphs_a_page, coalesce(round(sum(n_words) / nullif(count(DISTINCT p.expression_id), 0), 4), 0) AS words_a_page
      FROM expressions e LEFT JOIN profiled p ON p.expression_id = e.id GROUP BY 1""",
    "page_timeline": V.with_views(E) + "SELECT created_at AS day, count(*) AS created, count(crawled_at) AS crawled, count(approved_at) AS approved FROM expressions GROUP BY 1 ORDER BY 1 DESC LIMIT 10",
    "project_health": V.with_views(E) + "SELECT land_id, count(*) FILTER (WHERE approved_at IS NOT NULL AND relevance = 0) AS wrong, CASE WHEN land_id = 1 THEN 2 ELSE 0 END AS terms, land_id = 1 AND count(*) FILTER (WHERE approved_at IS NOT NULL AND relevance = 0) = 0 AS healthy FROM expressions GROUP BY 1",
    "sources_with_total": V.with_views(E, DM) + ", c AS (SELECT k.s AS source_method, count(d.id) AS n FROM (VALUES ('crawl'), ('archive'), ('direct'), ('manual')) k(s) LEFT JOIN domains d ON d.source_method = k.s GROUP BY 1) SELECT * FROM c UNION ALL SELECT 'total', sum(n)::BIGINT FROM c",
    "run_statistics": V.with_views(E) + "SELECT http_status, count(*) AS processed, count(*) FILTER (WHERE http_status >= 400 OR http_status = 0) AS errors FROM expressions WHERE crawled_at IS NOT NULL GROUP BY 1",
    "remaining_work": V.with_views(E, P) + "SELECT land_id, count(*) FILTER (WHERE crawled_at IS NULL) AS to_crawl, (SELECT count(*) FROM paragraphs p JOIN expressions x ON x.id = p.expression_id WHERE x.land_id = e.land_id) AS paragraphs, "
    "(SELECT count(*) FROM paragraphs p JOIN expressions x ON x.id = p.expression_id WHERE x.land_id = e.land_id AND len(embedding) > 0) AS vectors FROM expressions e GROUP BY 1",
    "home_pages": V.with_views(E, DM, _ATTEMPTS) + "SELECT f.domain, (SELECT tier FROM tiers t WHERE t.k = f.k) AS source_method, (SELECT content FROM attempts a WHERE a.domain = f.domain AND a.k = f.k) AS content, "
    "coalesce(f.k, 3)::INT AS retry_count, (SELECT sum(duration) FROM attempts a WHERE a.domain = f.domain AND a.k <= coalesce(f.k, 2))::BIGINT AS duration FROM firsts f",
    "seed_pages": V.with_views(E) + "SELECT DISTINCT 2 AS land_id, 'https://start.example.org/2' AS url, 0 AS depth FROM expressions",
    "merged_lists": V.with_views(E, _LANDS) + "SELECT l.land_id, array_to_string(l.start_urls, ' ') || CASE WHEN list_contains(l.start_urls, e.url) THEN '' ELSE ' ' || e.url END || ' https://more.example.org/' AS start_urls FROM lands l JOIN expressions e ON e.land_id = l.land_id AND e.id < 2",
    "project_languages": V.with_views(E) + "SELECT id, CASE WHEN id % 3 = 0 THEN 'fr+en' WHEN id % 3 = 1 THEN lang ELSE '' END AS languages FROM expressions",
    "simple_dates": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d 00:00:00') WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events",
    "search_ranges": V.with_views(E) + "SELECT id, 'cdr:1,cd_min:' || strftime(created_at, '%m/%d/%Y') || ',cd_max:' || strftime(created_at + 6, '%m/%d/%Y') AS range FROM expressions",
    "unit_vectors": V.with_views(P) + "SELECT id, CASE WHEN n = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS norm, round(embedding[1]::DOUBLE / CASE WHEN n = 0 THEN 1 ELSE n END, 9) AS first FROM (SELECT *, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM paragraphs)",
    "hashed_embeddings": "WITH c AS (SELECT doc_id, (unicode(unnest(regexp_extract_all(lower(text), '[\\s\\S]'))) * 39 % 64)::INT AS bin FROM documents), b AS (SELECT doc_id, bin, count(*) AS n FROM c GROUP BY 1, 2), "
    "t AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM b GROUP BY 1) SELECT b.doc_id, bin, round(n / len, 9) AS v FROM b JOIN t ON t.doc_id = b.doc_id",
}
