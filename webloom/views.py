"""The web-corpus model as views over the generated tables.

The generated pages carry a URL and HTML only; the lifecycle columns that a crawl would add (status, depth,
relevance, time stamps) are fixed functions of the page number, so that every query has a checkable answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import dealt, spread, table

FIRST_DAY = "2024-01-01"


def expressions(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    """Pages: one row per crawled page of two projects (``land_id`` 1 and 2).

    ``even`` deals a small table out over all cores (``session.spread``), for queries that compute much from each page.
    """
    p = table(spark, sf_dir, "pages")
    p = spread(p) if even else p
    n = F.col("page_id")
    day = lambda k: F.date_add(F.lit(FIRST_DAY).cast("date"), (n % k).cast("int"))
    crawled = F.when(n % 11 != 0, day(30))
    return p.select(
        n.alias("id"),
        (1 + n % 2).alias("land_id"),
        "url",
        "html",
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("domain_name"),
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("lang"),
        F.length("html").alias("content_length"),
        F.btrim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \n\t\r]+", " ")).alias("readable"),
        (n % 4).cast("int").alias("depth"),
        F.when(n % 17 == 0, 404).when(n % 19 == 0, 301).otherwise(200).alias("http_status"),
        F.when(n % 13 != 0, ((n * 7) % 100) / F.lit(10.0)).alias("relevance"),
        day(30).alias("created_at"),
        crawled.alias("crawled_at"),
        F.when(crawled.isNotNull() & (n % 5 != 0), day(30)).alias("readable_at"),
        F.when(crawled.isNotNull() & (n % 3 == 0), day(30)).alias("approved_at"),
        F.when(n % 7 == 0, "oui").when(n % 7 == 1, "non").alias("validllm"),
    )


EXPRESSIONS = """expressions AS (
  SELECT page_id AS id, 1 + page_id % 2 AS land_id, url, html,
         regexp_extract(url, '^https?://([^/?#]+)', 1) AS domain_name,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
         length(html) AS content_length,
         trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\n\\t\\r]+', ' ', 'g')) AS readable,
         CAST(page_id % 4 AS INT) AS depth,
         CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 19 = 0 THEN 301 ELSE 200 END AS http_status,
         CASE WHEN page_id % 13 <> 0 THEN ((page_id * 7) % 100) / 10.0::DOUBLE END AS relevance,
         DATE '2024-01-01' + CAST(page_id % 30 AS INT) AS created_at,
         CASE WHEN page_id % 11 <> 0 THEN DATE '2024-01-01' + CAST(page_id % 30 AS INT) END AS crawled_at,
         CASE WHEN page_id % 11 <> 0 AND page_id % 5 <> 0 THEN DATE '2024-01-01' + CAST(page_id % 30 AS INT) END AS readable_at,
         CASE WHEN page_id % 11 <> 0 AND page_id % 3 = 0 THEN DATE '2024-01-01' + CAST(page_id % 30 AS INT) END AS approved_at,
         CASE WHEN page_id % 7 = 0 THEN 'oui' WHEN page_id % 7 = 1 THEN 'non' END AS validllm
  FROM pages)"""


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, numbered by the smallest page that they serve; the status is text, as the model has it."""
    e = expressions(spark, sf_dir)
    found = e.groupBy("domain_name").agg(F.min("id").alias("id"))
    return found.select(
        "id",
        F.col("domain_name").alias("name"),
        F.concat(F.lit("Site "), "domain_name").alias("description"),
        F.when(F.col("id") % 5 != 0, F.when(F.col("id") % 7 == 0, "ERR").otherwise((200 + F.col("id") % 3).cast("string"))).alias("http_status"),
        F.when(F.col("id") % 5 != 0, F.element_at(F.array(F.lit("crawl"), F.lit("archive"), F.lit("direct")), (F.col("id") % 3 + 1).cast("int"))).alias("source_method"),
    )


DOMAINS = """domains AS (
  SELECT min(id) AS id, domain_name AS name, 'Site ' || domain_name AS description,
         CASE WHEN min(id) % 5 <> 0 THEN CASE WHEN min(id) % 7 = 0 THEN 'ERR' ELSE CAST(200 + min(id) % 3 AS VARCHAR) END END AS http_status,
         CASE WHEN min(id) % 5 <> 0 THEN ['crawl','archive','direct'][CAST(min(id) % 3 + 1 AS INT)] END AS source_method
  FROM expressions GROUP BY domain_name)"""


def page_count(spark: SparkSession, sf_dir: str) -> int:
    """Pages are numbered from 0; other tables point at them by remainders, so that graphs grow with the data."""
    return max(1, table(spark, sf_dir, "pages").count())


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-to-page links: pages linked by order lines, at most once, never to themselves."""
    li, n = table(spark, sf_dir, "lineitem"), page_count(spark, sf_dir)
    pairs = li.select((F.col("l_orderkey") % n).alias("source_id"), (F.col("l_partkey") * 7 % n).alias("target_id"))
    return dealt(pairs.where(F.col("source_id") != F.col("target_id")), li.count(), "source_id", "target_id").distinct()


_PAGES = "(SELECT greatest(count(*), 1) FROM pages)"
LINKS = f"""links AS (
  SELECT DISTINCT l_orderkey % {_PAGES} AS source_id, l_partkey * 7 % {_PAGES} AS target_id FROM lineitem
  WHERE l_orderkey % {_PAGES} <> l_partkey * 7 % {_PAGES})"""


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media of pages, with sizes and formats from ``part``."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    return p.select(
        n.alias("id"),
        (n % page_count(spark, sf_dir)).alias("expression_id"),
        F.concat(F.lit("https://cdn.example.org/m/"), n.cast("string"), F.when(n % 5 == 0, ".mp4").when(n % 5 == 1, ".mp3").otherwise(".jpg")).alias("url"),
        F.when(n % 5 == 0, "video").when(n % 5 == 1, "audio").otherwise("img").alias("type"),
        F.when(n % 3 != 0, F.col("p_size") * 20).alias("width"),
        F.when(n % 3 != 0, F.col("p_size") * 10).alias("height"),
        F.round(F.col("p_retailprice") * 1000).cast("long").alias("file_size"),
    )


MEDIA = f"""media AS (
  SELECT p_partkey AS id, p_partkey % {_PAGES} AS expression_id,
         'https://cdn.example.org/m/' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '.mp4' WHEN p_partkey % 5 = 1 THEN '.mp3' ELSE '.jpg' END AS url,
         CASE WHEN p_partkey % 5 = 0 THEN 'video' WHEN p_partkey % 5 = 1 THEN 'audio' ELSE 'img' END AS type,
         CASE WHEN p_partkey % 3 <> 0 THEN p_size * 20 END AS width,
         CASE WHEN p_partkey % 3 <> 0 THEN p_size * 10 END AS height,
         CAST(round(p_retailprice * 1000) AS BIGINT) AS file_size
  FROM part)"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag tree: regions, with their nations below them."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = r.select(F.col("r_regionkey").alias("id"), F.lit(None).cast("int").alias("parent_id"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("sorting"))
    low = n.select((100 + F.col("n_nationkey")).alias("id"), F.col("n_regionkey").alias("parent_id"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 7).alias("sorting"))
    return top.union(low)


TAGS = """tags AS (
  SELECT r_regionkey AS id, CAST(NULL AS INT) AS parent_id, r_name AS name, r_regionkey AS sorting FROM region
  UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name, n_nationkey % 7 FROM nation)"""


def tagged_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages tagged by hand: one per order."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderkey") % page_count(spark, sf_dir)).alias("expression_id"),
        (100 + F.col("o_custkey") % 25).cast("int").alias("tag_id"),
        (F.col("o_orderkey") % 40).cast("int").alias("from_char"),
        (F.col("o_orderkey") % 40 + 60).cast("int").alias("to_char"),
    )


TAGGED = f"""tagged AS (
  SELECT o_orderkey AS id, o_orderkey % {_PAGES} AS expression_id, CAST(100 + o_custkey % 25 AS INT) AS tag_id,
         CAST(o_orderkey % 40 AS INT) AS from_char, CAST(o_orderkey % 40 + 60 AS INT) AS to_char FROM orders)"""


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded paragraphs: ten pages of each project's embedding labels."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("id"), (F.col("label") * 5 + F.col("vec_id") % 5).cast("long").alias("expression_id"), "embedding")


PARAGRAPHS = "paragraphs AS (SELECT vec_id AS id, CAST(label * 5 + vec_id % 5 AS BIGINT) AS expression_id, embedding FROM embeddings)"

#: Terms of the example dictionary with their weights.
DICTIONARY = [("the", 1.0), ("und", 1.0), ("anthe", 2.0), ("thea", 0.5), ("eur", 1.5), ("ment", 1.0), ("que", 2.5), ("los", 1.0), ("der", 0.5), ("tion", 3.0)]


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionaries of the projects: terms of one, two and three words from the titles of their pages."""
    words = F.regexp_extract_all(F.lower("title"), F.lit("([a-zà-öø-ÿ]+)"), F.lit(1))
    pages = expressions(spark, sf_dir).select("id", "land_id", words.alias("w")).where("size(w) >= 4")
    terms = F.array(*[F.array_join(F.slice("w", a, n), " ") for a, n in ((1, 1), (1, 2), (2, 3))])
    each = pages.select("land_id", "id", F.posexplode(terms).alias("k", "term"))
    return each.select("land_id", "term", (1 + (F.col("id") % 4) / 2.0).alias("weight"), (F.col("id") * 3 + F.col("k")).alias("added"))


DICTIONARY_TABLE = """titled AS (SELECT id, land_id, regexp_extract_all(lower(title), '([a-zà-öø-ÿ]+)', 1) AS w FROM expressions), dictionary AS (
  SELECT land_id, unnest([w[1], w[1] || ' ' || w[2], w[2] || ' ' || w[3] || ' ' || w[4]]) AS term, 1 + (id % 4) / 2.0::DOUBLE AS weight, id * 3 + unnest([0, 1, 2]) AS added FROM titled WHERE len(w) >= 4)"""


def project_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(land_id, term, lang): the first words of the titles of a project's pages."""
    word = F.regexp_extract(F.lower("title"), "([a-zà-öø-ÿ]+)", 1).alias("term")
    return expressions(spark, sf_dir).select("land_id", word, "lang").where("term <> ''").distinct()


#: With the spellings of the terms: the endings are fixed values.
PROJECT_TERMS = """project_terms AS (SELECT DISTINCT land_id, regexp_extract(lower(title), '([a-zà-öø-ÿ]+)', 1) AS term, lang FROM expressions WHERE regexp_matches(lower(title), '[a-zà-öø-ÿ]')),
 spelled AS (SELECT land_id, lang, term || ending AS variation FROM project_terms
   JOIN (VALUES ('fr', ''), ('fr', 's'), ('fr', 'es'), ('fr', 'er'), ('fr', 'tion'), ('fr', 'eux'), ('fr', 'if'), ('en', ''), ('en', 's'), ('en', 'ies'), ('en', 'ed'), ('en', 'ing'), ('en', 'er'), ('en', 'est'), ('', '')) e(l, ending)
   ON e.l = CASE WHEN lang IN ('fr', 'en') THEN lang ELSE '' END WHERE length(term || ending) >= 2)"""


def with_views(*parts: str) -> str:
    """A WITH clause of the DuckDB views, in order."""
    return "WITH " + ", ".join(parts) + "\n"
