"""What a page goes through once it is fetched, as one plan of column expressions; and its links and media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom import views as V
from webloom.functions import html as H
from webloom.functions import text as X
from webloom.functions import url as U
from webloom.functions.dates import simple_date
from webloom.functions.quality import relevance, with_quality
from webloom.functions.stem import lemma_keywords, lemmas
from webloom.functions.quality import relevance_of
from webloom.session import spread, table

#: A small example lexicon of polarities.
LEXICON = {"good": 0.7, "bad": -0.7, "bon": 0.7, "mal": -0.6, "the": 0.15, "der": -0.2, "que": 0.3}


def extracted(pages: DataFrame) -> DataFrame:
    """Fetched pages (url, html) plus what the page says of itself, its text, and the text's measures.

    A page without a title is called after its host; the text comes from the first source that gives enough.
    """
    h = F.col("html")
    said = pages.withColumns(
        {
            "title": F.coalesce(H.title(h), F.concat(F.lit("Content from "), U.authority(F.col("url")))),
            "description": H.description(h),
            "keywords": H.keywords(h),
            "lang": F.coalesce(H.language(h), F.lit("")),
            "canonical_url": H.canonical(h),
            "published_at": F.to_date(simple_date(H.published(h))),
            "readable": H.main_content(h),
            "content_length": F.length(h),
        }
    )
    text = F.col("readable")
    return said.withColumns({"word_count": X.word_count(text), "reading_time": X.reading_minutes(text), "reading_level": F.round(X.reading_level(text), 6)})


def crawled(pages: DataFrame, terms: list[tuple[str, float]], wanted: list[str], as_of: Column, lexicon: dict[str, float] | None = None) -> DataFrame:
    """The crawl step: extraction, measures, relevance, verdict, sentiment and quality of every page.

    ``pages`` may carry ``reply``, what a model said when asked (``functions.text.relevance_prompt``): a page that is
    refused has no relevance, as has one in a language that the project does not want.
    """
    found = extracted(pages)
    langs = F.lit(wanted) if wanted else F.array().cast("array<string>")
    foreign = (F.col("lang") != "") & (F.size(langs) > 0) & ~F.array_contains(langs, F.col("lang"))
    verdict = F.when(F.col("reply").isNotNull(), F.when(X.yes_no(F.col("reply")), "oui").otherwise("non")) if "reply" in pages.columns else F.lit(None).cast("string")
    found = found.withColumn("validllm", verdict)
    score = relevance(F.col("title"), F.col("readable"), terms, F.col("lang"))
    found = found.withColumn("relevance", F.when(foreign | (F.coalesce(F.col("validllm"), F.lit("")) == "non"), 0.0).otherwise(score))
    found = found.withColumn("sentiment", X.sentiment(X.lexicon_polarity(X.cut_at_sentence(F.col("readable")), lexicon or LEXICON)))
    return with_quality(found, langs, as_of)


def links_of(pages: DataFrame) -> DataFrame:
    """Links of fetched pages that lead to pages: absolute, without tracking parameters, once a page, never to itself."""
    each = pages.select("id", "url", F.explode(H.link_list(F.col("html"), F.col("url"))).alias("l"))
    target = U.cleaned(F.col("l.url"))
    rows = each.select("id", "url", target.alias("target"), F.col("l.anchor").alias("anchor"), F.col("l.link_type").alias("link_type"))
    return rows.where(U.is_page(F.col("target")) & (F.col("target") != F.col("url"))).groupBy("id", "target", "link_type").agg(F.min("anchor").alias("anchor"))


def media_of(pages: DataFrame, text: str = "html") -> DataFrame:
    """Media of pages: absolute, behind no proxy, without tracking parameters, once a page."""
    each = pages.select("id", F.explode(H.media_table(F.col(text), F.col("url"))).alias("m"))
    rows = each.select("id", U.media_cleaned(U.unproxied(F.col("m.url"))).alias("url"), "m.alt", "m.title", "m.type")
    return rows.where("url IS NOT NULL").groupBy("id", "url").agg(F.min("type").alias("type"), F.min("alt").alias("alt"), F.min("title").alias("title"))


def recomputed(pages: DataFrame, terms: list[tuple[str, float]]) -> DataFrame:
    """The relevance of pages after a change of the dictionary; pages that a model refused keep none."""
    score = relevance(F.col("title"), F.col("readable"), terms, F.col("lang"))
    return pages.withColumn("relevance", F.when(F.coalesce(F.col("validllm"), F.lit("")) == "non", 0.0).otherwise(score))


def stem_relevance(pages: DataFrame, terms: list[tuple[str, float]]) -> DataFrame:
    """Relevance by stems: words of title and text against the stems of the terms, which the caller gives."""
    lang = F.col("lang")
    score = relevance_of(lemma_keywords(F.col("title"), lang, 20), lemma_keywords(F.col("readable"), lang, 50), terms, lang)
    return pages.select("id", score.alias("relevance"))


def _pages(s, d):
    p = spread(table(s, d, "pages"))
    reply = F.when(F.col("page_id") % 7 == 0, "Oui, elle l'est.").when(F.col("page_id") % 7 == 1, "non")
    return p.select(F.col("page_id").alias("id"), "url", "html", F.lit("200").alias("http_status"), F.lit("2024-03-01").cast("date").alias("crawled_at"), reply.alias("reply"))


def _marked(s, d):
    """Pages as Markdown with links, images and markers, made from the links of their menus."""
    p = table(s, d, "pages")
    menu = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">[^<]*</a>'), F.lit(1))
    link = lambda u, i: F.when(i % 3 == 0, F.concat(F.lit("[A "), i.cast("string"), F.lit("]("), u, F.lit(' "T"')  , F.lit(")"))).when(i % 3 == 1, F.concat(F.lit("!["), F.lit("](img"), u, F.lit(".png?ref=1&w=2)"))).otherwise(F.concat(F.lit('<a href="..'), u, F.lit('?utm_source=x&q=1#top"><b>B</b></a>')))
    return p.select(F.col("page_id").alias("id"), "url", F.array_join(F.transform(menu, link), " ").alias("md"))


def _crawled(s, d):
    return crawled(_pages(s, d), V.DICTIONARY, ["en", "fr"], F.lit("2025-06-01").cast("date"))


_STOP = lambda words: ", ".join(f"'{w}'" for w in words)
#: The references that the pages hold, decoded.
_DECODED = lambda c: f"replace(replace(replace(replace(replace(replace({c}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_STRINGS = lambda c: f"list_filter(list_transform(regexp_split_to_array({c}, '(?s)<!--.*?-->|<[^>]*>'), lambda t: trim({_DECODED('t')}, {_TRIM})), lambda t: t <> '')"


#: The paragraphs of an article; where one is left open, it is the first, and goes on to the end.
_PARAGRAPHS = lambda c: f"list_concat(CASE WHEN len(regexp_extract_all({c}, '<p>')) > len(regexp_extract_all({c}, '</p>')) THEN [regexp_extract({c}, '(?s)<p>(.*)', 1)] ELSE [] END, regexp_extract_all(CASE WHEN len(regexp_extract_all({c}, '<p>')) > len(regexp_extract_all({c}, '</p>')) THEN regexp_extract({c}, '(?s)<p>(.*)', 1) ELSE {c} END, '(?s)<p>(.*?)</p>', 1))"


def _bare(c: str, tags=("script", "style", "nav", "footer", "aside")) -> str:
    for tag in tags:
        c = f"regexp_replace({c}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '<x>', 'g')"
    return c


_TOKENS = "regexp_extract_all(lower({0}), '([a-zà-öø-ÿ]+)', 1)"
_TERMS = "(VALUES " + ", ".join(f"('{t}', {w}::DOUBLE)" for t, w in V.DICTIONARY) + ") d(term, w)"
_POLAR = "(VALUES " + ", ".join(f"('{t}', {w}::DOUBLE)" for t, w in LEXICON.items()) + ") x(term, p)"
STEP = f"""src AS (SELECT page_id AS id, url, html, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS t0, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
   array_to_string({_STRINGS("regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)")}, chr(10)) AS art, array_to_string({_STRINGS(_bare("html"))}, chr(10)) AS body,
   array_to_string(list_filter(list_transform({_PARAGRAPHS("regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)")}, lambda p: array_to_string({_STRINGS("p")}, '')), lambda p: length(p) > 50), chr(10) || chr(10)) AS par,
   CASE page_id % 7 WHEN 0 THEN 'oui' WHEN 1 THEN 'non' END AS validllm FROM pages),
 txt AS (SELECT id, url, lang, validllm, coalesce(t0, 'Content from ' || regexp_extract(url, '^https?://([^/?#]*)', 1)) AS title, CASE WHEN length(art) > 200 THEN art WHEN length(par) > 100 THEN par ELSE body END AS readable, length(art) > 200 OR length(par) > 100 AS smart, length(body) AS plain FROM src),
 kw AS (SELECT id, lang, 0 AS part, unnest({_TOKENS.format('title')}) AS word, generate_subscripts({_TOKENS.format('title')}, 1) AS pos, 20 AS most FROM txt
   UNION ALL SELECT id, lang, 1, unnest({_TOKENS.format('readable')}), generate_subscripts({_TOKENS.format('readable')}, 1), 50 FROM txt),
 fw AS (SELECT id, lang, part, most, word, row_number() OVER (PARTITION BY id, part ORDER BY min(pos)) AS n FROM kw
   WHERE length(word) >= 3 AND NOT (lang = 'fr' AND word IN ({_STOP(X.STOP_FR)})) AND NOT (lang = 'en' AND word IN ({_STOP(X.STOP_EN)})) GROUP BY 1, 2, 3, 4, 5),
 hit AS (SELECT id, lang, word, min(part) AS part, any_value(w) AS w FROM fw JOIN {_TERMS} ON d.term = fw.word WHERE n <= most GROUP BY 1, 2, 3),
 rel AS (SELECT id, round((sum(CASE WHEN part = 0 THEN 10 * w ELSE w END) + CASE WHEN count(*) > 1 THEN 0.5 * count(*) ELSE 0 END) * CASE WHEN any_value(lang) = 'fr' THEN 1.1 ELSE 1.0 END::DOUBLE, 2) AS score FROM hit GROUP BY id),
 head AS (SELECT id, CASE WHEN length(readable) <= 2000 THEN readable ELSE CASE WHEN strpos(left(readable, 2000), '.') > 0 AND 2000 - strpos(reverse(left(readable, 2000)), '.') > 1600
   THEN left(readable, 2001 - strpos(reverse(left(readable, 2000)), '.')) ELSE left(readable, 2000) END END AS h FROM txt),
 pol AS (SELECT id, greatest(-1, least(1, avg(p))) AS p FROM (SELECT id, unnest({_TOKENS.format('h')}) AS word FROM head) JOIN {_POLAR} ON x.term = word GROUP BY 1),
 step AS (SELECT t.id, title, t.lang, readable, smart, plain, validllm, len(list_filter(string_split_regex(readable, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))::INT AS word_count,
   CASE WHEN t.lang NOT IN ('', 'en', 'fr') OR validllm = 'non' THEN 0.0 ELSE coalesce(score, 0) END::DOUBLE AS relevance,
   round(coalesce(p, 0), 3) AS polarity, CASE WHEN p > 0.1 THEN 'positive' WHEN p < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment
   FROM txt t LEFT JOIN rel ON rel.id = t.id LEFT JOIN pol ON pol.id = t.id)"""
_MD = """md AS (SELECT page_id AS id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root,
 regexp_extract(url, '^(https?://[^/?#]*)', 1) || rtrim(regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), '[^/]+/$', ''), '/') AS up, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS u,
 generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1), 1) - 1 AS i FROM pages)"""
QUERIES = {
    "crawl_step": lambda s, d: _crawled(s, d).select("id", "title", "lang", "word_count", "validllm", "relevance", F.col("sentiment.label").alias("sentiment"), F.round("sentiment.score", 3).alias("polarity")),
    "crawl_flags": lambda s, d: _crawled(s, d).select("id", F.array_join("quality_flags", ",").alias("flags")),
    "crawl_texts": lambda s, d: _crawled(s, d).select("id", "readable"),
    "markdown_link_list": lambda s, d: _marked(s, d).select("id", F.explode(H.link_list(F.col("md"), F.col("url"))).alias("l")).select("id", "l.url", "l.anchor", "l.title", "l.link_type"),
    "markdown_media": lambda s, d: media_of(_marked(s, d), "md"),
    "crawl_links": lambda s, d: links_of(_marked(s, d).withColumnRenamed("md", "html")).select("id", "target", "link_type"),
    "enriched_markdown": lambda s, d: _enriched(s, d),
    "page_media": lambda s, d: _marked(s, d).select("id", F.explode(H.page_media(F.col("md"), F.col("url"))).alias("m")).select("id", "m.url", "m.type"),
    "parenthesised_links": lambda s, d: table(s, d, "pages").select("page_id", F.posexplode(H.parenthesised_links(F.concat(F.lit("see ("), "url", F.lit(") or (ftp://h.org/?) and ("), "url", F.lit("(x)y) end")))).alias("position", "link")),
    "bare_links": lambda s, d: _marked(s, d).select("id", F.posexplode(H.bare_markdown_links(F.col("md"))).alias("position", "link")),
    "allowed_media": lambda s, d: V.media(s, d).select("id", U.has_extension(F.concat("url", F.lit("?a=.png")), (".mp4", ".mp3")).alias("allowed"), U.media_type(F.col("url")).alias("media_type")),
    "proxied_media": lambda s, d: V.media(s, d).select("id", U.unproxied(F.concat(F.lit("https://i1.wp.com/"), F.regexp_replace("url", "^https://", ""), F.lit("?ssl=1&w=3"))).alias("url"), U.media_cleaned(F.concat("url", F.lit("?utm_source=a&w=3#x"))).alias("clean")),
    "recomputed_relevance": lambda s, d: recomputed(V.expressions(s, d), V.DICTIONARY[:4]).select("id", "relevance"),
    "stem_relevance": lambda s, d: stem_relevance(V.expressions(s, d), V.DICTIONARY),
    "word_stems": lambda s, d: V.expressions(s, d).select("lang", F.explode(X.tokens(F.col("readable"))).alias("word")).distinct().select("lang", "word", lemmas(F.array("word"), F.col("lang"))[0].alias("stem")),
    "page_dates": lambda s, d: _dated(s, d),
    "content_sources": lambda s, d: _sources(s, d),
    "marked_lines": lambda s, d: table(s, d, "pages").select("page_id", H.marked_lines(F.concat(F.col("html"), F.lit('<img src="/a.png">'))).alias("lines")),
    "smart_content": lambda s, d: table(s, d, "pages").select("page_id", H.main_content(F.col("html")).alias("text")),
}


def _enriched(s, d):
    extra = F.lit('<p><img class="x" src="/pic.png"><video src="v.mp4"></video><audio src="https://a.example/s.mp3"></audio></p>')
    made = H.enriched(F.col("md"), extra, F.col("url"))
    e = _marked(s, d).select("id", made["markdown"].alias("m"), made["media"].alias("media"))
    return e.select("id", F.regexp_extract("m", r"(?s)\n\n(.*)$", 1).alias("marker_lines"), F.size("media").alias("n_media"))


def _dated(s, d):
    """Dates of pages that give one in one of the places where they may."""
    tags = [f'<meta {k}="{n}" content="2024-0{i + 1}-03">' for i, (k, n) in enumerate([("property", "article:published_time"), ("itemprop", "datePublished"), ("name", "dc.date"), ("name", "date"), ("name", "published_time")])]
    n = F.col("page_id")
    head = F.concat(*[F.when(n % (k + 2) == 0, F.lit(t)).otherwise(F.lit("")) for k, t in reversed(list(enumerate(tags)))])
    return table(s, d, "pages").select("page_id", H.published(F.concat(F.lit("<head>"), head, F.lit("</head>"), "html")).alias("published"), H.keywords(F.concat(F.lit('<meta content="a, b" name="keywords">'), "html")).alias("keywords"))


def _sources(s, d):
    n = F.col("page_id")
    given = F.when(n % 3 == 0, F.repeat(F.lit("x"), 120))
    archived = F.when(n % 4 == 0, F.repeat(F.lit("y"), 100)).otherwise("short")
    return table(s, d, "pages").select("page_id", H.content_source(F.col("html"), given, archived).alias("source"))


_ABS = "CASE WHEN i % 3 = 0 THEN root || u WHEN i % 3 = 2 THEN up || u || '?utm_source=x&q=1#top' END"
ORACLES = {
    "crawl_step": V.with_views(STEP) + "SELECT id, title, lang, word_count, validllm, relevance, sentiment, polarity FROM step",
    "crawl_texts": V.with_views(STEP) + "SELECT id, readable FROM step",
    "crawl_flags": V.with_views(STEP) + """SELECT s.id, array_to_string(list_filter(['no_description', 'no_keywords', 'no_canonical',
      CASE WHEN word_count = 0 THEN 'no_content' WHEN word_count < 80 THEN 'very_short_content' WHEN word_count < 150 THEN 'short_content' WHEN word_count > 10000 THEN 'very_long_content' END,
      CASE WHEN word_count > 0 THEN CASE WHEN word_count / length(html) < 0.05 THEN 'poor_text_ratio' WHEN word_count / length(html) < 0.1 THEN 'low_text_ratio' END END,
      CASE WHEN word_count // 200 > 25 THEN 'very_long_reading' END,
      CASE WHEN lang = '' THEN 'no_language' WHEN lang NOT IN ('en', 'fr') THEN 'wrong_language' END,
      CASE WHEN relevance < 0.5 THEN 'low_relevance' END, CASE WHEN validllm = 'non' THEN 'llm_rejected' END, 'no_readable', 'not_approved'], lambda f: f IS NOT NULL), ',') AS flags
      FROM step s JOIN pages p ON p.page_id = s.id""",
    "markdown_link_list": f"WITH {_MD}, l AS (SELECT id, i, root, {_ABS} AS url, CASE WHEN i % 3 = 0 THEN 'A ' || i ELSE 'B' END AS anchor, CASE WHEN i % 3 = 0 THEN 'T' END AS title FROM md WHERE i % 3 <> 1) "
    "SELECT id, url, arg_min(anchor, CASE WHEN title IS NULL THEN 1000000 + i ELSE i END) AS anchor, max(title) AS title, 'internal' AS link_type FROM l GROUP BY 1, 2",
    "markdown_media": f"WITH {_MD} SELECT DISTINCT id, regexp_replace(url, '[^/]*$', '') || 'img' || u || '.png?w=2' AS url, 'img' AS type, NULL AS alt, NULL AS title FROM md WHERE i % 3 = 1",
    "crawl_links": f"WITH {_MD} SELECT DISTINCT id, CASE WHEN i % 3 = 2 THEN up || u || '?q=1' ELSE root || u END AS target, 'internal' AS link_type FROM md WHERE i % 3 <> 1 AND CASE WHEN i % 3 = 2 THEN up || u || '?q=1' ELSE root || u END <> url",
    "enriched_markdown": f"WITH {_MD} SELECT p.page_id AS id, '![IMAGE](' || regexp_extract(p.url, '^(https?://[^/?#]*)', 1) || '/pic.png)' || chr(10) || '[VIDEO: ' || regexp_replace(p.url, '[^/]*$', '') || 'v.mp4]' || chr(10) || '[AUDIO: https://a.example/s.mp3]' AS marker_lines, "
    "(3 + (SELECT count(DISTINCT u) FROM md WHERE md.id = p.page_id AND i % 3 = 1))::INT AS n_media FROM pages p",
    "page_media": f"WITH {_MD} SELECT DISTINCT id, regexp_replace(url, '[^/]*$', '') || 'img' || u || '.png?ref=1&w=2' AS url, 'img' AS type FROM md WHERE i % 3 = 1",
    "parenthesised_links": "SELECT page_id, unnest([0, 1, 2]) AS position, unnest([url, 'ftp://h.org/?', url || '(x)y']) AS link FROM pages",
    "bare_links": f"WITH {_MD} SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS position, CASE WHEN i % 3 = 0 THEN u || ' \"T\"' ELSE 'img' || u || '.png?ref=1&w=2' END AS link FROM md WHERE i % 3 <> 2",
    "allowed_media": V.with_views(V.MEDIA) + "SELECT id, id % 5 < 2 AS allowed, type AS media_type FROM media",
    "proxied_media": V.with_views(V.MEDIA) + "SELECT id, url || '?w=3' AS url, url || '?w=3' AS clean FROM media",
    "recomputed_relevance": V.with_views(V.EXPRESSIONS) + f""", kw AS (SELECT id, lang, 0 AS part, unnest({_TOKENS.format('title')}) AS word, generate_subscripts({_TOKENS.format('title')}, 1) AS pos, 20 AS most FROM expressions
      UNION ALL SELECT id, lang, 1, unnest({_TOKENS.format('readable')}), generate_subscripts({_TOKENS.format('readable')}, 1), 50 FROM expressions),
      fw AS (SELECT id, lang, part, most, word, row_number() OVER (PARTITION BY id, part ORDER BY min(pos)) AS n FROM kw
        WHERE length(word) >= 3 AND NOT (lang = 'fr' AND word IN ({_STOP(X.STOP_FR)})) AND NOT (lang = 'en' AND word IN ({_STOP(X.STOP_EN)})) GROUP BY 1, 2, 3, 4, 5),
      hit AS (SELECT id, lang, word, min(part) AS part, any_value(w) AS w FROM fw JOIN (VALUES {", ".join(f"('{t}', {w}::DOUBLE)" for t, w in V.DICTIONARY[:4])}) d(term, w) ON d.term = fw.word WHERE n <= most GROUP BY 1, 2, 3),
      rel AS (SELECT id, round((sum(CASE WHEN part = 0 THEN 10 * w ELSE w END) + CASE WHEN count(*) > 1 THEN 0.5 * count(*) ELSE 0 END) * CASE WHEN any_value(lang) = 'fr' THEN 1.1 ELSE 1.0 END::DOUBLE, 2) AS score FROM hit GROUP BY id)
      SELECT e.id, CASE WHEN validllm = 'non' THEN 0.0 ELSE coalesce(score, 0) END::DOUBLE AS relevance FROM expressions e LEFT JOIN rel ON rel.id = e.id""",
    "page_dates": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '2024-01-03' WHEN page_id % 3 = 0 THEN '2024-02-03' WHEN page_id % 4 = 0 THEN '2024-03-03' WHEN page_id % 5 = 0 THEN '2024-04-03' WHEN page_id % 6 = 0 THEN '2024-05-03' END AS published, 'a, b' AS keywords FROM pages",
    "content_sources": V.with_views(STEP) + f"SELECT s.id AS page_id, CASE WHEN s.id % 3 = 0 THEN 'extractor' WHEN s.id % 4 = 0 THEN 'archive' WHEN smart THEN 'smart' WHEN plain >= 100 THEN 'plain' ELSE 'none' END AS source FROM step s JOIN pages p ON p.page_id = s.id",
    "marked_lines": "SELECT page_id, array_to_string(list_filter(list_transform(string_split(array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace("
    + _bare("(html || '<img src=\"/a.png\">')", ("script", "style", "iframe", "form", "footer", "nav"))
    + f""", '(?i)<img\\b[^>]*?\\ssrc=["'']([^"'']+)["''][^>]*>', '<x>[IMAGE: \\1]<x>', 'g'), '(?s)<!--.*?-->|<[^>]*>'), lambda t: t <> ''), lambda t: {_DECODED('t')}), ' '), chr(10)),
      lambda t: trim(t, {_TRIM})), lambda t: t <> ''), chr(10)) AS lines FROM pages""",
    "smart_content": V.with_views(STEP) + "SELECT id AS page_id, readable AS text FROM step",
}
