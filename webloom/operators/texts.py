"""Text measures over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom import views as V
from webloom.functions import html as H
from webloom.functions import text as X
from webloom.functions import url as U
from webloom.functions.quality import relevance, relevance_counted
from webloom.session import spread, table


def text_metrics(docs: DataFrame) -> DataFrame:
    """Words, characters, sentences, syllables and reading ease of each text; what they share is counted once."""
    t = F.col("text")
    counted = docs.select(
        "doc_id", X.word_count(t).alias("word_count"), F.length(X.strip(t)).alias("char_count"), X.sentence_count(t).alias("sentence_count"),
        F.regexp_count(t, F.lit(f"[{X.VOWELS}]+")).alias("_v"),
    )
    n, syllables = F.col("word_count"), F.greatest("_v", "word_count")
    score = 207 - 1.015 * (n / F.col("sentence_count")) - 84.6 * (syllables / n)
    return counted.select(
        "doc_id", "word_count", "char_count", "sentence_count", syllables.alias("syllables"),
        F.round(F.when(n >= 5, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))), 6).alias("reading_level"),
        F.when(n > 0, F.greatest(F.lit(1), F.floor(n / 200).cast("int"))).alias("reading_minutes"),
    )


def detected_languages(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.detect_language(F.col("text")).alias("detected"))


def frequent_words(docs: DataFrame, top: int = 10, shortest: int = 3) -> DataFrame:
    """Per document its commonest words; ties go to the word that comes first. All counting stays in the row.

    Tokens are sorted with their places, so that a word's places stand together and are counted as one run.
    """
    word = lambda w, i: F.struct(w.alias("word"), i.alias("first"))
    tokens = F.array_sort(F.filter(F.transform(X.tokens(F.col("text")), word), lambda t: F.length(t["word"]) >= shortest))
    each = docs.select("doc_id", tokens.alias("_t"))
    # where a run of equal words begins; the way to the next beginning is its count
    heads = F.filter(F.transform(F.col("_t"), lambda t, i: F.struct(i.alias("at"), t["word"].alias("word"), t["first"].alias("first"))), lambda t: (t["at"] == 0) | (F.get(F.col("_t"), t["at"] - 1)["word"] != t["word"]))
    each = each.select("doc_id", F.size("_t").alias("_n"), heads.alias("_h"))
    runs = F.transform(
        F.col("_h"), lambda h, i: F.struct((h["at"] - F.coalesce(F.get(F.col("_h"), i + 1)["at"], F.col("_n"))).alias("minus"), h["first"].alias("first"), h["word"].alias("word"))
    )
    best = each.select("doc_id", F.posexplode(F.slice(F.array_sort(runs), 1, top)).alias("rank", "_r"))
    return best.select("doc_id", (F.col("rank") + 1).alias("rank"), "_r.word", (-F.col("_r.minus")).cast("long").alias("n"))


def first_keywords(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.array_join(X.keywords(F.col("text"), 15), " ").alias("keywords"))


def slugs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.slug(F.col("text")).alias("slug"))


def line_paragraphs(docs: DataFrame, shortest: int = 50) -> DataFrame:
    """Lines as paragraphs with their position among the long ones; a text repeated within a document stays once.

    Positions keep the gaps that repeats leave.
    """
    lines = F.transform(F.split(F.col("text"), "\n"), lambda t: X.strip(F.regexp_replace(t, r"[ \t\n\r\f\x0B]+", " ")))
    kept = docs.select("doc_id", F.posexplode(F.filter(lines, lambda p: F.length(p) >= shortest)).alias("position", "_p"))
    hashed = kept.select("doc_id", "position", F.sha2("_p", 256).alias("text_hash"), F.length("_p").alias("n_chars"))
    return hashed.groupBy("doc_id", "text_hash").agg(F.min("position").alias("position"), F.min("n_chars").alias("n_chars"))


def title_similarity(pages: DataFrame) -> DataFrame:
    """How far the title's words are the text's first words."""
    return pages.select("id", F.round(X.similarity(F.col("title"), F.col("readable")), 6).alias("similarity"))


def page_relevance(pages: DataFrame) -> DataFrame:
    return pages.select("id", relevance(F.col("title"), F.col("readable"), V.DICTIONARY, F.col("lang")).alias("relevance"))


def page_relevance_counted(pages: DataFrame) -> DataFrame:
    return pages.select("id", relevance_counted(F.col("title"), F.col("readable"), [t for t, _ in V.DICTIONARY]).cast("long").alias("relevance"))


def page_links(pages: DataFrame) -> DataFrame:
    """Links found in HTML, resolved and typed, once per page."""
    each = pages.select("id", "url", F.explode(H.hrefs(F.col("html"))).alias("href"))
    full = each.select("id", "url", U.resolved(F.col("url"), F.col("href")).alias("target"))
    return full.select("id", "target", U.link_type(F.col("url"), F.col("target")).alias("link_type")).distinct()


def clean_urls(pages: DataFrame) -> DataFrame:
    u = F.col("url")
    return pages.select("id", U.cleaned(u).alias("clean"), U.without_fragment(u).alias("bare"), U.authority(u).alias("host"), U.url_hash(u).alias("hash"), U.is_page(u).alias("is_page"))


def metadata(pages: DataFrame) -> DataFrame:
    h = F.col("html")
    return pages.select("id", H.title(h).alias("title"), H.language(h).alias("lang"), H.description(h).alias("description"), H.canonical(h).alias("canonical"))


def markdown_link_table(pages: DataFrame) -> DataFrame:
    """Links of pages turned to Markdown."""
    md = F.regexp_replace("html", '<a href="([^"]*)">([^<]*)</a>', "[$2]($1)")
    return pages.select("id", F.posexplode(H.markdown_links(md)).alias("position", "_l")).select("id", "position", "_l.anchor", "_l.url")


def corpus_files(pages: DataFrame) -> DataFrame:
    """File name and Dublin Core header of each page of a text corpus."""
    name = F.concat(F.col("id").cast("string"), F.lit("-"), X.slug(F.col("title")), F.lit(".txt"))
    header = F.concat(F.lit('---\nTitle: "'), F.col("title"), F.lit('"\nIdentifier: "'), F.col("id").cast("string"), F.lit('"\nSource: "'), F.col("url"), F.lit('"\nLanguage: "'), X.export_value(F.col("lang")), F.lit('"\n---\n'))
    return pages.select("id", name.alias("file_name"), header.alias("header"))


E = V.EXPRESSIONS
_STRIP = r"trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_WORDS = r"list_filter(string_split_regex(" + _STRIP.format("text") + r", '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
_VOWELS = f"[{X.VOWELS}]+"
_TOKENS = "regexp_extract_all(lower({0}), '([a-zà-öø-ÿ]+)', 1)"
_first = lambda col, n: f"list_slice(list_filter({_TOKENS.format(col)}, lambda w, i: length(w) >= 3 AND list_position({_TOKENS.format(col)}, w) = i), 1, {n})"
_sql_list = lambda words: ", ".join(f"'{w}'" for w in words)
_WEIGHTS = "(VALUES " + ", ".join(f"('{t}', {w}::DOUBLE)" for t, w in V.DICTIONARY) + ") d(term, w)"
_slug = lambda c: f"substring(trim(regexp_replace(regexp_replace(lower(strip_accents({c})), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-'), 1, 50)"
QUERIES = {
    "text_metrics": lambda s, d: text_metrics(spread(table(s, d, "documents"))),
    "detected_languages": lambda s, d: detected_languages(table(s, d, "documents")),
    "frequent_words": lambda s, d: frequent_words(spread(table(s, d, "documents"))),
    "first_keywords": lambda s, d: first_keywords(table(s, d, "documents")),
    "slugs": lambda s, d: slugs(table(s, d, "documents")),
    "line_paragraphs": lambda s, d: line_paragraphs(table(s, d, "documents")),
    "title_similarity": lambda s, d: title_similarity(V.expressions(s, d)),
    "page_relevance": lambda s, d: page_relevance(V.expressions(s, d, even=True)),
    "page_relevance_counted": lambda s, d: page_relevance_counted(V.expressions(s, d)),
    "html_links": lambda s, d: page_links(V.expressions(s, d)),
    "clean_urls": lambda s, d: clean_urls(V.expressions(s, d)),
    "page_metadata": lambda s, d: metadata(V.expressions(s, d)),
    "markdown_links": lambda s, d: markdown_link_table(V.expressions(s, d)),
    "corpus_files": lambda s, d: corpus_files(V.expressions(s, d)),
}
_TRACK = ", ".join(f"'{t}'" for t in U.TRACKING)
_FR, _EN = (", ".join(f"'{w}'" for w in ws) for ws in (X.FRENCH, X.ENGLISH))
ORACLES = {
    "text_metrics": f"""WITH m AS (SELECT doc_id, len({_WORDS})::INT AS word_count, length({_STRIP.format('text')}) AS char_count,
      greatest(len(regexp_extract_all(text, '[.!?]+')), 1)::INT AS sentence_count, len(regexp_extract_all(text, '{_VOWELS}'))::INT AS v FROM documents)
      SELECT doc_id, word_count, char_count, sentence_count, greatest(v, word_count) AS syllables,
      round(CASE WHEN word_count >= 5 THEN greatest(0.0, least(100.0, 207 - 1.015::DOUBLE * (word_count / sentence_count) - 84.6::DOUBLE * (greatest(v, word_count) / word_count))) END, 6) AS reading_level,
      CASE WHEN word_count > 0 THEN greatest(1, word_count // 200) END AS reading_minutes FROM m""",
    "detected_languages": f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '([a-zA-Z{X.ACCENTS}{X.ACCENTS.upper()}]+)', 1) AS ws, length({_STRIP.format('text')}) AS n FROM documents),
      c AS (SELECT *, len(list_filter(ws, lambda x: x IN ({_FR}))) AS fr, len(list_filter(ws, lambda x: x IN ({_EN}))) AS en, len(regexp_extract_all(lower(text), '[{X.ACCENTS}]')) AS acc FROM w)
      SELECT doc_id, CASE WHEN n < 10 THEN NULL WHEN len(ws) < 3 THEN CASE WHEN n > 50 THEN 'en' END WHEN fr + en >= 2 AND fr > en THEN 'fr' WHEN fr + en >= 2 AND en > fr THEN 'en'
      WHEN acc > len(ws) * 0.02 THEN 'fr' WHEN n > 50 THEN 'en' END AS detected FROM c""",
    "frequent_words": f"""WITH t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS word, generate_subscripts({_TOKENS.format('text')}, 1) AS pos FROM documents),
      c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM t WHERE length(word) >= 3 GROUP BY 1, 2)
      SELECT doc_id, rank, word, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c) WHERE rank <= 10""",
    "first_keywords": f"""WITH t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS word, generate_subscripts({_TOKENS.format('text')}, 1) AS pos FROM documents),
      f AS (SELECT doc_id, word, min(pos) AS first FROM t WHERE length(word) >= 3 GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS k FROM f)
      SELECT d.doc_id, coalesce(string_agg(r.word, ' ' ORDER BY r.k), '') AS keywords FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND r.k <= 15 GROUP BY 1""",
    "slugs": f"""SELECT doc_id, CASE WHEN coalesce(s, '') = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT doc_id, {_slug('text')} AS s FROM documents)""",
    "line_paragraphs": r"""WITH k AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda t: trim(regexp_replace(t, '[ \t\n\r\f\x0B]+', ' ', 'g'),
        ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda p: length(p) >= 50) AS ps FROM documents), u AS (SELECT doc_id, ps, unnest(range(0, len(ps))) AS position FROM k)
      SELECT doc_id, sha256(ps[position + 1]) AS text_hash, min(position) AS position, min(length(ps[position + 1])) AS n_chars FROM u GROUP BY doc_id, ps[position + 1]""",
    "title_similarity": V.with_views(E) + f""", k AS (SELECT id, {_first('title', 50)} AS a, list_slice(list_distinct([1]), 1, 0) AS z FROM expressions),
      t AS (SELECT id, unnest({_TOKENS.format('readable')}) AS word, generate_subscripts({_TOKENS.format('readable')}, 1) AS pos FROM expressions),
      f AS (SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY min(pos)) AS n FROM t WHERE length(word) >= 3 GROUP BY 1, 2),
      b AS (SELECT id, list(word) AS b FROM f WHERE n <= 50 GROUP BY 1)
      SELECT k.id, round(CASE WHEN len(a) = 0 OR b IS NULL THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM k LEFT JOIN b ON b.id = k.id""",
    "page_relevance": V.with_views(E) + f""", src AS (SELECT id, lang, 0 AS part, title AS x, 20 AS most FROM expressions UNION ALL SELECT id, lang, 1, readable, 50 FROM expressions),
      t AS (SELECT id, lang, part, most, unnest({_TOKENS.format('x')}) AS word, generate_subscripts({_TOKENS.format('x')}, 1) AS pos FROM src),
      f AS (SELECT id, lang, part, most, word, row_number() OVER (PARTITION BY id, part ORDER BY min(pos)) AS n FROM t
        WHERE length(word) >= 3 AND NOT (lang = 'fr' AND word IN ({_sql_list(X.STOP_FR)})) AND NOT (lang = 'en' AND word IN ({_sql_list(X.STOP_EN)})) GROUP BY 1, 2, 3, 4, 5),
      h AS (SELECT id, lang, word, min(part) AS part, any_value(w) AS w FROM f JOIN {_WEIGHTS} ON d.term = f.word WHERE n <= most GROUP BY 1, 2, 3),
      s AS (SELECT id, (sum(CASE WHEN part = 0 THEN 10 * w ELSE w END) + CASE WHEN count(*) > 1 THEN 0.5 * count(*) ELSE 0 END) * CASE WHEN any_value(lang) = 'fr' THEN 1.1 ELSE 1.0 END::DOUBLE AS score FROM h GROUP BY id)
      SELECT e.id, coalesce(round(s.score, 2), 0) AS relevance FROM expressions e LEFT JOIN s ON s.id = e.id""",
    "page_relevance_counted": V.with_views(E)
    + "SELECT id, ("
    + " + ".join(
        f"{k} * len(list_filter(regexp_extract_all(lower({c}), '([a-zà-ÿ]+)', 1), lambda w: w = '{t}'))" for t, _ in V.DICTIONARY for c, k in (("title", 10), ("readable", 1))
    )
    + ")::BIGINT AS relevance FROM expressions",
    "html_links": V.with_views(E) + """, h AS (SELECT id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM expressions)
      SELECT DISTINCT id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS target, 'internal' AS link_type FROM h""",
    "clean_urls": V.with_views(E) + f""", u AS (SELECT id, url, regexp_replace(url, '#.*$', '') AS b FROM expressions),
      q AS (SELECT *, list_filter(string_split(regexp_extract(b, '\\?(.*)$', 1), '&'), lambda p: contains(p, '=') AND lower(string_split(p, '=')[1]) NOT IN ({_TRACK})) AS kept FROM u)
      SELECT id, regexp_replace(b, '\\?.*$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS clean,
      b AS bare, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, md5(url) AS hash, regexp_matches(url, '^https?://') AND NOT regexp_matches(lower(url), '\\.(jpg|jpeg|png|bmp|webp|pdf|txt|csv|xls|xlsx|doc|docx)$') AS is_page FROM q""",
    "page_metadata": V.with_views(E) + "SELECT id, nullif(trim(title), '') AS title, nullif(lang, '') AS lang, NULL AS description, NULL AS canonical FROM expressions",
    "markdown_links": V.with_views(E) + """, h AS (SELECT id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS anchor,
      generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) - 1 AS position FROM expressions) SELECT id, position, anchor, url FROM h""",
    "corpus_files": V.with_views(E) + f"""SELECT id, id || '-' || CASE WHEN s = '' THEN 'untitled' ELSE s END || '.txt' AS file_name,
      '---' || chr(10) || 'Title: "' || title || '"' || chr(10) || 'Identifier: "' || id || '"' || chr(10) || 'Source: "' || url || '"' || chr(10) || 'Language: "' || coalesce(nullif(lang, ''), 'na') || '"' || chr(10) || '---' || chr(10) AS header
      FROM (SELECT *, {_slug('title')} AS s FROM expressions)""",
}
