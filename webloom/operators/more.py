"""Text assessment, paging facts, work lists, JSON columns and dates over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom import views as V
from webloom.functions import dates as D
from webloom.functions import media as M
from webloom.functions import nested as N
from webloom.functions import text as X
from webloom.operators.order import numbered
from webloom.session import table


def assessed_texts(docs: DataFrame) -> DataFrame:
    """A text's quality from 0 to 100: length, ease, structure, variety, language, word length."""
    t = F.col("text")
    m = docs.select(
        "doc_id",
        X.word_count(t).alias("words"), X.sentence_count(t).alias("sentences"), X.reading_level(t).alias("level"),
        F.length(X.strip(t)).alias("chars"), X.detect_language(t).alias("lang"),
        F.size(F.filter(F.split(t, "\n"), lambda p: X.strip(p) != "")).alias("paragraphs"), F.size(X.keywords(t, 10)).alias("keywords"),
    )
    w, lv, p, s, k = (F.col(c) for c in ("words", "level", "paragraphs", "sentences", "keywords"))
    per_word = F.col("chars") / F.nullif(w, F.lit(0))
    length = F.when(w.between(50, 2000), 20).when(w.between(20, 5000), 15).when(w > 10, 10).otherwise(0)
    ease = F.when(lv.between(40, 80), 25).when(lv.between(20, 90), 20).when(lv > 10, 15).otherwise(0)
    structure = F.when((p > 1) & (s > 3), 20).when((p >= 1) & (s > 1), 15).when(s > 0, 10).otherwise(0)
    variety = F.when((k >= 5) & per_word.between(4, 7), 15).when(k >= 3, 10).when(k >= 1, 5).otherwise(0)
    language = F.when(F.col("lang").isin("fr", "en"), 10).when(F.col("lang").isNotNull(), 5).otherwise(0)
    words = F.when(per_word.between(4, 8), 10).when(per_word.between(2, 12), 5).otherwise(0)
    advice = F.array_compact(
        F.array(
            F.when(w < 20, "very short"), F.when(w > 5000, "very long"), F.when((lv > 0) & (lv < 20), "hard to read"), F.when(lv > 90, "very plain"),
            F.when(p == 0, "no paragraphs"), F.when((p == 1) & (w > 200), "one long paragraph"), F.when(F.col("lang").isNull(), "language unknown"),
        )
    )
    advice = F.when(F.size(advice) == 0, F.lit("good")).otherwise(F.array_join(advice, "; "))
    return m.select("doc_id", (length + ease + structure + variety + language + words).alias("score"), advice.alias("advice"))


def paging(pages: DataFrame, size: int, page: int = 1) -> DataFrame:
    """Per project: rows, pages of the list, and what lies beside page number ``page``."""
    n = F.count("*")
    last = F.ceil(n / size)
    return pages.groupBy("land_id").agg(
        n.alias("total"), last.alias("total_pages"), (last > page).alias("has_next"), F.lit(page > 1).alias("has_previous")
    )


def archive_numbers(pages: DataFrame, size: int) -> DataFrame:
    """The archive that each page of a project goes to."""
    placed = numbered(pages.select("id", "land_id"), "land_id", [F.col("id")])
    return placed.select("id", "land_id", F.ceil(F.col("place") / size).cast("int").alias("archive"))


def metrics_candidates(pages: DataFrame, status: str = "all", least: float = 0, payload: str | None = None, force: bool = False) -> DataFrame:
    """Pages whose metrics are wanted: of any status, none, or one; those that have a payload only if forced."""
    kept = pages.where(F.coalesce(F.col("relevance"), F.lit(0.0)) >= least)
    if status == "none":
        kept = kept.where(F.col("http_status").isNull())
    elif status not in ("all", "any"):
        kept = kept.where(F.col("http_status") == int(status))
    if payload and not force:
        kept = kept.where(F.col(payload).isNull())
    return kept.select("id", "http_status")


def open_domains(domains: DataFrame, limit: int = 0) -> DataFrame:
    """Hosts that were not fetched; limit 0 means all."""
    kept = domains.where("source_method IS NULL").select("id", "name")
    return kept.orderBy("id").limit(limit) if limit else kept


def embedding_worklist(paragraphs: DataFrame, provider: str) -> DataFrame:
    """Paragraphs without a vector or with one of another provider, once each."""
    named = paragraphs.withColumn("provider", F.when(F.col("id") % 3 == 0, "old").otherwise("new"))
    missing = F.col("embedding").isNull() | (F.size("embedding") == 0)
    return named.where(missing | (F.col("provider") != provider)).select("id").distinct()


def event_properties(events: DataFrame) -> DataFrame:
    """The JSON properties of events as columns."""
    return N.widened(events.select("event_id", "props"), "props")


def media_facts(media: DataFrame) -> DataFrame:
    colour = F.array((F.col("id") % 256).cast("int"), (F.col("id") * 7 % 256).cast("int"), (F.col("id") * 31 % 256).cast("int"))
    m = media.select("id", M.aspect_ratio(F.col("width"), F.col("height")).alias("ratio"), colour.alias("c"), *[c.alias(n) for n, c in M.analysed(F.lit(None), F.col("width")).items()])
    safe = M.web_safe_colour(F.col("c"))
    return m.select("id", "ratio", "is_processed", "state", F.array_join(safe.cast("array<string>"), "-").alias("safe"), M.colour_distance(F.col("c"), safe).alias("distance"))


def written_dates(events: DataFrame) -> DataFrame:
    """Event dates written in the ways of search results, and read back."""
    n = F.col("event_id") % 6
    ts = F.col("ts").cast("timestamp")
    text = (
        F.when(n == 0, F.date_format(ts, "yyyy-MM-dd")).when(n == 1, F.date_format(ts, "MMM d, yyyy")).when(n == 2, F.concat(F.lit("Updated: "), F.date_format(ts, "d MMMM yyyy")))
        .when(n == 3, F.concat((F.col("event_id") % 9 + 1).cast("string"), F.lit(" days ago"))).when(n == 4, F.lit("yesterday")).otherwise(F.lit("soon"))
    )
    return events.select("event_id", F.to_date(D.written_date(text, F.lit("2024-02-01 12:00:00").cast("timestamp"))).cast("string").alias("day"))


def paragraph_totals(paragraphs: DataFrame, pages: DataFrame) -> DataFrame:
    """Per project: pages with paragraphs, paragraphs, and paragraphs a page."""
    p = paragraphs.join(pages.select(F.col("id").alias("expression_id"), "land_id"), "expression_id")
    return p.groupBy("land_id").agg(
        F.countDistinct("expression_id").alias("pages"), F.count("*").alias("paragraphs"), F.round(F.count("*") / F.nullif(F.countDistinct("expression_id"), F.lit(0)), 2).alias("per_page")
    )


E, D_, P, MD = V.EXPRESSIONS, V.DOMAINS, V.PARAGRAPHS, V.MEDIA
QUERIES = {
    "assessed_texts": lambda s, d: assessed_texts(table(s, d, "documents")),
    "paging": lambda s, d: paging(V.expressions(s, d), 50, 2),
    "archive_numbers": lambda s, d: archive_numbers(V.expressions(s, d), 40),
    "metrics_candidates": lambda s, d: metrics_candidates(V.expressions(s, d).withColumn("seorank", F.when(F.col("id") % 3 == 0, "{}")), "200", 1.0, "seorank"),
    "open_domains": lambda s, d: open_domains(V.domains(s, d)),
    "embedding_worklist": lambda s, d: embedding_worklist(V.paragraphs(s, d), "new"),
    "event_properties": lambda s, d: event_properties(table(s, d, "events")),
    "media_facts": lambda s, d: media_facts(V.media(s, d)),
    "written_dates": lambda s, d: written_dates(table(s, d, "events")),
    "paragraph_totals": lambda s, d: paragraph_totals(V.paragraphs(s, d), V.expressions(s, d)),
}
_STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_FR, _EN = (", ".join(f"'{w}'" for w in ws) for ws in (X.FRENCH, X.ENGLISH))
ORACLES = {
    "assessed_texts": rf"""WITH m AS (SELECT doc_id, text, len(list_filter(string_split_regex({_STRIP.format('text')}, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS words,
        greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS sentences, len(regexp_extract_all(text, '[{X.VOWELS}]+')) AS v, length({_STRIP.format('text')}) AS chars,
        len(list_filter(string_split(text, chr(10)), lambda p: {_STRIP.format('p')} <> '')) AS paragraphs,
        least(10, len(list_distinct(list_filter(regexp_extract_all(lower(text), '([a-zà-öø-ÿ]+)', 1), lambda w: length(w) >= 3)))) AS keywords,
        regexp_extract_all(lower(text), '([a-zA-Z{X.ACCENTS}{X.ACCENTS.upper()}]+)', 1) AS ws FROM documents),
      c AS (SELECT *, len(list_filter(ws, lambda x: x IN ({_FR}))) AS fr, len(list_filter(ws, lambda x: x IN ({_EN}))) AS en, len(regexp_extract_all(lower(text), '[{X.ACCENTS}]')) AS acc,
        CASE WHEN words >= 5 THEN greatest(0.0, least(100.0, 207 - 1.015::DOUBLE * (words / sentences) - 84.6::DOUBLE * (greatest(v, words) / words))) END AS lv, chars / nullif(words, 0) AS per_word FROM m),
      l AS (SELECT *, CASE WHEN chars < 10 THEN NULL WHEN len(ws) < 3 THEN CASE WHEN chars > 50 THEN 'en' END WHEN fr + en >= 2 AND fr > en THEN 'fr' WHEN fr + en >= 2 AND en > fr THEN 'en'
        WHEN acc > len(ws) * 0.02 THEN 'fr' WHEN chars > 50 THEN 'en' END AS lang FROM c)
      SELECT doc_id, (CASE WHEN words BETWEEN 50 AND 2000 THEN 20 WHEN words BETWEEN 20 AND 5000 THEN 15 WHEN words > 10 THEN 10 ELSE 0 END
        + CASE WHEN lv BETWEEN 40 AND 80 THEN 25 WHEN lv BETWEEN 20 AND 90 THEN 20 WHEN lv > 10 THEN 15 ELSE 0 END
        + CASE WHEN paragraphs > 1 AND sentences > 3 THEN 20 WHEN paragraphs >= 1 AND sentences > 1 THEN 15 WHEN sentences > 0 THEN 10 ELSE 0 END
        + CASE WHEN keywords >= 5 AND per_word BETWEEN 4 AND 7 THEN 15 WHEN keywords >= 3 THEN 10 WHEN keywords >= 1 THEN 5 ELSE 0 END
        + CASE WHEN lang IN ('fr', 'en') THEN 10 WHEN lang IS NOT NULL THEN 5 ELSE 0 END
        + CASE WHEN per_word BETWEEN 4 AND 8 THEN 10 WHEN per_word BETWEEN 2 AND 12 THEN 5 ELSE 0 END)::INT AS score,
      coalesce(nullif(array_to_string(list_filter([CASE WHEN words < 20 THEN 'very short' END, CASE WHEN words > 5000 THEN 'very long' END, CASE WHEN lv > 0 AND lv < 20 THEN 'hard to read' END,
        CASE WHEN lv > 90 THEN 'very plain' END, CASE WHEN paragraphs = 0 THEN 'no paragraphs' END, CASE WHEN paragraphs = 1 AND words > 200 THEN 'one long paragraph' END,
        CASE WHEN lang IS NULL THEN 'language unknown' END], lambda x: x IS NOT NULL), '; '), ''), 'good') AS advice FROM l""",
    "paging": V.with_views(E) + "SELECT land_id, count(*) AS total, ceil(count(*) / 50)::BIGINT AS total_pages, ceil(count(*) / 50) > 2 AS has_next, true AS has_previous FROM expressions GROUP BY 1",
    "archive_numbers": V.with_views(E) + "SELECT id, land_id, ceil(row_number() OVER (PARTITION BY land_id ORDER BY id) / 40)::INT AS archive FROM expressions",
    "metrics_candidates": V.with_views(E) + "SELECT id, http_status FROM expressions WHERE coalesce(relevance, 0) >= 1 AND http_status = 200 AND id % 3 <> 0",
    "open_domains": V.with_views(E, D_) + "SELECT id, name FROM domains WHERE source_method IS NULL",
    "embedding_worklist": V.with_views(P) + "SELECT DISTINCT id FROM paragraphs WHERE embedding IS NULL OR len(embedding) = 0 OR id % 3 = 0",
    "event_properties": "SELECT event_id, coalesce(nullif(json_extract_string(props, '$.k'), ''), 'na') AS k FROM events",
    "media_facts": V.with_views(MD)
    + ", c AS (SELECT *, (id % 256)::INT AS r, (id * 7 % 256)::INT AS g, (id * 31 % 256)::INT AS b FROM media), s AS (SELECT *, ((r + 25) // 51 * 51)::INT AS sr, ((g + 25) // 51 * 51)::INT AS sg, ((b + 25) // 51 * 51)::INT AS sb FROM c) "
    "SELECT id, CASE WHEN coalesce(height, 0) = 0 THEN 0.0::DOUBLE ELSE round(width / height, 2) END AS ratio, width IS NOT NULL AS is_processed, CASE WHEN width IS NOT NULL THEN 'done' ELSE 'open' END AS state, "
    "sr || '-' || sg || '-' || sb AS safe, (r - sr) * (r - sr) + (g - sg) * (g - sg) + (b - sb) * (b - sb) AS distance FROM s",
    "written_dates": "SELECT event_id, CASE WHEN event_id % 6 < 3 THEN CAST(ts::DATE AS VARCHAR) WHEN event_id % 6 = 3 THEN CAST(DATE '2024-02-01' - CAST(event_id % 9 + 1 AS INT) AS VARCHAR)[:10] WHEN event_id % 6 = 4 THEN '2024-01-31' END AS day FROM events",
    "paragraph_totals": V.with_views(E, P)
    + "SELECT e.land_id, count(DISTINCT e.id) AS pages, count(*) AS paragraphs, round(count(*) / count(DISTINCT e.id), 2) AS per_page FROM paragraphs p JOIN expressions e ON e.id = p.expression_id GROUP BY 1",
}
