"""Page quality from five weighted blocks, and dictionary relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import keywords, strip

#: How much each block counts.
WEIGHTS = {"access": 0.30, "structure": 0.15, "richness": 0.25, "coherence": 0.20, "integrity": 0.10}


def _filled(c: Column, more_than: int = 0) -> Column:
    return F.coalesce(F.length(strip(c)) > more_than, F.lit(False))


def access(status: Column, content_type: Column, crawled_at: Column) -> Column:
    code = status.try_cast("int")
    by_status = F.when(code.between(200, 299), 1.0).when(code.between(300, 399), 0.5).otherwise(0.0)
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    factor = F.when((kind == "") | kind.contains("text/html"), 1.0).when(kind.contains("application/pdf"), 0.0).otherwise(0.3)
    return F.when(crawled_at.isNull(), 0.0).otherwise(by_status * factor)


def structure(title: Column, description: Column, keywords_: Column, canonical: Column) -> Column:
    part = lambda ok, w: F.when(ok, w).otherwise(0.0)
    return (
        part(_filled(title), 0.4) + part(_filled(description, 20), 0.3) + part(_filled(keywords_), 0.15) + part(F.coalesce(canonical, F.lit("")) != "", 0.15)
    )


def richness(word_count: Column, content_length: Column, reading_time: Column) -> Column:
    n = word_count
    by_words = (
        F.when(n < 80, 0.1)
        .when(n < 150, 0.3)
        .when(n <= 5000, F.exp(-F.pow(n - 1500, F.lit(2)) / (2 * 1500.0**2)))
        .otherwise(F.greatest(F.lit(0.5), 0.8 - (n - 5000) / 50000.0))
    )
    ratio = n / F.nullif(content_length, F.lit(0))
    by_ratio = F.when(ratio.isNull(), 0.5).when(ratio < 0.05, 0.2).when(ratio < 0.1, 0.5).when(ratio <= 0.3, 1.0).otherwise(0.9)
    t = F.nullif(reading_time.cast("double"), F.lit(0.0))
    by_time = F.when(t.isNull(), 0.5).when(t < 0.25, 0.2).when(t < 0.5, 0.5).when(t <= 15, 1.0).when(t <= 25, 0.8).otherwise(0.3)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(by_words * 0.5 + by_ratio * 0.3 + by_time * 0.2)


def coherence(lang: Column, wanted: Column, relevance: Column, published: Column, as_of: Column) -> Column:
    known = (F.coalesce(lang, F.lit("")) != "") & (F.size(wanted) > 0)
    by_lang = F.when(~F.coalesce(known, F.lit(False)), 0.5).when(F.array_contains(wanted, lang), 1.0).otherwise(0.0)
    by_relevance = F.when(relevance.isNull(), 0.5).otherwise(F.least(relevance / 5.0, F.lit(1.0)))
    age = F.datediff(as_of, published)
    by_age = F.when(age.isNull(), 0.5).when(age < 0, 0.0).when(age < 365, 1.0).when(age < 730, 0.9).when(age < 1825, 0.7).otherwise(0.5)
    return by_lang * 0.4 + by_relevance * 0.4 + by_age * 0.2


def integrity(verdict: Column, readable: Column, readable_at: Column, approved_at: Column) -> Column:
    by_verdict = F.when(verdict == "oui", 0.4).when(verdict == "non", 0.0).otherwise(0.2)
    has = readable_at.isNotNull() & (F.coalesce(readable, F.lit("")) != "")
    by_text = F.when(~has, 0.0).when(_filled(readable, 100), 0.4).otherwise(0.2)
    return by_verdict + by_text + F.when(approved_at.isNotNull(), 0.2).otherwise(0.0)


def flags(c: dict[str, Column], wanted: Column) -> Column:
    """What speaks against a page, in the order of the blocks; nothing after a page that cannot be had.

    ``c`` holds the columns of a page by name.
    """
    code, kind = c["http_status"].try_cast("int"), F.lower(F.coalesce(c["content_type"], F.lit("")))
    n, ratio, minutes = c["word_count"], c["word_count"] / F.nullif(c["content_length"], F.lit(0)), F.nullif(c["reading_time"].cast("double"), F.lit(0.0))
    missing_status = F.coalesce(c["http_status"].cast("string"), F.lit("")) == ""
    ok = code.between(200, 399)
    html = (kind == "") | kind.contains("text/html")
    access_flags = F.array(
        F.when(missing_status, "no_http_status").when(code.isNull(), "invalid_http_status").when(code.between(300, 399), "redirect").when(~ok, "http_error"),
        F.when(ok & ~html, F.when(kind.contains("application/pdf"), "non_html_pdf").otherwise("non_html")),
        F.when(ok & ~kind.contains("application/pdf") & c["crawled_at"].isNull(), "not_crawled"),
    )
    empty = F.coalesce(n, F.lit(0)) == 0
    has = c["readable_at"].isNotNull() & (F.coalesce(c["readable"], F.lit("")) != "")
    age = F.datediff(c["as_of"], c["published_at"])
    others = F.array(
        F.when(~_filled(c["title"]), "no_title"),
        F.when(~_filled(c["description"], 20), "no_description"),
        F.when(~_filled(c["keywords"]), "no_keywords"),
        F.when(F.coalesce(c["canonical_url"], F.lit("")) == "", "no_canonical"),
        F.when(empty, "no_content").when(n < 80, "very_short_content").when(n < 150, "short_content").when(n > 10000, "very_long_content"),
        F.when(~empty, F.when(ratio < 0.05, "poor_text_ratio").when(ratio < 0.1, "low_text_ratio")),
        F.when(~empty, F.when(minutes < 0.25, "very_short_reading").when(minutes < 0.5, "short_reading").when(minutes > 25, "very_long_reading")),
        F.when(F.coalesce(c["lang"], F.lit("")) == "", "no_language").when((F.size(wanted) > 0) & ~F.array_contains(wanted, c["lang"]), "wrong_language"),
        F.when(c["relevance"] < 0.5, "low_relevance"),
        F.when(age < 0, "future_date").when(age >= 1825, "old_content"),
        F.when(c["validllm"] == "non", "llm_rejected"),
        F.when(~has, "no_readable").when(~_filled(c["readable"], 100), "short_readable"),
        F.when(c["approved_at"].isNull(), "not_approved"),
    )
    denied = access(c["http_status"], c["content_type"], c["crawled_at"]) == 0
    return F.array_compact(F.when(denied, access_flags).otherwise(F.concat(access_flags, others)))


def reason(score: Column, blocked: Column, found: Column) -> Column:
    """The score in words: the main penalties where it is low."""
    figure = F.format_string("%.2f", score)
    said = F.array_compact(
        F.array(
            F.when(F.array_contains(found, "http_error"), "erreur HTTP"),
            F.when(F.arrays_overlap(found, F.array(F.lit("short_content"), F.lit("very_short_content"))), "contenu trop court"),
            F.when(F.array_contains(found, "wrong_language"), "langue incorrecte"),
            F.when(F.array_contains(found, "low_relevance"), "faible pertinence"),
            F.when(F.array_contains(found, "no_readable"), "extraction échouée"),
        )
    )
    main = F.array_join(F.when(F.size(said) > 0, said).otherwise(F.slice(found, 1, 2)), ", ")
    return (
        F.when(blocked, F.concat(F.lit("Accès impossible: "), F.array_join(found, ", ")))
        .when(score >= 0.8, F.concat(F.lit("Haute qualité ("), figure, F.lit("): contenu riche et complet")))
        .when(score >= 0.6, F.concat(F.lit("Qualité acceptable ("), figure, F.lit("): contenu standard")))
        .otherwise(F.concat(F.lit("Qualité "), F.lower(category(score)), F.lit(" ("), figure, F.lit("): "), main))
    )


def category(score: Column) -> Column:
    return F.when(score >= 0.8, "Excellent").when(score >= 0.6, "Bon").when(score >= 0.4, "Moyen").when(score >= 0.2, "Faible").otherwise("Très faible")


#: The columns of a page that quality looks at, and their types.
COLUMNS = {
    "http_status": "string", "content_type": "string", "crawled_at": "date", "title": "string", "description": "string", "keywords": "string",
    "canonical_url": "string", "word_count": "int", "content_length": "int", "reading_time": "double", "lang": "string", "relevance": "double",
    "published_at": "date", "validllm": "string", "readable": "string", "readable_at": "date", "approved_at": "date",
}


def with_quality(pages: DataFrame, wanted: Column, as_of: Column, weights: dict[str, float] | None = None) -> DataFrame:
    """``pages`` plus the five blocks, ``quality``, ``quality_category``, ``quality_flags`` and ``quality_reason``.

    Inaccessible pages score 0. Columns that ``pages`` lacks count as missing values.
    """
    w = weights or WEIGHTS
    c = {name: F.col(name) if name in pages.columns else F.lit(None).cast(kind) for name, kind in COLUMNS.items()} | {"as_of": as_of}
    blocks = {
        "access": access(c["http_status"], c["content_type"], c["crawled_at"]),
        "structure": structure(c["title"], c["description"], c["keywords"], c["canonical_url"]),
        "richness": richness(c["word_count"], c["content_length"], c["reading_time"]),
        "coherence": coherence(c["lang"], wanted, c["relevance"], c["published_at"], as_of),
        "integrity": integrity(c["validllm"], c["readable"], c["readable_at"], c["approved_at"]),
    }
    scored = pages.withColumns({f"q_{k}": v for k, v in blocks.items()} | {"quality_flags": flags(c, wanted)})
    total = sum((F.col(f"q_{k}") * w[k] for k in blocks), F.lit(0.0))
    total = F.when(F.col("q_access") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    scored = scored.withColumn("_q", total).withColumn("quality", F.round(F.col("_q") + 1e-9, 3)).withColumn("quality_category", category(F.col("_q")))
    return scored.withColumn("quality_reason", reason(F.col("_q"), F.col("q_access") == 0, F.col("quality_flags"))).drop("_q")


def _weight(terms: list[tuple[str, float]]) -> Column:
    """term -> weight as a literal map; the last weight of a repeated term counts."""
    return F.create_map(*[F.lit(x) for term, weight in dict(terms).items() for x in (term, float(weight))])


def relevance_of(in_title: Column, in_body: Column, terms: list[tuple[str, float]], lang: Column) -> Column:
    """Weight of the dictionary terms among keywords: each term once, titles tenfold, French a tenth more."""
    if not terms:
        return F.lit(0.0)
    weight = _weight(terms)
    known = lambda words: F.filter(words, lambda k: weight[k].isNotNull())
    total = lambda words: F.aggregate(words, F.lit(0.0), lambda s, k: s + weight[k])
    first = known(in_title)
    later = F.array_except(known(in_body), first)
    hits = F.size(first) + F.size(later)
    score = 10 * total(first) + total(later) + F.when(hits > 1, 0.5 * hits).otherwise(0.0)
    return F.round(score * F.when(F.coalesce(lang == "fr", F.lit(False)), 1.1).otherwise(1.0), 2)


def relevance(title: Column, body: Column, terms: list[tuple[str, float]], lang: Column) -> Column:
    """As ``relevance_of`` with words as they stand; ``functions.stem`` has the keywords by stems."""
    word = lambda text, most: keywords(F.coalesce(text, F.lit("")), most, lang=lang)
    return relevance_of(word(title, 20), word(body, 50), terms, lang)


def relevance_counted(title: Column, body: Column, terms: list[str]) -> Column:
    """Every hit of every term counts, titles tenfold (an integer)."""
    count = lambda text: sum((F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?<![a-zà-ÿ]){t}(?![a-zà-ÿ])")) for t in terms), F.lit(0))
    return 10 * count(title) + count(body)
