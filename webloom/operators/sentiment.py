"""Sentiment of texts by a lexicon that is a table, or by a model for the texts that are worth it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import text as X
from webloom.session import table

#: A word's places are dealt to so many tasks, however common it is.
SALTS = 32
#: Languages that are scored, characters that a text must have, and the confidence below which a score is doubtful: fixed values.
SPOKEN = ("en", "fr")
LEAST = 10
SURE = 0.5


def learned_lexicon(texts: DataFrame, least: int = 5) -> DataFrame:
    """(lang, term, polarity) from marked texts (text, lang, good of 0 or 1): how much oftener a term stands in good ones.

    Terms of fewer than ``least`` texts say nothing. Texts without mark or language are left out.
    """
    each = texts.where("good IS NOT NULL AND lang IS NOT NULL").select(F.lower("lang").alias("lang"), "good", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    counted = each.groupBy("lang", "term").agg(F.count("*").alias("n"), F.sum("good").alias("g"))
    return counted.where(F.col("n") >= least).select("lang", "term", F.round(2 * F.col("g") / F.col("n") - 1, 6).alias("polarity"))


def polarities(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, polarity) of the texts (id, text, lang) that hold a term of their language's lexicon: the mean over all its places.

    Of repeated terms the mean counts. The lexicon is copied ``SALTS`` times, so that a common word's places meet it in many
    tasks. Polarities are summed in whole millionths, so the order of rows does not matter.
    """
    known = lexicon.where("polarity IS NOT NULL").groupBy(F.lower("lang").alias("lang"), "term").agg(F.avg("polarity").alias("p"))
    known = known.select("lang", "term", F.round(F.col("p") * 1_000_000).cast("long").alias("p"))
    known = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    words = texts.select("id", F.lower("lang").alias("lang"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("_salt"), F.explode(X.tokens(F.col("text"))).alias("term"))
    mean = F.sum("p") / F.lit(1_000_000) / F.count("*")
    return words.join(known, ["lang", "term", "_salt"]).groupBy("id").agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean)).alias("polarity"))


def sentiments(texts: DataFrame, lexicon: DataFrame, model: Callable[[Column], Column] | None = None, best: Column | None = None) -> DataFrame:
    """Score, label, confidence, status and maker of every text (id, text, lang; ids are unique).

    Texts of fewer than ten characters and texts in other languages than ``SPOKEN`` have a status and no score. Where
    ``best`` holds, ``model`` (``functions.models.text_model``) is asked; where it has no answer the status says so. All
    others go by the lexicon.
    """
    content = F.length(X.strip(F.coalesce(F.col("text"), F.lit("")))) >= LEAST
    spoken = F.coalesce(F.lower("lang").isin(*SPOKEN), F.lit(False))
    to_model = F.lit(False) if model is None else F.coalesce(best if best is not None else F.lit(True), F.lit(False)) & content & spoken
    rows = texts.select("id", "text", "lang", content.alias("_content"), spoken.alias("_spoken"), to_model.alias("_ask"))
    scored = rows.join(polarities(rows.where("_content AND _spoken AND NOT _ask"), lexicon), "id", "left")
    said = model(F.when(F.col("_ask"), F.col("text"))) if model is not None else F.lit(None).cast("double")
    scored = scored.withColumn("_said", said)
    score = F.when(F.col("_ask"), F.col("_said")).otherwise(F.coalesce("polarity", F.lit(0.0)))
    status = F.when(~F.col("_content"), "no_content").when(~F.col("_spoken"), "unsupported_lang").when(F.col("_ask") & F.col("_said").isNull(), "failed").otherwise("computed")
    scored = scored.select("id", score.alias("_p"), status.alias("status"), "_ask")
    label = F.when(F.col("_p") > 0.1, "positive").when(F.col("_p") < -0.1, "negative").otherwise("neutral")
    here = lambda c: F.when(F.col("status") == "computed", c)
    sure = here(F.round(F.abs("_p"), 3))
    return scored.select(
        "id", here(F.round("_p", 3)).alias("score"), here(label).alias("label"), sure.alias("confidence"), F.when(sure < SURE, "low_confidence").otherwise(F.col("status")).alias("status"),
        here(F.when(F.col("_ask"), "model").otherwise("lexicon")).alias("maker"),
    )


def _texts(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")


def _lexicon(s, d):
    marked = _texts(s, d).join(table(s, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("good")), "id")
    return learned_lexicon(marked)


QUERIES = {
    "learned_lexicon": _lexicon,
    "lexicon_sentiments": lambda s, d: sentiments(_texts(s, d), _lexicon(s, d)),
}
_TOKENS = "regexp_extract_all(lower(text), '([a-zà-öø-ÿ]+)', 1)"
_LEXICON = f"""lexicon AS (SELECT lang, term, round(2 * sum(quality) / count(*) - 1, 6)::DOUBLE AS polarity FROM
  (SELECT d.doc_id, lower(lang) AS lang, quality, unnest(list_distinct({_TOKENS})) AS term FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL AND lang IS NOT NULL) GROUP BY 1, 2 HAVING count(*) >= 5)"""
ORACLES = {
    "learned_lexicon": f"WITH {_LEXICON} SELECT * FROM lexicon",
    "lexicon_sentiments": f"""WITH {_LEXICON}, w AS (SELECT doc_id, lower(lang) AS lang, unnest({_TOKENS}) AS term FROM documents),
  p AS (SELECT doc_id, greatest(-1, least(1, sum(CAST(round(polarity * 1000000) AS BIGINT)) / 1000000.0::DOUBLE / count(*))) AS p FROM w JOIN lexicon USING (lang, term) GROUP BY 1),
  s AS (SELECT d.doc_id AS id, coalesce(p, 0) AS p, CASE WHEN length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) < 10 THEN 'no_content' WHEN coalesce(lower(lang) NOT IN ('en', 'fr'), true) THEN 'unsupported_lang' ELSE 'computed' END AS status FROM documents d LEFT JOIN p USING (doc_id))
  SELECT id, CASE WHEN status = 'computed' THEN round(p, 3) END AS score, CASE WHEN status <> 'computed' THEN NULL WHEN p > 0.1 THEN 'positive' WHEN p < -0.1 THEN 'negative' ELSE 'neutral' END AS label,
  CASE WHEN status = 'computed' THEN round(abs(p), 3) END AS confidence, CASE WHEN status = 'computed' AND round(abs(p), 3) < 0.5 THEN 'low_confidence' ELSE status END AS status, CASE WHEN status = 'computed' THEN 'lexicon' END AS maker FROM s""",
}
