"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the
last return the columns of ``documents``, further columns included whatever their names. SQL cannot express the
models and the packing, so the pipeline has no oracle; tests/llm compares its rows with a brute-force version.

In every stage an empty table gives an empty one. Null texts count as empty: they are not toxic, are of no
language, and so leave at the second stage. Rows without id are scored like others, neither lose lines nor are near
copies, and are packed. Rows that repeat an id are documents of their own, told apart by their texts; of rows that
repeat a text as well, one stays where near copies go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import jaccard, langid, line_dedup, packing, toxicity
from webloom.llm.skew import free, quoted
from webloom.session import materialize, table

#: A text whose best language is hardly likelier than chance is rejected.
LEAST_LANGUAGE_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the models of ``labels.toxic`` predict to be toxic."""
    labels = table(spark, sf_dir, "labels")
    score, predicted = free(docs, "score", "predicted")
    scored = toxicity.score(docs, toxicity.train(docs, labels.where(~toxicity.held_out())), names=(score, predicted))
    return scored.where(F.col(predicted) == 0).select(*quoted(docs.columns))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts of no language that was learned."""
    net = langid.train(docs.where(~langid.held_out()))
    if not net.labels:  # nothing to learn from: only texts without letters are known to be none
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = free(docs, "lang_pred", "score")
    known = (F.col(lang) != langid.UNDECIDED) & (F.col(score) >= LEAST_LANGUAGE_SCORE)
    return langid.identify(docs, net, names=(lang, score)).where(known).select(*quoted(docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document holds, and documents of which nothing is left."""
    before, dropped = free(docs, "n_lines", "n_dropped")
    kept = line_dedup.line_dedup(docs, names=(before, dropped)).withColumn("n_chars", F.char_length("text").cast("long"))
    emptied = (F.col(dropped) > 0) & (F.length(F.btrim("text", F.lit(line_dedup.STRIP))) == 0)
    return kept.where(~emptied).select(*quoted(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the first stays: the smallest id's.

    Rows go by id and text, so that another text of the same id stays.
    """
    rows = materialize(jaccard.linked_rows(docs, size=5, threshold=(80, 100)), "near-rows")
    known = rows.where("doc_id IS NOT NULL AND n > 0")
    first = (F.col("doc_id") == F.col("component_id")) & (F.col("h") == F.col("first_h"))
    key, text = free(docs, "_id", "_text")
    named = lambda df: df.select(F.col("doc_id").alias(key), F.col("h").alias(text))
    same = (F.col("doc_id") == F.col(key)) & (jaccard.text_hash(F.col("text")) == F.col(text))
    gone = materialize(named(known.where(~first)).distinct(), "near-copies")
    kept = docs.join(gone, same, "left_anti")
    again = known.where(first).groupBy("doc_id", "h").agg(F.count("*").alias("rows")).where("rows > 1")
    again = materialize(named(again), "near-repeats")
    if again.isEmpty():
        return kept
    (part,) = free(docs, "_part")
    once = kept.join(again, same, "left_semi").withColumn(part, jaccard.text_hash(F.col("text"))).dropDuplicates(["doc_id", part]).drop(part)
    return kept.join(again, same, "left_anti").unionByName(once)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1,024 tokens."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
