"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from webloom.llm import bpe, filter_audit, html_extract, importance, jaccard, langid, line_dedup, media, packing, repair, toxicity, vectors, window_packing
from webloom.session import table


def op1_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.digest_columns(toxicity.toxicity(docs, labels))


def op3_bpe_roundtrip(spark, sf_dir):
    return bpe.digest_columns(bpe.encode_decode(table(spark, sf_dir, "documents")))


def op4_line_dedup(spark, sf_dir):
    return line_dedup.digest_columns(line_dedup.line_dedup(table(spark, sf_dir, "documents")))


def op5_html_text(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_media_columns(spark, sf_dir):
    return media.digest_columns(media.media_columns(table(spark, sf_dir, "documents")))


def op7_best_fit_packing(spark, sf_dir):
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op8_repair_token_store(spark, sf_dir):
    return repair.digest_columns(repair.token_store_roundtrip(table(spark, sf_dir, "documents")))


def op9_vector_near_dedup(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark, sf_dir):
    return langid.language_id(table(spark, sf_dir, "documents"))


def op11_window_packing(spark, sf_dir):
    return window_packing.window_packing(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_importance_resampling(spark, sf_dir):
    return importance.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_toxicity": op2_toxicity,
    "op3_bpe_roundtrip": op3_bpe_roundtrip,
    "op4_line_dedup": op4_line_dedup,
    "op5_html_text": op5_html_text,
    "op6_media_columns": op6_media_columns,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_repair_token_store": op8_repair_token_store,
    "op9_vector_near_dedup": op9_vector_near_dedup,
    "op10_language_id": op10_language_id,
    "op11_window_packing": op11_window_packing,
    "op12_filter_audit": op12_filter_audit,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLES = {
    "op4_line_dedup": line_dedup.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_importance_resampling": importance.ORACLE,
}
