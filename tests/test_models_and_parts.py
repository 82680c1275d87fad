"""Models on columns, and tables that change one partition."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from webloom.functions import models
from webloom.functions.text import embedding_text
from webloom.operators.sentiment import learned_lexicon, polarities, sentiments
from webloom.plans.corpus import SIMILAR, similarity_run, stored_run
from webloom.session import work_path
from webloom.sinks.partitions import replace_part, stored

PAIRS = [("a b c", "a b c d"), ("a b", "c d"), ("it is not so", "it is so"), (None, "x"), ("", "")]


def said(spark, load, **how):
    rows = spark.createDataFrame(list(enumerate(PAIRS)), "id int, p struct<a string, b string>").repartition(2)
    out = rows.select("id", models.pair_model(spark, load, **how)(F.col("p.a"), F.col("p.b")).alias("s")).orderBy("id").collect()
    return [(r["s"]["relation"], r["s"]["confidence"]) for r in out]


def test_a_model_reads_both_texts(spark):
    assert said(spark, models.overlap_judge) == [(1, 1.0), (0, 0.5), (-1, 1.0), (0, 0.5), (0, 0.5)]


def test_failed_batches_are_unknown_and_others_are_not(spark):
    def moody():
        def ask(pairs):
            if any(a.startswith("it") for a, _ in pairs):
                raise RuntimeError("no")
            return [(1, 0.9)] * len(pairs)

        return ask

    assert said(spark, moody, batch=1) == [(1, 0.9), (1, 0.9), (0, 0.5), (1, 0.9), (1, 0.9)]
    assert said(spark, lambda: lambda pairs: [(1, 0.9)] * (len(pairs) + 1)) == [(0, 0.5)] * 5  # answers that cannot be assigned
    assert said(spark, lambda: 1 / 0) == [(0, 0.5)] * 5  # no model


def test_a_batch_is_tried_again():
    calls = []

    def ask(items):
        calls.append(len(items))
        if len(calls) == 1:
            raise RuntimeError("busy")
        return items

    assert models.asked(ask, list(range(5)), 3, 2, None) == [0, 1, 2, 3, 4] and calls == [3, 3, 2]
    assert models.asked(None, [1, 2], 3, 2, 0) == [0, 0] and models.asked(ask, [], 3, 2, 0) == []


LEXICON = [("en", "good", 0.8), ("fr", "bon", 0.6), ("fr", "mal", -0.6), ("fr", "mal", -1.0), ("en", "x", None)]


def test_sentiment_by_language_and_maker(spark):
    texts = [("good day to you", "en"), ("good day to you", "de"), ("mal mal bon ____", "FR"), ("  short  ", "en"), ("good and long", "en"), ("good and long", None), (None, "en"), ("nothing known", "en"), ("fails: good one", "en")]
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "id int, text string, lang string")
    lexicon = spark.createDataFrame(LEXICON, "lang string, term string, polarity double")

    def judge():
        def ask(some):
            assert not any(t.startswith("mal") for t in some)  # not asked of the model
            if any(t.startswith("fails") for t in some):
                raise RuntimeError("no")
            return [-0.9 for _ in some]

        return ask

    made = sentiments(rows, lexicon, models.text_model(spark, judge, batch=1), F.col("id").isin(0, 1, 8)).orderBy("id").collect()
    none = (None, None, None)
    assert [tuple(r)[1:] for r in made] == [
        (-0.9, "negative", 0.9, "computed", "model"),
        (*none, "unsupported_lang", None),
        (-0.333, "negative", 0.333, "low_confidence", "lexicon"),
        (*none, "no_content", None),
        (0.8, "positive", 0.8, "computed", "lexicon"),
        (*none, "unsupported_lang", None),
        (*none, "no_content", None),
        (0.0, "neutral", 0.0, "low_confidence", "lexicon"),
        (*none, "failed", None),
    ]
    assert sentiments(rows.limit(0), lexicon).count() == 0 and sentiments(rows, lexicon.limit(0)).where("score <> 0").count() == 0


def test_lexicon_is_learned_from_marks(spark):
    rows = [(k, "nice nice day" if k % 2 else "poor day", "en", k % 2) for k in range(10)] + [(10, "rare day", "en", 1), (11, "nice", "en", None), (12, None, None, 1)]
    found = learned_lexicon(spark.createDataFrame(rows, "id int, text string, lang string, good int"), 5).collect()
    assert sorted(map(tuple, found)) == [("en", "day", round(12 / 11 - 1, 6)), ("en", "nice", 1.0), ("en", "poor", -1.0)]


def test_places_of_a_common_word_are_dealt_to_many_tasks(spark):
    rows = spark.createDataFrame([(k, "the day", "en") for k in range(600)], "id int, text string, lang string").repartition(2)
    lexicon = spark.createDataFrame([("en", "the", 0.5), ("en", "The", 0.1), ("en", "day", -0.1)], "lang string, term string, polarity double")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(kept, ("-1", "false", "16")):
            spark.conf.set(k, v)
        found = polarities(rows, lexicon)
        assert {r["polarity"] for r in found.collect()} == {0.2} and found.count() == 600
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(lang" in plan and "_salt" in plan.split("hashpartitioning(lang")[1].split(")")[0]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_text_for_embedding(spark):
    texts = ["a\u0085b\x00c", "one\ntwo  three", "see https://x.org/a(b)~c, d", "mail é.b@c.org!", "x 06.12.34.56.78 y +33 6 12 34 56 78", "so?!... -- --- ___ _", None]
    out = spark.createDataFrame(list(enumerate(texts)), "id int, t string").orderBy("id").select(embedding_text(F.col("t"))).collect()
    assert [r[0] for r in out] == ["abc", "onetwo three", "see ~c, d", "mail é!", "x  y +33 6 12 34 56 78", "so. --   _", ""]


def test_addresses_end_where_letters_with_marks_begin(spark):
    texts = ["see a.b@c0.example.comÉté x", "Étéa@b.org.", "é06 12 34 56 78é", "a@b.orgx1 y"]
    out = spark.createDataFrame(list(enumerate(texts)), "id int, t string").orderBy("id").select(embedding_text(F.col("t"))).collect()
    assert [r[0] for r in out] == ["see Été x", "Été.", "éé", "a@b.orgx1 y"]


def files(path, method):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path.removeprefix('file://')}/method={method}/*.parquet")}


@pytest.fixture(scope="module")
def paragraphs(spark):
    rows = [(i, i % 7, [float(i % 5), float(i % 3), 1.0], "not a b" if i % 2 else "a b") for i in range(40)]
    return spark.createDataFrame(rows, "id long, expression_id long, embedding array<float>, text string")


def test_only_the_own_part_is_written(spark, paragraphs):
    path = work_path(spark, "similar")
    assert stored(spark, path, SIMILAR).count() == 0
    stored_run(paragraphs, path, "cosine", 0.9)
    stored_run(paragraphs, path, "knn", 0.3, 3)
    before = files(path, "cosine")
    again = sorted(map(str, stored_run(paragraphs, path, "knn", 0.3, 3).collect()))
    assert files(path, "cosine") == before and before
    wanted = similarity_run(paragraphs, similarity_run(paragraphs, spark.createDataFrame([], SIMILAR), "cosine", 0.9), "knn", 0.3, 3)
    assert again == sorted(map(str, wanted.collect()))


def test_a_failed_run_leaves_the_table_and_can_be_repeated(spark, paragraphs):
    path = work_path(spark, "similar")
    stored_run(paragraphs, path, "cosine", 0.9)
    stored_run(paragraphs, path, "nli", 0.3, 3)
    before, rows = files(path, "nli"), sorted(map(str, stored(spark, path, SIMILAR).collect()))
    fails = lambda a, b: F.struct(F.raise_error(F.lit("lost")).cast("int").alias("relation"), F.lit(0.1).alias("confidence"))
    with pytest.raises(Exception, match="lost"):
        stored_run(paragraphs, path, "nli", 0.3, 3, fails)
    assert files(path, "nli") == before and sorted(map(str, stored(spark, path, SIMILAR).collect())) == rows
    judged = stored_run(paragraphs, path, "nli", 0.3, 3, models.pair_model(spark, models.overlap_judge)).where("method = 'nli'")
    assert {r["relation"] for r in judged.select("relation").distinct().collect()} == {1, -1}


def test_no_rows_empty_the_part_and_strange_rows_raise(spark, paragraphs):
    path = work_path(spark, "similar")
    stored_run(paragraphs, path, "cosine", 0.9)
    stored_run(paragraphs, path, "knn", 0.3, 3)
    assert {r["method"] for r in stored_run(paragraphs, path, "cosine", 1.1).select("method").distinct().collect()} == {"knn"}
    with pytest.raises(ValueError, match="do not belong"):
        replace_part(stored(spark, path, SIMILAR), path, "method", "cosine")
    with pytest.raises(ValueError, match="partition name"):
        replace_part(stored(spark, path, SIMILAR), path, "method", "a/b")
    assert stored(spark, path, SIMILAR).count() > 0


def test_only_a_batch_of_texts_becomes_strings():
    import pyarrow as pa

    a, b = pa.array(["x"] * 7), pa.array(["y"] * 7)
    assert [(len(p), len(q)) for p, q in models._by(3, a, b)] == [(3, 3), (3, 3), (1, 1)] and not list(models._by(3, a[:0]))
    assert next(models._by(3, a))[0].buffers()[2].address == a.buffers()[2].address  # no copy


def test_a_part_is_written_once(spark, paragraphs, monkeypatch):
    from pyspark.sql import DataFrameWriter

    path, calls, write = work_path(spark, "similar"), [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: calls.append(a) or write(self, *a, **b))
    for _ in range(2):
        found = stored_run(paragraphs, path, "cosine", 0.9)
    assert len(calls) == 2 and found.count() > 0
    assert os.listdir(path.removeprefix("file://")) == ["method=cosine"]
    replace_part(spark.createDataFrame([], SIMILAR), path, "method", "cosine")
    replace_part(found.where("false"), path, "method", "cosine")
    assert stored(spark, path, SIMILAR).count() == 0 and os.listdir(path.removeprefix("file://")) == []
