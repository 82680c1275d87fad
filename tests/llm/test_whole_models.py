"""What the workers do not hold of the toxicity models is looked up, so that their size changes no score."""

import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from webloom.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    plain, vile = [f"w{k}" for k in range(400)], [f"v{k}" for k in range(60)]
    rows = []
    for i in range(900):
        toxic = int(rng.random() < 0.3)
        words = [rng.choice(plain) for _ in range(rng.randint(1, 40))] + [rng.choice(vile) for _ in range(4 * toxic)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(300)] + [(3000, None, 0), (3001, "", 0), (3002, "never seen", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3).cache()


@pytest.mark.parametrize("words, pairs", [(30, 50), (0, 0), (10**6, 20), (20, 10**6)])
def test_scores_of_the_whole_models(corpus, words, pairs):
    docs, labels = corpus.drop("toxic"), corpus.select("doc_id", "toxic")
    whole = toxicity.train(docs, labels)
    small = toxicity.train(docs, labels, most_words=words, most_pairs=pairs)
    assert whole.rest is None and whole.size > 300 and len(whole.pairs) > 300
    assert small.size <= words and len(small.pairs) <= pairs and small.rest.count() > 100
    wanted, got = ({r["doc_id"]: r["score"] for r in toxicity.score(docs.withColumn("_more", F.lit(1)), e).collect()} for e in (whole, small))
    assert wanted.keys() == got.keys() and len(got) == 1203
    ids = sorted(wanted)
    assert np.allclose([wanted[i] for i in ids], [got[i] for i in ids], rtol=1e-12, atol=1e-15)
    assert np.std([wanted[i] for i in ids]) > 0.1
    texts = [r["text"] for r in docs.where("doc_id < 9").orderBy("doc_id").collect()]
    assert np.allclose(small.scores(texts), [wanted[i] for i in range(9)], rtol=1e-12)


def test_the_pipeline_drops_the_same_rows(spark, tmp_path, corpus, monkeypatch):
    docs = corpus.drop("toxic").withColumn("lang", F.lit("aa")).withColumn("a.b", F.col("doc_id")).withColumn("_more", F.lit("x"))
    corpus.select("doc_id", "toxic", F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    rows = lambda: sorted(map(tuple, corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()), key=lambda r: (r[0], r[1] or ""))
    wanted = rows()
    monkeypatch.setattr(toxicity, "train", partial(toxicity.train, most_words=10, most_pairs=10))
    got = rows()
    assert got == wanted and 700 < len(got) < 1150 and len(got[0]) == 5
