"""The toxicity models count all labelled rows, and have a size of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import toxicity


@pytest.fixture(scope="module")
def many(spark):
    """20,000 rows: a word of each four of them, behind a word of each three; toxic ones hold `vile` as well."""
    toxic = (F.col("id") % 4 == 0).cast("int")
    text = F.concat_ws(" ", F.concat(F.lit("b"), F.floor(F.col("id") / 3)), F.concat(F.lit("w"), F.col("id") % 5000), F.when(toxic == 1, F.lit("vile")))
    return spark.range(20_000, numPartitions=4).select(F.col("id").alias("doc_id"), text.alias("text"), toxic.alias("toxic")).cache()


def test_every_labelled_row_counts(many):
    evidence = toxicity.train(many.drop("toxic"), many.select("doc_id", "toxic"), calibrate=F.col("id") >= 19_000)
    rows = [(r["text"].split(), r["toxic"]) for r in many.where("doc_id < 19000").collect()]
    befores = {}
    for words, toxic in rows:
        for v, w in zip(["", *words], words):
            befores.setdefault(w, (set(), set()))[1 - toxic].add(v)
    wanted = {w: tuple(map(len, sides)) for w, sides in befores.items() if sum(map(len, sides)) >= 2}
    assert set(evidence.vocabulary) == set(wanted) and evidence.size == len(wanted) > 4000
    bad, good = evidence.scores(["b1 w1 vile", "b1 w1"])
    assert bad > 0.5 > good


def test_the_model_keeps_its_size(many):
    evidence = toxicity.train(many.drop("toxic"), many.select("doc_id", "toxic"), most_words=10, most_pairs=10)
    assert "vile" in evidence.vocabulary and evidence.size <= 10 and len(evidence.pairs) <= 10
    bad, good = evidence.scores(["b1 w1 vile", "b1 w1"])
    assert bad > 0.5 > good and np.isfinite([bad, good]).all()
