"""The rows kept for the logistic fit hold both classes whenever the labels do."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import toxicity


@pytest.mark.parametrize("fifth, n_toxic", [({0, 1, 2, 3}, 12), ({4}, 12), ({0, 1, 2, 3}, 1), ({4}, 1)])
def test_a_class_on_one_side_of_the_split(spark, fifth, n_toxic):
    place = lambda i: zlib.crc32(str(i).encode()) % 5
    toxic = [i for i in range(1000) if place(i) in fifth][:n_toxic]
    plain = [i for i in range(1000, 1200)]
    rows = [(i, f"vile crud {'abcdefghij'[k % 10]} crud vile{k} vile crud", 1) for k, i in enumerate(toxic)]
    rows += [(i, f"the cat {k} sat on {k * 7 % 50} mats and the dog{k % 9} ran", 0) for k, i in enumerate(plain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    evidence = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"), discount=0.0)
    assert evidence is not None
    bad, good = evidence.scores(["vile crud and vile crud", "the cat sat on the mats"])
    assert bad > good


def test_no_text_of_a_class(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "some words", 0), (3, "more words", 0)], "doc_id long, text string, toxic int")
    assert toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic")) is None


def brute_models(rows, d1):
    """Both classes' probability of a word behind another, from the definition; and which words are known."""
    triples = {c: {t for text, k in rows if k == c for w in [text.lower().split()] for t in zip(["", "", *w], ["", *w], w)} for c in (1, 0)}
    pairs = {c: Counter((v, w) for _, v, w in triples[c]) for c in (1, 0)}
    total = pairs[1] + pairs[0]
    singles = {c: Counter(w for _, w in pairs[c]) for c in (1, 0)}
    both = singles[1] + singles[0]
    both = Counter({w: n for w, n in both.items() if n >= 2})
    sizes = Counter(total.values())
    d2 = sizes[1] / (sizes[1] + 2 * sizes[2]) if sizes[1] and sizes[2] else 0.75
    once, twice = (sum(n == k for n in both.values()) for k in (1, 2))
    d1 = max(d1, once / (once + 2 * twice) if once and twice else 0.75)
    everything = sum(both.values())
    small = sum(min(n, 1) for n in both.values()) / everything
    rest = sum(min(n, d1) for n in both.values()) / everything

    def single(c, w):
        shared = (1 - small) * both[w] / everything + small / (len(both) + 1)
        own = {x: max(singles[c][x] - d1, 0) for x in both}
        weight = rest if sum(own.values()) else 1.0
        return (1 - weight) * own.get(w, 0) / max(sum(own.values()), 1) + weight * shared

    def behind(c, v, w):
        kept = {x: pairs[c][v, x] for x in both if total[v, x] >= 2 and (v == "" or v in both)}
        n = sum(kept.values())
        if not n:
            return single(c, w)
        share = sum(min(x, d2) for x in kept.values()) / n
        return max(kept.get(w, 0) - d2, 0) / n + share * single(c, w)

    return behind, both


def test_probabilities_as_by_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(14)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12))), int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    evidence = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"), discount=1.5, calibrate=F.col("id") >= 100)
    once = {}
    for i, text, toxic in rows:
        once[text] = (min(i, once.get(text, (i,))[0]), max(toxic, once.get(text, (0, 0))[1]))
    behind, known = brute_models([(text, toxic) for text, (i, toxic) in once.items() if i < 100], 1.5)
    assert set(evidence.vocabulary) == set(known)
    for _, text, _ in [*rows[90:], (0, "w1 never w2 w2 seen", 0)]:
        w = text.split()
        ids = np.array([evidence.vocabulary.get(x, len(evidence.vocabulary)) for x in w])
        got = evidence.ratios(ids, np.array([0]))
        known_before = [v if v in known or not v else "?" for v in ["", *w[:-1]]]
        wanted = [math.log(behind(1, v, x)) - math.log(behind(0, v, x)) for v, x in zip(known_before, w)]
        assert np.allclose(got, wanted)
    for c in (1, 0):
        assert abs(sum(behind(c, "w1", w) for w in [*known, "unknown"]) - 1) < 1e-9


def test_equal_texts_with_both_labels(spark):
    rng = random.Random(8)
    plain = lambda: [rng.choice("the a cat dog sat ran on to mat rug it was and not of".split()) for _ in range(14)]
    def vile():
        words = plain()
        for _ in range(4):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "crud", "grot"]))
        return words
    rows = [(i, "vile crud and the cat grot of it", int(i % 2)) for i in range(40)]
    rows += [(100 + i, " ".join(plain()), 0) for i in range(120)] + [(300 + i, " ".join(vile()), 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = [toxicity.train(d.drop("toxic"), d.select("doc_id", "toxic"), discount=0.0) for d in (docs, docs.repartition(5).orderBy(F.desc("doc_id")))]
    texts = ["vile crud and the cat grot of it", "the cat sat on a mat", "", "x" * 200_000, "vile " * 50_000]
    a, b = (f.scores(texts) for f in found)
    assert np.array_equal(a, b) and a[0] > 0.5 > a[1] and np.isfinite(a).all()
