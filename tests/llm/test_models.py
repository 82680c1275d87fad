"""Models by held-out accuracy, page extraction by literal pages, the pipeline by brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from webloom.llm import html_extract, langid, queries, toxicity

SYLLABLES = {"aa": "ka no mi ra shi to".split(), "bb": "sch ung ver keit lich ein".split(), "cc": "eau oux tion ment que les".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        lang = rng.choice(list(SYLLABLES))
        words = sentence(rng, lang, rng.randint(20, 120)).split()
        toxic = int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "crud", "Muck!", "grot"]))
        rows.append((i, " ".join(words), lang, "s", 0, toxic))
    rows += [(1000, None, "aa", "s", 0, 0), (1001, "", None, "s", 0, 0), (1002, "123 ... 4", "aa", "s", 0, 0), (None, "ka no mi", None, "s", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxic int")
    return df.withColumn("score", F.lit("clash")).cache()


def test_language_id(labelled):
    got = langid.language_id(labelled.drop("toxic")).toPandas().set_index("doc_id")
    truth = labelled.select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    held = [i for i in got.index if i < 900 and got.loc[i, "held_out"]]
    assert len(held) > 100 and np.mean([got.loc[i, "lang_pred"] == truth[i] for i in held]) > 0.95
    assert all(got.loc[i, "lang_pred"] == "und" for i in (1000, 1001, 1002)) and got["score"].between(0, 1).all()


def test_language_id_without_labels(labelled):
    got = langid.language_id(labelled.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in got.collect()} == {"und"}
    assert langid.language_id(labelled.limit(0)).count() == 0


def test_network_learns_in_numpy():
    rng = random.Random(2)
    data = [(sentence(rng, lang, 30).encode(), k) for k, lang in enumerate(SYLLABLES) for _ in range(60)]
    x = np.concatenate([langid.windows_of(d, 64)[:1] for d, _ in data])
    y = np.array([k for _, k in data])
    net = langid.ByteNet(list(SYLLABLES), size=64).fit(x, y, epochs=6).compile()
    assert (net.probabilities(x).argmax(1) == y).mean() > 0.97
    best, _ = net._pooled(x)
    assert np.allclose(net.probabilities(x), net._softmax(np.maximum(best, 0) @ net.weights + net.bias), atol=1e-4)


def test_toxicity(labelled):
    labels = labelled.where("doc_id < 900").select("doc_id", "toxic", F.lit(1).alias("quality"))
    got = toxicity.digest_columns(toxicity.toxicity(labelled.drop("toxic"), labels)).toPandas()
    truth = dict(labels.select("doc_id", "toxic").toPandas().to_numpy())
    held = got[got.held_out.fillna(False).astype(bool) & got.doc_id.isin(list(truth))]
    y = held.doc_id.map(truth)
    assert held.predicted[y == 1].mean() > 0.9 and held.predicted[y == 0].mean() < 0.05
    assert got.score.between(0, 1).all() and set(got[got.doc_id.isin([1000, 1001, 1002])].predicted) == {0}


def test_toxicity_without_labels(labelled):
    labels = labelled.select("doc_id", "toxic")
    got = toxicity.toxicity(labelled.drop("toxic"), labels.where("toxic = 0")).collect()
    assert {r["predicted"] for r in got} == {0}
    assert toxicity.toxicity(labelled.limit(0), labels).count() == 0


PROSE = "The cat sat on the mat and it was not for the dog that the man had to go out in the rain with his hat. "


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>T</title></head><body></body></html>", ""),
        (
            '<body><nav><a href="/">Home</a></nav><div class="ad">Buy now</div><article><h1>Head &amp; tail</h1><p><b>Short.<br><p>A  &lt;tag&gt;\n line</p></article>'
            "<footer>&copy; x</footer>",
            "Head & tail\nShort.\nA <tag> line",
        ),
        (
            f'<body><header><a href="/">Site</a></header><div id="main"><h2>News</h2><p>{PROSE * 3}</p><p>Yes.</p><p>{PROSE * 3}</p></div><aside>{PROSE * 3}</aside>'
            f'<div class="comments"><p>{PROSE * 3}</p></div><form><p>{PROSE * 3}</p></form><script>var a = "<p>no</p>";</script><p><a href="x">{PROSE * 3}</a></p>',
            "\n".join(["News", (PROSE * 3).strip(), "Yes.", (PROSE * 3).strip()]),
        ),
        ("<article><p>One<!-- <p>gone</p> --> two</p><style>p{}</style><div id='cookie-notice'>We use</div><ul><li>Item</li></ul></article>", "One two\nItem"),
    ],
)
def test_pages(page, text):
    assert html_extract.main_text(page or "") == text


def test_page_table(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>é x</p></article>", "old"), (2, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(df).collect()) == [(1, "é x", 3), (2, "", 0)]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path, labelled):
    rng = random.Random(9)
    docs = labelled.where("doc_id < 300").select("doc_id", "text", "lang", "source", "n_chars")
    base = sentence(rng, "aa", 120).split()
    near = [(2000 + k, " ".join([*base[:60], f"x{k}", *base[61:]]), "aa", "s", 0) for k in range(6)]
    lines = [(3000 + k, "The very same common line\n" + sentence(rng, "bb", 40), "bb", "s", 0) for k in range(5)]
    extra = [(4000, "... 12 !!", "aa", "s", 0), (4001, None, "aa", "s", 0), (4002, "vile grot crud vile " + sentence(rng, "cc", 20), "cc", "s", 0)]
    docs = docs.union(spark.createDataFrame(near + lines + extra, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labelled.where("doc_id < 300").select("doc_id", F.lit(1).alias("quality"), "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in kept.collect()}
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.columns == docs.columns
        after = {r["doc_id"]: r for r in kept.collect()}
        gone = before.keys() - after.keys()
        if name == "toxicity":
            assert 4002 in gone and not gone & {2000, 2001, 3000, 3001}
        if name == "language_id":
            assert gone == {4000, 4001}
        if name == "line_dedup":
            assert not gone and all("common line" not in after[3000 + k]["text"] for k in range(1, 5)) and "common line" in after[3000]["text"]
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "jaccard_join":
            assert gone == {2001, 2002, 2003, 2004, 2005}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(after)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_language_id_edges(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, lang, 30), lang) for i, lang in enumerate(list(SYLLABLES) * 40)]
    rows += [(900, "ka no mi " * 40_000, "aa"), (901, rows[0][1], "aa"), (901, rows[0][1], "aa"), (902, "éé", f"{'x' * 300}"), (903, None, "aa")]
    rows += [(1000 + k, sentence(rng, "aa", 4), f"rare{k}") for k in range(260)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, Lang_Pred string")
    net = langid.train(df.where(~langid.held_out()))
    known = {r[2] for r in rows if r[1] and zlib.crc32(str(r[0]).encode()) % 4 != 2}
    assert set(net.labels) == known and len(known) > 180
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.language_id(df).collect()]
    assert len(got) == len(rows) and len({x[1:] for x in got if x[0] == 901}) == 1 and all(0 <= s <= 1 for _, _, s in got)
    drawn = langid.train(df.where("doc_id = 900"), per_label=50)
    assert drawn.labels == ["aa"]
