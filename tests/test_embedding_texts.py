"""`embedding_texts` has the rows of its SQL, whatever letters, spaces and marks stand around addresses and numbers."""

import random

import duckdb

from webloom import catalog

ODD = [
    "Ciónes.\ndcddf.12@mail4.example.com La",
    "mail é.b@c.org!",
    "é-x@b.org é_x@b.org éx@b.org, ².y@b.org",
    "áb@c.org a@b.orgé a@b.org|x a@b.co|",
    "  x  　0612 34 56 78 ",
    "06 12 34 56 78 é06.12.34.56.78é 0612345678_",
    "x\u0085y z\x1fé@b.org",
    "\U0001f600a@b.org\U0001f600 h​ttps://x",
    "",
    None,
]


def test_rows_of_sql(spark, tmp_path):
    rng = random.Random(5)
    bits = ["é", "n", "a.b", "@", "c.org", ".", "-", "_", "|", " ", " ", " ", "06 12 34 56 78", "0", "12", "x@y.fr", "https://x.org/", "!", "²", "\n", "\x85", "+"]
    texts = ODD + ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(4000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in catalog.QUERIES["embedding_texts"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = dict(con.execute(catalog.ORACLES["embedding_texts"]).fetchall())
    assert got == wanted and got[0].startswith("Ció La") and got[len(ODD) - 1] is None
