import os
import zipfile
from xml.etree import ElementTree as ET

from webloom import views as V
from webloom.operators import export, texts
from webloom.sinks import files

SMALL = "/root/testdata/sf0.001"


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"'), (2, None)], "id int, name string").orderBy("id")
    assert files.write_csv(df, str(tmp_path / "x.csv")) == 2
    assert (tmp_path / "x.csv").read_bytes() == b'"id","name"\r\n"1","a ""b"""\r\n"2",""\r\n'
    assert files.write_csv(df.limit(0), str(tmp_path / "y.csv"), header_always=False) == 0
    assert (tmp_path / "y.csv").read_bytes() == b""


def test_gexf(spark):
    pages = V.expressions(spark, SMALL)
    nodes = export.relevant(pages, 2, 2.0)
    edges = export.graph_edges(pages, V.links(spark, SMALL), 2, 2.0)
    root = ET.fromstring(files.gexf(nodes, edges, "url", "relevance", {"title": "string", "depth": "integer"}))
    ns = {"g": "http://www.gexf.net/1.2draft"}
    ids = {n.get("id") for n in root.findall(".//g:node", ns)}
    assert len(ids) == nodes.count()
    found = root.findall(".//g:edge", ns)
    assert len(found) == edges.count() and all(e.get("source") in ids and e.get("target") in ids for e in found)


def test_archives(spark, tmp_path):
    pages = V.expressions(spark, SMALL)
    joined = texts.corpus_files(pages).join(pages.select("id", "readable"), "id")
    made = files.write_corpus(joined, str(tmp_path / "corpus"), per_archive=20)
    assert [len(zipfile.ZipFile(m).namelist()) for m in made] == [20, 20, 10]
    files.write_bundle({"pages": pages.select("id", "url"), "links": V.links(spark, SMALL)}, str(tmp_path / "b.zip"))
    assert sorted(zipfile.ZipFile(tmp_path / "b.zip").namelist()) == ["links.csv", "pages.csv"]


def test_exports_by_name(spark, tmp_path):
    from webloom.sinks import exports

    made = exports.run_all(spark, SMALL, [{"kind": k, "land": 1, "least": 2.0, "stamp": "x"} for k in (*exports.EXPORTS, "nothing")], str(tmp_path))
    assert [r["status"] for r in made] == ["done"] * len(exports.EXPORTS) + ["failed"] and "unknown export nothing" in made[-1]["error"]
    pages = V.expressions(spark, SMALL).where("land_id = 1 AND relevance >= 2").count()
    lines = (tmp_path / "land_1_pagecsv_x.csv").read_bytes().split(b"\r\n")
    assert len(lines) == pages + 2 and lines[0] == b'"id","url","title","lang","relevance","depth"'
    root = ET.parse(tmp_path / "land_1_pagegexf_x.gexf").getroot()
    ns = {"g": "http://www.gexf.net/1.2draft"}
    ids = {n.get("id") for n in root.findall(".//g:node", ns)}
    assert len(ids) == pages and all({e.get("source"), e.get("target")} <= ids for e in root.findall(".//g:edge", ns))
    assert sum(len(zipfile.ZipFile(p).namelist()) for p in tmp_path.glob("land_1_corpus_x_*.zip")) == pages


def test_files_are_kept_for_days(tmp_path):
    from webloom.sinks import exports

    for k, age in enumerate((1, 8, 30)):
        (tmp_path / f"{k}.csv").write_text("x")
        os.utime(tmp_path / f"{k}.csv", (1e9 - age * 86_400,) * 2)
    assert [os.path.basename(p) for p in exports.expired(str(tmp_path), 7, 1e9)] == ["1.csv", "2.csv"]
    exports.clean(str(tmp_path), 7, 1e9)
    assert [p.name for p in tmp_path.iterdir()] == ["0.csv"]


def test_parts_and_raw_pages(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"'), (2, None)], "id int, name string").coalesce(1).orderBy("id")
    files.write_parts(df, str(tmp_path / "p"), null="None")
    (part,) = (tmp_path / "p").glob("part-*.csv")
    assert part.read_text() == '"id","name"\n"1","a ""b"""\n"2","None"\n'
    pages = V.expressions(spark, SMALL)
    files.write_html(pages, str(tmp_path / "raw"))
    back = spark.read.json(str(tmp_path / "raw"))
    assert back.count() == pages.count() and len(list((tmp_path / "raw").glob("domain_name=*"))) == pages.select("domain_name").distinct().count()
