from webloom.sources import tables


def test_address_list(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# list\nhttps://h.org/a\n\n https://h.org/b \nhttps://h.org/a\nnothing\n")
    assert sorted(r["url"] for r in tables.address_list(spark, str(tmp_path)).collect()) == ["https://h.org/a", "https://h.org/b"]


def test_fetched_pages_and_archive(spark):
    rows = [("u1", 200, {"Content-Type": "Text/HTML; charset=x", "ETag": "e", "Content-Length": "7"}, "<p>é</p>"), ("u2", None, None, None), ("u3", 200, {"content-length": "many"}, "é")]
    pages = tables.fetched(spark.createDataFrame(rows, "url string, status int, headers map<string,string>, body string"))
    got = {r["url"]: r for r in pages.collect()}
    assert (got["u1"]["http_status"], got["u1"]["content_type"], got["u1"]["content_length"], got["u1"]["etag"]) == (200, "text/html", 7, "e")
    assert (got["u2"]["http_status"], got["u2"]["content_type"], got["u3"]["content_length"]) == (0, None, 2)
    archive = spark.createDataFrame([("u2", 1, "old"), ("u2", 5, "new"), ("u1", 9, "x")], "url string, taken_at int, html string")
    assert {(r["url"], r["source"], r["html"]) for r in tables.with_archive(pages, archive).collect()} == {("u1", "fetch", "<p>é</p>"), ("u2", "archive", "new"), ("u3", "fetch", "é")}
