"""Row-wise rules against small literal tables."""

import datetime
import json
import sys

import pytest
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions import quality as Q
from webloom.functions import text as X
from webloom.functions import url as U
from webloom.functions import vectors as Z


def values(spark, rows, column, schema="text string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    "given, slug",
    [
        (None, "untitled"), ("", "untitled"), ("   ", "untitled"), ("àéîôù", "aeiou"), ("Ça marche très bien", "ca-marche-tres-bien"),
        ("Multiple---Dashes", "multiple-dashes"), ("A" * 100, "a" * 50), ("Hello, World!", "hello-world"),
    ],
)
def test_slug(spark, given, slug):
    assert values(spark, [(given,)], X.slug(F.col("text"))) == [slug]


def test_counts(spark):
    rows = [("One two. Three!",), ("",), (None,), ("  a  ",), ("été!",)]
    assert values(spark, rows, X.word_count(F.col("text"))) == [3, 0, None, 1, 1]
    assert values(spark, rows[:2], X.sentence_count(F.col("text"))) == [2, 1]
    assert values(spark, [("été!",), ("rhythm",)], X.syllables(F.col("text"))) == [2, 1]
    assert values(spark, [("a b c d",)], X.reading_level(F.col("text"))) == [None]
    assert values(spark, [("le chat et le chien",)], X.reading_level(F.col("text"))) == [100.0]
    text = "la maison ancienne du village abandonné"
    assert values(spark, [(text,)], X.reading_level(F.col("text")))[0] == pytest.approx(207 - 1.015 * 6 - 84.6 * 14 / 6)


def test_language(spark):
    rows = [("le chat et la souris sont dans une maison",), ("the cat is in the house with that mouse",), ("short",), ("zzz qqq",)]
    assert values(spark, rows, X.detect_language(F.col("text"))) == ["fr", "en", None, None]


def test_paragraphs_and_packing(spark):
    text = "x" * 60 + "\n\n" + "tiny" + "\n\n" + ("A sentence of some length here. " * 8).strip()
    got = values(spark, [(text,)], X.paragraphs(F.col("text"), 50, 100))[0]
    assert got[0] == "x" * 60 and all(len(p) <= 100 for p in got) and " ".join(got[1:]).count("sentence") == 8


def test_cut_at_sentence(spark):
    assert values(spark, [("a" * 85 + ". tail" + "b" * 50,)], X.cut_at_sentence(F.col("text"), 100)) == ["a" * 85 + "."]
    assert values(spark, [("ab. " + "c" * 200,)], X.cut_at_sentence(F.col("text"), 100))[0] == ("ab. " + "c" * 200)[:100]


def test_variations_and_values(spark):
    df = spark.createDataFrame([("walk", "en")], "t string, lang string")
    assert df.select(X.term_variations(F.col("t"), F.col("lang"))).first()[0] == ["walk", "walks", "walkies", "walked", "walking", "walker", "walkest"]
    assert values(spark, [(None,), ("",), ("unknown",), ("x",)], X.export_value(F.col("text"))) == ["na", "na", "na", "x"]
    assert values(spark, [("Oui, sans doute",), ("non",), (None,)], X.yes_no(F.col("text"))) == [True, False, False]


@pytest.mark.parametrize(
    "base, link, full",
    [
        ("https://e.com/articles/page.html", "./images/t.jpg", "https://e.com/articles/images/t.jpg"),
        ("https://e.com/articles/page.html", "/about", "https://e.com/about"),
        ("https://e.com/a/b/c", "../d", "https://e.com/a/d"),
        ("https://e.com", "x", "https://e.com/x"),
        ("https://e.com/a", "//cdn.net/i.png", "https://cdn.net/i.png"),
        ("https://e.com/a?q=1#f", "?p=2", "https://e.com/a?p=2"),
        ("https://e.com/a", "https://o.org/z", "https://o.org/z"),
    ],
)
def test_resolved(spark, base, link, full):
    df = spark.createDataFrame([(base, link)], "b string, l string")
    assert df.select(U.resolved(F.col("b"), F.col("l"))).first()[0] == full


def test_urls(spark):
    u = F.col("text")
    assert values(spark, [("https://e.com/p?utm_source=a&id=3&flag#x",), ("https://e.com/p?ref=1",)], U.cleaned(u)) == ["https://e.com/p?id=3", "https://e.com/p"]
    assert values(spark, [("https://e.com/a#b",), ("#b",)], U.without_fragment(u)) == ["https://e.com/a", "#b"]
    assert values(spark, [("https://e.com/a.pdf",), ("https://e.com/a",), ("ftp://e.com",)], U.is_page(u)) == [False, True, False]
    assert values(spark, [("http://x/v.mp4?t=1",), ("http://x/s.ogg",), ("http://x/y",)], U.media_type(u)) == ["video", "audio", "img"]
    rules = {"example.com": r"^https?://(?:www\.)?([^/]+)"}
    assert values(spark, [("https://www.example.com/x",), ("https://other.org/x",)], U.domain_name(u, rules)) == ["example.com", "other.org"]


def test_html(spark):
    page = (
        '<html lang="fr"><head><title> T </title><meta name="description" content="D"><meta content="OG" property="og:title">'
        '<link rel="canonical" href="https://e.com/c"><meta property="article:published_time" content="2024-01-02T03:04:05+02:00"></head>'
        "<body><nav>menu</nav><article><p>" + "word " * 40 + "</p></article></body></html>"
    )
    h = F.col("text")
    row = spark.createDataFrame([(page,)], "text string").select(H.title(h), H.description(h), H.canonical(h), H.published(h), H.language(h), H.main_content(h)).first()
    assert list(row)[:5] == ["OG", "D", "https://e.com/c", "2024-01-02T03:04:05+02:00", "fr"]
    assert row[5].startswith("word word") and "menu" not in row[5]


def test_markdown(spark):
    text = "![alt](a.jpg) [link](https://x.org/a) [](b) [VIDEO: v.mp4] ![alt](a.jpg)"
    got = spark.createDataFrame([(text,)], "text string").select(H.markdown_links(F.col("text")), H.markdown_media(F.col("text"))).first()
    assert [tuple(x) for x in got[0]] == [("link", "https://x.org/a"), ("No text", "b")]
    assert [tuple(x) for x in got[1]] == [("a.jpg", "img"), ("v.mp4", "video")]


def test_perfect_page_quality(spark):
    row = spark.sql(
        "SELECT 1 AS id, 200 AS http_status, 'text/html' AS content_type, 'T' AS title, repeat('d', 30) AS description, 'k' AS keywords, 'c' AS canonical_url, 1500 AS word_count,"
        " 12000 AS content_length, 7.0D AS reading_time, 'fr' AS lang, 4.5D AS relevance, DATE'2024-05-01' AS published_at, 'oui' AS validllm, repeat('r', 200) AS readable,"
        " DATE'2024-05-02' AS crawled_at, DATE'2024-05-02' AS readable_at, DATE'2024-05-02' AS approved_at"
    )
    got = Q.with_quality(row, F.array(F.lit("fr")), F.lit("2024-06-01").cast("date")).first()
    assert (got["quality"], got["quality_category"]) == (0.992, "Excellent")
    gone = Q.with_quality(row.withColumn("http_status", F.lit("404")), F.array(F.lit("fr")), F.lit("2024-06-01").cast("date")).first()
    assert (gone["quality"], gone["quality_category"]) == (0.0, "Très faible")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [round(r[0], 9) for r in df.select(Z.cosine(F.col("a"), F.col("b"))).collect()] == [0.96, 0.0]
    v = values(spark, [("Abc",), ("abc",)], Z.hashed_embedding(F.col("text")))
    assert v[0] == v[1] and len(v[0]) == 64 and abs(sum(x * x for x in v[0]) - 1) < 1e-9


def test_characters_are_counted_outside_the_plan(spark):
    texts = [("Éa😀a",), ("",), (None,)]
    v = values(spark, texts, Z.hashed_embedding(F.col("text")))
    n = [0] * 64
    for c in "éa😀a":
        n[ord(c) * 39 % 64] += 1
    length = sum(x * x for x in n) ** 0.5
    assert v[0] == [x / length for x in n] and v[1] == [0.0] * 64 and v[2] is None
    assert values(spark, [("Éœ ﬁ½ ß漢x",), ("",), (None,)], X.ascii_only(F.col("text"))) == ["E fi12 x", "", None]
    rows = spark.createDataFrame(texts, "text string")
    plan = rows.select(Z.hashed_embedding(F.col("text")), X.ascii_only(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan and "translate(" not in plan


def test_written_dates(spark):
    from webloom.functions import dates as D

    now = F.lit("2024-02-01 12:00:00").cast("timestamp")
    rows = [("2024-01-05",), ("Jan. 5, 2024",), ("5th January 2024",), ("Updated: 2024/01/05",), ("27 days ago",), ("2 weeks ago",), ("yesterday",), ("3 hours ago",), ("",), (None,), ("soon",)]
    got = values(spark, rows, F.to_date(D.written_date(F.col("text"), now)).cast("string"))
    assert got == ["2024-01-05"] * 5 + ["2024-01-18", "2024-01-31", "2024-02-01", None, None, None]


def test_assessed_text(spark):
    from webloom.operators.more import assessed_texts

    good = "The house of the man is in the town. " * 10 + "\nIt has a door and it has a wall. Yes. No."
    got = {r["doc_id"]: (r["score"], r["advice"]) for r in assessed_texts(spark.createDataFrame([(1, good), (2, "zz")], "doc_id long, text string")).collect()}
    assert got[1][0] >= 80 and got[1][1] in ("good", "very plain") and got[2][0] <= 30 and "very short" in got[2][1]


def test_json_columns(spark):
    from webloom.functions import nested as N

    df = spark.createDataFrame([(1, '{"b": 1, "a": "x"}'), (2, '{"a": ""}'), (3, None), (4, "broken")], "id int, j string")
    assert [tuple(r) for r in N.widened(df, "j").orderBy("id").collect()] == [(1, "x", "1"), (2, "na", "na"), (3, "na", "na"), (4, "na", "na")]


def test_web_safe_colours(spark):
    from webloom.functions import media as M

    df = spark.createDataFrame([([0, 25, 26],), ([76, 77, 255],)], "c array<int>")
    assert [r[0] for r in df.select(M.web_safe_colour(F.col("c"))).collect()] == [[0, 0, 51], [51, 102, 255]]


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_relevance_counts_each_term_once(spark):
    from webloom.functions.quality import relevance

    terms = [("climat", 2.0), ("mer", 1.0), ("glace", 4.0)]
    case = lambda title, body, lang: relevance(F.lit(title), F.lit(body), terms, F.lit(lang))
    got = one(spark, case("Climat", "climat mer climat", "fr"), case("Climat", "climat", "fr"), case("", "mer glace", "de"), case("rien", "rien", "fr"), case(None, "la mer", "en"), relevance(F.lit("mer"), F.lit("mer"), [], F.lit("fr")))
    assert list(got) == [round((20 + 1 + 1) * 1.1, 2), 22.0, 6.0, 0.0, 1.0, 0.0]


def test_stems(spark):
    from webloom.functions.stem import english, french, lemma_keywords

    pairs = "continuation continu continuellement continuel majestueusement majestu maladies malad maïs maï contractions contract maintenant mainten mairie mair".split()
    assert [french(w) for w in pairs[::2]] == pairs[1::2]
    pairs = "consistency consist conspirators conspir knitted knit knackeries knackeri generate generat hoping hope cried cri skies sky consolingly consol".split()
    assert [english(w) for w in pairs[::2]] == pairs[1::2]
    got = one(spark, lemma_keywords(F.lit("Les maladies des malades et la mairie"), F.lit("fr")), lemma_keywords(F.lit("The knights were knitting, a knight knitted"), F.lit("en")), lemma_keywords(F.lit("Die Häuser die"), F.lit("de")))
    assert list(got) == [["malad", "mair"], ["knight", "knit"], ["die", "häuser"]]


def test_resolved_addresses(spark):
    from webloom.functions.url import resolved

    base = "https://h.org/a/b/c/x.html?p=1#f"
    cases = {
        "../../d": "https://h.org/a/d", "../../../../../d": "https://h.org/d", "./d": "https://h.org/a/b/c/d", "d/./e/../f": "https://h.org/a/b/c/d/f", "/./k?x=/./y": "https://h.org/k?x=/./y",
        "..": "https://h.org/a/b/", "?q": "https://h.org/a/b/c/x.html?q", "//o.net/z": "https://o.net/z", "data:image/png;base64,AA": "data:image/png;base64,AA", "mailto:a@b": "mailto:a@b",
    }
    got = one(spark, *[resolved(F.lit(base), F.lit(u)) for u in cases])
    assert list(got) == list(cases.values())


def test_slugs_and_ascii(spark):
    from webloom.functions.text import slug

    cases = {"Łódź ŒUVRE straße naïve": "odz-uvre-strae-naive", "ﬁn de ½ jour №5": "fin-de-12-jour-no5", "日本": "untitled", "": "untitled", "a" * 49 + " b": "a" * 49 + "-", "  --Élan--  ": "elan"}
    assert list(one(spark, *[slug(F.lit(t)) for t in cases])) == list(cases.values())


def test_dates_of_a_page(spark):
    from webloom.functions import html as H

    tags = [f'<meta {k}="{n}" content="d{i}">' for i, (k, n) in enumerate([("property", "article:published_time"), ("itemprop", "datePublished"), ("name", "dc.date"), ("name", "date"), ("name", "published_time")])]
    got = one(spark, *[H.published(F.lit("<head>" + "".join(tags[i:][::-1]))) for i in range(5)], H.published(F.lit('<time datetime="2024">')))
    assert list(got) == ["d0", "d1", "d2", "d3", "d4", None]


def test_links_and_media_of_markdown(spark):
    from webloom.functions import html as H

    md = '[One](/a "T") ![no](/i.png) [Two](b?x=1) <a href="../c" title="U"><b>Three</b></a> [again](/a) [m](mailto:x@y) [](#top) [](/empty)'
    base = F.lit("https://h.org/d/e/p.html")
    links, media = one(spark, H.link_list(F.lit(md), base), H.media_table(F.lit('![alt](/i.png "T") ![](v.mp4) <img src="/i.png" alt="x"> <img class="k" src="j.gif" alt="J">  ![](data:image/png;base64,A)'), base))
    assert [tuple(x) for x in links] == [
        ("https://h.org/a", "One", "T", "internal"), ("https://h.org/d/e/b?x=1", "Two", None, "internal"), ("https://h.org/empty", None, None, "internal"), ("https://h.org/d/c", "Three", "U", "internal"),
    ]
    assert [tuple(x) for x in media] == [("https://h.org/i.png", "alt", "T", "img"), ("https://h.org/d/e/v.mp4", None, None, "video"), ("https://h.org/d/e/j.gif", "J", None, "img")]


def test_media_addresses(spark):
    from webloom.functions import url as U

    got = one(spark, U.unproxied(F.lit("https://i0.wp.com/h.org/a/b.jpg?w=3&ssl=1")), U.unproxied(F.lit("ftp://x/y")), U.unproxied(F.lit("https://h.org/b.jpg")), U.media_cleaned(F.lit("https://i1.wp.com/x?url=https%3A%2F%2Fh.org%2Fz.png&w=1")), U.has_extension(F.lit("https://h.org/a.MP4?x=.png"), (".mp4",)), U.has_extension(F.lit("data:video/x"), (".mp4",)), U.has_extension(F.lit("https://h.mp4/a"), (".mp4",)), U.has_extension(F.lit(None).cast("string"), (".mp4",)))
    assert list(got) == ["https://h.org/a/b.jpg?w=3", None, "https://h.org/b.jpg", "https://h.org/z.png", True, True, False, False]


def test_quality_flags_and_reason(spark):
    from webloom.functions.quality import with_quality

    schema = "id int, http_status string, content_type string, crawled_at date, title string, description string, keywords string, canonical_url string, word_count int, content_length int, reading_time double, lang string, relevance double, published_at date, validllm string, readable string, readable_at date, approved_at date"
    day = datetime.date(2025, 5, 1)
    perfect = (1, "200", "text/html; charset=utf-8", day, "Title", "A description of more than twenty letters", "k", "https://h.org", 1500, 8000, 7.0, "fr", 6.0, day, "oui", "x" * 200, day, day)
    poor = (2, "301", None, day, "", None, "", None, 50, 5000, 0.1, "de", 0.2, datetime.date(2010, 1, 1), "non", "short", day, None)
    rows = [perfect, poor, (3, "404", *perfect[2:]), (4, "x", *perfect[2:]), (5, None, *perfect[2:]), (6, "200", "application/pdf", *perfect[3:]), (7, "200", "text/html", None, *perfect[4:])]
    got = {r["id"]: r for r in with_quality(spark.createDataFrame(rows, schema), F.array(F.lit("fr")), F.lit(datetime.date(2025, 6, 1))).collect()}
    assert got[1]["quality"] == 1.0 and got[1]["quality_flags"] == [] and got[1]["quality_reason"] == "Haute qualité (1.00): contenu riche et complet"
    assert got[2]["quality_flags"] == [
        "redirect", "no_title", "no_description", "no_keywords", "no_canonical", "very_short_content", "poor_text_ratio", "very_short_reading", "wrong_language", "low_relevance", "old_content",
        "llm_rejected", "short_readable", "not_approved",
    ]
    assert got[2]["quality_reason"].endswith("contenu trop court, langue incorrecte, faible pertinence")
    assert [got[i]["quality_flags"] for i in (3, 4, 5, 6, 7)] == [["http_error"], ["invalid_http_status"], ["no_http_status"], ["non_html_pdf"], ["not_crawled"]]
    assert all(got[i]["quality"] == 0 and got[i]["quality_reason"].startswith("Accès impossible: ") for i in (3, 4, 5, 6, 7))


def test_numbers_over_parts(spark):
    from webloom.operators.order import numbered

    rows = [(i % 3, (i * 37) % 101) for i in range(100)]
    got = numbered(spark.createDataFrame(rows, "g int, v int").repartition(5), "g", [F.col("v").desc()]).collect()
    for g in range(3):
        assert [r["v"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])] == sorted((v for k, v in rows if k == g), reverse=True)
        assert sorted(r["place"] for r in got if r["g"] == g) == list(range(1, sum(k == g for k, _ in rows) + 1))


def test_deep_trees_and_rings(spark):
    from webloom.operators.tags import descendants, nested_tree, tag_paths

    tree = spark.createDataFrame([(1, None, "a", 0), (2, 1, 'b"', 1), (3, 2, "c", 0), (4, 1, "d", 0), (5, 99, "e", 0), (6, 7, "f", 0), (7, 6, "g", 0)], "id int, parent_id int, name string, sorting int")
    paths = {r["id"]: (r["path"], r["depth"], r["is_leaf"]) for r in tag_paths(tree, "/").collect()}
    assert paths == {1: ("a", 0, False), 2: ('a/b"', 1, False), 3: ('a/b"/c', 2, True), 4: ("a/d", 1, True), 5: ("e", 0, True)}
    nested = {r["id"]: json.loads(r["tree"]) for r in nested_tree(tree).collect()}
    assert [c["id"] for c in nested[1]["children"]] == [4, 2] and nested[1]["children"][1]["children"][0]["name"] == "c" and nested[5]["children"] == []
    assert {(r["id"], r["distance"]) for r in descendants(tree, 1).collect()} == {(2, 1), (3, 2), (4, 1)}
    n = 200
    chain = [(i, i - 1 if i > 1 else None, f"t{i}", 0) for i in range(1, n + 1)] + [(1000 + i, 1000 + (i + 1) % 30, "ring", 0) for i in range(30)] + [(2000, 1000, "below a ring", 0), (2001, 3, "side", -1)]
    long = spark.createDataFrame(chain, "id int, parent_id int, name string, sorting int")
    found = {r["id"]: (r["path"], r["depth"]) for r in tag_paths(long).collect()}
    assert found == {i: ("_".join(f"t{k}" for k in range(1, i + 1)), i - 1) for i in range(1, n + 1)} | {2001: ("t1_t2_t3_side", 3)}
    (row,) = nested_tree(long).collect()
    sys.setrecursionlimit(5000)
    at = json.loads(row["tree"])
    for i in range(1, n + 1):
        assert (at["id"], at["name"]) == (i, f"t{i}")
        assert [c["id"] for c in at["children"]] == ([2001, 4] if i == 3 else [i + 1] if i < n else [])
        at = at["children"][-1] if i < n else None
    assert descendants(long, 100).count() == 100


def test_element_tree(spark):
    from webloom.functions import html as H
    from webloom.functions import tree as T

    def text_of(page, use=T.main_content):
        return one(spark, T.bound(T.parsed(F.lit(page)), lambda t: use(t)))[0]

    long, longer = "word " * 45, "other " * 60
    two = f"<body><article><p>{long}</p></article><p>between</p><article><h2>T&amp;U</h2>{longer}<script>var x='</article>'</script></article></body>"
    assert text_of(two) == "T&U\n" + longer.strip()
    assert text_of(f"<nav>menu</nav><div id=content class='x'>short</div><div class='a post-body'>{long}</div>") == long.strip()
    assert text_of(f'<div role="main">{long}<br>{long}</div>') == f"{long.strip()}\n{long.strip()}"
    assert text_of(f"<p>{'a' * 60}<p>{'b' * 60}</p><p>c</p>") == f"{'a' * 60}{'b' * 60}c\n\n{'b' * 60}"
    assert text_of("<nav>menu</nav><p>few <b>words</b></p><aside>beside</aside><style>p{}</style>") == "few\nwords"
    assert text_of("no markup at all") == "no markup at all" and text_of("") == "" and one(spark, H.main_content(F.lit(None).cast("string")))[0] is None
    old = '<title>T</title><div class="box menu">m</div><form>f</form>a <b>b</b>\n  <img src="i.png"> <video src=v.mp4>no video</video>\n\n<audio></audio><aside>c</aside>'
    assert one(spark, H.marked_lines(F.lit(old)))[0] == "T a  b\n[IMAGE: i.png]   [VIDEO: v.mp4]\nc"
    shapes = "<ul><li class='a b'>1<li>2</ul></div><p title='x > y' hidden>3</p><!-- <p> --><br/>4 < 5"
    tree = T.read_page(shapes)
    assert [(e["tag"], e["first"], e["last"]) for e in tree["elements"]] == [("ul", 1, 6), ("li", 2, 6), ("li", 4, 6), ("p", 7, 9), ("br", 10, 10)]
    assert [n for n in tree["nodes"] if n] == ["1", "2", "3", "4 < 5"] and dict(tree["elements"][3]["attrs"]) == {"title": "x > y", "hidden": ""}


def test_references_without_semicolon_stay():
    from webloom.functions import tree as T

    page = "<h1>a&amp;&amp;&amp</h1>&lt;&gt; &copy x&#233;&#xe9; &#233 &amp;lt; &notit; &nosuch; &"
    assert "".join(n for n in T.read_page(page)["nodes"] if n) == "a&&&amp<> &copy xéé &#233 &lt; &notit; &nosuch; &"


def test_all_media_of_a_page(spark):
    from webloom.functions import html as H

    page = (
        '<audio src="s.mp3"></audio><img src="/a.png" srcset="/a.png 1x, b.png 2x,"><video><source src="v.webm"><p><source src="v.mp4"></p></video><source src="x.mp4">'
        '<img data-src="l.png"><img src="data:image/png;base64,A"> ![m](c_(1).png "t") [AUDIO: https://o.org/t.mp3] [image: a.png] [VIDEO: none'
    )
    got = one(spark, H.page_media(F.lit(page), F.lit("https://h.org/d/p")))[0]
    assert [tuple(x) for x in got] == [
        ("https://h.org/a.png", "img"), ("https://h.org/d/b.png", "img"), ("https://h.org/d/v.webm", "video"), ("https://h.org/d/v.mp4", "video"), ("https://h.org/d/s.mp3", "audio"),
        ("https://h.org/d/c_(1).png", "img"), ("https://o.org/t.mp3", "audio"), ("https://h.org/d/a.png", "img"),
    ]


def test_brackets_of_markdown(spark):
    from webloom.functions import html as H

    md = "[a](b_(c)) [d](e (f) ![g](h 'x') [i] j](k) [l](m \"n\") [o]() ](p) [q](r"
    got = one(spark, H.brackets(F.lit(md)))[0]
    assert [(x["image"], x["label"], x["inner"], x["address"], x["title"]) for x in got] == [
        (False, "a", "b_(c)", "b_(c)", None), (False, "d", "e (f", None, None), (True, "g", "h 'x'", None, None), (False, "l", 'm "n"', "m", "n"), (False, "o", "", None, None),
    ]
    old = "see (https://h.org/a_(b)) and (ftp://x.y/z) (http://?no) (https://h.org/c(d) (mailto:x) ((https://e.f/g))"
    assert one(spark, H.parenthesised_links(F.lit(old)))[0] == ["https://h.org/a_(b", "ftp://x.y/z", "https://h.org/c(d", "https://e.f/g"]
