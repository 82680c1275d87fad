"""Pages whose marks, hints and neighbours decide what is main text."""

import random
import time

import pytest

from webloom.llm import html_extract

PROSE = ("The cat sat on the mat and it was not for the dog that the man had to go out in the rain with his hat. " * 3).strip()
RUSSIAN = "Вчера вечером дети гуляли у реки. Потом пошёл сильный дождь, и все побежали домой! " * 4
RUSSIAN = RUSSIAN.strip()
ITALIAN = ("Il gatto dorme sopra il tavolo della cucina. Nessuno vuole svegliarlo prima di cena. " * 4).strip()
FIGURES = " ".join(f"{k * 37} {k * 91}" for k in range(60))
LINKS = '<ul><li><a href="/a">One more story of the day</a></li><li><a href="/b">Another story of the day</a></li></ul>'
CARDS = "".join(f'<article class="teaser"><h3>Card {k}</h3><p>Read it today.</p></article>' for k in range(3))


@pytest.mark.parametrize(
    "page, text",
    [
        # text in a plain div outweighs cards
        (f"<body><div id='main'><h2>News</h2><p>{PROSE}</p><p>Yes.</p><p>{PROSE}</p></div>{CARDS}</body>", f"News\n{PROSE}\nYes.\n{PROSE}"),
        # a short notice outside does not outweigh the article
        (f"<body><article><p>{PROSE}</p><p>{PROSE}</p></article><div><p>{PROSE}</p></div></body>", f"{PROSE}\n{PROSE}"),
        # comments nested in the article, and after it in the same main
        (f'<article class="post"><p>{PROSE}</p><article class="comment"><p>{PROSE}</p></article></article>', PROSE),
        (f'<main><article class="has-sidebar"><p>{PROSE}</p></article><article class="comment"><p>{PROSE}</p></article></main>', PROSE),
        # the outermost is exempt from hints
        (f'<article class="has-sidebar"><p>{PROSE}</p></article>', PROSE),
        (f'<main class="with-menu"><p>{PROSE}</p></main>', PROSE),
        # open blocks in the article inherit from lists of links on both sides, and from the good side
        (f"<article><p>{PROSE}</p>{LINKS}<p>Most read this week</p>{LINKS}<p>{PROSE}</p></article>", f"{PROSE}\n{PROSE}"),
        (f"<article><p>{PROSE}</p><p>Yes.</p>{LINKS}<p>{PROSE}</p></article>", f"{PROSE}\nYes.\n{PROSE}"),
        (f"<article><p>Short.</p>{LINKS}</article>", "Short."),
        # top-level articles that say they are none, and names that only hold such a word
        (f'<article class="post"><p>{PROSE}</p></article><article class="comment" id="comment-7"><p>{PROSE}</p></article>', PROSE),
        (f'<main><p>{PROSE}</p><article class="related teaser"><p>{PROSE}</p></article></main>', PROSE),
        (f'<article><p class="social-history">{PROSE}</p><section id="related-work"><p>{PROSE}</p></section><p class="postComments-list">Hi</p></article>', f"{PROSE}\n{PROSE}"),
        # languages whose function words are not listed
        (f"<body>{LINKS}<p>{RUSSIAN}</p><p>Да.</p><p>{RUSSIAN}</p></body>", f"{RUSSIAN}\nДа.\n{RUSSIAN}"),
        (f"<body><div>{LINKS}</div><p>{ITALIAN}</p><footer>Tutti i diritti</footer></body>", ITALIAN),
        # what holds few stop words stays between good neighbours
        (f"<body><p>{PROSE}</p><pre>{FIGURES}</pre><p>{PROSE}</p></body>", f"{PROSE}\n{FIGURES}\n{PROSE}"),
        # readers' comments by other names
        (f'<article><p>{PROSE}</p><section class="reader-comments"><p>{PROSE}</p></section></article>', PROSE),
        (f'<article><p>{PROSE}</p><section class="discussion"><h2>Comments</h2><p>{PROSE}</p></section></article>', PROSE),
        # a sentence that opens like a notice is none
        (f"<article><p>{PROSE}</p><p>All rights reserved clauses were struck by the court in the end.</p><p>All rights reserved. © 2024</p></article>", f"{PROSE}\nAll rights reserved clauses were struck by the court in the end."),
        # notices and adverts inside an article
        (f"<article><p>{PROSE}</p><p>Sponsored by X</p><p>{PROSE}</p><p>Disclaimer: this is no advice.</p></article>", f"{PROSE}\n{PROSE}"),
        # text of mathematics, drawings and objects
        (f"<article><p>{PROSE} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> <svg><title>no</title><text>label</text></svg><object>it</object></p></article>", f"{PROSE} x=2 labelit"),
        # damaged markup
        (f'<article><p title="never closed>{PROSE}</p><p>{PROSE}</p></article>', f"{PROSE}\n{PROSE}"),
        (f"<article><p>{PROSE} 1 < 2 <3 a<b and <</p><p>{PROSE}</p></article>", f"{PROSE} 1 < 2 <3 a\n{PROSE}"),
        (f"<article><p>{PROSE}</p><noscript><p>{PROSE}</p></article>", f"{PROSE}\n{PROSE}"),
        (f"<article hidden><p>{PROSE}</p></article><div><p>{PROSE}</p></div>", PROSE),
        # no mark at all
        (f"<body><nav>{LINKS}</nav><div><p>{PROSE}</p><p>Yes.</p><p>{PROSE}</p></div><div>{LINKS}</div></body>", f"{PROSE}\nYes.\n{PROSE}"),
    ],
)
def test_blocks(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("unit", ["<a ", '<a href="', "<!", "<!-- ", "<p class='", "</script", "<select>", "<div></section>", "<a class=", "&amp", "<", 'x="', "<p x='\">"])
def test_time_grows_with_the_length(unit):
    begin = time.process_time()
    html_extract.main_text("<article><p>" + unit * (1_000_000 // len(unit)))
    assert time.process_time() - begin < 4


def brute_labels(blocks):
    """The second pass by its definition: each open block looks for its nearest decided neighbours of the same article."""
    first = html_extract.classify([html_extract.Block(b.text, b.linked, b.bad, b.article, b.heading) for b in blocks], second_pass=False)
    out = []
    for i, b in enumerate(first):
        if b.label != "open":
            out.append(b.label)
            continue
        near = {}
        for side, order in (("left", range(i - 1, -1, -1)), ("right", range(i + 1, len(first)))):
            for j in order:
                o = first[j]
                if o.article == b.article and o.label != "open" and not (o.bad and o.article):
                    near[side] = (o.label, abs(j - i))
                    break
        left, right = near.get("left", ("", 0)), near.get("right", ("", 0))
        if b.article and not (left[0] and right[0]):
            label = right[0] or "good" if b.heading else "good"
        elif left[0] == right[0]:
            label = left[0] or "bad"
        elif b.heading:
            label = right[0] or "bad"
        elif not left[0] or not right[0]:
            label = "bad" if len(b.text) < 70 else left[0] or right[0]
        else:
            good, bad = sorted([left, right], key=lambda x: x[0] == "bad")
            nearer = good[1] < bad[1] or good[1] == bad[1] and (left[0] == "good" or b.article)
            label = "good" if nearer or len(b.text) >= 70 else "bad"
        out.append(label)
    return out


def test_labels_as_by_brute_force():
    rng = random.Random(4)
    texts = ["Yes.", PROSE, "Zz qq xx " * 12, "the a of " * 8, "Two words", PROSE[:150]]
    for _ in range(300):
        blocks = []
        for _ in range(rng.randint(1, 14)):
            text = rng.choice(texts).strip()
            blocks.append(html_extract.Block(text, rng.choice([0, 0, len(text)]), rng.random() < 0.15, rng.choice([0, 0, 1, 2]), rng.random() < 0.2))
        wanted = brute_labels(blocks)
        assert [b.label for b in html_extract.classify(blocks)] == wanted


def test_repeated_rows_and_clashing_names(spark):
    page = f"<article><p>{PROSE}</p></article>"
    rows = [(1, "u", page, 5, "t"), (1, "u", page, 5, "t"), (None, None, page * 400, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, N_CHARS int, Text string")
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in html_extract.extract(df).collect())
    assert got == [(0, 400 * len(PROSE) + 399), (1, len(PROSE)), (1, len(PROSE))]
