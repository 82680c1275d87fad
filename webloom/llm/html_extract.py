"""Main text of web pages by two passes of block rules.

The first pass labels each block on its own: blocks inside menus, footers, sidebars, forms, adverts,
notices and reader comments, and blocks that are mostly links, are bad; long blocks rich in stop words are
good; short ones, headings and blocks without links that are poor in stop words are left open. On a page in whose
text the listed stop words are rare, as in another language, ends of sentences count instead. In the second pass an open block
inherits from its nearest decided neighbours: good where both sides, or the nearer good side, allow it.
Blocks of a marked article stand by themselves: what is open there looks at neighbours of the same article
only, and is good where the article decides nothing else; an advert or a menu in it decides nothing.
Where the good text outside is longer than that of the marked articles, as on a page whose articles are
cards, the marks are no evidence, and the page is labelled without them.

Class, id and role are hints where a whole name says what an element is: ``comment``, ``nav-menu`` or
``related-posts`` do, ``social-history`` and ``has-sidebar`` do not. Articles are subject to them, ``main`` is not.
Short blocks that open like a notice or an advert are bad wherever they stand.

Null handling: a null or empty page has an empty text. Unclosed and stray tags are tolerated, markup in
scripts, styles and comments is not markup; behind a quote that never closes, quotes mean nothing any more. The
time grows with the length of a page and no faster, whatever it holds. Equal pages get equal texts, repeated rows
stay. Other columns pass through; ``text`` and ``n_chars`` give way to the new ones. An empty table gives an empty one.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from webloom.llm.columns import text_list, with_computed

#: Common function words of the languages that the rules look at.
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by can for from had has have he her his if in is it its not of on or
    she so that the their they this to was we were which will with you
    aber als am auch auf aus bei bis das dass dem den der des die du ein eine einen einer er es für hat ich
    ihr im ist mit nach nicht noch nur oder sich sie sind so um und uns vom von vor war wie wir zu zum zur
    au aux avec ce ces cette dans de des du elle en est et eux il je la le les leur lui mais ne nous on ou où
    par pas plus pour qu que qui sa sans se ses son sont sur tu un une vous
    al como con cual cuando de del desde dos el ella en entre era es esta este fue ha la las lo los mas más me
    mi muy no nos o para pero por que qué se ser si sin sobre su sus también un una uno y ya
    """.split()
)
#: Elements whose content is no text of the page; the first four hold no markup either.
RAW_TEXT = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "select")
BAD_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "head"}
NESTING = BAD_TAGS | {
    "article", "main", "section", "div", "header", "ul", "ol", "dl", "table", "tbody", "thead", "tr", "td", "th",
    "blockquote", "figure", "details", "body", "html", "center",
}
BLOCKS = NESTING | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "hr", "address", "figcaption", "option", "caption", "summary", "legend", "label"}
#: Names of what is not the article, and words that may stand beside them in a class or an id.
HINTS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies
    consent discussion discussions disqus disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification
    pagination popup promo promos promotion promoted related replies reply respond share sharing sidebar signup sitemap social
    sponsor sponsored sponsors subscribe subscription teaser teasers toolbar topbar widget widgets alert alerts
    """.split()
)
BESIDE = frozenset(
    """
    a area articles bar block body bottom box button buttons card center column container content div entry feed form global group
    header icon icons inner item items left link links list main message module outer page panel popular post posts primary reader readers right
    row secondary section site slot small space stories strip text thread top unit user view wrap wrapper
    """.split()
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu", "menubar", "alertdialog"}
#: How notices and adverts open.
NOTICE = re.compile(
    r"(?:advertisement|sponsored(?: by| content| post|$)|paid (?:post|content|partnership)|promoted(?: by| content|$)|disclaimer\W*(?::|$)|all rights reserved\W*(?:$|©|\()"
    r"|(?:we|this (?:web)?site) uses? cookies|share this (?:article|post|story|page)|follow us(?: on\b|\W*$)|sign up (?:for|to) (?:our|the)|subscribe to (?:our|the)"
    r"|anzeige$|werbung$|gesponsert(?: von|$)|haftungsausschluss\W*(?::|$)|alle rechte vorbehalten\W*(?:$|©|\()|wir verwenden cookies"
    r"|publicité$|sponsorisé(?: par|$)|tous droits réservés\W*(?:$|©|\()|nous utilisons des cookies"
    r"|publicidad$|patrocinado(?: por|$)|todos los derechos reservados\W*(?:$|©|\()|utilizamos cookies)",
    re.I,
)
SENTENCE_END = re.compile(r"[.!?…](?=[\s\"'»”)]|$)|[。！？।؟]")
HINTING = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
QUOTED = re.compile(r"""=\s*+(?:"[^"]*+"|'[^']*+')""")
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w=-])", re.I)
NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile(r""">|=[ \t\n\f\r]*["']""")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW_TEXT}
PART = re.compile(r"[a-z]+")
WORD = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("text", "linked", "bad", "article", "heading", "label")

    def __init__(self, text, linked, bad, article, heading):
        self.text, self.linked, self.bad, self.article, self.heading = text, linked, bad, article, heading
        self.label = ""


def _names(value: str) -> bool:
    """Does one of these names say that the element is not the article?"""
    for name in value.split():
        parts = PART.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
        if any(p in HINTS for p in parts) and all(p in HINTS or p in BESIDE for p in parts):
            return True
    return False


def _hinted(attributes: str) -> bool:
    """Do class, id, role or hidden speak against an element?"""
    for name, a, b, c in HINTING.findall(attributes):
        name, value = name.lower(), (a or b or c)
        if name in ("class", "id"):
            if _names(value):
                return True
        elif value.lower() in ROLES if name == "role" else value.lower() != "false":
            return True
    return "hidden" in attributes.lower() and bool(HIDDEN.search(QUOTED.sub("", attributes)))


class Scanner:
    """A page from left to right: texts and tags. Nothing is read again, so the time is in proportion to the length."""

    def __init__(self, page: str):
        self.page, self.at, self.quotes = page, 0, True
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.endless: set[str] = set()

    def _tag_end(self, at: int) -> int:
        page, begin = self.page, at
        while self.quotes:
            stop = STOP.search(page, at)
            if not stop:
                break
            mark = page[stop.end() - 1]
            if mark == ">":
                return stop.start()
            if stop.end() > self.last[mark]:
                break
            at = page.find(mark, stop.end()) + 1
        self.quotes = False
        return page.find(">", begin)

    def skip(self, name: str) -> None:
        """Go behind the end of an element whose content is no text; one that never ends holds nothing, or all the rest."""
        if name in self.endless:
            return
        end = RAW_END[name].search(self.page, self.at)
        close = self.page.find(">", end.end()) if end else -1
        if close >= 0:
            self.at = close + 1
        elif name in RAW_TEXT[:4]:
            self.at = len(self.page)
        else:
            self.endless.add(name)

    def __iter__(self):
        """("", text, "") or (name, "/" or "", attributes)."""
        page, size = self.page, len(self.page)
        while self.at < size:
            begin = page.find("<", self.at)
            if begin < 0:
                begin = size
            if begin > self.at:
                text, self.at = page[self.at : begin], begin
                yield "", text, ""
                continue
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 2)
                self.at = size if end < 0 else end + 3
                continue
            name = NAME.match(page, begin + 1)
            if begin > self.last[">"] or not name and page[begin + 1 : begin + 2] not in ("!", "?"):
                self.at = begin + 1
                yield "", "<", ""
            elif not name:
                self.at = page.find(">", begin) + 1
            else:
                end = self._tag_end(name.end())
                self.at = end + 1
                yield name[2].lower(), name[1], page[name.end() : end]


def blocks_of(page: str) -> list[Block]:
    """The blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = [("", False, 0)]  # tag, bad, number of the article it belongs to
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked_parts: list[str] = []
    state = {"bad": False, "heading": False}
    articles, in_link = 0, False

    def close():
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                linked = len(" ".join(html_lib.unescape("".join(linked_parts)).split()))
                out.append(Block(text, linked, stack[-1][1] or state["bad"], stack[-1][2], state["heading"]))
        parts.clear()
        linked_parts.clear()
        state["bad"] = state["heading"] = False

    scanner = Scanner(page)
    for name, text, attributes in scanner:
        if not name:
            parts.append(text)
            if in_link:
                linked_parts.append(text)
        elif text == "/":
            if name == "a":
                in_link = False
            elif name in BLOCKS:
                close()
                if open_tags[name]:
                    while True:
                        top = stack.pop()[0]
                        open_tags[top] -= 1
                        if top == name:
                            break
        elif name in RAW_END:
            if not attributes.endswith("/"):
                scanner.skip(name)
        elif name == "a":
            in_link = True
        elif name in ("br", "wbr", "img"):
            parts.append(" ")
        elif name in BLOCKS:
            close()
            in_link = False
            bad, article = stack[-1][1], stack[-1][2]
            if name in ("article", "main") and not article:
                articles += 1
                article = articles
            bad = bad or name in BAD_TAGS or (name == "header" and not article)
            if name not in ("html", "body", "main"):
                bad = bad or _hinted(attributes)
            if name in NESTING:
                stack.append((name, bad, article))
                open_tags[name] += 1
            else:
                state["bad"], state["heading"] = bad, len(name) == 2 and name[0] == "h"
    close()
    return out


def stop_word_density(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def list_fits(blocks: list[Block], few: float) -> bool:
    """Are the stop words those of the page's language? All its text without links and marks of its own speaks for it."""
    text = " ".join(b.text for b in blocks if not b.linked and not b.bad)
    return stop_word_density(text) >= few


def sentence_density(text: str, few: float, many: float) -> float:
    """What stands in for the density of stop words in other languages: prose has several sentences."""
    ends = len(SENTENCE_END.findall(text))
    return many if ends >= 2 else few if ends else 0.0


def classify(
    blocks: list[Block],
    short: int = 70,
    long: int = 200,
    most_linked: float = 0.33,
    few_stop_words: float = 0.15,
    many_stop_words: float = 0.3,
    second_pass: bool = True,
) -> list[Block]:
    """Label every block ``good`` or ``bad``; the first pass alone leaves some ``open``."""
    known = list_fits(blocks, few_stop_words)
    for b in blocks:
        density = b.linked / len(b.text)
        if b.bad or density > most_linked or len(b.text) < long and NOTICE.match(b.text):
            b.label = "bad"
        elif b.heading or len(b.text) < short:
            b.label = "bad" if b.linked and not b.article and not b.heading else "open"
        else:
            rich = stop_word_density(b.text) if known else sentence_density(b.text, few_stop_words, many_stop_words)
            if rich >= many_stop_words and len(b.text) > long or b.article and rich >= few_stop_words:
                b.label = "good"
            elif rich >= few_stop_words or b.article:
                b.label = "open"
            else:
                b.label = "open" if density == 0 else "bad"  # neighbours decide on tables of figures, code and verse
    if not second_pass:
        return blocks
    n = len(blocks)
    before: list[tuple[str, int]] = []
    last = {}
    for i, b in enumerate(blocks):
        key = b.article
        before.append(last.get(key, ("", 0)))
        if b.label != "open" and not (b.bad and b.article):  # an advert inside an article says nothing about its neighbours
            last[key] = (b.label, i)
    after: list[tuple[str, int]] = [("", 0)] * n
    last = {}
    for i in range(n - 1, -1, -1):
        b = blocks[i]
        after[i] = last.get(b.article, ("", 0))
        if b.label != "open" and not (b.bad and b.article):
            last[b.article] = (b.label, i)
    decided = []
    for i, b in enumerate(blocks):
        if b.label != "open":
            decided.append(b.label)
            continue
        (left, li), (right, ri) = before[i], after[i]
        if b.article and not (left and right):  # the mark speaks for the side that decides nothing
            decided.append(right or "good" if b.heading else "good")
        elif left == right:
            decided.append(left or "bad")
        elif b.heading:
            decided.append(right or "bad")
        elif not left or not right:
            decided.append("bad" if len(b.text) < short else left or right)
        else:
            to_good, to_bad = (i - li, ri - i) if left == "good" else (ri - i, i - li)
            near = to_good < to_bad or to_good == to_bad and (left == "good" or b.article)
            decided.append("good" if near or len(b.text) >= short else "bad")
    for b, label in zip(blocks, decided):
        b.label = label
    return blocks


def main_text(page: str) -> str:
    """The good blocks in page order, joined by line feeds."""
    if not page:
        return ""
    blocks = classify(blocks_of(page))
    good = [b for b in blocks if b.label == "good"]
    inside = [b for b in good if b.article]
    if inside:  # a marked article is the main text, unless what stands outside outweighs it
        if 2 * sum(len(b.text) for b in inside) >= sum(len(b.text) for b in good):
            good = inside
        else:
            for b in blocks:
                b.article = 0
            good = [b for b in classify(blocks) if b.label == "good"]
    return "\n".join(b.text for b in good)


OUTPUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` plus ``text`` and ``n_chars``, the code points of the text."""

    def make():
        def compute(pages_):
            texts = [main_text(p) for p in text_list(pages_)]
            return [texts, [len(t) for t in texts]]

        return compute

    return with_computed(pages, [html_col], OUTPUT, make)
