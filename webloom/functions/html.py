"""HTML and Markdown rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import tree
from webloom.functions.text import bound, strip
from webloom.functions.url import link_type, media_type, resolved


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def _first(html: Column, *patterns: str) -> Column:
    found = [F.nullif(strip(F.regexp_extract(html, p, 1)), F.lit("")) for p in patterns]
    return F.coalesce(*found)


def meta(html: Column, key: str, name: str) -> Column:
    """The content of a meta element, whichever attribute comes first."""
    after = rf'(?is)<meta[^>]*\b{key}\s*=\s*["\']{name}["\'][^>]*\bcontent\s*=\s*["\']([^"\']*)["\']'
    before = rf'(?is)<meta[^>]*\bcontent\s*=\s*["\']([^"\']*)["\'][^>]*\b{key}\s*=\s*["\']{name}["\']'
    return _first(html, after, before)


def title(html: Column) -> Column:
    return F.coalesce(meta(html, "property", "og:title"), meta(html, "name", "twitter:title"), _first(html, r"(?is)<title[^>]*>(.*?)</title>"))


def description(html: Column) -> Column:
    return F.coalesce(meta(html, "property", "og:description"), meta(html, "name", "twitter:description"), meta(html, "name", "description"))


def keywords(html: Column) -> Column:
    return meta(html, "name", "keywords")


def language(html: Column) -> Column:
    return _first(html, r'(?is)<html[^>]*\blang\s*=\s*["\']([^"\']+)["\']')


def canonical(html: Column) -> Column:
    link = r'(?is)<link[^>]*\brel\s*=\s*["\']canonical["\'][^>]*\bhref\s*=\s*["\']([^"\']+)["\']'
    return F.coalesce(_first(html, link), meta(html, "property", "og:url"))


def published(html: Column) -> Column:
    """The date that the page gives for itself, as it stands there."""
    return F.coalesce(
        meta(html, "property", "article:published_time"),
        meta(html, "itemprop", "datePublished"),
        meta(html, "name", "dc.date"),
        meta(html, "name", "date"),
        meta(html, "name", "published_time"),
    )


def main_content(html: Column, least: int = 100) -> Column:
    """The main text of a page: see ``functions.tree``."""
    return bound(tree.parsed(html), lambda page: tree.main_content(page, least))


def content_source(html: Column, readable: Column, archived: Column, least: int = 100) -> Column:
    """Which of the sources gives the text of a page, in order of preference."""
    long = lambda c: F.length(F.coalesce(c, F.lit(""))) >= least
    return bound(
        tree.parsed(html),
        lambda page: F.when(long(readable), "extractor")
        .when(long(archived), "archive")
        .when(F.length(F.coalesce(tree.smart_content(page), F.lit(""))) > least, "smart")
        .when(long(tree.plain_content(page)), "plain")
        .otherwise("none"),
    )


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def brackets(text: Column) -> Column:
    """(image, label, inner, address, title) of what Markdown puts in square and round brackets, in order.

    The text is cut where one closes and the other opens: the label ends the part before, the address begins the part
    after and goes on to the round bracket that balances it. ``address`` is null where there is none, or where more
    than a quoted title follows it.
    """
    parts = F.split(text, r"\]\(", -1)

    def closed(part: Column) -> Column:
        first = F.substring_index(part, ")", 1)
        return bound(
            F.struct(first.alias("first"), F.call_function("substring_index", part, F.lit(")"), _count(first, "(") + 1).alias("wide")),
            lambda c: F.when((_count(c["wide"], "(") == _count(c["wide"], ")")) & (F.length(c["wide"]) < F.length(part)), c["wide"]).otherwise(c["first"]),
        )

    def link(at: Column) -> Column:
        before, after = F.get(parts, at - 1), F.get(parts, at)
        label, inner = F.substring_index(before, "[", -1), closed(after)
        mark = F.substring(before, F.length(before) - F.length(label) - 1, F.lit(1))
        holds = before.contains("[") & ~label.contains("]") & (F.length(inner) < F.length(after))
        found = F.struct((mark == "!").alias("image"), label.alias("label"), inner.alias("inner"))
        return F.when(holds, found)

    def read(x: Column) -> Column:
        bare = strip(F.regexp_replace(x["inner"], r'\s"[^"]*"\s*$', ""))
        title = F.nullif(strip(F.regexp_extract(x["inner"], r'\s"([^"]*)"\s*$', 1)), F.lit(""))
        address = F.when((bare != "") & ~bare.rlike(r'[\s"]'), bare)
        return F.struct(x["image"].alias("image"), x["label"].alias("label"), x["inner"].alias("inner"), address.alias("address"), title.alias("title"))

    places = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(F.transform(places, link), lambda x: x.isNotNull()), read)


def markers(text: Column) -> Column:
    """(url, type) of the marker lines that stand for media: ``[VIDEO: address]``."""
    parts = F.split(text, r"\[", -1)
    kind = lambda p: F.upper(F.substring_index(p, ":", 1))
    found = F.filter(parts, lambda p: kind(p).isin("IMAGE", "VIDEO", "AUDIO") & p.contains(":") & p.contains("]"))
    address = lambda p: strip(F.substring_index(F.substring(p, F.instr(p, ":") + 1, F.length(p)), "]", 1))
    typed = lambda p: F.when(kind(p) == "IMAGE", "img").otherwise(F.lower(kind(p)))
    return F.transform(found, lambda p: F.struct(address(p).alias("url"), typed(p).alias("type")))


def markdown_links(text: Column) -> Column:
    """(anchor, url) of inline links; images are no links, anchors are cut at 200 characters."""
    named = lambda a: F.when(strip(a) == "", F.lit("No text")).otherwise(F.substring(strip(a), 1, 200))
    address = lambda x: F.element_at(F.split(strip(x["inner"]), r"\s"), 1)
    found = F.filter(brackets(text), lambda x: ~x["image"] & (strip(x["inner"]) != ""))
    return F.transform(found, lambda x: F.struct(named(x["label"]).alias("anchor"), address(x).alias("url")))


def _first_by_url(found: Column) -> Column:
    """Of structs with one ``url``, the first."""
    urls = F.transform(found, lambda x: x["url"])
    return F.filter(found, lambda x, i: (F.array_position(urls, x["url"]) == i + 1))


def _named(found: Column, label: str) -> Column:
    """Bracketed addresses as (label, url, title)."""
    part = lambda c: F.nullif(strip(c), F.lit(""))
    return F.transform(F.filter(found, lambda x: x["address"].isNotNull()), lambda x: F.struct(part(x["label"]).alias(label), x["address"].alias("url"), x["title"].alias("title")))


def link_list(text: Column, base: Column) -> Column:
    """(url, anchor, title, link_type) of Markdown links and HTML anchors, absolute, each address once."""
    found = F.concat(_named(F.filter(brackets(text), lambda x: ~x["image"]), "anchor"), bound(tree.parsed(text), tree.links))
    outside = lambda x: F.lower(x["url"]).rlike(r"^(?:#|mailto:|tel:|javascript:|data:)")
    full = F.transform(F.filter(found, lambda x: ~outside(x)), lambda x: F.struct(resolved(base, x["url"]).alias("url"), x["anchor"].alias("anchor"), x["title"].alias("title")))
    typed = F.transform(full, lambda x: F.struct(x["url"].alias("url"), x["anchor"].alias("anchor"), x["title"].alias("title"), link_type(base, x["url"]).alias("link_type")))
    return bound(typed, _first_by_url)


def media_table(text: Column, base: Column) -> Column:
    """(url, alt, title, type) of Markdown images and HTML images, absolute, each address once."""
    inline, images = _named(F.filter(brackets(text), lambda x: x["image"]), "alt"), bound(tree.parsed(text), tree.images)
    full = lambda x, kind: F.struct(resolved(base, x["url"]).alias("url"), x["alt"].alias("alt"), x["title"].alias("title"), kind(resolved(base, x["url"])).alias("type"))
    kept = lambda x: ~F.lower(x["url"]).startswith("data:")
    both = F.concat(
        F.transform(F.filter(inline, kept), lambda x: full(x, media_type)), F.transform(F.filter(images, kept), lambda x: full(x, lambda u: F.lit("img")))
    )
    return bound(both, _first_by_url)


def page_media(text: Column, base: Column) -> Column:
    """(url, type) of all media of a page or a Markdown text, absolute, each address once.

    Media elements come first, with the candidates of ``srcset`` and the sources of video and audio, then Markdown
    images, then markers.
    """
    images = F.filter(brackets(text), lambda x: x["image"] & x["address"].isNotNull())
    found = F.concat(bound(tree.parsed(text), tree.media_addresses), _typed(F.transform(images, lambda x: x["address"]), "img"), markers(text))
    kept = F.filter(found, lambda x: (x["url"] != "") & ~F.lower(x["url"]).startswith("data:"))
    return bound(F.transform(kept, lambda x: F.struct(resolved(base, x["url"]).alias("url"), x["type"].alias("type"))), _first_by_url)


def bare_markdown_links(text: Column) -> Column:
    """What stands in the round brackets of Markdown links, images included, up to the first that closes."""
    return F.transform(brackets(text), lambda x: F.substring_index(x["inner"], ")", 1))


#: The schemes of the older form.
SCHEMES = "https?|ftp"


def parenthesised_links(text: Column) -> Column:
    """Web addresses in round brackets, as the older form reads them.

    In a run without white space the address goes on to the last closing bracket. Another one at its end is taken off,
    unless the address opens more brackets than it closes.
    """
    tails = F.transform(F.split(text, r"\s+"), lambda run: F.regexp_extract(run, rf"\(((?:{SCHEMES})://.*)$", 1))
    cut = lambda t: F.substring(t, F.lit(1), F.length(t) - F.length(F.substring_index(t, ")", -1)) - 1)
    whole = F.transform(F.filter(tails, lambda t: t.contains(")")), cut)
    good = F.filter(whole, lambda u: u.rlike(r"^[a-z]+://[^/$.?#]."))
    extra = lambda u: u.endswith(")") & (_count(u, "(") <= _count(u, ")"))
    return F.transform(good, lambda u: F.when(extra(u), F.substring(u, F.lit(1), F.length(u) - 1)).otherwise(u))


def enriched(text: Column, html: Column, base: Column) -> dict[str, Column]:
    """Markdown with marker lines for the media of its HTML, and the list of all its media, each address once."""
    kinds = {"img": "![IMAGE](%s)", "video": "[VIDEO: %s]", "audio": "[AUDIO: %s]"}

    def sources(kind):
        addresses = lambda page: F.filter(F.transform(tree.select(page, kind), lambda e: tree.attribute(e, "src")), lambda u: u.isNotNull())
        return F.transform(F.coalesce(bound(tree.parsed(html), addresses), F.array().cast("array<string>")), lambda u: resolved(base, u))

    found = {k: sources(k) for k in kinds}
    marker = lambda form: lambda u: F.format_string(form, u)
    lines = F.concat(*[F.transform(found[k], marker(form)) for k, form in kinds.items()])
    more = F.transform(F.filter(brackets(text), lambda x: x["image"]), lambda x: resolved(base, x["inner"]))
    media = F.concat(*[_typed(found[k], k) for k in kinds])
    known = F.concat(*found.values())
    media = F.concat(media, _typed(F.array_except(more, known), "img"))
    whole = F.when(F.size(lines) > 0, F.concat(text, F.lit("\n\n"), F.array_join(lines, "\n"))).otherwise(text)
    return {"markdown": whole, "media": media}


def marked_lines(html: Column) -> Column:
    """Text of a page with its media as markers: see ``functions.tree``."""
    return bound(tree.parsed(html), lambda page: tree.marked_lines(page))


def _typed(urls: Column, kind: str) -> Column:
    return F.transform(urls, lambda u: F.struct(u.alias("url"), F.lit(kind).alias("type")))


def markdown_media(text: Column) -> Column:
    """(url, type) of images, and of marked video and audio, once each."""
    address = lambda x: F.element_at(F.split(strip(x["inner"]), r"\s"), 1)
    inline = F.transform(F.filter(brackets(text), lambda x: x["image"] & (strip(x["inner"]) != "")), address)
    images = F.transform(bound(tree.parsed(text), tree.images), lambda x: x["url"])
    played = F.filter(markers(text), lambda m: m["type"] != "img")
    return F.array_distinct(F.concat(_typed(inline, "img"), F.array_sort(played, lambda a, b: _later(a, b)), _typed(images, "img")))


def _later(a: Column, b: Column) -> Column:
    """Video before audio; the sort keeps the order of equals."""
    rank = lambda m: F.when(m["type"] == "video", 0).otherwise(1)
    return rank(a) - rank(b)
