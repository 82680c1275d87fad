"""URL rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The query parameters that carry no content.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source", "campaign"]
#: Endings of files that are not pages.
NOT_PAGES = ["jpg", "jpeg", "png", "bmp", "webp", "pdf", "txt", "csv", "xls", "xlsx", "doc", "docx"]


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def domain_name(url: Column, heuristics: dict[str, str] | None = None) -> Column:
    """The host, or what the pattern of the first fitting suffix takes from the URL."""
    host = authority(url)
    chosen = None
    for suffix, pattern in (heuristics or {}).items():
        taken = F.regexp_extract(url, pattern, 1)
        case = (host.endswith(suffix), F.when(taken != "", taken).otherwise(host))
        chosen = F.when(*case) if chosen is None else chosen.when(*case)
    return host if chosen is None else chosen.otherwise(host)


def without_fragment(url: Column) -> Column:
    at = F.instr(url, "#")
    return F.when(at > 1, F.substring(url, F.lit(1), at - 1)).otherwise(url)


def is_page(url: Column) -> Column:
    return url.rlike(r"^https?://") & ~F.lower(url).rlike(r"\.(" + "|".join(NOT_PAGES) + r")$")


def cleaned(url: Column) -> Column:
    """Without fragment and tracking parameters; query parts without a value go too."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_replace(bare, r"\?.*$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: p.contains("=") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING))
    return F.when(F.size(kept) > 0, F.concat(head, F.lit("?"), F.array_join(kept, "&"))).otherwise(head)


def _folded(path: Column) -> Column:
    """A path without its dot segments; those that would leave the root are dropped."""
    parts = F.split(path, "/", -1)
    step = lambda kept, p: (
        F.when(p == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).when(p == ".", kept).otherwise(F.array_append(kept, p))
    )
    kept = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step)
    ends = F.element_at(parts, -1).isin(".", "..")
    return F.array_join(F.when(ends, F.array_append(kept, F.lit(""))).otherwise(kept), "/")


def resolved(base: Column, link: Column) -> Column:
    """An absolute URL from a link on the page ``base``; dot segments of its path are taken out."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*(?:/.*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(root, F.lit("/")))
    joined = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("#") | (link == ""), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .when(link.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), link))
        .otherwise(F.concat(folder, link))
    )
    head = F.regexp_extract(joined, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(joined, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(joined, r"^[^?#]*(.*)$", 1)
    dotted = (head != "") & path.rlike(r"/\.{1,2}(?:/|$)")
    return F.when(dotted, F.concat(head, _folded(path), tail)).otherwise(joined)


def link_type(source: Column, target: Column) -> Column:
    return F.when(authority(source) == authority(target), "internal").otherwise("external")


def media_type(url: Column) -> Column:
    """By ending; an image where nothing else fits."""
    low = F.lower(F.regexp_replace(url, "[?#].*$", ""))
    return (
        F.when(low.rlike(r"\.(mp4|webm|avi|mov|mkv|ogv)$"), "video")
        .when(low.rlike(r"\.(mp3|wav|ogg|flac|aac|m4a)$"), "audio")
        .otherwise("img")
    )


def url_hash(url: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).otherwise(F.md5(url))


def has_extension(url: Column, endings: tuple[str, ...]) -> Column:
    """Does the path end in one of these? Data addresses pass."""
    path = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1))
    ends = path.endswith(endings[0])
    for e in endings[1:]:
        ends = ends | path.endswith(e)
    return F.coalesce(F.lower(url).startswith("data:") | ends, F.lit(False)) & (F.coalesce(url, F.lit("")) != "")


def unproxied(url: Column) -> Column:
    """The original address of an image behind a resizing proxy; null for what is no web address."""
    parts = r"^https?://i[012]\.wp\.com/([^/?#]+)(/[^?#]*)"
    query = F.btrim(F.regexp_replace(F.regexp_extract(url, r"\?([^#]*)", 1), "ssl=1", ""), F.lit("&"))
    fragment = F.regexp_extract(url, "(#.*)$", 1)
    inner = F.concat(F.lit("https://"), F.regexp_extract(url, parts, 1), F.regexp_extract(url, parts, 2), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")), fragment)
    return F.when(~url.rlike(r"^https?://[^/?#]+"), F.lit(None).cast("string")).when(url.rlike(parts), inner).otherwise(url)


def media_cleaned(url: Column) -> Column:
    """A media address without tracking parameters and fragment; behind a proxy, the address that it names."""
    bare = cleaned(url)
    inner = F.url_decode(F.regexp_extract(bare, r"\?url=([^&]*)", 1))
    return F.when(bare.rlike(r"i[01]\.wp\.com") & (inner != ""), inner).otherwise(bare)
