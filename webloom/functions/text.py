"""Text measures as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from webloom.session import ship

BLANKS = " \t\n\u000b\f\r"
#: The letters that count as vowels of a syllable (``y`` is none).
VOWELS = "aeiouàâäéèêëïîôùûüÿAEIOUÀÂÄÉÈÊËÏÎÔÙÛÜŸ"
#: The word lists of the two-language detector.
FRENCH = (
    "le de et à un il être en avoir que pour dans ce son une sur avec ne se pas tout plus par les du des la au fait été"
).split()
ENGLISH = (
    "the be to of and a in that have it for not on with he as you do at this but his by from they we say her she or"
).split()
ACCENTS = "àâäéèêëïîôùûüÿñç"
#: French words that are no keywords, as the public stop list has them, and seven more.
STOP_FR = (
    "au aux avec ce ces dans de des du elle en et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que "
    "qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y été étée étées étés étant étante étants étantes suis es est sommes "
    "êtes sont serai seras sera serons serez seront serais serait serions seriez seraient étais était étions étiez étaient fus fut fûmes fûtes furent sois "
    "soit soyons soyez soient fusse fusses fût fussions fussiez fussent ayant ayante ayantes ayants eu eue eues eus ai as avons avez ont aurai auras aura "
    "aurons aurez auront aurais aurait aurions auriez auraient avais avait avions aviez avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse "
    "eusses eût eussions eussiez eussent cela celui celle ceux celles ça où"
).split()
#: The English ones.
STOP_EN = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because "
    "as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don "
    "should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()


def _decomposed() -> tuple[str, str, dict[str, str]]:
    """Letters whose compatibility decomposition has one ASCII character, that character, and those with several."""
    one, many = {}, {}
    for code in (*range(0x80, 0x2500), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one[chr(code)] = plain
        elif plain:
            many[chr(code)] = plain
    return "".join(one), "".join(one.values()), many


MARKED, PLAIN, SEVERAL = _decomposed()


_ASCII = str.maketrans(dict(zip(MARKED, PLAIN)) | SEVERAL)


@F.arrow_udf(StringType())
def _ascii_only(text: pa.Array) -> pa.Array:
    plain = lambda t: t if t is None or t.isascii() else t.translate(_ASCII).encode("ascii", "ignore").decode()
    return pa.array([plain(t) for t in text.to_pylist()], pa.string())


def ascii_only(text: Column) -> Column:
    """Letters without their marks; what has no ASCII form goes."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)
    return _ascii_only(text)


def stop_free(word: Column, lang: Column) -> Column:
    """Is a word none of its language's common words?"""
    return F.when(lang == "fr", ~word.isin(STOP_FR)).when(lang == "en", ~word.isin(STOP_EN)).otherwise(F.lit(True))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """The runs of anything but white space."""
    return F.filter(F.split(strip(text), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sentence_count(text: Column) -> Column:
    """Runs of end marks, one at least."""
    return F.greatest(F.regexp_count(text, F.lit("[.!?]+")), F.lit(1))


def syllables(text: Column) -> Column:
    """Runs of vowels, not fewer than words."""
    return F.greatest(F.regexp_count(text, F.lit(f"[{VOWELS}]+")), word_count(text))


def reading_level(text: Column) -> Column:
    """Reading ease from 0 to 100; none below five words."""
    n = word_count(text)
    score = 207 - 1.015 * (n / sentence_count(text)) - 84.6 * (syllables(text) / n)
    return F.when(n >= 5, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def detect_language(text: Column) -> Column:
    """French or English by common words, then by accents, then English for longer texts; else null."""
    letters = "a-zA-Z" + ACCENTS + ACCENTS.upper()
    low = F.lower(text)
    found = F.regexp_extract_all(low, F.lit(f"([{letters}]+)"), F.lit(1))
    count = lambda terms: F.size(F.filter(found, lambda w: w.isin(terms)))
    fr, en, n = count(FRENCH), count(ENGLISH), F.size(found)
    size = F.length(strip(text))
    by_default = F.when(size > 50, F.lit("en"))
    by_words = F.when((fr + en >= 2) & (fr > en), F.lit("fr")).when((fr + en >= 2) & (en > fr), F.lit("en"))
    accents = F.regexp_count(low, F.lit(f"[{ACCENTS}]")) > n * 0.02
    chosen = F.coalesce(by_words, F.when(accents, F.lit("fr")), by_default)
    return F.when(size < 10, F.lit(None).cast("string")).when(n < 3, by_default).otherwise(chosen)


def reading_minutes(text: Column) -> Column:
    """Whole minutes at 200 words a minute, one at least; none for an empty text."""
    n = word_count(text)
    return F.when(n > 0, F.greatest(F.lit(1), F.floor(n / 200).cast("int")))


def clean_markup(text: Column) -> Column:
    """Tags removed and common entities decoded, the ampersand first."""
    out = F.regexp_replace(text, "<[^>]+>", "")
    for entity, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&hellip;", "..."), ("&mdash;", "—"), ("&ndash;", "–")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


def normalized(text: Column) -> Column:
    """Lower case without marks, punctuation and repeated blanks."""
    plain = ascii_only(F.lower(text))
    return strip(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9_\s]", " "), r"\s+", " "))


def core_normalized(text: Column) -> Column:
    """Without tags and punctuation; letters of any script, hyphens and marks stay, and the case."""
    out = F.regexp_replace(text, r"<[^>]+>", " ")
    out = F.regexp_replace(out, "[–—]", "-")
    out = F.regexp_replace(out, r"(?U)[^\w\s\-]", " ")
    return F.btrim(F.regexp_replace(out, r"(?U)\s+", " "))


def slug(text: Column, most: int = 50) -> Column:
    """ASCII letters and digits joined by hyphens, cut at ``most``; ``untitled`` where nothing is left."""
    made = F.btrim(F.regexp_replace(F.lower(ascii_only(text)), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.substring(made, 1, most)
    return F.when(F.coalesce(cut, F.lit("")) == "", F.lit("untitled")).otherwise(cut)


def tokens(text: Column) -> Column:
    """Runs of Latin letters in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-zà-öø-ÿ]+)"), F.lit(1))


def keywords(text: Column, most: int = 50, shortest: int = 3, lang: Column | None = None) -> Column:
    """The first ``most`` different tokens, in order of appearance; common words of ``lang`` are none."""
    free = (lambda w: stop_free(w, lang)) if lang is not None else (lambda w: F.lit(True))
    kept = F.filter(tokens(text), lambda w: (F.length(w) >= shortest) & free(w))
    return F.slice(F.array_distinct(kept), 1, most)


def similarity(a: Column, b: Column, most: int = 50) -> Column:
    """Jaccard similarity of two texts' first keywords; 0 where either has none."""
    x, y = keywords(a, most), keywords(b, most)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def paragraphs(text: Column, shortest: int = 50, longest: int = 5000, separator: str = r"\n\s*\n|(?i)<br\s*/?>|<p[^>]*>") -> Column:
    """Paragraphs of allowed length; longer ones are packed from their sentences."""
    parts = F.transform(F.split(text, separator), lambda p: strip(F.regexp_replace(clean_markup(p), r"\s+", " ")))
    whole = F.filter(parts, lambda p: F.length(p) >= shortest)
    return F.flatten(F.transform(whole, lambda p: F.when(F.length(p) <= longest, F.array(p)).otherwise(packed_sentences(p, longest))))


def packed_sentences(text: Column, longest: int, shortest: int = 20) -> Column:
    """Sentences packed in order into chunks of at most ``longest`` characters; a longer one is cut."""
    pieces = F.flatten(
        F.transform(
            F.split(text, r"(?<=[.!?])\s+"),
            lambda s: F.when(F.length(s) <= longest, F.array(s)).otherwise(
                F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / longest).cast("int")), lambda k: s.substr(k * longest + 1, F.lit(longest)))
            ),
        )
    )
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    grow = lambda acc, s: F.when(
        F.length(acc["open"]) + 1 + F.length(s) > longest,
        F.struct(F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"), s.alias("open")),
    ).otherwise(F.struct(acc["done"].alias("done"), F.ltrim(F.concat(acc["open"], F.lit(" "), s)).alias("open")))
    packed = F.aggregate(pieces, start, grow, lambda acc: F.array_append(acc["done"], acc["open"]))
    return F.filter(packed, lambda c: F.length(c) >= shortest)


def cut_at_sentence(text: Column, most: int = 2000) -> Column:
    """At most ``most`` characters, up to the last full stop if that lies in the last fifth."""
    head = F.substring(text, 1, most)
    stop = F.length(head) - F.instr(F.reverse(head), ".") + 1
    has = F.instr(head, ".") > 0
    return F.when(F.length(text) <= most, text).when(has & (stop - 1 > most * 0.8), F.substring(head, F.lit(1), stop)).otherwise(head)


def combined(*fields: Column) -> Column:
    """The fields that hold text, parted by blank lines."""
    return F.array_join(F.filter(F.array(*fields), lambda f: F.coalesce(strip(f), F.lit("")) != ""), "\n\n")


#: Where a word of ASCII letters, digits and ``_`` ends, and what follows the local part of a mail address.
_END = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<=\|)(?=[A-Za-z0-9_]))"
_HOST = rf"@[A-Za-z0-9.-]+\.[A-Za-z|]{{2,}}{_END}"
#: What a text loses, or what stands for it, before it is embedded, in this order: fixed values.
FOR_EMBEDDING = (
    (r"[\x00-\x1f\x7f-\x9f]", ""),  # control characters, line feeds among them
    (r"(?U)\s+", " "),
    (r"https?://[!$-_a-z]+", ""),
    (rf"(?U)\b[A-Za-z0-9._%+-]+{_HOST}", ""),
    (rf"([^\x00-\x7f])(?=[A-Za-z0-9_])[A-Za-z0-9._%+-]+{_HOST}", "$1"),  # behind a letter with a mark, too
    (rf"0[1-9](?<![A-Za-z0-9_]..)(?:[-.\s]?[0-9]{{2}}){{4}}{_END}", ""),  # French telephone numbers
    (r"[.,;:!?]{2,}", "."),
    (r"[-_]{3,}", ""),
)


#: The same as SQL's patterns read them: words, their ends and white space are ASCII, and an address is found in one pass.
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
FOR_EMBEDDING_ASCII = (
    FOR_EMBEDDING[0],
    (r"[ \t\n\f\r]+", " "),
    FOR_EMBEDDING[2],
    (rf"{_EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{{2,}}{_EDGE}", ""),
    *FOR_EMBEDDING[5:],
)
#: What SQL trims: spaces of any width.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def embedding_text(text: Column, ascii_only: bool = False) -> Column:
    """Without control characters, addresses and French telephone numbers; runs of marks become one full stop.

    With ``ascii_only`` the rows are those of SQL: letters with accents end a word, and a missing text stays missing.
    """
    out = text if ascii_only else F.coalesce(text, F.lit(""))
    for pattern, plain in FOR_EMBEDDING_ASCII if ascii_only else FOR_EMBEDDING:
        out = F.regexp_replace(out, pattern, plain)
    return F.btrim(out, F.lit(SPACES)) if ascii_only else strip(out)


def summary_stats(text: Column, digits: int = 2) -> dict[str, Column]:
    """What a summary of a text holds: its measures, its average word without marks, its paragraphs and keywords."""
    bare = F.transform(words(text), lambda w: F.length(F.regexp_replace(w, r"[^\p{L}\p{N}_]", "")))
    total = F.aggregate(bare, F.lit(0), lambda s, n: s + n)
    count = word_count(text)
    return {
        "word_count": count,
        "char_count": F.length(strip(text)),
        "sentence_count": sentence_count(text),
        "avg_word_length": F.when(count > 0, F.round(total / count, digits)).otherwise(F.lit(0.0)),
        "paragraph_count": F.size(F.filter(F.split(text, r"\n\s*\n"), lambda p: strip(p) != "")),
    }


def export_value(value: Column) -> Column:
    """Missing, empty and unknown values as ``na``; arrays, maps and structs go through ``export_json``."""
    text = value.cast("string")
    return F.when(F.coalesce(text, F.lit("")).isin("", "unknown"), F.lit("na")).otherwise(text)


def export_json(value: Column) -> Column:
    """A list or a mapping as JSON; an empty or missing one as ``na``."""
    text = F.to_json(value)
    return F.when(F.coalesce(text, F.lit("[]")).isin("[]", "{}"), F.lit("na")).otherwise(text)


def term_variations(term: Column, lang: Column) -> Column:
    """A dictionary term with the endings of its language, without repeats."""
    ends = {"fr": ["s", "es", "er", "tion", "eux", "if"], "en": ["s", "ies", "ed", "ing", "er", "est"]}
    made = lambda e: F.transform(F.array(*map(F.lit, ["", *e])), lambda x: F.concat(term, x))
    return F.filter(
        F.array_distinct(F.when(lang == "fr", made(ends["fr"])).when(lang == "en", made(ends["en"])).otherwise(F.array(term))),
        lambda t: F.length(t) >= 2,
    )


def sentiment(polarity: Column) -> Column:
    """Label, confidence and status of a polarity between -1 and 1."""
    label = F.when(polarity > 0.1, "positive").when(polarity < -0.1, "negative").otherwise("neutral")
    return F.struct(
        F.round(polarity, 3).alias("score"),
        label.alias("label"),
        F.round(F.abs(polarity), 3).alias("confidence"),
        F.when(F.abs(polarity) < 0.5, "low_confidence").otherwise("computed").alias("status"),
    )


def yes_no(reply: Column) -> Column:
    """Does a model's reply say yes? Unclear replies count as no."""
    low = F.lower(strip(reply))
    return F.coalesce(low.contains("oui") | low.contains("yes"), F.lit(False))


def first_word(reply: Column) -> Column:
    """``oui`` or ``non`` where a reply starts so, else ``?``."""
    low = F.lower(strip(F.coalesce(reply, F.lit(""))))
    return F.when(low.startswith("oui") | low.startswith("yes"), "oui").when(low.startswith("non") | low.startswith("no"), "non").otherwise("?")


def relevance_prompt(project: Column, words_: Column, title: Column, text: Column, most: int = 1000) -> Column:
    """What a model is asked about a page: the project, its words, the title, and the start of the text."""
    head = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(F.coalesce(text, F.lit("")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Project: "), project),
        F.concat(F.lit("Words: "), F.array_join(words_, ", ")),
        F.concat(F.lit("Title: "), F.coalesce(title, F.lit(""))),
        F.concat(F.lit("Text: "), head),
        F.lit("Does the page belong to the project? Answer oui or non."),
    )


def lexicon_polarity(text: Column, weights: dict[str, float]) -> Column:
    """A polarity between -1 and 1: the mean weight of the words that a lexicon knows."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    found = F.filter(F.transform(tokens(F.coalesce(text, F.lit(""))), lambda w: weight[w]), lambda x: x.isNotNull())
    mean = F.aggregate(found, F.lit(0.0), lambda s, x: s + x) / F.size(found)
    return F.when(F.size(found) > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean))).otherwise(F.lit(0.0))
