"""Stems of French and English words, by the published Snowball rules, and keywords built on them.

A word's stem depends on the word alone: each Python worker keeps those that it has met. A language without
rules leaves words as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.text import stop_free, tokens


def _after(word: str, vowels: str, begin: int = 0) -> int:
    """Where the region behind the first consonant that follows a vowel begins."""
    for i in range(begin + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _longest(word: str, endings: tuple[str, ...]) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


_FR = "aeiouyâàëéêèïîôûù"
#: The endings of the French rules, step by step.
_FR_PLAIN = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
_FR_ATION = "atrice ateur ation atrices ateurs ations".split()
_FR_I = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante "
    "issantes issants isse issent isses issez issiez issions issons it"
).split()
_FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
_FR_STANDARD = tuple([*_FR_PLAIN, *_FR_ATION, "logie", "logies", "usion", "ution", "usions", "utions", "ence", "ences", "ement", "ements",
                      "ité", "ités", "if", "ive", "ifs", "ives", "eaux", "aux", "euse", "euses", "issement", "issements", "amment", "emment", "ment", "ments"])


def _french_standard(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """The word without a noun's ending, and whether verb endings are looked at as well."""
    e = _longest(w, _FR_STANDARD)
    at = len(w) - len(e)
    stem, in1, in2, inv = w[:at], at >= r1, at >= r2, at >= rv
    ends = lambda s, x, region: s.endswith(x) and len(s) - len(x) >= region
    if not e:
        return w, True
    if e in _FR_PLAIN and in2:
        return stem, False
    if e in _FR_ATION and in2:
        if stem.endswith("ic"):
            stem = stem[:-2] if len(stem) - 2 >= r2 else stem[:-2] + "iqU"
        return stem, False
    if e in ("logie", "logies") and in2:
        return stem + "log", False
    if e in ("usion", "ution", "usions", "utions") and in2:
        return stem + "u", False
    if e in ("ence", "ences") and in2:
        return stem + "ent", False
    if e in ("ement", "ements") and inv:
        if ends(stem, "iv", r2):
            stem = stem[:-2]
            if ends(stem, "at", r2):
                stem = stem[:-2]
        elif stem.endswith("eus"):
            stem = stem[:-3] if len(stem) - 3 >= r2 else stem[:-1] + "x" if len(stem) - 3 >= r1 else stem
        elif ends(stem, "abl", r2) or ends(stem, "iqU", r2):
            stem = stem[:-3]
        elif ends(stem, "ièr", rv) or ends(stem, "Ièr", rv):
            stem = stem[:-3] + "i"
        return stem, False
    if e in ("ité", "ités") and in2:
        if stem.endswith("abil"):
            stem = stem[:-4] if len(stem) - 4 >= r2 else stem[:-4] + "abl"
        elif stem.endswith("ic"):
            stem = stem[:-2] if len(stem) - 2 >= r2 else stem[:-2] + "iqU"
        elif ends(stem, "iv", r2):
            stem = stem[:-2]
        return stem, False
    if e in ("if", "ive", "ifs", "ives") and in2:
        if ends(stem, "at", r2):
            stem = stem[:-2]
            if stem.endswith("ic"):
                stem = stem[:-2] if len(stem) - 2 >= r2 else stem[:-2] + "iqU"
        return stem, False
    if e == "eaux":
        return stem + "eau", False
    if e == "aux" and in1:
        return stem + "al", False
    if e in ("euse", "euses"):
        if in2:
            return stem, False
        if in1:
            return stem + "eux", False
    if e in ("issement", "issements") and in1 and stem and stem[-1] not in _FR:
        return stem, False
    if e == "amment" and inv:
        return stem + "ant", True
    if e == "emment" and inv:
        return stem + "ent", True
    if e in ("ment", "ments") and stem and stem[-1] in _FR and at - 1 >= rv:
        return stem, True
    return w, True


def _french_verb(w: str, rv: int, r2: int) -> str:
    region = w[rv:]
    e = _longest(region, tuple(_FR_I))
    if e and len(region) > len(e) and region[-len(e) - 1] not in _FR:
        return w[: -len(e)]
    e = _longest(region, tuple(_FR_E + _FR_A + ["ions"]))
    if e == "ions":
        return w[:-4] if len(w) - 4 >= r2 else w
    if e in _FR_E:
        return w[: -len(e)]
    if e:
        w = w[: -len(e)]
        return w[:-1] if w.endswith("e") and len(w) - 1 >= rv else w
    return w


@lru_cache(maxsize=200_000)
def french(word: str) -> str:
    w = word.lower()
    w = re.sub(r"qu", "qU", w)
    w = re.sub(f"(?<=[{_FR}])([ui])(?=[{_FR}])", lambda m: m[1].upper(), w)
    w = re.sub(f"(?<=[{_FR}])y|y(?=[{_FR}])", "Y", w)
    if len(w) >= 2 and w[0] in _FR and w[1] in _FR or w[:3] in ("par", "col", "tap"):
        rv = min(3, len(w))
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in _FR), len(w))
    r1 = _after(w, _FR)
    r2 = _after(w, _FR, r1) if r1 < len(w) else len(w)
    before = w
    w, verbs = _french_standard(w, rv, r1, r2)
    if verbs:
        w = _french_verb(w, rv, r2)
    if w != before:
        if w.endswith("Y"):
            w = w[:-1] + "i"
        elif w.endswith("ç"):
            w = w[:-1] + "c"
    else:
        if len(w) >= 2 and w[-1] == "s" and w[-2] not in "aiouès":
            w = w[:-1]
        region = w[rv:]
        if region.endswith("ion") and len(w) - 3 >= r2 and len(w) - 4 >= rv and w[-4] in "st":
            w = w[:-3]
        elif (e := _longest(region, ("ier", "ière", "Ier", "Ière"))):
            w = w[: -len(e)] + "i"
        elif region.endswith("e"):
            w = w[:-1]
        elif region.endswith("ë") and w[-3:-1] == "gu":
            w = w[:-1]
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(f"[éè](?=[^{_FR}]+$)", "e", w)
    return w.lower()


_EN = "aeiouy"
#: Words that the English rules take as they are given here.
_EN_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_EN_SAME = frozenset("sky news howe atlas cosmos bias andes".split())
_EN_STOP = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_EN_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_EN_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_4 = tuple("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split())


def _short(w: str) -> bool:
    """Does the word end in a short syllable?"""
    if len(w) == 2:
        return w[0] in _EN and w[1] not in _EN
    return len(w) > 2 and w[-3] not in _EN and w[-2] in _EN and w[-1] not in _EN + "wxY"


@lru_cache(maxsize=200_000)
def english(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    if w in _EN_WHOLE or w in _EN_SAME:
        return _EN_WHOLE.get(w, w)
    w = w.lstrip("'")
    w = re.sub("^y|(?<=[aeiouy])y", "Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), _after(w, _EN))
    r2 = _after(w, _EN, r1) if r1 < len(w) else len(w)
    for e in ("'s'", "'s", "'"):
        if w.endswith(e):
            w = w[: -len(e)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _EN for c in w[:-2]):
        w = w[:-1]
    if w in _EN_STOP:
        return w
    e = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        w = w[: -len(e)] + "ee" if len(w) - len(e) >= r1 else w
    elif e and any(c in _EN for c in w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif r1 >= len(w) and _short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN:
        w = w[:-1] + "i"
    e = _longest(w, tuple(_EN_2))
    at = len(w) - len(e)
    if e and at >= r1 and (e != "ogi" or w[at - 1 : at] == "l") and (e != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
        w = w[:at] + _EN_2[e]
    e = _longest(w, tuple(_EN_3))
    at = len(w) - len(e)
    if e and at >= (r2 if e == "ative" else r1):
        w = w[:at] + _EN_3[e]
    e = _longest(w, _EN_4)
    at = len(w) - len(e)
    if e and at >= r2 and (e != "ion" or w[at - 1 : at] in ("s", "t")):
        w = w[:at]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short(w[:-1])):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2] == "l":
        w = w[:-1]
    return w.lower()


RULES = {"fr": french, "en": english}


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stemmed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for words, lang in batches:
        yield pd.Series([None if w is None else [*map(RULES[k], w)] if k in RULES else list(w) for w, k in zip(words, lang)])


def lemmas(words: Column, lang: Column) -> Column:
    """The stem of each word of an array, by language."""
    return _stemmed(words, F.coalesce(lang, F.lit("")))


def lemma_keywords(text: Column, lang: Column, most: int = 10, shortest: int = 3) -> Column:
    """The first ``most`` different stems of words that are not too common, in order of appearance."""
    kept = F.filter(tokens(F.coalesce(text, F.lit(""))), lambda w: (F.length(w) >= shortest) & stop_free(w, lang))
    return F.slice(F.array_distinct(lemmas(F.array_distinct(kept), lang)), 1, most)
