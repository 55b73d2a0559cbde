"""Stemmers for English and Russian by the published Snowball rules, chosen per value: any Cyrillic letter means Russian."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS, _DOUBLES, _LI = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"
#: Fixed values of the published rules: words with stems of their own, and words that stop after the first step.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_STOPS = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    r1 = len(w)
    for prefix in ("gener", "commun", "arsen"):
        if w.startswith(prefix):
            r1 = len(prefix)
            break
    else:
        m = re.search(r"[aeiouy][^aeiouy]", w)
        r1 = m.end() if m else len(w)
    m = re.search(r"[aeiouy][^aeiouy]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS + "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


@lru_cache(200_000)
def stem_english(word: str) -> str:
    w = word
    if len(w) <= 2:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = w.lstrip("'")
    w = ("Y" + w[1:] if w.startswith("y") else w)
    w = re.sub(r"([aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _STOPS:
        return w
    for suffix in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(suffix):
            if suffix in ("eed", "eedly"):
                if len(w) - len(suffix) >= r1:
                    w = w[: -len(suffix)] + "ee"
            elif re.search(r"[aeiouy]", w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLES):
                    w = w[:-1]
                elif _short_end(w) and r1 >= len(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for suffix in sorted(_STEP2, key=len, reverse=True):
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + _STEP2[suffix]
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] and w[-3] in _LI:
            w = w[:-2]
    for suffix in sorted((*_STEP3, "ative"), key=len, reverse=True):
        if w.endswith(suffix):
            if suffix == "ative":
                if len(w) - 5 >= r2:
                    w = w[:-5]
            elif len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + _STEP3[suffix]
            break
    for suffix in (*_STEP4, "ion"):
        if w.endswith(suffix) and not (suffix == "ion" and w[-4:-3] not in ("s", "t")):
            if len(w) - len(suffix) >= r2:
                w = w[: -len(suffix)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


_RU_VOWELS = "аеиоуыэюя"
_GERUND = (("вшись", "вши", "в"), ("ившись", "ывшись", "ивши", "ывши", "ив", "ыв"))
_ADJECTIVE = "ими ыми его ого ему ому ее ие ые ое ей ий ый ой ем им ым ом их ых ую юю ая яя ою ею".split()
_PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
_VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(), "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split())
_NOUN = "иями ями ами ией иям ием иях ев ов ие ье еи ии ей ой ий ям ем ам ом ах ях ию ью ия ья а е и й о у ы ь ю я".split()


def _cut(w: str, rv: int, plain: tuple | list, after_a: tuple | list = ()) -> str | None:
    for suffix in sorted((*plain, *after_a), key=len, reverse=True):
        if w.endswith(suffix) and len(w) - len(suffix) >= rv:
            if suffix in after_a and suffix not in plain:
                if len(w) - len(suffix) - 1 < rv or w[len(w) - len(suffix) - 1] not in "ая":
                    continue
            return w[: -len(suffix)]
    return None


@lru_cache(200_000)
def stem_russian(word: str) -> str:
    w = word.replace("ё", "е")
    m = re.search(f"[{_RU_VOWELS}]", w)
    rv = m.end() if m else len(w)
    m = re.search(f"[{_RU_VOWELS}][^{_RU_VOWELS}]", w)
    r1 = m.end() if m else len(w)
    m = re.search(f"[{_RU_VOWELS}][^{_RU_VOWELS}]", w[r1:])
    r2 = r1 + m.end() if m else len(w)
    cut = _cut(w, rv, _GERUND[1], _GERUND[0])
    if cut is not None:
        w = cut
    else:
        w = _cut(w, rv, ("ся", "сь")) or w
        adjective = _cut(w, rv, _ADJECTIVE)
        if adjective is not None:
            w = adjective
            w = _cut(w, rv, _PARTICIPLE[1], _PARTICIPLE[0]) or w
        else:
            verb = _cut(w, rv, _VERB[1], _VERB[0])
            w = verb if verb is not None else (_cut(w, rv, _NOUN) or w)
    if w.endswith("и") and len(w) - 1 >= rv:
        w = w[:-1]
    for suffix in ("ость", "ост"):
        if w.endswith(suffix) and len(w) - len(suffix) >= r2:
            w = w[: -len(suffix)]
            break
    superlative = _cut(w, rv, ("ейше", "ейш"))
    if superlative is not None:
        w = superlative
    if w.endswith("нн") and len(w) - 1 >= rv:
        w = w[:-1]
    elif w.endswith("ь") and len(w) - 1 >= rv:
        w = w[:-1]
    return w


def stem(word: str, russian: bool) -> str:
    return stem_russian(word) if russian else stem_english(word)


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed_words(text: pd.Series) -> pd.Series:
    """Stems of a value's words in order; a value with a Cyrillic letter is Russian. Null gives an empty array."""
    out = []
    for value in text:
        low = (value or "").lower()
        russian = any("Ѐ" <= ch <= "ӿ" for ch in low)
        out.append([stem(w, russian) for w in re.findall(r"[^\W_]+", low)])
    return pd.Series(out, dtype=object)
