"""Stems by the published Porter2 (English) and a light French rule set; one Arrow batch a call, remembered by word."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouy"
# Fixed values of the published English algorithm.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
FRENCH = ["issements", "issement", "atrices", "atrice", "ateurs", "ateur", "ations", "ation", "ements", "ement", "ances", "ance", "iques", "ique", "ismes", "isme", "ables", "able", "istes", "iste", "euses", "euse", "ités", "ité", "ives", "ive", "ifs", "if", "eux", "aux", "ées", "ée", "és", "er", "ez", "ant", "ent", "é", "es", "e", "s"]


def _regions(w: str) -> tuple[int, int]:
    special = re.match(r"gener|commun|arsen", w)
    m = re.search(f"[{VOWELS}][^{VOWELS}]", w)
    r1 = special.end() if special else m.end() if m else len(w)
    m = re.search(f"[{VOWELS}][^{VOWELS}]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _short(w: str, r1: int) -> bool:
    return r1 >= len(w) and bool(re.search(rf"(?:^[{VOWELS}][^{VOWELS}]|[^{VOWELS}][{VOWELS}][^{VOWELS}wxY])$", w))


@lru_cache(maxsize=1 << 16)
def english(word: str) -> str:
    """Porter2 stem of a lower-case word."""
    if len(word) <= 2 or word in SPECIAL:
        return SPECIAL.get(word, word)
    w = re.sub(f"(?<=[{VOWELS}])y|^y", "Y", word.lstrip("'"))
    r1, r2 = _regions(w.lower() if False else w)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{VOWELS}].+s$", w):
        w = w[:-1]
    if w in KEPT:
        return w
    if m := re.search(r"(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(ingly|edly|ing|ed)$", w)) and re.search(f"[{VOWELS}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif _short(w, r1):
            w += "e"
    w = re.sub(f"(?<=.[^{VOWELS}])[yY]$", "i", w)
    for table, least in ((STEP2, r1), (STEP3, r1)):
        for s in sorted({*table, *(("ogi", "li") if table is STEP2 else ("ative",))}, key=len, reverse=True):
            if w.endswith(s):
                at = len(w) - len(s)
                if at >= least:
                    if s == "ogi":
                        w = w[:-1] if w[at - 1 : at] == "l" else w
                    elif s == "li":
                        w = w[:-2] if w[at - 1 : at] in "cdeghkmnrt" else w
                    elif s == "ative":
                        w = w[:at] if at >= r2 else w
                    else:
                        w = w[:at] + table[s]
                break
    for s in [*STEP4, "ion"] if not w.endswith("ion") else ["ion"]:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and (s != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short(w[:-1], r1)):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@lru_cache(maxsize=1 << 16)
def french(word: str) -> str:
    """The longest known ending off, at least three letters left."""
    for s in FRENCH:
        if word.endswith(s) and len(word) - len(s) >= 3:
            return word[: -len(s)]
    return word


def stems(tokens: Column, language: Column) -> Column:
    """Stems of an array of tokens of three characters and more: English, French, or both one after the other."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series, langs: pd.Series) -> pd.Series:
        def one(ts, lang):
            if ts is None:
                return None
            ts = [t for t in ts if len(t) >= 3]
            if lang == "fr":
                return [french(t) for t in ts]
            return [english(t) for t in ts] + ([french(t) for t in ts] if lang == "both" else [])

        return pd.Series([one(ts, lang) for ts, lang in zip(lists, langs, strict=True)])

    return run(tokens, language)
