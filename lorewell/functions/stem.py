"""Stemmed words without stop words: the published English Snowball algorithm, over columns of word lists."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed stop words.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here there when where why how all any
    both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
#: Fixed exceptions: whole words, and words that stay as they are after the first step.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {
    w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
}
STAY = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Fixed suffixes of the second, third and fourth step; None marks rules with a condition.
SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive",
    "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": None, "li": None,
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": None, "ical": "ic", "ness": "", "ful": ""}
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_REGION, _DOUBLE = re.compile(r"[aeiouy][^aeiouy]"), re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_SHORT = re.compile(r"([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _regions(word: str) -> tuple[int, int]:
    """Where the first and the second region begin: after the first consonant that follows a vowel, and the same again."""
    at = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if at is None:
        m = _REGION.search(word)
        at = m.end() if m else len(word)
    m = _REGION.search(word, at)
    return at, m.end() if m else len(word)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of two letters or less, and those with other signs than a-z and ', as they are."""
    if len(word) <= 2 or not re.fullmatch(r"[a-z']+", word):
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = re.sub(r"(?<=[aeiouy])y|^y", "Y", word.lstrip("'"))
    first, second = _regions(word)
    word = re.sub(r"('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(r"[aeiouy].", word[:-1]):
        word = word[:-1]
    if word in STAY:
        return word
    if word.endswith(("eed", "eedly")):
        cut = 3 if word.endswith("eed") else 5
        word = word[: len(word) - cut] + "ee" if len(word) - cut >= first else word
    elif (m := re.search(r"(ingly|edly|ing|ed)$", word)) and re.search(r"[aeiouy]", word[: m.start()]):
        word = word[: m.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _DOUBLE.search(word):
            word = word[:-1]
        elif first >= len(word) and _SHORT.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    for end, to in SECOND.items():
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= first:
                if end == "ogi":
                    word = word[:-1] if word[at - 1 : at] == "l" else word
                elif end == "li":
                    word = word[:-2] if word[at - 1 : at] in tuple("cdeghkmnrt") else word
                else:
                    word = word[:at] + to
            break
    for end, to in THIRD.items():
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= first and (end != "ative" or at >= second):
                word = word[:at] + (to or "")
            break
    for end in FOURTH:
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= second and (end != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    if word.endswith("e") and (len(word) - 1 >= second or (len(word) - 1 >= first and not _SHORT.search(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.replace("Y", "y")


@F.pandas_udf(T.ArrayType(T.StringType()))
def lexemes(words: pd.Series) -> pd.Series:
    """The stems of a list of lower-case words, stop words left out; repeats stay."""
    return words.map(lambda ws: [stem(w) for w in ws if w not in STOP] if ws is not None else None)
