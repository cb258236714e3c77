"""English search terms: stop words, the published Porter2 stemmer, tokens."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.udf import vectorized

# The stop words of the public English search configuration.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their
    theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and
    but if or because as until while of at by for with about against between into through during before after above below to from up down in out on
    off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so
    than too very s t can will just don should now""".split()
)
# Suffix lists and exceptions of the published algorithm.
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
_VOWEL = "aeiouy"


def _regions(word: str) -> tuple[int, int]:
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)

    def after(start: int) -> int:
        m = re.compile("[aeiouy][^aeiouy]").search(word, start)
        return m.end() if m else len(word)

    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(word: str) -> bool:
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$", word) or re.fullmatch("[aeiouy][^aeiouy]", word))


def stem(word: str) -> str:
    """Porter2 of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = word.removeprefix("'")
    word = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)
    for suffix in ("'s'", "'s", "'"):
        if word.endswith(suffix):
            word = word[: -len(suffix)]
            break
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word.lower()
    eed = next((s for s in ("eedly", "eed") if word.endswith(s)), None)
    if eed:
        if len(word) - len(eed) >= r1:
            word = word[: -len(eed)] + "ee"
    elif suffix := next((s for s in ("ingly", "edly", "ing", "ed") if word.endswith(s)), None):
        rest = word[: -len(suffix)]
        if re.search("[aeiouy]", rest):
            word = rest
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(_DOUBLES):
                word = word[:-1]
            elif r1 >= len(word) and _short_end(word):
                word += "e"
    if re.search("[^aeiouy][yY]$", word) and len(word) > 2:
        word = word[:-1] + "i"
    for suffix, to in _STEP2:
        if word.endswith(suffix):
            if len(word) - len(suffix) >= r1:
                word = word[: -len(suffix)] + to
            break
    else:
        if word.endswith("ogi"):
            if len(word) - 3 >= r1 and word[-4:-3] == "l":
                word = word[:-1]
        elif word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] in "cdeghkmnrt" and len(word) > 2:
            word = word[:-2]
    for suffix, to in _STEP3:
        if word.endswith(suffix):
            if len(word) - len(suffix) >= r1:
                word = word[: -len(suffix)] + to
            break
    else:
        if word.endswith("ative") and len(word) - 5 >= r2:
            word = word[:-5]
    for suffix in _STEP4:
        if word.endswith(suffix):
            if len(word) - len(suffix) >= r2:
                word = word[: -len(suffix)]
            break
    else:
        if word.endswith("ion") and len(word) - 3 >= r2 and word[-4:-3] in ("s", "t"):
            word = word[:-3]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


@vectorized("string")
def stem_words(words: pd.Series) -> pd.Series:
    """Stems of a column of distinct lower-case words; null for stop words."""
    return words.map(lambda w: None if w is None or w in STOP_WORDS else stem(w), na_action=None)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


@vectorized("array<string>")
def folded_tokens(texts: pd.Series) -> pd.Series:
    """Distinct compatibility-normalised, case-folded word tokens, sorted."""
    import unicodedata

    word = re.compile(r"[^\W_]+")
    return texts.map(lambda t: sorted(set(word.findall(unicodedata.normalize("NFKC", t or "").casefold()))))
