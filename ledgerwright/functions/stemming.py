"""English lexemes: the published Porter2 rules behind one vectorised UDF.

Lexemes are computed once, when text is stored; searches then compare plain arrays in
the JVM. Each worker remembers the stems it has met, so the Python cost follows the
vocabulary and not the length of the corpus.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ledgerwright import fixed
from ledgerwright.functions.sqltext import apply, quoted
from ledgerwright.functions.text import word_tokens

_V = "[aeiouy]"
_C = "[^aeiouy]"
# Fixed values of the published algorithm.
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"),
    ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
    ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
    ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"),
    ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""),
)
_STEP4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti",
    "ous", "ive", "ize", "ion", "al", "er", "ic",
)


def _regions(word: str) -> tuple[int, int]:
    prefix = re.match("gener|commun|arsen", word)
    if prefix:
        r1 = prefix.end()
    else:
        hit = re.search(_V + _C, word)
        r1 = hit.end() if hit else len(word)
    hit = re.search(_V + _C, word[r1:])
    return r1, r1 + hit.end() if hit else len(word)


def _ends_short(word: str) -> bool:
    return bool(re.search(f"{_C}{_V}[^aeiouywxY]$", word) or re.fullmatch(f"{_V}{_C}", word))


def stem(word: str) -> str:
    """Porter2 stem of a lower-case word. Numbers are their own stems; kept, they would drive out the words."""
    return word if word.isdecimal() else _stem(word)


@lru_cache(maxsize=1 << 18)
def _stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word.lstrip("'"))
    r1, r2 = _regions(word)
    # plural endings
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(_V, word[:-2]):
        word = word[:-1]
    if word in _AFTER_PLURAL:
        return word
    # past and progressive endings
    hit = re.search(r"(eedly|eed)$", word)
    if hit:
        if hit.start() >= r1:
            word = word[: hit.start()] + "ee"
    else:
        hit = re.search(r"(ingly|edly|ing|ed)$", word)
        if hit and re.search(_V, word[: hit.start()]):
            word = word[: hit.start()]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
                word = word[:-1]
            elif _ends_short(word) and len(word) <= r1:
                word += "e"
    word = re.sub(f"(?<=.{_C})[yY]$", "i", word)
    for ending, new in _STEP2:
        if word.endswith(ending):
            cut = len(word) - len(ending)
            allowed = cut >= r1
            if ending == "ogi":
                allowed = allowed and word[cut - 1] == "l"
            if ending == "li":
                allowed = allowed and word[cut - 1] in "cdeghkmnrt"
            word = word[:cut] + new if allowed else word
            break
    for ending, new in _STEP3:
        if word.endswith(ending):
            cut = len(word) - len(ending)
            if cut >= (r2 if ending == "ative" else r1):
                word = word[:cut] + new
            break
    for ending in _STEP4:
        if word.endswith(ending):
            cut = len(word) - len(ending)
            if cut >= r2 and (ending != "ion" or word[cut - 1] in "st"):
                word = word[:cut]
            break
    if word.endswith("e"):
        cut = len(word) - 1
        if cut >= r2 or (cut >= r1 and not _ends_short(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


@F.pandas_udf(ArrayType(StringType()))
def _stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: None if ts is None else sorted({stem(t) for t in ts}))


def lexemes(text: Column) -> Column:
    """Sorted distinct stems of a text, stop words left out."""
    stop = F.array(*[F.lit(w) for w in fixed.STOP_WORDS])
    return _stems(F.array_except(word_tokens(text), stop))


def query_lexemes(text: str) -> list[str]:
    """Stems of a search phrase; the phrase is a parameter, so this runs on the driver."""
    words = re.split(r"[\W_]+", text.lower())
    return sorted({stem(w) for w in words if w and w not in set(fixed.STOP_WORDS)})


def beginnings(lexeme: str) -> list[str]:
    """What a word with this stem begins with: the rules leave the first two letters alone, fixed words are looked up."""
    return sorted({lexeme[:2], *(word[:2] for word, short in _WHOLE.items() if short == lexeme)})


def matches_all(stored: Column, phrase: str) -> Column:
    """Do the stored lexemes hold every lexeme of the phrase? A phrase without any matches nothing."""
    wanted = query_lexemes(phrase)
    if not wanted:
        return F.lit(False)
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), stored)) == 0


def text_matches(text: Column, phrase: str) -> Column:
    """Do the lexemes of a text hold every lexeme of the phrase? As `matches_all`, for a text without stored lexemes.

    Texts without the beginning of a wanted word are left out before any Python runs, and of the others only the words
    that begin like a wanted one are stemmed.
    """
    wanted = [beginnings(w) for w in query_lexemes(phrase)]
    if not wanted:
        return F.lit(False)
    # The text is bound once: it may be an expression of some size.
    held = apply(" AND ".join("(" + " OR ".join(f"contains(x, {quoted(b)})" for b in bs) + ")" for bs in wanted), F.lower(text))
    begins = lambda w: reduce(Column.__or__, [w.startswith(b) for b in sorted({b for bs in wanted for b in bs})])
    stop = F.array(*[F.lit(w) for w in fixed.STOP_WORDS])
    return held & matches_all(_stems(F.array_except(F.filter(word_tokens(text), begins), stop)), phrase)
