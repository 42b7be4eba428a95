"""English stems by the published Porter algorithm, with its two later rules (logi, bli)."""

from __future__ import annotations

import re
import unicodedata

# The algorithm's endings. Pairs of an ending and what replaces it, longer ones before those that they end in.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
LONGEST = 64


def _shape(stem: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel after a consonant."""
    out = ""
    for c in stem:
        out += "v" if c in "aeiou" or c == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replaced(word: str, endings: tuple[tuple[str, str], ...]) -> str:
    found = [(e, r) for e, r in endings if word.endswith(e)]
    if found:
        ending, new = max(found, key=lambda x: len(x[0]))
        if _measure(word[: -len(ending)]) > 0:
            return word[: -len(ending)] + new
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of other characters than a to z and digits, and very short or long ones, stay."""
    if not 3 <= len(word) <= LONGEST or not word.isascii():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for ending in ("ed", "ing"):
            if word.endswith(ending) and "v" in _shape(word[: -len(ending)]):
                word = word[: -len(ending)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word[-2:-1] == word[-1] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2), STEP_3)
    ending = max((e for e in STEP_4 if word.endswith(e)), key=len, default="")
    if ending and _measure(word[: -len(ending)]) > 1 and (ending != "ion" or word[-4] in "st"):
        word = word[: -len(ending)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short_end(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def folded(word: str) -> str:
    """Without marks over and under letters."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")
