"""The public Porter2 (English Snowball) stemmer."""

from __future__ import annotations

import re
from functools import lru_cache

# The lists and suffixes of the published algorithm, in its order.
VOWELS = "aeiouy"
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = frozenset("sky news howe atlas cosmos bias andes".split())
UNCHANGED_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT_END = re.compile("(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")


def _after(word: str, start: int) -> int:
    """Where the region begins: after the first vowel that a consonant follows."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _ends(word: str, suffixes) -> str | None:
    """The longest of the suffixes (longest first) that a word ends in."""
    return next((s for s in suffixes if word.endswith(s)), None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case English word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    if word in UNCHANGED:
        return word
    word = word.removeprefix("'")
    word = re.sub("^y|(?<=[aeiouy])y", "Y", word)  # a y that is no vowel
    prefix = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = len(prefix) if prefix else _after(word, 0)
    r2 = _after(word, r1)
    word = re.sub("(?:'s'|'s|')$", "", word)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in UNCHANGED_AFTER_PLURAL:
        return word

    suffix = _ends(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if suffix in ("eedly", "eed"):
        if len(word) - len(suffix) >= r1:
            word = word[: -len(suffix)] + "ee"
    elif suffix and re.search("[aeiouy]", word[: -len(suffix)]):
        word = word[: -len(suffix)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif len(word) <= r1 and _SHORT_END.match(word):
            word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    suffix = _ends(word, STEP_2)
    if suffix and len(word) - len(suffix) >= r1:
        rest = word[: -len(suffix)]
        if suffix == "li":
            word = rest if rest[-1:] in tuple("cdeghkmnrt") else word
        elif suffix != "ogi" or rest.endswith("l"):
            word = rest + STEP_2[suffix]

    suffix = _ends(word, STEP_3)
    if suffix and len(word) - len(suffix) >= r1 and (suffix != "ative" or len(word) - len(suffix) >= r2):
        word = word[: -len(suffix)] + STEP_3[suffix]

    suffix = _ends(word, STEP_4)
    if suffix and len(word) - len(suffix) >= r2 and (suffix != "ion" or word[: -len(suffix)].endswith(("s", "t"))):
        word = word[: -len(suffix)]

    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or at >= r1 and not _SHORT_END.match(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
