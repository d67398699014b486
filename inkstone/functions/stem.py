"""Porter's suffix stripping (1980) over Arrow batches, words of over three letters only."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The published suffix tables of steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c", _shape(w)))


def _short_end(w: str) -> bool:
    """Ends consonant, vowel, consonant, the last none of w, x, y."""
    return _shape(w).endswith("cvc") and w[-1] not in "wxy"


def _table(w: str, table: dict[str, str]) -> str:
    """The longest matching suffix decides, whether its condition holds or not."""
    for n in range(min(len(w), 7), 0, -1):
        if w[-n:] in table:
            return w[:-n] + table[w[-n:]] if _measure(w[:-n]) > 0 else w
    return w


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """The stem of a lower-case word; three letters or fewer stay."""
    if len(w) <= 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((x for x in ("ed", "ing") if w.endswith(x) and "v" in _shape(w[: -len(x)])), "")
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")) or (_measure(w) == 1 and _short_end(w)):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                w = w[:-1]
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _table(_table(w, STEP2), STEP3)
    for x in sorted(STEP4, key=len, reverse=True):
        if w.endswith(x):
            base = w[: -len(x)] + (x[0] if x in ("sion", "tion") else "")
            w = base if _measure(base) > 1 else w
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stems(words: Column) -> Column:
    """Stems of a column of words; null stays null.  The function is made at call time, when a session is there."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda w: None if w is None else stem(w))

    return run(words)
