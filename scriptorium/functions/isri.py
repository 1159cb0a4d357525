"""Arabic root extraction after Taghva, Elkhoury and Coombs, "Arabic Stemming Without a Root Dictionary" (2005).

Written from the published description; words are stemmed once per distinct token (`stem_map`), never per row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

# Fixed values of the published algorithm: affix sets by length, letter groups, patterns.
P3 = ("كال", "بال", "ولل", "وال")
P2 = ("ال", "لل")
P1 = ("ل", "ب", "ف", "س", "و", "ي", "ت", "ن", "ا")
S3 = ("تمل", "همل", "تان", "تين", "كمل")
S2 = ("ون", "ات", "ان", "ين", "تن", "كم", "هن", "نا", "يا", "ها", "تم", "كن", "ني", "وا", "ما", "هم")
S1 = ("ة", "ه", "ي", "ك", "ت", "ا", "ن")
STOP = frozenset(("يكون", "وليس", "وكان", "كذلك", "التي", "وبين", "عليها", "مساء", "الذي", "وكانت", "ولكن", "والتي", "تكون", "اليوم", "اللذين", "عليه", "كانت", "لذلك", "أمام", "هناك", "منها", "مازال", "لازال", "لايزال", "مايزال", "اصبح", "أصبح", "أمسى", "امسى", "أضحى", "اضحى", "مابرح", "مافتئ", "ماانفك", "لاسيما", "ولايزال", "الحالي", "اليها", "الذين", "فانه", "والذي", "وهذا", "لهذا", "فكان", "ستكون", "اليه", "يمكن", "بهذا", "الذى"))
MARK = re.compile("[ً-ْ]")


def _is(word: str, shape: str) -> bool:
    """shape: a letter stands for itself, `.` for any."""
    return len(word) == len(shape) and all(s in (".", c) for s, c in zip(shape, word, strict=True))


def _take(word: str, places: tuple[int, ...]) -> str:
    return "".join(word[i] for i in places)


# shape -> places of the root letters
FOUR = (("م...", (1, 2, 3)), (".ا..", (0, 2, 3)), ("..ا.", (0, 1, 3)), ("..و.", (0, 1, 3)), ("..ي.", (0, 1, 3)), ("...ة", (0, 1, 2)))
FIVE = (
    ("..اعل", ()), ("ا..ا.", (1, 2, 4)), ("م..و.", (1, 2, 4)), ("م..ا.", (1, 2, 4)), ("م..ي.", (1, 2, 4)), ("...ان", (0, 1, 2)), ("ت..ي.", (1, 2, 4)), (".وا..", (0, 3, 4)), ("..ا.ة", (0, 1, 3)), ("..ائ.", (0, 1, 4)),
    ("م.ت..", (1, 3, 4)), ("ا.ت..", (1, 3, 4)), ("ا...ة", (1, 2, 3)), ("من...", (2, 3, 4)), ("ان...", (2, 3, 4)), ("م...ة", (1, 2, 3)), (".ا.و.", (0, 2, 4)), ("ت.ا..", (1, 3, 4)), ("م.ا..", (1, 3, 4)), (".ا..ة", (0, 2, 3)), ("..و.ة", (0, 1, 3)), ("..ي.ة", (0, 1, 3)),
)
SIX = (("است...", (3, 4, 5)), ("مست...", (3, 4, 5)), ("م.ا..ة", (1, 3, 4)), ("ا.ت.ا.", (1, 3, 5)), ("ا..و..", (1, 4, 5)), ("ا..ا..", (1, 2, 5)), ("ت...يل", ()), ("ان..ا.", (2, 3, 5)), ("ا...اء", (1, 2, 3)))


def _root(word: str, shapes) -> str | None:
    return next((_take(word, places) for shape, places in shapes if places and _is(word, shape)), None)


def _short(word: str, front: bool) -> str:
    """One affix of one letter less: the suffix first unless `front`."""
    if not front and word.endswith(S1):
        return word[:-1]
    if word.startswith(P1):
        return word[1:]
    return word[:-1] if word.endswith(S1) else word


def root(word: str) -> str:
    word = MARK.sub("", word)
    if word in STOP:
        return word
    for p in (P3 if len(word) >= 6 else ()) + (P2 if len(word) >= 5 else ()):
        if word.startswith(p):
            word = word[len(p):]
            break
    for s in (S3 if len(word) >= 6 else ()) + (S2 if len(word) >= 5 else ()):
        if word.endswith(s):
            word = word[: -len(s)]
            break
    if len(word) >= 4 and word.startswith("وو"):
        word = word[1:]
    word = re.sub("^[آأإ]", "ا", word)
    for _ in range(4):
        n = len(word)
        if n <= 3 or n > 7:
            break
        found = _root(word, {4: FOUR, 5: FIVE, 6: SIX}.get(n, ()))
        if found:
            return found
        less = _short(word, front=False)
        if less == word:
            break
        word = less
    return word


def stem(word: str) -> str:
    """Stem of a normalised word: lower case without Arabic letters, else the root, a final alif cut."""
    if not re.search("[ء-ي]", word):
        return word.lower()
    out = root(word)
    return out[:-1] if len(out) >= 3 and out.endswith("ا") else out


def stem_map(tokens: DataFrame, column: str) -> DataFrame:
    """(token, stem) for the distinct tokens of a column: the JVM does Latin ones, Python the Arabic rest."""
    words = tokens.select(F.col(column).alias("token")).distinct()
    latin = words.where(~F.col("token").rlike(T.ARABIC)).select("token", F.lower("token").alias("stem"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"token": b["token"], "stem": b["token"].map(stem)})

    return latin.union(words.where(F.col("token").rlike(T.ARABIC)).mapInPandas(run, "token string, stem string"))
