"""Text functions as column expressions (F1-F24). Code-point semantics throughout."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes and mappings of the orthographic normal form.
MARKS = r"[ؐ-ًؚ-ٰٟۖ-ۭـ]"
FOLD_FROM = "آأإٱىةؤئ٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
FOLD_TO = "اااايهوي01234567890123456789"
TOKEN = r"([ء-يٮ-ۓA-Za-z0-9]+)"
ARABIC = r"[ء-ي]"
LETTERS_NOT = r"[^ء-يA-Za-z]"
HIGHLIGHT = r"([ء-يٮ-ۓؐ-ٰA-Za-z0-9ً-ٟ]+)"
SENTENCE_END = r"(?U)(?<=[.!?؟۔])\s+|\n{2,}"
EDGES = r"(?U)^\s+|\s+$"
# Affixes of the light stemmer, first match wins.
LIGHT_PREFIXES = ("وال", "فال", "بال", "كال", "لل", "ال", "و", "ف", "ب", "ك", "ل", "س")
LIGHT_SUFFIXES = ("كما", "هما", "تما", "تان", "ات", "ان", "ون", "ين", "ها", "هم", "هن", "كم", "كن", "نا", "وا", "ية", "ه", "ة", "ي", "ك", "ت", "ا", "ن")
AUTHOR_JOIN = " ؛ "
ELLIPSIS = "…"


def strip(text: Column) -> Column:
    """Trim of all Unicode white space (trim() takes blanks only)."""
    return F.regexp_replace(text, EDGES, "")


def normalize(text: Column) -> Column:
    return F.translate(F.regexp_replace(text, MARKS, ""), FOLD_FROM, FOLD_TO)


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(normalize(text), F.lit(TOKEN), 1)


def light_stem(word: Column) -> Column:
    """The longest rules first, as listed; three letters must remain."""
    cases = [F.when(word.startswith(p) & (F.length(word) - len(p) >= 3), F.substring(word, len(p) + 1, 1 << 20)) for p in LIGHT_PREFIXES]
    front = F.coalesce(*cases, word)

    def back(w):
        ends = [F.when(w.endswith(s) & (F.length(w) - len(s) >= 3), F.left(w, F.length(w) - F.lit(len(s)))) for s in LIGHT_SUFFIXES]
        return F.coalesce(*ends, w)

    return F.transform(F.array(front), lambda w: back(w))[0]


def cut_alif(stem: Column) -> Column:
    return F.when((F.length(stem) >= 3) & stem.endswith("ا"), F.left(stem, F.length(stem) - F.lit(1))).otherwise(stem)


def latin_stem(word: Column) -> Column:
    """The stem of a word without Arabic letters; null for others."""
    return F.when(~word.rlike(ARABIC), F.lower(word))


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, SENTENCE_END), lambda s: strip(s))
    return F.filter(parts, lambda s: s != "")


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, LETTERS_NOT, ""))


def split_authors(text: Column, distinct: bool = True) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\s*[؛;]\s*"), lambda s: strip(s)), lambda s: s != "")
    return F.array_distinct(parts) if distinct else parts


def join_authors(names: Column) -> Column:
    clean = F.array_distinct(F.filter(F.transform(names, lambda s: strip(s)), lambda s: s != ""))
    return F.nullif(F.array_join(clean, AUTHOR_JOIN), F.lit(""))


def matched_words(text: Column, stems: list[str]) -> Column:
    """Distinct words of the original text, in order, whose stem is among `stems` (words without Arabic letters)."""
    words = F.regexp_extract_all(text, F.lit(HIGHLIGHT), 1)
    wanted = F.array(*[F.lit(s) for s in stems]) if stems else F.array().cast("array<string>")
    return F.array_distinct(F.filter(words, lambda w: F.array_contains(wanted, F.lower(normalize(w)))))


def snippet(text: Column, matched: Column, width: int = 240) -> Column:
    n = F.length(text)
    plain = F.concat(F.left(text, F.lit(width)), F.when(n > width, F.lit(ELLIPSIS)).otherwise(F.lit("")))
    pos = F.greatest(F.call_function("instr", text, F.get(matched, F.lit(0))) - F.lit(1), F.lit(0))
    start = F.greatest(pos - F.lit(width // 3), F.lit(0))
    end = F.least(n, start + F.lit(width))
    cut = F.concat(F.when(start > 0, F.lit(ELLIPSIS)).otherwise(F.lit("")), strip(F.substring(text, start + F.lit(1), end - start)), F.when(end < n, F.lit(ELLIPSIS)).otherwise(F.lit("")))
    return F.when(F.size(matched) == 0, plain).otherwise(cut)


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC; text below U+00A0 is its own normal form and stays in the JVM."""
    return F.when(text.rlike(r"[^\x00-\x9F]"), _nfkc(text)).otherwise(text)


def clean_pdf_text(text: Column) -> Column:
    return F.regexp_replace(nfkc(text), r"[ \t]+(?=[ً-ٰ])", "")


def ocr_form(text: Column, normal=nfkc) -> Column:
    t = F.regexp_replace(normal(text), r"[ً-ْٰـ]", "")
    t = F.regexp_replace(t, r"[آأإٱ]", "ا")
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def version_parts(version: Column) -> Column:
    """Leading digits of the first three dot parts, as numbers."""
    part = lambda p: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(p, r"^(\d{1,18})", 1), F.lit("")), F.lit("9" * 18)).cast("bigint"), F.lit(0).cast("bigint"))
    return F.slice(F.concat(F.transform(F.slice(F.split(version, r"\."), 1, 3), part), F.array_repeat(F.lit(0).cast("bigint"), 3)), 1, 3)


def newer(a: Column, b: Column) -> Column:
    """Whether version a is newer than b (as number triples)."""
    x, y = version_parts(a), version_parts(b)
    order = [F.when(x[i] != y[i], x[i] > y[i]) for i in range(3)]
    return F.coalesce(*order, F.lit(False))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r'[\\/:*?"<>|]', "_")


def file_stem(path: Column) -> Column:
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.lower(F.when(base.rlike(r".\.[^.]*$"), F.regexp_extract(base, r"^(.+)\.[^.]*$", 1)).otherwise(base))


def file_ext(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]*)$", 1))


def terms_from_json(text: Column) -> Column:
    """Tolerant: what isn't a JSON array of strings is no terms."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
