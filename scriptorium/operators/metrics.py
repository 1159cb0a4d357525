"""Text quality: broken text layers (A10), scans (A11), comparison metrics (M1-M7)."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..functions import text as T

ARABIC_WORD = r"([ء-ي]+)"


def text_layer_broken(text: Column) -> Column:
    """A10: whether Arabic text looks reversed, by three signs; fewer than 30 words say nothing."""

    def signs(w):
        count = lambda test: F.size(F.filter(w, test))
        rev, fi = count(lambda x: x == "يف"), count(lambda x: x == "في")
        ta, al = count(lambda x: x.startswith("ة")), count(lambda x: x.startswith("ال"))
        la = count(lambda x: x.endswith("لا") & (F.length(x) > 3))
        n = F.size(w)
        return (n >= 30) & ((rev > F.greatest(F.lit(3), fi)) | (ta > F.greatest(F.lit(4.0), n * F.lit(0.003))) | (la > F.greatest(F.lit(4), al)))

    words = F.regexp_extract_all(text, F.lit(ARABIC_WORD), 1)
    return F.transform(F.array(words), lambda w: signs(w))[0]


def broken_documents(pages: DataFrame, document: str = "document_id") -> DataFrame:
    """A10 over documents: pages are counted each and summed, so no document's text is gathered."""
    w = F.regexp_extract_all("text", F.lit(ARABIC_WORD), 1)
    tests = {"n": lambda x: F.lit(True), "rev": lambda x: x == "يف", "fi": lambda x: x == "في", "ta": lambda x: x.startswith("ة"), "al": lambda x: x.startswith("ال"), "la": lambda x: x.endswith("لا") & (F.length(x) > 3)}
    p = pages.select(document, w.alias("w")).select(document, *[F.size(F.filter("w", t)).cast("bigint").alias(k) for k, t in tests.items()])
    s = p.groupBy(document).agg(*[F.sum(k).alias(k) for k in tests])
    broken = (F.col("n") >= 30) & ((F.col("rev") > F.greatest(F.lit(3), "fi")) | (F.col("ta") > F.greatest(F.lit(4.0), F.col("n") * 0.003)) | (F.col("la") > F.greatest(F.lit(4), "al")))
    return s.select(document, broken.alias("broken"))


def scans(pages: DataFrame, document: str = "document_id") -> DataFrame:
    """Documents more than half of whose pages are blank."""
    blank = F.when(T.strip(F.coalesce("text", F.lit(""))) == "", 1.0).otherwise(0.0)
    return pages.groupBy(document).agg((F.avg(blank) > 0.5).alias("is_scan"))


def _ratio(a, b) -> float:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() * 100 if a and b else 0.0


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def _order(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio(list(x), list(y)) if x is not None and y is not None else 0.0 for x, y in zip(a, b, strict=True)])


def similarity(a: Column, b: Column) -> Column:
    """M1: percent of matching characters of the OCR normal forms."""
    return _similarity(T.ocr_form(a), T.ocr_form(b))


def words(text: Column, pattern: str = ARABIC_WORD, least: int = 3) -> Column:
    return F.filter(F.regexp_extract_all(T.ocr_form(text), F.lit(pattern), 1), lambda w: F.length(w) >= least)


def word_order(a: Column, b: Column, pattern: str = ARABIC_WORD) -> Column:
    """M2."""
    return _order(words(a, pattern), words(b, pattern))


def findable(reference: Column, candidate: Column) -> Column:
    """M3: percent of the reference's occurrences (array of stems) that the candidate (array of stems) has; 0 for an empty reference."""
    found = F.size(F.filter(reference, lambda s: F.array_contains(candidate, s)))
    return F.when(F.size(reference) > 0, found * F.lit(100.0) / F.size(reference)).otherwise(0.0)


def tashkil(text: Column) -> Column:
    """M4: vowel marks per 100 letters."""
    marks = F.length(text) - F.length(F.regexp_replace(text, r"[ً-ْ]", ""))
    letters = F.length(F.regexp_replace(text, r"[^ء-ي]", ""))
    return F.when(letters > 0, marks * F.lit(100.0) / letters).otherwise(0.0)


def assemble_rtl(boxes: DataFrame, page: str = "page_id") -> DataFrame:
    """M5: boxes(page, x0, x1, y0, y1, text) to text: lines from the top, words of a line from the right.

    Lines are found greedily, in order. A page's boxes are bounded by the page; they meet in one row, and rows go to Python in batches.
    """

    @F.pandas_udf(StringType())
    def lines_of(pages: pd.Series) -> pd.Series:
        return pages.map(_lines)

    box = F.struct("y0", "y1", "x0", "x1", "text")
    return boxes.groupBy(page).agg(F.array_sort(F.collect_list(box)).alias("b")).select(page, lines_of("b").alias("text"))


def _lines(boxes) -> str:
    """The text of a page from its boxes, in order of their tops."""
    lines: list[list] = []  # top, bottom, members
    for b in boxes:
        top, bottom = b["y0"], b["y1"]
        for line in lines:
            least = min(line[1] - line[0], bottom - top)
            if least > 0 and (min(line[1], bottom) - max(line[0], top)) / least > 0.5:
                line[:] = [min(line[0], top), max(line[1], bottom), [*line[2], b]]
                break
        else:
            lines.append([top, bottom, [b]])
    said = [" ".join(x["text"] for x in sorted(line[2], key=lambda x: -x["x1"])) for line in sorted(lines, key=lambda x: x[0])]
    return "\n".join(said)


def deviation(pages: Column, reference: Column) -> Column:
    """M7: by how many pages a count is off."""
    return F.abs(pages - reference)


def summary(rows: DataFrame, engine: str, metrics: list[str]) -> DataFrame:
    """M6."""
    return rows.groupBy(engine).agg(*[F.avg(m).alias(m) for m in metrics])
