"""Search over documents and passages: filters (P1-P11), full text (Q4-Q7), hits with snippets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import isri
from ..functions import text as T
from ..plans import query as Q
from .index import Index, search

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HIT = ["passage_id", "document_id", "title", "author", "page_from", "page_to", "text", "score", "reliability"]


def _as_list(x) -> list:
    return [v for v in (x if isinstance(x, (list, tuple, set)) else [x]) if v not in (None, "")]


def like(text: Column, part: str) -> Column:
    """LIKE %part%, folding A-Z only; % and _ in the value are wildcards."""
    return F.translate(text, UPPER, LOWER).like("%" + part.translate(str.maketrans(UPPER, LOWER)) + "%")


def filtered(rows: DataFrame, author=None, document_id=None, category=None, categories: DataFrame | None = None) -> DataFrame:
    """P1 (author substring, any of), P2 (document ids), P3 (category names through the link table, any of)."""
    if names := _as_list(author):
        rows = rows.where(T.any_of([like(F.col("author"), n) for n in names]))
    if ids := _as_list(document_id):
        rows = rows.where(F.col("document_id").isin(ids))
    if names := _as_list(category):
        wanted = categories.where(F.col("category").isin(names)).select("document_id")
        rows = rows.join(wanted, "document_id", "left_semi")
    return rows


def payload_filtered(rows: DataFrame, source=None, **exact) -> DataFrame:
    """Exact matches, any of each list, all lists."""
    for column, values in exact.items():
        if vals := _as_list(values):
            rows = rows.where(F.col(column).isin(vals))
    return rows.where(F.col("source") == source) if source else rows


def reliability(value: Column) -> Column:
    """P10: where nothing is said, pages count as safe."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("sicher"))


def clamp(limit: int = 40, offset: int = 0, most: int = 200) -> tuple[int, int]:
    """The page that a public call may ask for."""
    return max(1, min(most, limit)), max(0, offset)


class Archive:
    """documents (document_id, title, author, reliability), passages (passage_id, document_id, idx, page_from, page_to, text),
    categories (document_id, category), and the index of the passages."""

    def __init__(self, documents: DataFrame, passages: DataFrame, categories: DataFrame | None = None, index: Index | None = None):
        self.documents, self.passages, self.categories = documents, passages, categories
        self.index = index or Index.of(passages)

    def _full(self, rows: DataFrame) -> DataFrame:
        full = rows.join(self.passages, "passage_id").join(self.documents, "document_id")
        return full.withColumn("reliability", reliability(F.col("reliability")))

    def hits(self, rows: DataFrame, stems: list[str]) -> DataFrame:
        """Adds matched_words and snippet to a page of results; Arabic words go through a UDF, on these rows only."""
        if any(isri.re.search(T.ARABIC, s) for s in stems):
            wanted = frozenset(stems)

            @F.udf("array<string>")
            def matched(text):
                return list(dict.fromkeys(w for w in isri.re.findall(T.HIGHLIGHT, text or "") if isri.stem(Q._MARKS.sub("", w).translate(Q._FOLD)) in wanted))

            words = matched("text")
        else:
            words = T.matched_words(F.col("text"), stems)
        rows = rows.withColumn("matched_words", words)
        return rows.withColumn("snippet", T.snippet(F.col("text"), F.col("matched_words"))).drop("text")

    def _search(self, groups: list[Q.Group], limit: int, offset: int, **filters) -> DataFrame:
        if not any(g.positive for g in groups):
            return self._browse(limit, offset, **filters)
        rows = filtered(self._full(search(self.index, groups)), categories=self.categories, **filters)
        rows = rows.orderBy("score", "passage_id").offset(offset).limit(limit).select(*HIT)
        return self.hits(rows, Q.positive_stems(groups))

    def search(self, q: str, limit: int = 40, offset: int = 0, **filters) -> DataFrame:
        return self._search(Q.parse(q), *clamp(limit, offset), **filters)

    def structured(self, and_groups: list[list[str]], exclude: list[str] = (), limit: int = 40, offset: int = 0, **filters) -> DataFrame:
        return self._search(Q.structured(and_groups, exclude), *clamp(limit, offset), **filters)

    def browse(self, limit: int = 40, offset: int = 0, **filters) -> DataFrame:
        return self._browse(*clamp(limit, offset), **filters)

    def _browse(self, limit: int, offset: int, **filters) -> DataFrame:
        rows = filtered(self._full(self.passages.select("passage_id").withColumn("score", F.lit(0.0))), categories=self.categories, **filters)
        rows = rows.orderBy("document_id", "idx").offset(offset).limit(limit)
        return rows.select(*[c for c in HIT if c != "text"], F.array().cast("array<string>").alias("matched_words"), F.left("text", F.lit(200)).alias("snippet"))


def match_spans(text: str, stems: set[str]) -> list[tuple[int, int]]:
    return [m.span() for m in isri.re.finditer(T.HIGHLIGHT, text) if isri.stem(Q._MARKS.sub("", m[0]).translate(Q._FOLD)) in stems]


def highlight_spans(rows: DataFrame, terms: list[str] | None, text: str = "text") -> DataFrame:
    """rows with `spans`: [(start, end)] of the words whose stem is one of the terms' (F12, F15); regex offsets need Python."""
    stems = Q.stems_of_terms(terms)
    none = F.array().cast("array<struct<start:int,end:int>>")
    if not stems:
        return rows.withColumn("spans", none)

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        known: dict[str, bool] = {}  # each distinct word of a batch is stemmed once

        def hit(word):
            if word not in known:
                known[word] = isri.stem(Q._MARKS.sub("", word).translate(Q._FOLD)) in stems
            return known[word]

        return texts.map(lambda t: [{"start": m.start(), "end": m.end()} for m in isri.re.finditer(T.HIGHLIGHT, t or "") if hit(m[0])])

    return rows.withColumn("spans", spans(text))
