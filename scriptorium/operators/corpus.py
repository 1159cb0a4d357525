"""Bulk corpus: derived dimensions (A6, A7) and page reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def dimension(rows: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row per key, by the first in load order; rows with a null in the key are skipped."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    best = rows.where(whole).groupBy(*key).agg(F.min_by(F.struct(*columns), order).alias("__r"))
    return best.select(*key, *[F.col(f"__r.{c}").alias(c) for c in columns])


def merged(parts: Column) -> Column:
    """Text of parts (array of struct(cs, o, ce, tx), sorted): overlaps once, gaps not padded."""
    zero = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("upto"))

    def step(a, p):
        tail = F.when(p["cs"] >= a["upto"], p["tx"]).otherwise(F.substring(p["tx"], (a["upto"] - p["cs"]).cast("int") + F.lit(1), F.lit(1 << 30)))
        more = F.struct(F.concat(a["text"], tail).alias("text"), F.greatest(a["upto"], p["ce"]).alias("upto"))
        return F.when(p["ce"] <= a["upto"], a).otherwise(more)

    return T.strip(F.aggregate(parts, zero, step, lambda a: a["text"]))


def reconstruct(chunks: DataFrame, key: list[str], order: str) -> DataFrame:
    """Pages from overlapping chunks (char_start, char_end, text, order): one row per key with the page's text."""
    part = F.struct(F.coalesce(F.col("char_start").cast("bigint"), F.lit(0)).alias("cs"), F.col(order).alias("o"), F.coalesce(F.col("char_end").cast("bigint"), F.lit(0)).alias("ce"), F.coalesce("text", F.lit("")).alias("tx"))
    return chunks.groupBy(*key).agg(F.array_sort(F.collect_list(part)).alias("p")).select(*key, merged(F.col("p")).alias("text"))


def neighbours(pages: DataFrame, book: int, seq: int, before: int, after: int) -> DataFrame:
    """R2: the pages of a book around seq, within the book's bounds, in order; none for an unknown book."""
    mine = pages.where(F.col("book_id") == book)
    bounds = mine.agg(F.min("sequence_num").alias("lo"), F.max("sequence_num").alias("hi"))
    inside = F.col("sequence_num").between(F.greatest(F.col("lo"), F.lit(seq - before)), F.least(F.col("hi"), F.lit(seq + after)))
    return mine.join(F.broadcast(bounds)).where(inside).orderBy("sequence_num").select(*pages.columns)


def page_counts(books: DataFrame, pages: DataFrame) -> DataFrame:
    """The scalar count per book, 0 without pages."""
    n = pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("page_count"))
    return books.join(n, "book_id", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0)))
