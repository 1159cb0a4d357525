"""Pagination (S3) and chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PAGE_CHARS = 2000
#: Soft target, hard limit and least letters of a passage.
TARGET, HARD, MIN_LETTERS = 700, 1100, 20


def paginate(docs: DataFrame, text: str = "text", size: int = PAGE_CHARS) -> DataFrame:
    """docs without text, with page_no (from 1) and text of fixed width; empty text is one empty page."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.ceil(F.length(t) / F.lit(size)), F.lit(1)).cast("int")
    pages = F.transform(F.sequence(F.lit(0), n - F.lit(1)), lambda i: F.substring(F.col("__t"), i * F.lit(size) + F.lit(1), F.lit(size)))
    d = docs.withColumns({"__t": t}).withColumn("__p", pages)
    rest = [c for c in docs.columns if c != text]
    return d.select(*rest, F.posexplode_outer("__p").alias("__i", "text")).select(*rest, (F.col("__i") + 1).alias("page_no"), "text")


def chunks(text: Column) -> Column:
    """The passages of one page, in order: a left fold over sentence pieces.

    A sentence longer than HARD is cut into heads of HARD characters, each of which ends a passage, and a tail.
    """

    def pieces(s):
        heads = F.greatest(F.ceil(F.length(s) / F.lit(HARD)).cast("int") - F.lit(1), F.lit(0))
        return F.transform(F.sequence(F.lit(0), heads), lambda i: F.struct(F.when(i < heads, F.substring(s, i * F.lit(HARD) + F.lit(1), F.lit(HARD))).otherwise(F.substring(s, i * F.lit(HARD) + F.lit(1), F.lit(1 << 30))).alias("p"), (i < heads).alias("head")))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("buf"), F.lit(0).alias("n"))
    none = F.array().cast("array<string>")

    def emit(out, buf):
        passage = T.strip(F.array_join(buf, " "))
        kept = F.transform(F.array(passage), lambda x: F.when(T.letter_count(x) >= MIN_LETTERS, F.array(x)).otherwise(none))[0]
        return F.concat(out, kept)

    def step(a, x):
        n = F.length(x["p"])
        added = F.concat(a["buf"], F.array(x["p"]))
        full = (a["n"] + n > TARGET) & (F.size(a["buf"]) > 0)
        return (
            F.when(x["head"], F.struct(emit(a["out"], added).alias("out"), none.alias("buf"), F.lit(0).alias("n")))
            .when(full, F.struct(emit(a["out"], a["buf"]).alias("out"), F.array(x["p"]).alias("buf"), (n + F.lit(1)).alias("n")))
            .otherwise(F.struct(a["out"].alias("out"), added.alias("buf"), (a["n"] + n + F.lit(1)).alias("n")))
        )

    flat = F.flatten(F.transform(T.sentences(text), pieces))
    return F.aggregate(flat, start, step, lambda a: F.when(F.size(a["buf"]) > 0, emit(a["out"], a["buf"])).otherwise(a["out"]))


def chunk(pages: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, idx, page_from, page_to, text): kept passages, numbered through each document from 0."""
    p = pages.select(document, "page_no", F.posexplode(chunks(F.col("text"))).alias("pos", "text"))
    w = Window.partitionBy(document).orderBy("page_no", "pos")
    return p.select(document, (F.row_number().over(w) - 1).alias("idx"), F.col("page_no").alias("page_from"), F.col("page_no").alias("page_to"), "text")
