"""Shared column helpers; the table store of the package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..session import shared_dir, stored

__all__ = ["ascii_lower", "blank_words", "bound", "covered", "meet", "packed", "shared_dir", "ship", "stored", "unpacked", "word_hashes"]

#: Texts go to Python workers in batches of at most so many rows and bytes, so that a worker's memory doesn't follow the length of texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Send the package to Python workers and bound their batches. For the queries; a caller of the operators chooses for their session."""
    session.ship(spark)
    for k, v in BATCH.items():
        spark.conf.set(k, v)


#: What is found for documents goes to all executors up to so many bytes, and meets them by shuffle beyond.
BROADCAST_BYTES = 128 << 20


def packed(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (all columns of docs as one struct), doc_id, th (hash of the text), text: the caller's names can't clash with an operator's."""
    return docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), F.xxhash64(docs[f"`{text}`"]).alias("th"), docs[f"`{text}`"].alias("text"))


def unpacked(df: DataFrame, columns: list[str], new: dict[str, Column]) -> DataFrame:
    """The caller's columns again, in their order, with new values for those in `new`."""
    return df.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in columns])


def meet(keyed: DataFrame, found: DataFrame, how: str, size: Column) -> DataFrame:
    """keyed (doc_id, th, ...) with the columns of found (doc_id, th, ...: a stored table of one row per document).

    size is the bytes that a row of found takes. Up to BROADCAST_BYTES in all, found is broadcast and the texts stay where they are.
    """
    if (found.agg(F.sum(size.cast("double"))).first()[0] or 0) <= BROADCAST_BYTES:
        found = F.broadcast(found)
    mine = [] if how in ("left_semi", "left_anti") else [F.col(f"b.{c}") for c in found.columns if c not in ("doc_id", "th")]
    c = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a.th") == F.col("b.th")]
    return keyed.alias("a").join(found.alias("b"), c, how).select("a.*", *mine)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, also where f uses it in a lambda."""
    return F.transform(F.array(value), f)[0]


#: Separators of `[^\x20\x09-\x0D]+` words.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def blank_words(text: Column) -> Column:
    """Words `[^\x20\x09-\x0D]+` in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else. lower() is the same on pure ASCII and has a fast path there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def covered(starts: Column, size: int) -> Column:
    """Number of positions inside any [start, start + size). starts: ascending array<int>."""
    zero = F.struct(F.lit(0).cast("int").alias("e"), F.lit(0).cast("bigint").alias("t"))

    def step(a, p):
        return F.struct((p + F.lit(size)).cast("int").alias("e"), (a["t"] + (p + F.lit(size) - F.greatest(p, a["e"]))).cast("bigint").alias("t"))

    return F.aggregate(starts, zero, step, lambda a: a["t"])
