"""Vectors: cosine top-k (V3, V6), missing vectors (V2), quantised two-stage search (V7), rank fusion (V4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD, RRF_K, OVERSAMPLING = 0.25, 60, 2.0
QUERY_PREFIX, PASSAGE_PREFIX = "query: ", "passage: "


def dot(vec: Column, query: list[float]) -> Column:
    """Dot product in double precision, in the JVM."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vec, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def unit(vector: list[float]) -> list[float]:
    """L2-normalised; a zero vector stays."""
    v = np.asarray(vector, dtype=float)
    return list(v / (np.linalg.norm(v) or 1.0))


def top_k(vectors: DataFrame, query: list[float], limit: int, least: float | None = THRESHOLD, offset: int = 0, id_: str = "passage_id", vec: str = "vec") -> DataFrame:
    """(id, sim): the limit first, then the threshold."""
    rows = vectors.select(id_, dot(F.col(vec), query).alias("sim")).orderBy(F.desc("sim"), id_).offset(offset).limit(limit)
    return rows if least is None else rows.where(F.col("sim") >= least)


def quantised(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """vectors with `q8`: components of a unit vector as bytes."""
    return vectors.withColumn("q8", F.transform(vec, lambda x: F.round(x * 127).cast("byte")))


def two_stage(vectors: DataFrame, query: list[float], limit: int, oversampling: float = OVERSAMPLING, id_: str = "passage_id", vec: str = "vec") -> DataFrame:
    """Coarse top by bytes, then the exact order of limit * oversampling rows. Reads the full vectors of those only through the limit."""
    coarse = F.aggregate(F.zip_with("q8", F.array(*[F.lit(int(round(x * 127))) for x in query]), lambda a, b: a.cast("int") * b), F.lit(0), lambda s, x: s + x)
    rows = vectors.withColumn("__c", coarse).orderBy(F.desc("__c"), id_).limit(int(limit * oversampling))
    return rows.select(id_, dot(F.col(vec), query).alias("sim")).orderBy(F.desc("sim"), id_).limit(limit)


def signs(vec: Column) -> Column:
    """One bit a component (1: above zero), 32 to a number."""
    word = lambda w: F.aggregate(F.slice(vec, w * 32 + F.lit(1), F.lit(32)), F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 1).bitwiseOR((x > 0).cast("bigint")))
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(vec) / F.lit(32)).cast("int") - F.lit(1)), word)


def binary_quantised(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """vectors with `q1`: the signs of their components, a thirty-second of the vector's size."""
    return vectors.withColumn("q1", F.when(F.size(vec) > 0, signs(F.col(vec))).otherwise(F.array().cast("array<bigint>")))


def two_stage_binary(vectors: DataFrame, query: list[float], limit: int, oversampling: float = OVERSAMPLING, id_: str = "passage_id", vec: str = "vec") -> DataFrame:
    """Coarse top by the number of equal signs, then the exact order of limit * oversampling rows."""
    apart = F.aggregate(F.zip_with("q1", signs(F.array(*[F.lit(float(x)) for x in query])), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    rows = vectors.withColumn("__c", apart).orderBy("__c", id_).limit(int(limit * oversampling))
    return rows.select(id_, dot(F.col(vec), query).alias("sim")).orderBy(F.desc("sim"), id_).limit(limit)


def missing(passages: DataFrame, vectors: DataFrame, id_: str = "passage_id") -> DataFrame:
    return passages.join(vectors.select(id_), id_, "left_anti")


def embed_missing(passages: DataFrame, vectors: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """(passage_id, vec) for passages without a vector. load() makes the model, once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            for k in range(0, len(b), batch):
                part = b.iloc[k : k + batch]
                yield pd.DataFrame({"passage_id": part["passage_id"], "vec": [np.asarray(v, dtype=np.float32) for v in model(part["text"].tolist())]})

    return missing(passages, vectors).select("passage_id", "text").mapInPandas(run, "passage_id long, vec array<float>")


def fuse(text_hits: DataFrame, vector_hits: DataFrame, limit: int, offset: int = 0, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two result pages: (passage_id, rrf). Ranks from 0; ties: text hits first, each in its order.

    Both inputs are pages of a bounded limit, so the two windows sort a page, not the corpus.
    """
    a = text_hits.select("passage_id", (F.row_number().over(Window.orderBy("score", "passage_id")) - 1).alias("ra"))
    b = vector_hits.select("passage_id", (F.row_number().over(Window.orderBy(F.desc("sim"), "passage_id")) - 1).alias("rb"))
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(r)), F.lit(0.0))
    both = a.join(b, "passage_id", "full_outer").withColumn("rrf", part("ra") + part("rb"))
    return both.orderBy(F.desc("rrf"), F.col("ra").asc_nulls_last(), "rb").offset(offset).limit(limit).select("passage_id", "rrf", "ra", "rb")


def hybrid(archive, q: str, vectors: DataFrame, embed: Callable[[str], list[float]] | None, limit: int = 20, offset: int = 0, **filters) -> DataFrame:
    """Text hits and vector hits fused; boolean, blank or unembeddable queries are full text only."""
    from ..plans import query as Q
    from .search import filtered

    span = offset + limit
    groups = Q.parse(q)
    try:
        query = None if embed is None or not q.strip() or Q.is_boolean(groups) else embed(QUERY_PREFIX + q)
    except Exception:  # any failure of a user's model: the query is answered by text alone
        query = None
    if query is None:
        return archive.search(q, limit=limit, offset=offset, **filters)
    text_hits = archive._search(groups, span * 3, 0, **filters).select("passage_id", "score")
    allowed = filtered(archive.passages.select("passage_id", "document_id").join(archive.documents, "document_id"), categories=archive.categories, **filters).select("passage_id")
    fused = fuse(text_hits, top_k(vectors.join(allowed, "passage_id", "left_semi"), unit(query), span * 3), limit, offset)
    rows = archive._full(fused.withColumnRenamed("rrf", "score"))
    return archive.hits(rows.orderBy(F.desc("score"), F.col("ra").asc_nulls_last(), "rb"), Q.positive_stems(groups)).drop("ra", "rb")
