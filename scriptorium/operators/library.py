"""Library export and import (S12, S13): Parquet tables and a JSON manifest; recomputation of what derives from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .index import Index

FORMAT = 1
CARRIED = ("documents", "pages", "passages", "vectors")


def export_library(tables: dict[str, DataFrame], path: str, ids: list[int] | None = None) -> None:
    """documents, pages, passages, vectors (of the chosen documents) and a manifest."""
    out = {k: t for k, t in tables.items() if k in CARRIED}
    if ids is not None:
        chosen = F.col("document_id").isin(ids)
        out = {k: t.where(chosen) if "document_id" in t.columns else t for k, t in out.items()}
        if "vectors" in out:
            out["vectors"] = out["vectors"].join(out["passages"].select("passage_id"), "passage_id", "left_semi")
    for k, t in out.items():
        t.write.mode("overwrite").parquet(f"{path}/{k}")
    m = out["documents"].agg(F.lit(FORMAT).alias("format"), F.count(F.lit(1)).alias("documents"), F.count("file_path").alias("files_included") if "file_path" in out["documents"].columns else F.lit(0).alias("files_included"))
    m.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def import_library(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """tables with the documents of an export that aren't there yet: new ids, links from author strings, vectors carried.

    Categories are not carried. The index of the result is Index.of(passages).
    """
    got = {k: spark.read.parquet(f"{path}/{k}") for k in CARRIED if k in tables}
    new = catalog.remapped(catalog.not_imported(got["documents"], tables["documents"]), tables["documents"], "document_id")
    ids = new.select("document_id", F.col("new_id").alias("__d"))
    out = dict(tables)
    out["documents"] = tables["documents"].unionByName(new.drop("document_id").withColumnRenamed("new_id", "document_id").select(*tables["documents"].columns))
    if "pages" in got:
        out["pages"] = tables["pages"].unionByName(got["pages"].join(ids, "document_id").drop("document_id").withColumnRenamed("__d", "document_id").select(*tables["pages"].columns))
    passages = catalog.remapped(got["passages"].join(ids, "document_id").drop("document_id").withColumnRenamed("__d", "document_id"), tables["passages"], "passage_id")
    if "vectors" in got:
        v = got["vectors"].join(passages.select("passage_id", "new_id"), "passage_id").drop("passage_id").withColumnRenamed("new_id", "passage_id")
        out["vectors"] = tables["vectors"].unionByName(v.select(*tables["vectors"].columns))
    out["passages"] = tables["passages"].unionByName(passages.drop("passage_id").withColumnRenamed("new_id", "passage_id").select(*tables["passages"].columns))
    out["author_names"], out["author_links"] = catalog.synced_links(out["documents"])
    return out


def rebuilt(tables: dict[str, DataFrame], version: str) -> Index | None:
    """A new index of all passages where the stored stem version differs; None where it is current."""
    row = tables["meta"].where(F.col("key") == "stem_version").select("value").first()
    return None if row and row["value"] == version else Index.of(tables["passages"])
