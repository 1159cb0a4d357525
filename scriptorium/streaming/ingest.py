"""Incremental ingest: a file source of documents, each new document becomes pages and passages exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunk import chunk, paginate
from ..session import stored

TABLES = ("documents", "pages", "passages")


def _there(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/documents")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def ingest_batch(batch: DataFrame, path: str, number: int) -> None:
    """Write what is new of a batch under its number: a batch that runs again writes the same folders again.

    Of several rows of one id the least by all columns counts. What is new is stored first, so that all three tables are of the same rows.
    """
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c != "document_id"]
    new = batch.groupBy("document_id").agg(F.min(F.struct(*rest)).alias("r")).select(*[F.col(c) if c == "document_id" else F.col(f"r.{c}").alias(c) for c in batch.columns])
    if _there(spark, path):
        others = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/documents").where(~F.input_file_name().contains(f"batch={number}/")).select("document_id")
        new = new.join(others, "document_id", "left_anti")
    new = stored(new, "batch")
    pages = paginate(new.select("document_id", "text"))
    for name, t in (("pages", pages), ("passages", chunk(pages)), ("documents", new.drop("text"))):
        t.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")


def ingest_stream(spark: SparkSession, landing: str, path: str, checkpoint: str, schema: str) -> StreamingQuery:
    """A query over Parquet files of documents (document_id, text, ...) in the landing folder, for what is there now."""
    stream = spark.readStream.schema(schema).parquet(landing)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda b, n: ingest_batch(b, path, n)).start()
