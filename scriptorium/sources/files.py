"""File sources (S1-S5, S8, S15, S18). Converters, PDF layout and OCR are outside programs: pluggable, not built in."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from ..functions import text as T
from ..operators.chunk import paginate

PARAGRAPH = re.compile(r"<w:p[ >].*?</w:p>|<w:p/>", re.S)
RUN = re.compile(r"<w:t(?: [^>]*)?>([^<]*)</w:t>|<w:(tab|br|cr)/>")
ENTITY = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): UTF-8 with replacement of broken bytes, universal newlines."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", newlines(_decoded(F.col("content"))).alias("text"))


@F.pandas_udf(StringType())
def _decoded(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


def docx_text(data: bytes) -> str:
    """Paragraphs of word/document.xml, one per line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "replace")
    lines = ["".join(t if t or not b else "\t" if b == "tab" else "\n" for t, b in RUN.findall(p)) for p in PARAGRAPH.findall(xml)]
    return re.sub("|".join(ENTITY), lambda m: ENTITY[m[0]], "\n".join(lines))


def docx_pages(data: bytes) -> int | None:
    """The page count that the writing program has noted."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            m = re.search(r"<Pages>(\d+)</Pages>", z.read("docProps/app.xml").decode("utf-8", "replace"))
        return int(m[1]) if m else None
    except (KeyError, zipfile.BadZipFile):
        return None


@F.pandas_udf(LongType())
def docx_page_count(content: pd.Series) -> pd.Series:
    return content.map(lambda b: docx_pages(bytes(b))).astype("Int64")


def extract(spark: SparkSession, path: str, pdf: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """The pages of the .txt, .docx and .pdf files under path."""
    return extracted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), pdf)


def extracted(files: DataFrame, pdf: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, page_no, text, reliability, engine, error) of files (path, content); files of other kinds and broken ones carry an error.

    pdf(bytes) -> page texts is the user's PDF reader. Files are split into pages in Python where the format needs it,
    plain text is paginated in the JVM.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, data in zip(b["path"], b["content"], strict=True):
                ext = name.lower().rpartition(".")[2]
                try:
                    if ext == "txt":
                        rows.append((name, None, bytes(data).decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"), "sicher", "TXT", None))
                    elif ext == "docx":
                        rows.append((name, None, docx_text(bytes(data)), "ungefähr", "DOCX", None))
                    elif ext == "pdf" and pdf:
                        rows += [(name, k, t.strip(), "sicher", "PDF", None) for k, t in enumerate(pdf(bytes(data)), 1)]
                    else:
                        raise ValueError(f"unsupported file type: {ext}")
                except Exception as e:  # a broken file is a row with its error, not a broken job
                    rows.append((name, None, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "reliability", "engine", "error"]).astype({"page": "Int32"})

    found = files.select("path", "content").mapInPandas(run, "path string, page int, text string, reliability string, engine string, error string")
    whole = paginate(found.where("page is null and error is null").drop("page")).select("path", "page_no", "text", "reliability", "engine", "error")
    pages = found.where("page is not null").select("path", F.col("page").alias("page_no"), T.clean_pdf_text(F.col("text")).alias("text"), "reliability", "engine", "error")
    return whole.union(pages).union(found.where("error is not null").select("path", F.col("page").alias("page_no"), "text", "reliability", "engine", "error"))


def _split_name(name: Column) -> tuple[Column, Column]:
    """Stem and ending (with its dot) of a file name; a name that begins with its only dot is all stem."""
    ending = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)\z", 1)
    return F.left(name, F.length(name) - F.length(ending)), ending


def free_names(uploads: DataFrame, taken: DataFrame) -> DataFrame:
    """S15 over tables: uploads (name, ...) with `free`, the first of name, name-2, name-3, ... that taken (name) doesn't have.

    A taken name counts as number 1 of itself and as number k of what it is without -k. The first free number follows the first number
    whose successor is missing: a join of numbers with numbers, so no name's files are gathered.
    """
    numbered = r"(?s)^(.+)-([2-9]|[1-9][0-9]{1,17})\z"
    stem, ending = _split_name(F.col("name"))
    k = F.regexp_extract(stem, numbered, 2)
    first = taken.select(F.col("name").alias("__base"), F.lit(1).cast("bigint").alias("__k"))
    more = taken.select(F.concat(F.regexp_extract(stem, numbered, 1), ending).alias("__base"), F.nullif(k, F.lit("")).cast("bigint").alias("__k"))
    t = first.union(more.where("__k is not null")).where("__base is not null").distinct()
    last = t.join(t.select("__base", (F.col("__k") - 1).alias("__k")), ["__base", "__k"], "left_anti").groupBy("__base").agg(F.min("__k").alias("__last"))
    last = last.join(first.select("__base"), "__base", "left_semi")
    u = uploads.withColumn("__base", F.element_at(F.split(F.translate("name", "\\", "/"), "/"), -1)).join(last, "__base", "left")
    stem, ending = _split_name(F.col("__base"))
    free = F.when(F.col("__last").isNull(), F.col("__base")).otherwise(F.concat(stem, F.lit("-"), (F.col("__last") + 1).cast("string"), ending))
    return u.select(*uploads.columns, free.alias("free"))


def free_name(name: str, taken: set[str]) -> str:
    """Name, or name-2, name-3, ..."""
    name = name.replace("\\", "/").rpartition("/")[2]
    stem, dot, ext = name.rpartition(".")
    stem, ext = (stem, dot + ext) if stem else (name, "")
    return next(n for k in range(1, len(taken) + 2) if (n := name if k == 1 else f"{stem}-{k}{ext}") not in taken)
