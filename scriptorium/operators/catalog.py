"""The catalogue of a library as pure functions DataFrame -> DataFrame.

documents(document_id, title, author, ...), names(id, name), links(document_id, id), passages, bookmarks. Nothing is changed in
place: a caller writes the result as the next snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import stored


# -- joins and counts ---------------------------------------------------------------------------------------------------

def with_count(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Parents with the number of their children, 0 kept; children are counted before the join."""
    n = children.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def with_names(documents: DataFrame, links: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Documents with their names, sorted."""
    each = links.join(names, "id").groupBy("document_id").agg(F.array_sort(F.collect_set("name")).alias(column))
    return documents.join(each, "document_id", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))


def facet(rows: DataFrame, column: str) -> DataFrame:
    """Values that aren't empty, with counts, by value."""
    return rows.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column)


def top_facet(rows: DataFrame, column: str, limit: int) -> DataFrame:
    """A3: the most frequent values."""
    return facet(rows, column).orderBy(F.desc("n"), column).limit(limit)


def distinct_parts(rows: DataFrame, column: str) -> DataFrame:
    """A5: the distinct names in a joined list column, sorted."""
    return rows.select(F.explode(T.split_authors(F.col(column))).alias("name")).distinct().orderBy("name")


def not_imported(incoming: DataFrame, present: DataFrame) -> DataFrame:
    """Incoming documents whose (title, page_count) isn't there yet, nor earlier among the incoming. A null page_count never matches."""
    new = incoming.join(present.select("title", "page_count").distinct(), ["title", "page_count"], "left_anti").select(*incoming.columns)
    known = new.where("title is not null and page_count is not null")
    first = known.groupBy("title", "page_count").agg(F.min("document_id").alias("document_id")).select("document_id")
    return known.join(first, "document_id", "left_semi").select(*incoming.columns).union(new.where("title is null or page_count is null"))


def without_shadowed(files: DataFrame, library: DataFrame) -> DataFrame:
    """files(path) but for .docx ones whose name is also that of a .pdf here or in the library (path)."""
    library = library.where(T.file_ext(F.col("path")) == ".pdf")
    f = files.withColumns({"__stem": T.file_stem(F.col("path")), "__ext": T.file_ext(F.col("path"))})
    pdf = f.where(F.col("__ext") == ".pdf").select("__stem").union(library.select(T.file_stem(F.col("path")))).distinct()
    docx = f.where(F.col("__ext") == ".docx").join(pdf, "__stem", "left_anti")
    return f.where(F.col("__ext") != ".docx").select("path").union(docx.select("path"))


def on_page(points: DataFrame, passages: DataFrame) -> DataFrame:
    """points(document_id, page_no) with the passages whose page range holds them."""
    p = passages.select("document_id", "passage_id", "page_from", "page_to")
    return points.join(p, "document_id").where(F.col("page_no").between(F.col("page_from"), F.col("page_to")))


def repaired_bookmarks(bookmarks: DataFrame, documents: DataFrame, passages: DataFrame) -> DataFrame:
    """bookmarks(id, document_id, passage_id, doc_title, page_no, snippet) with the document and passage they mean today.

    The document by id, else the first by title; the passage by id, else on the page the first with the snippet's first 40
    characters, else the page's first. A bookmark without a document keeps its passage_id and is missing.
    """
    b = bookmarks.withColumnRenamed("document_id", "was").withColumnRenamed("passage_id", "old")
    same = documents.select(F.col("document_id").alias("was"), F.lit(True).alias("there"))
    by_title = documents.groupBy(F.col("title").alias("doc_title")).agg(F.min("document_id").alias("other"))
    b = b.join(same, "was", "left").join(by_title, "doc_title", "left")
    b = b.withColumn("document_id", F.when(F.col("there"), F.col("was")).otherwise(F.col("other"))).drop("there", "other", "was")
    exact = passages.select(F.col("passage_id").alias("old"), "document_id", F.lit(True).alias("ok"))
    b = b.join(exact, ["old", "document_id"], "left")
    lost = b.where(F.col("ok").isNull() & F.col("document_id").isNotNull()).select("id", "document_id", "page_no", F.left(F.coalesce("snippet", F.lit("")), F.lit(40)).alias("part"))
    near = lost.join(passages.select("document_id", "passage_id", "page_from", "page_to", "text"), "document_id").where(F.col("page_no").between(F.col("page_from"), F.col("page_to")))
    has = (F.col("part") != "") & F.coalesce(F.col("text").contains(F.col("part")), F.lit(False))
    found = near.groupBy("id").agg(F.coalesce(F.min(F.when(has, F.col("passage_id"))), F.min("passage_id")).alias("new"))
    passage = F.when(F.col("ok") | F.col("document_id").isNull(), F.col("old")).otherwise(F.col("new"))
    return b.join(found, "id", "left").select(*[passage.alias(c) if c == "passage_id" else F.col(c) for c in bookmarks.columns], F.col("document_id").isNull().alias("missing"))


# -- maintenance --------------------------------------------------------------------------------------------------------

def created(names: DataFrame, wanted: list[str]) -> DataFrame:
    """Names with the wanted ones that are new; new ids follow the largest."""
    spark = names.sparkSession
    clean = list(dict.fromkeys(w.strip() for w in wanted if w and w.strip()))
    new = spark.createDataFrame([(i, n) for i, n in enumerate(clean)], "i long, name string").join(names, "name", "left_anti")
    top = names.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    number = F.row_number().over(Window.orderBy("i"))  # the wanted list only
    return names.select("id", "name").union(new.withColumn("k", number).join(F.broadcast(top)).select((F.col("top") + F.col("k")).alias("id"), "name"))


def renamed(names: DataFrame, links: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """A new name, or, where the name exists, one entry with the links of both."""
    ids = {r["name"]: r["id"] for r in names.where(F.col("name").isin([old, new])).collect()}
    if old not in ids or old == new:
        return names, links
    if new not in ids:
        return names.withColumn("name", F.when(F.col("name") == old, F.lit(new)).otherwise(F.col("name"))), links
    moved = links.withColumn("id", F.when(F.col("id") == ids[old], F.lit(ids[new])).otherwise(F.col("id"))).dropDuplicates(["document_id", "id"])
    return names.where(F.col("name") != old), moved


def removed(names: DataFrame, links: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Without a name and its links; documents stay."""
    gone = names.where(F.col("name") == name).select("id")
    return names.where(F.col("name") != name), links.join(gone, "id", "left_anti").select(*links.columns)


def relinked(links: DataFrame, names: DataFrame, document_id: int, wanted: list[str]) -> DataFrame:
    """T4: a document's links are those of the wanted names (which exist, T1)."""
    clean = list(dict.fromkeys(w.strip() for w in wanted if w and w.strip()))
    new = names.where(F.col("name").isin(clean)).select(F.lit(document_id).cast("bigint").alias("document_id"), "id")
    return links.where(F.col("document_id") != document_id).select("document_id", "id").union(new)


def synced_links(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T5: names and links from the joined author strings; the same however often it runs."""
    each = documents.select("document_id", F.explode(T.split_authors(F.col("author"))).alias("name"))
    # an id that depends on the name alone: no global numbering
    names = each.select("name").distinct().select(F.xxhash64("name").alias("id"), "name")
    return names, each.select("document_id", F.xxhash64("name").alias("id")).distinct()


def recached(documents: DataFrame, links: DataFrame, names: DataFrame) -> DataFrame:
    """Author strings from the links, names in order; none is null."""
    full = with_names(documents.drop("author"), links, names, "__names")
    return full.withColumn("author", T.join_authors(F.col("__names"))).select(*documents.columns)


def without_documents(tables: dict[str, DataFrame], ids: list[int]) -> dict[str, DataFrame]:
    """The documents and all that hangs on them; bookmarks stay. Vectors go with their passages."""
    gone = F.col("document_id").isin(ids)
    out = {k: t if k == "bookmarks" or "document_id" not in t.columns else t.where(~gone) for k, t in tables.items()}
    if "vectors" in tables and "passages" in tables:
        out["vectors"] = tables["vectors"].join(tables["passages"].where(gone).select("passage_id"), "passage_id", "left_anti")
    return out


def remapped(rows: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows with new ids beyond the largest present one, in the order of the old, as `new_id`.

    Rows are dealt into ranges of the old id that hold about as many each (sampled), whatever the ids are; ranges are stored and counted,
    and ids are ranked within them: no task sees all rows.
    """
    top = present.agg(F.coalesce(F.max(key), F.lit(-1)).alias("top"))
    r = stored(rows.repartitionByRange(key).withColumn("__range", F.spark_partition_id()), "ranges")
    per = r.groupBy("__range").count()
    before = per.select("__range", (F.sum("count").over(Window.orderBy("__range")) - F.col("count")).alias("__before"))  # one row for each range
    w = Window.partitionBy("__range").orderBy(key)
    r = r.withColumn("__n", F.row_number().over(w)).join(F.broadcast(before), "__range").join(F.broadcast(top))
    return r.select(*rows.columns, (F.col("top") + F.col("__before") + F.col("__n")).alias("new_id"))


def reingested(documents: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh rows take the place of documents with the same id, but keep title and author where they have them."""
    old = documents.select("document_id", F.col("title").alias("__t"), F.col("author").alias("__a"))
    new = fresh.join(old, "document_id", "left").withColumns({"title": F.coalesce("__t", "title"), "author": F.coalesce("__a", "author")}).select(*documents.columns)
    return documents.join(fresh.select("document_id"), "document_id", "left_anti").select(*documents.columns).union(new)


def latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key. A partially aggregated maximum, so a hot key is no hot task."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__r"))
    return best.select(*[F.col(c) if c in key else F.col(f"__r.{c}").alias(c) for c in rows.columns])


def upserted(table: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """changes (with a load order) over table."""
    old = table.withColumn(order, F.lit(None).cast(changes.schema[order].dataType))
    return latest(old.unionByName(changes), key, F.struct(F.col(order).isNotNull(), order)).drop(order)


def toggled(bookmarks: DataFrame, mark: DataFrame) -> DataFrame:
    """Mark (a row like bookmarks) goes if one is there for its document and passage (or page, without a passage); else it is added."""
    m = mark.select(F.col("document_id").alias("__d"), F.col("passage_id").alias("__p"), F.col("page_no").alias("__n"))
    same = (F.col("document_id") == F.col("__d")) & F.when(F.col("__p").isNull(), F.col("passage_id").isNull() & (F.col("page_no") == F.col("__n"))).otherwise(F.col("passage_id") == F.col("__p"))
    left = bookmarks.join(m, same, "left_anti")
    hit = bookmarks.join(m, same, "left_semi").select("document_id", "passage_id", "page_no")
    b = hit.select(F.col("document_id").alias("__d"), F.col("passage_id").alias("__p"), F.col("page_no").alias("__n"))
    same_new = (F.col("document_id") == F.col("__d")) & F.when(F.col("passage_id").isNull(), F.col("__p").isNull() & (F.col("page_no") == F.col("__n"))).otherwise(F.col("passage_id") == F.col("__p"))
    return left.union(mark.join(b, same_new, "left_anti").select(*bookmarks.columns))


def with_metadata(documents: DataFrame, document_id: int, title: str | None = None, author: str | None = None) -> DataFrame:
    """T13."""
    mine = F.col("document_id") == document_id
    new = {c: F.when(mine, F.lit(v)).otherwise(F.col(c)) for c, v in (("title", title), ("author", author)) if v is not None}
    return documents.withColumns(new) if new else documents
