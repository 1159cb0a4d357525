"""Named queries over the driver's tables, each with the same question in DuckDB SQL where SQL can ask it.

documents are books (source = author, lang = category), their 2,000-character pages are the passages of the search queries,
embeddings are vectors of passages, conversations are overlapping chunks of a page, TPC-H tables are catalogue relations.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import isri
from ..functions import text as T
from ..operators import catalog as C
from ..operators import corpus, library, metrics, vector
from ..operators.chunk import chunk, paginate
from ..operators.index import Index, search
from ..operators.search import Archive, filtered, highlight_spans, like, payload_filtered, reliability
from ..session import shared_dir, ship
from ..sources import files
from ..streaming.ingest import ingest_batch
from . import query as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Latin letters as Arabic ones, to run Arabic text functions over the (Latin) documents.
LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyz", "أبتةىذكلمنهويسعفقئصرشؤـَإا"
TOKEN_CLASS = "[ء-يٮ-ۓA-Za-z0-9]+"


def query(sql: str | None = None):
    """Register a function of (t, spark), t giving tables by name, under its own name; sql is its oracle."""

    def wrap(f):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            t = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
            t.at = sf
            return f(t, spark)

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def books(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("Book "), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("author"), F.lit("").alias("reliability"))


def pages(t) -> DataFrame:
    return paginate(t("documents").select(F.col("doc_id").alias("document_id"), "text"))


def passages(t) -> DataFrame:
    """Pages as passages with ids that follow from the document."""
    p = pages(t)
    return p.select((F.col("document_id") * 1_000_000 + F.col("page_no")).alias("passage_id"), "document_id", (F.col("page_no") - 1).alias("idx"), F.col("page_no").alias("page_from"), F.col("page_no").alias("page_to"), "text")


def links(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("category"))


#: Folders of indexes built by this application, by folder of tables.
INDEXES: dict[tuple[str, str], str] = {}


def index(t, spark: SparkSession) -> Index:
    """The index of a folder's passages, built once per application."""
    key = spark.sparkContext.applicationId, t.at
    if key not in INDEXES:
        path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        Index.of(passages(t), stem_words=False).write(path)
        INDEXES[key] = path
    return Index.read(spark, INDEXES[key])


def archive(t, spark: SparkSession) -> Archive:
    return Archive(books(t), passages(t), links(t), index(t, spark))


def arabised(column: str = "text"):
    return F.translate(F.lower(column), LATIN, ARABIC)


# SQL of the same tables
PAGES = "(SELECT doc_id AS document_id, n::INT AS page_no, substring(text, (2000 * (n - 1) + 1)::BIGINT, 2000) AS text FROM documents, unnest(range(1, greatest(ceil(length(text) / 2000.0)::BIGINT, 1) + 1)) AS u(n))"
PASSAGES = f"(SELECT document_id * 1000000 + page_no AS passage_id, document_id, page_no - 1 AS idx, page_no, text, 'Book ' || document_id AS title, source AS author, lang AS category FROM {PAGES} JOIN (SELECT doc_id, source, lang FROM documents) ON doc_id = document_id)"
AR = f"translate(lower(text), '{LATIN}', '{ARABIC}')"


def norm_sql(x: str) -> str:
    return f"translate(regexp_replace({x}, '{T.MARKS}', '', 'g'), '{T.FOLD_FROM}', '{T.FOLD_TO}')"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all({norm_sql(x)}, '{TOKEN_CLASS}')"


def light_sql(w: str) -> str:
    front = " ".join(f"WHEN starts_with({w}, '{p}') AND length({w}) >= {len(p) + 3} THEN substring({w}, {len(p) + 1})" for p in T.LIGHT_PREFIXES)
    return f"CASE {front} ELSE {w} END"


def light_back_sql(w: str) -> str:
    back = " ".join(f"WHEN ends_with({w}, '{s}') AND length({w}) >= {len(s) + 3} THEN left({w}, length({w}) - {len(s)})" for s in T.LIGHT_SUFFIXES)
    return f"CASE {back} ELSE {w} END"


# -- text functions -----------------------------------------------------------------------------------------------------

@query(f"SELECT doc_id, md5({norm_sql(AR)}) AS norm_md5, length({norm_sql(AR)})::BIGINT AS norm_chars FROM documents")
def f1_normalize(t, spark):
    n = T.normalize(arabised())
    return t("documents").select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).cast("bigint").alias("norm_chars"))


@query(f"SELECT doc_id, len({tokens_sql('text')})::BIGINT AS n_tokens, len(list_distinct({tokens_sql('text')}))::BIGINT AS n_distinct, {tokens_sql('text')}[1] AS first_token FROM documents")
def f2_token_counts(t, spark):
    d = t("documents").select("doc_id", T.tokenize(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"), F.get("w", F.lit(0)).alias("first_token"))


@query()
def f3_root_counts(t, spark):
    """Roots of all distinct words in Arabic letters, with the number of words of each (Python stemmer, no SQL)."""
    words = t("documents").select(F.explode(F.array_distinct(T.tokenize(arabised()))).alias("w"))
    return isri.stem_map(words, "w").groupBy("stem").agg(F.count(F.lit(1)).alias("n_words"))


@query(f"SELECT w AS word, {light_back_sql('f')} AS stem FROM (SELECT w, {light_sql('w')} AS f FROM (SELECT DISTINCT unnest({tokens_sql(AR)}) AS w FROM documents))")
def f4_light_stem(t, spark):
    words = t("documents").select(F.explode(F.array_distinct(T.tokenize(arabised()))).alias("word")).distinct()
    return words.select("word", T.light_stem(F.col("word")).alias("stem"))


@query(f"SELECT doc_id, md5(array_to_string({tokens_sql('text')}, ' ')) AS norm_md5, md5(lower(array_to_string({tokens_sql('text')}, ' '))) AS stems_md5 FROM documents")
def f5_index_forms(t, spark):
    d = t("documents").select("doc_id", T.tokenize(F.col("text")).alias("w"))
    return d.select("doc_id", F.md5(F.array_join("w", " ")).alias("norm_md5"), F.md5(F.array_join(F.transform("w", lambda x: T.latin_stem(x)), " ")).alias("stems_md5"))


SENT = "list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?؟۔])[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', '\\1' || chr(1), 'g'), '\\x01|\\n\\n+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


@query(f"SELECT doc_id, len({SENT})::BIGINT AS n_sentences, md5(array_to_string({SENT}, '|')) AS sentences_md5 FROM documents")
def f8_sentences(t, spark):
    d = t("documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


@query("SELECT doc_id, length(regexp_replace(text, '[^ء-يA-Za-z]', '', 'g'))::BIGINT AS n_letters FROM documents")
def f9_letters(t, spark):
    return t("documents").select("doc_id", T.letter_count(F.col("text")).cast("bigint").alias("n_letters"))


AUTHORS = "source || ' ؛ ' || lang || ' ;' || source || ';; '"
SPLIT = f"list_filter(list_transform(string_split_regex({AUTHORS}, '\\s*[؛;]\\s*'), lambda s: trim(s)), lambda s: s <> '')"


@query(f"SELECT doc_id, array_to_string({SPLIT}, '|') AS every, source || '|' || lang AS once, source || ' ؛ ' || lang AS joined FROM documents")
def f10_author_split(t, spark):
    a = F.concat("source", F.lit(" ؛ "), "lang", F.lit(" ;"), "source", F.lit(";; "))
    d = t("documents").select("doc_id", T.split_authors(a, distinct=False).alias("e"), T.split_authors(a).alias("o"))
    return d.select("doc_id", F.array_join("e", "|").alias("every"), F.array_join("o", "|").alias("once"), T.join_authors(F.col("e")).alias("joined"))


STEMS = ["the", "der", "les", "que"]
MATCHED = f"list_filter(regexp_extract_all(text, '[ء-يٮ-ۓؐ-ٰA-Za-z0-9ً-ٟ]+'), lambda w: lower({norm_sql('w')}) IN ('the', 'der', 'les', 'que'))"
#: Distinct in the order of first appearance.
ORDERED = f"list_filter({MATCHED}, lambda w, i: list_position({MATCHED}, w) = i)"


@query(f"SELECT doc_id, array_to_string({ORDERED}, ' ') AS matched FROM documents")
def f13_matched_words(t, spark):
    return t("documents").select("doc_id", F.array_join(T.matched_words(F.col("text"), STEMS), " ").alias("matched"))


@query()
def f12_highlight_spans(t, spark):
    """Spans of the words whose stem is asked for; offsets of matches need Python."""
    d = highlight_spans(t("documents").select("doc_id", "text"), ["the", "der"])
    return d.select("doc_id", F.size("spans").cast("bigint").alias("n_spans"), F.md5(F.to_json("spans")).alias("spans_md5"))


SNIP = """CASE WHEN m IS NULL THEN left(text, 240) || CASE WHEN length(text) > 240 THEN '…' ELSE '' END
 ELSE CASE WHEN st > 0 THEN '…' ELSE '' END || regexp_replace(substring(text, (st + 1)::BIGINT, (least(length(text), st + 240) - st)::BIGINT), '^\\s+|\\s+$', '', 'g') || CASE WHEN least(length(text), st + 240) < length(text) THEN '…' ELSE '' END END"""


@query(f"SELECT doc_id, {SNIP} AS snippet FROM (SELECT doc_id, text, m, greatest(greatest(instr(text, m) - 1, 0) - 80, 0) AS st FROM (SELECT doc_id, text, {MATCHED}[1] AS m FROM documents))")
def f16_snippet(t, spark):
    d = t("documents").withColumn("m", T.matched_words(F.col("text"), STEMS))
    return d.select("doc_id", T.snippet(F.col("text"), F.col("m")).alias("snippet"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS form_md5 FROM documents")
def f19_ocr_form(t, spark):
    return t("documents").select("doc_id", F.md5(T.ocr_form(F.col("text"))).alias("form_md5"))


@query("""SELECT p_partkey, (a[1] > b[1] OR a[1] = b[1] AND (a[2] > b[2] OR a[2] = b[2] AND a[3] > b[3])) AS newer FROM
 (SELECT p_partkey, [p_size, p_partkey % 7, 3] AS a, [25, 3, p_partkey % 5] AS b FROM part)""")
def f20_newer_version(t, spark):
    a = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"), F.lit("3rc1"))
    b = F.concat_ws(".", F.lit("25"), F.lit("3"), (F.col("p_partkey") % 5).cast("string"))
    return t("part").select("p_partkey", T.newer(a, b).alias("newer"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END::BIGINT AS n_terms, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type || ',x' END AS terms FROM events")
def f21_json_terms(t, spark):
    j = F.when(F.col("event_id") % 3 == 0, F.lit("{broken")).otherwise(F.to_json(F.array("event_type", F.lit("x"))))
    d = t("events").select("event_id", T.terms_from_json(j).alias("x"))
    return d.select("event_id", F.size("x").cast("bigint").alias("n_terms"), F.array_join("x", ",").alias("terms"))


@query("SELECT page_id, CASE WHEN url LIKE '%/' THEN '.html' ELSE lower(regexp_extract(url, '([^/]*)$', 1)) END AS stem, CASE WHEN url LIKE '%/' THEN '' ELSE '.html' END AS ext, regexp_replace(url, '[\\\\/:*?\"<>|]', '_', 'g') AS safe FROM pages")
def f23_file_names(t, spark):
    u = F.concat("url", F.lit(".HTML"))
    return t("pages").select("page_id", T.file_stem(u).alias("stem"), T.file_ext(u).alias("ext"), T.safe_name(F.col("url")).alias("safe"))


@query("SELECT doc_id, left(text, 400) AS note, 'query: ' || left(text, 20) AS query FROM documents")
def f22_f24_cuts(t, spark):
    return t("documents").select("doc_id", F.left("text", F.lit(400)).alias("note"), F.concat(F.lit(vector.QUERY_PREFIX), F.left("text", F.lit(20))).alias("query"))


@query(f"SELECT document_id, page_no, md5(text) AS text_md5, length(text)::BIGINT AS chars FROM {PAGES}")
def s3_paginate(t, spark):
    return pages(t).select("document_id", "page_no", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("chars"))


#: The same fold, as a recursion over the pieces of each document.
CHUNK_SQL = f"""WITH RECURSIVE s AS (SELECT doc_id, unnest({SENT}) AS s, generate_subscripts({SENT}, 1) AS k FROM documents),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, h) AS k, substring(s, (1100 * h + 1)::BIGINT, 1100) AS p, h < heads AS head
 FROM (SELECT doc_id, s, k, heads, unnest(range(0, heads + 1)) AS h FROM (SELECT doc_id, s, k, greatest(ceil(length(s) / 1100.0)::BIGINT - 1, 0) AS heads FROM s))),
r AS (SELECT doc_id, 0::BIGINT AS k, ''::VARCHAR AS buf, 0::BIGINT AS n, NULL::VARCHAR AS out FROM (SELECT DISTINCT doc_id FROM p)
 UNION ALL SELECT r.doc_id, p.k,
  CASE WHEN p.head THEN '' WHEN r.n + length(p.p) > 700 AND r.n > 0 THEN p.p WHEN r.n = 0 THEN p.p ELSE r.buf || ' ' || p.p END,
  CASE WHEN p.head THEN 0 WHEN r.n + length(p.p) > 700 AND r.n > 0 THEN length(p.p) + 1 ELSE r.n + length(p.p) + 1 END,
  CASE WHEN p.head THEN CASE WHEN r.n = 0 THEN p.p ELSE r.buf || ' ' || p.p END WHEN r.n + length(p.p) > 700 AND r.n > 0 THEN r.buf END
 FROM r JOIN p ON p.doc_id = r.doc_id AND p.k = r.k + 1),
o AS (SELECT doc_id, k, regexp_replace(out, '^\\s+|\\s+$', '', 'g') AS out FROM (SELECT doc_id, k, out FROM r WHERE out IS NOT NULL
 UNION ALL SELECT doc_id, k + 1, buf FROM (SELECT doc_id, k, buf, n, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS last FROM r) WHERE last = 1 AND n > 0))
SELECT doc_id AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS idx, md5(out) AS text_md5, length(out)::BIGINT AS chars
FROM o WHERE length(regexp_replace(out, '[^ء-يA-Za-z]', '', 'g')) >= 20"""


@query(CHUNK_SQL)
def c1_chunk(t, spark):
    """Each document as one page."""
    p = t("documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_no"), "text")
    return chunk(p).select("document_id", F.col("idx").cast("bigint").alias("idx"), F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("chars"))


# -- full text ----------------------------------------------------------------------------------------------------------

#: A word boundary in the token form ' a b c '.
FORM = f"' ' || lower(array_to_string({tokens_sql('text')}, ' ')) || ' '"
HAS = f"(SELECT *, {FORM} AS form FROM {PASSAGES})"


def found(q: str):
    def run(t, spark):
        a = archive(t, spark)
        return search(a.index, Q.parse(q)).select("passage_id")

    return run


def has(word: str) -> str:
    return f"contains(form, ' {word} ')"


for _name, _q, _where in (
    ("q6_and", "der und", f"{has('der')} AND {has('und')}"),
    ("q6_or_groups", "der und | the of", f"({has('der')} AND {has('und')}) OR ({has('the')} AND {has('of')})"),
    ("q6_not", "the -of -was", f"{has('the')} AND NOT {has('of')} AND NOT {has('was')}"),
    ("q9_phrase", '"of the"', has("of the")),
    ("q9_negative_phrase", 'the -"of the" oder les -que', f"({has('the')} AND NOT {has('of the')}) OR ({has('les')} AND NOT {has('que')})"),
):
    _f = found(_q)
    _f.__name__ = _name
    query(f"SELECT passage_id FROM {HAS} WHERE {_where}")(_f)


@query(f"SELECT passage_id FROM {HAS} WHERE (({has('the')} AND {has('of that')}) OR ({has('der')})) AND NOT {has('was')} AND NOT {has('ist')}")
def q4_structured(t, spark):
    groups = Q.structured([["the", "of that"], ["der"]], ["was", "ist nicht"])
    return search(archive(t, spark).index, groups).select("passage_id")


BM25 = f"""WITH w AS (SELECT *, len({tokens_sql('text')}) AS n FROM {HAS}), f AS (SELECT *, 2 * n AS d, len(list_filter(string_split(form, ' '), lambda x: x = 'der')) AS a, len(list_filter(string_split(form, ' '), lambda x: x = 'und')) AS b FROM w),
s AS (SELECT count(*) AS nn, avg(d) AS ad, count(*) FILTER (a > 0) AS na, count(*) FILTER (b > 0) AS nb FROM f),
x AS (SELECT passage_id, 1.2 * (0.25 + 0.75 * d / ad) AS k, a, b, greatest(ln((nn - na + 0.5) / (na + 0.5)), 1e-6) AS ia, greatest(ln((nn - nb + 0.5) / (nb + 0.5)), 1e-6) AS ib FROM f, s)
SELECT passage_id, round(-(ia * (2.0 * a * 2.2 / (2.0 * a + k) + a * 2.2 / (a + k)) + ib * (2.0 * b * 2.2 / (2.0 * b + k) + b * 2.2 / (b + k))), 9) AS score FROM x WHERE a > 0 AND b > 0"""


@query(f"{BM25} ORDER BY -(ia * (2.0 * a * 2.2 / (2.0 * a + k) + a * 2.2 / (a + k)) + ib * (2.0 * b * 2.2 / (2.0 * b + k) + b * 2.2 / (b + k))), passage_id LIMIT 10")
def q8_bm25_topk(t, spark):
    rows = search(archive(t, spark).index, Q.parse("der und")).orderBy("score", "passage_id").limit(10)
    return rows.select("passage_id", F.round("score", 9).alias("score"))


@query(BM25)
def q8_bm25_all(t, spark):
    return search(archive(t, spark).index, Q.parse("der und")).select("passage_id", F.round("score", 9).alias("score"))


DER = MATCHED.replace("IN ('the', 'der', 'les', 'que')", "= 'der'")
DER_ORDERED = f"list_filter({DER}, lambda w, i: list_position({DER}, w) = i)"


@query(f"""WITH w AS (SELECT *, len({tokens_sql('text')}) AS n, string_split(form, ' ') AS forms FROM {HAS}), f AS (SELECT *, 2 * n AS d, len(list_filter(forms, lambda x: x = 'der')) AS a FROM w),
s AS (SELECT count(*) AS nn, avg(d) AS ad, count(*) FILTER (a > 0) AS na FROM f),
x AS (SELECT f.*, -greatest(ln((nn - na + 0.5) / (na + 0.5)), 1e-6) * (2.0 * a * 2.2 / (2.0 * a + k) + a * 2.2 / (a + k)) AS v FROM (SELECT f.*, nn, na, 1.2 * (0.25 + 0.75 * d / ad) AS k FROM f, s) f WHERE a > 0 AND NOT list_contains(forms, 'zuen')),
h AS (SELECT *, {DER}[1] AS m FROM x ORDER BY v, passage_id LIMIT 10)
SELECT passage_id, document_id, title, author, page_no AS page_from, page_no AS page_to, {SNIP} AS snippet, round(v, 9) AS score, array_to_string({DER_ORDERED}, ' ') AS matched_words, 'sicher' AS reliability
FROM (SELECT *, greatest(greatest(instr(text, m) - 1, 0) - 80, 0) AS st FROM h)""")
def q5_search_hits(t, spark):
    """Full hits with snippets and matched words: the flagship."""
    h = archive(t, spark).search("der -zuen", limit=10)
    return h.select("passage_id", "document_id", "title", "author", "page_from", "page_to", "snippet", F.round("score", 9).alias("score"), F.array_join("matched_words", " ").alias("matched_words"), "reliability")


@query(f"SELECT passage_id, document_id, title, author, page_no AS page_from, 0.0::DOUBLE AS score, left(text, 200) AS snippet, 'sicher' AS reliability FROM {PASSAGES} ORDER BY document_id, idx LIMIT 40 OFFSET 5")
def q7_browse(t, spark):
    return archive(t, spark).search("-the", limit=40, offset=5).select("passage_id", "document_id", "title", "author", "page_from", "score", "snippet", "reliability")


@query(f"SELECT w AS term, count(DISTINCT passage_id) AS df, count(*) AS cf FROM (SELECT passage_id, unnest(list_transform({tokens_sql('text')}, lambda x: lower(x))) AS w FROM {PASSAGES}) GROUP BY w")
def q_doc_freq(t, spark):
    return index(t, spark).terms.where("field = 'norm'").select("term", "df", "cf")


@query(f"SELECT passage_id FROM {PASSAGES} WHERE contains(lower(author), 'rc1') OR contains(lower(author), 'src7')")
def p1_author_filter(t, spark):
    rows = passages(t).join(books(t), "document_id")
    return filtered(rows, author=["RC1", "src7"]).select("passage_id")


@query(f"SELECT passage_id FROM {PASSAGES} WHERE document_id IN (1, 2, 3, 5, 8, 13)")
def p2_doc_filter(t, spark):
    return filtered(passages(t), document_id=[1, 2, 3, 5, 8, 13, None]).select("passage_id")


@query(f"SELECT passage_id FROM {PASSAGES} WHERE category IN ('de', 'fr')")
def p3_category_semi(t, spark):
    return filtered(passages(t), category=["de", "fr"], categories=links(t)).select("passage_id")


@query(f"SELECT document_id, page_no, md5(text) AS text_md5 FROM {PAGES} WHERE document_id = 6 AND page_no BETWEEN 2 AND 42 ORDER BY page_no")
def p4_page_range(t, spark):
    first, last = 2, 99
    return pages(t).where((F.col("document_id") == 6) & F.col("page_no").between(first, min(last, first + 40))).orderBy("page_no").select("document_id", "page_no", F.md5("text").alias("text_md5"))


@query(f"SELECT p.document_id, p.page_no, 'Book ' || p.document_id AS title, lo, hi FROM {PAGES} p JOIN (SELECT document_id, min(page_no) AS lo, max(page_no) AS hi FROM {PAGES} GROUP BY 1) b ON p.document_id = b.document_id")
def p5_reader_page(t, spark):
    p = pages(t)
    bounds = p.groupBy("document_id").agg(F.min("page_no").alias("lo"), F.max("page_no").alias("hi"))
    return p.join(bounds, "document_id").join(books(t), "document_id").select("document_id", "page_no", "title", "lo", "hi")


@query(f"SELECT passage_id, title, author, md5(text) AS text_md5 FROM {PASSAGES} WHERE passage_id = 7000001")
def p6_passage_lookup(t, spark):
    return passages(t).where("passage_id = 7000001").join(books(t), "document_id").select("passage_id", "title", "author", F.md5("text").alias("text_md5"))


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND source = 'src3'")
def p7_payload_filters(t, spark):
    return payload_filtered(t("documents"), source="src3", lang=["en", "de"]).select("doc_id")


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), '#00000001')")
def p8_name_search(t, spark):
    return t("customer").where(like(F.col("c_name"), "#00000001")).select("c_custkey")


# -- vectors ------------------------------------------------------------------------------------------------------------

QVEC = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
SIM = f"list_sum(list_transform(list_zip(embedding, {QVEC}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def vectors(t) -> tuple[DataFrame, list[float]]:
    v = t("embeddings").select(F.col("vec_id").alias("passage_id"), F.col("embedding").alias("vec"), "label")
    return v, list(v.where("passage_id = 0").first()["vec"])


@query(f"SELECT vec_id AS passage_id, round({SIM}, 9) AS sim FROM embeddings ORDER BY {SIM} DESC, vec_id LIMIT 10")
def v3_cosine_topk(t, spark):
    return vector.top_k(*vectors(t), 10, least=None).withColumn("sim", F.round("sim", 9))


@query(f"SELECT * FROM (SELECT vec_id AS passage_id, round({SIM}, 9) AS sim FROM embeddings ORDER BY {SIM} DESC, vec_id LIMIT 40) WHERE sim >= 0.25")
def v3_threshold(t, spark):
    return vector.top_k(*vectors(t), 40).withColumn("sim", F.round("sim", 9))


@query("SELECT doc_id AS passage_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def v2_missing_vectors(t, spark):
    return vector.missing(t("documents").select(F.col("doc_id").alias("passage_id")), t("embeddings").select(F.col("vec_id").alias("passage_id"))).select("passage_id")


@query(f"SELECT vec_id AS passage_id, round({SIM}, 9) AS sim FROM embeddings WHERE label IN (1, 2, 3) ORDER BY {SIM} DESC, vec_id LIMIT 10 OFFSET 5")
def v6_filtered_topk(t, spark):
    v, q = vectors(t)
    return vector.top_k(payload_filtered(v, label=[1, 2, 3]), q, 10, least=None, offset=5).withColumn("sim", F.round("sim", 9))


@query(f"SELECT vec_id AS passage_id, round({SIM}, 9) AS sim FROM embeddings ORDER BY {SIM} DESC, vec_id LIMIT 11")
def v8_has_more(t, spark):
    """limit + 1 rows: the last says that there is more."""
    return vector.top_k(*vectors(t), 10 + 1, least=None).withColumn("sim", F.round("sim", 9))


COARSE = f"list_sum(list_transform(list_zip(embedding, {QVEC}), lambda z: round(z[1] * 127::FLOAT)::BIGINT * round_even(z[2]::DOUBLE * 127, 0)::BIGINT))"


@query(f"SELECT vec_id AS passage_id, round({SIM}, 9) AS sim FROM (SELECT * FROM embeddings ORDER BY {COARSE} DESC, vec_id LIMIT 20) ORDER BY {SIM} DESC, vec_id LIMIT 10")
def v7_two_stage(t, spark):
    v, q = vectors(t)
    return vector.two_stage(vector.quantised(v), q, 10).withColumn("sim", F.round("sim", 9))


APART = f"list_sum(list_transform(list_zip(embedding, {QVEC}), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END))"


@query(f"SELECT vec_id AS passage_id, round({SIM}, 9) AS sim FROM (SELECT * FROM embeddings ORDER BY {APART}, vec_id LIMIT 40) ORDER BY {SIM} DESC, vec_id LIMIT 10")
def v7_binary(t, spark):
    v, q = vectors(t)
    return vector.two_stage_binary(vector.binary_quantised(v), q, 10, 4.0).withColumn("sim", F.round("sim", 9))


@query(f"""WITH v AS (SELECT vec_id AS passage_id, row_number() OVER (ORDER BY {SIM} DESC, vec_id) - 1 AS rb FROM embeddings QUALIFY rb < 60 AND {SIM} >= 0.25),
x AS (SELECT doc_id AS passage_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS ra FROM documents QUALIFY ra < 60)
SELECT coalesce(x.passage_id, v.passage_id) AS passage_id, round(coalesce(1.0 / (60 + ra), 0) + coalesce(1.0 / (60 + rb), 0), 12) AS rrf FROM x FULL JOIN v ON x.passage_id = v.passage_id ORDER BY coalesce(1.0 / (60 + ra), 0) + coalesce(1.0 / (60 + rb), 0) DESC, ra NULLS LAST, rb LIMIT 20""")
def v4_rrf(t, spark):
    text_hits = t("documents").select(F.col("doc_id").alias("passage_id"), F.col("n_chars").alias("score")).orderBy("score", "passage_id").limit(60)
    return vector.fuse(text_hits, vector.top_k(*vectors(t), 60), 20).select("passage_id", F.round("rrf", 12).alias("rrf"))


# -- catalogue ----------------------------------------------------------------------------------------------------------

@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j3_left_count(t, spark):
    return C.with_count(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "n_orders")


@query("SELECT r_regionkey, r_name, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey < 12 GROUP BY ALL")
def j4_counts_with_empty(t, spark):
    n = t("nation").where("n_nationkey < 12").select(F.col("n_regionkey").alias("r_regionkey"))
    return C.with_count(t("region"), n, "r_regionkey", "n")


@query("SELECT doc_id AS document_id, coalesce(names, '') AS names FROM documents LEFT JOIN (SELECT l.doc_id AS d, CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'good|toxic' ELSE 'good' END ELSE CASE WHEN toxic = 1 THEN 'toxic' END END AS names FROM labels l) ON d = doc_id")
def j2_collect(t, spark):
    label = t("labels")
    names = spark.createDataFrame([(0, "good"), (1, "toxic")], "id long, name string")
    pairs = label.where("quality = 1").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("id")).union(label.where("toxic = 1").select("doc_id", F.lit(1)))
    return C.with_names(t("documents").select(F.col("doc_id").alias("document_id")), pairs, names, "names").withColumn("names", F.array_join("names", "|"))


IMPORT = "SELECT doc_id AS document_id, md5(text) AS title, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE n_chars END AS page_count FROM documents WHERE doc_id % 2 = "


@query(f"WITH i AS ({IMPORT}0), p AS ({IMPORT}1), n AS (SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.title = i.title AND p.page_count = i.page_count)) SELECT document_id, title, page_count FROM n WHERE page_count IS NULL OR document_id = (SELECT min(document_id) FROM n m WHERE m.title = n.title AND m.page_count = n.page_count)")
def j7_import_dedup(t, spark):
    d = t("documents").select(F.col("doc_id").alias("document_id"), F.md5("text").alias("title"), F.when(F.col("doc_id") % 10 != 0, F.col("n_chars")).alias("page_count"))
    return C.not_imported(d.where("document_id % 2 = 0"), d.where("document_id % 2 = 1"))


@query("WITH f AS (SELECT 'Book' || (doc_id % 300) AS s, CASE WHEN doc_id % 3 = 0 THEN '.pdf' ELSE '.DOCX' END AS e, doc_id FROM documents) SELECT 'in/' || s || e AS path FROM f WHERE e = '.pdf' OR NOT (s IN (SELECT s FROM f WHERE e = '.pdf') OR s IN ('Book1', 'Book4'))")
def j8_shadowed(t, spark):
    p = F.concat(F.lit("in/Book"), (F.col("doc_id") % 300).cast("string"), F.when(F.col("doc_id") % 3 == 0, ".pdf").otherwise(".DOCX"))
    return C.without_shadowed(t("documents").select(p.alias("path")), spark.createDataFrame([("x/book1.pdf",), ("BOOK4.pdf",), ("lib/book7.txt",)], "path string"))


SPANS = "(SELECT o_orderkey AS passage_id, o_custkey AS document_id, (o_orderkey % 20)::INT AS page_from, (o_orderkey % 20 + o_orderkey % 5)::INT AS page_to FROM orders)"


@query(f"SELECT c.document_id, page_no, passage_id FROM (SELECT c_custkey AS document_id, (c_custkey % 25)::INT AS page_no FROM customer) c JOIN {SPANS} s ON c.document_id = s.document_id AND page_no BETWEEN page_from AND page_to")
def j9_point_in_range(t, spark):
    o = F.col("o_orderkey")
    s = t("orders").select(o.alias("passage_id"), F.col("o_custkey").alias("document_id"), (o % 20).cast("int").alias("page_from"), (o % 20 + o % 5).cast("int").alias("page_to"))
    c = t("customer").select(F.col("c_custkey").alias("document_id"), (F.col("c_custkey") % 25).cast("int").alias("page_no"))
    return C.on_page(c, s).select("document_id", "page_no", "passage_id")


MARKS = f"""(SELECT passage_id AS id, CASE WHEN document_id % 5 = 0 THEN -1 - document_id ELSE document_id END AS document_id, CASE WHEN document_id % 2 = 0 THEN -5 ELSE passage_id END AS passage_id,
 CASE WHEN document_id % 15 = 0 THEN 'gone' ELSE title END AS doc_title, page_no, CASE WHEN document_id % 4 = 0 THEN 'nowhere to be found' ELSE substring(text, 11, 60) END AS snippet FROM {PASSAGES})"""


@query(f"""WITH b AS {MARKS}, p AS {PASSAGES}, d AS (SELECT doc_id, 'Book ' || doc_id AS title FROM documents),
x AS (SELECT b.*, coalesce((SELECT doc_id FROM d WHERE d.doc_id = b.document_id), (SELECT min(doc_id) FROM d WHERE d.title = b.doc_title)) AS did FROM b)
SELECT id, did AS document_id, CASE WHEN did IS NULL OR EXISTS (SELECT 1 FROM p WHERE p.passage_id = x.passage_id AND p.document_id = did) THEN x.passage_id
 ELSE coalesce((SELECT min(p.passage_id) FROM p WHERE p.document_id = did AND p.page_no = x.page_no AND left(x.snippet, 40) <> '' AND contains(p.text, left(x.snippet, 40))), (SELECT min(p.passage_id) FROM p WHERE p.document_id = did AND p.page_no = x.page_no)) END AS passage_id,
 doc_title, page_no, snippet, did IS NULL AS missing FROM x""")
def j10_repair(t, spark):
    p, d = passages(t), F.col("document_id")
    b = p.select(
        F.col("passage_id").alias("id"), F.when(d % 5 == 0, -1 - d).otherwise(d).alias("document_id"), F.when(d % 2 == 0, F.lit(-5).cast("bigint")).otherwise(F.col("passage_id")).alias("passage_id"),
        F.when(d % 15 == 0, "gone").otherwise(F.concat(F.lit("Book "), d.cast("string"))).alias("doc_title"), F.col("page_from").alias("page_no"), F.when(d % 4 == 0, "nowhere to be found").otherwise(F.substring("text", 11, 60)).alias("snippet"),
    )
    return C.repaired_bookmarks(b, books(t), p)


@query("SELECT source, count(*) AS n FROM documents WHERE source <> '' GROUP BY 1 ORDER BY 1")
def a2_facet(t, spark):
    return C.facet(t("documents"), "source")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def a3_topk_facet(t, spark):
    return C.top_facet(t("documents"), "source", 5)


@query("SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY 1")
def a4_bounds(t, spark):
    return t("conversations").groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"))


@query("SELECT DISTINCT name FROM (SELECT source AS name FROM documents UNION ALL SELECT lang FROM documents) ORDER BY name")
def a5_distinct_explode(t, spark):
    return C.distinct_parts(t("documents").select(F.concat_ws(T.AUTHOR_JOIN, "source", "lang").alias("author")), "author")


@query("SELECT s_suppkey AS book_id, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 45) AS page_count FROM supplier")
def a6_scalar_count(t, spark):
    return corpus.page_counts(t("supplier").select(F.col("s_suppkey").alias("book_id")), t("lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("book_id")))


@query("SELECT conv_id AS book_id, arg_min(role, turn) AS title, arg_min(text, turn) AS first_text FROM conversations GROUP BY 1")
def a7_dims(t, spark):
    rows = t("conversations").select(F.col("conv_id").alias("book_id"), "turn", F.col("role").alias("title"), F.col("text").alias("first_text"))
    return corpus.dimension(rows, ["book_id"], "turn", ["title", "first_text"])


@query("SELECT count(*) AS n FROM documents")
def a12_size(t, spark):
    return t("documents").agg(F.count(F.lit(1)).alias("n"))


def languages(t, spark) -> tuple[DataFrame, DataFrame]:
    names = spark.createDataFrame([(0, "de"), (1, "en"), (2, "es"), (3, "fr")], "id long, name string")
    return names, links(t).join(F.broadcast(names), F.col("category") == F.col("name")).select("document_id", "id")


@query("SELECT id, name FROM (VALUES (0, 'de'), (1, 'en'), (2, 'es'), (3, 'fr'), (4, 'ar'), (5, 'he')) v(id, name)")
def t1_create_if_absent(t, spark):
    return C.created(languages(t, spark)[0], [" ar", "en", "", "he", "ar "])


@query("SELECT doc_id AS document_id, CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END::BIGINT AS id FROM documents")
def t2_rename_merge(t, spark):
    return C.renamed(*languages(t, spark), "de", "en")[1].select("document_id", "id")


@query("SELECT doc_id AS document_id, CASE lang WHEN 'de' THEN 0 WHEN 'es' THEN 2 ELSE 3 END::BIGINT AS id FROM documents WHERE lang <> 'en'")
def t3_cascade(t, spark):
    return C.removed(*languages(t, spark), "en")[1]


@query("SELECT doc_id AS document_id, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END::BIGINT AS id FROM documents WHERE doc_id <> 7 UNION ALL SELECT 7, 0 UNION ALL SELECT 7, 3")
def t4_replace_links(t, spark):
    names, pairs = languages(t, spark)
    return C.relinked(pairs, names, 7, ["fr", " de ", "fr"])


@query("SELECT name, count(*) AS n FROM (SELECT source AS name FROM documents UNION ALL SELECT lang FROM documents) GROUP BY 1")
def t5_sync(t, spark):
    d = t("documents").select(F.col("doc_id").alias("document_id"), F.concat_ws(" ; ", "source", "lang", "source").alias("author"))
    names, pairs = C.synced_links(d)
    return C.with_count(names, pairs, "id", "n").select("name", "n")


@query("SELECT doc_id AS document_id, lang || ' ؛ ' || source AS author FROM documents")
def t6_recache(t, spark):
    d = t("documents").select(F.col("doc_id").alias("document_id"), F.concat_ws(" ; ", "source", "lang").alias("author"))
    names, pairs = C.synced_links(d)
    return C.recached(d, pairs, names).select("document_id", "author")


@query(f"SELECT passage_id FROM {PASSAGES} WHERE document_id NOT IN (3, 4)")
def t7_document_delete(t, spark):
    return C.without_documents({"documents": books(t), "passages": passages(t)}, [3, 4])["passages"].select("passage_id")


@query("SELECT doc_id AS document_id, (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY doc_id) AS new_id FROM documents")
def t8_id_remap(t, spark):
    d = t("documents").select(F.col("doc_id").alias("document_id"))
    return C.remapped(d, d, "document_id")


@query("SELECT doc_id AS document_id, 'Book ' || doc_id AS title, source AS author, CASE WHEN doc_id % 4 = 0 THEN 'exakt' ELSE '' END AS reliability FROM documents")
def t9_reingest(t, spark):
    d = books(t)
    return C.reingested(d, d.where("document_id % 4 = 0").withColumns({"title": F.lit("new"), "author": F.lit(None).cast("string"), "reliability": F.lit("exakt")}))


@query("SELECT o_custkey % 100 AS k, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1")
def t11_upsert(t, spark):
    old = spark.createDataFrame([(3, 0.5), (5, 0.25)], "k long, v double")
    return C.upserted(old, t("orders").select((F.col("o_custkey") % 100).alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq")), ["k"], "seq")


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def s10_upsert(t, spark):
    return C.latest(t("events").select("user_id", "event_id", "event_type"), ["user_id"], F.col("event_id"))


@query("SELECT o_orderkey AS id, o_custkey AS document_id, o_orderkey AS passage_id, 1 AS page_no FROM orders WHERE o_orderkey <> 4 UNION ALL SELECT -1, 1, 999999999, 7")
def t12_bookmark_toggle(t, spark):
    b = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("passage_id"), F.lit(1).alias("page_no"))
    there = b.where("id = 4")
    b = C.toggled(b, there)
    return C.toggled(b, spark.createDataFrame([(-1, 1, 999999999, 7)], "id long, document_id long, passage_id long, page_no int"))


@query("SELECT doc_id AS document_id, CASE WHEN doc_id = 9 THEN 'Nine' ELSE 'Book ' || doc_id END AS title, source AS author FROM documents")
def t13_metadata(t, spark):
    return C.with_metadata(books(t), 9, title="Nine").select("document_id", "title", "author")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j6_anti(t, spark):
    return t("customer").join(t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def j1_inner(t, spark):
    c = t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    j = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


# -- bulk corpus and metrics --------------------------------------------------------------------------------------------

#: Each text as chunks of 120 characters that overlap by 20.
CUTS = "(SELECT conv_id AS book_id, turn AS page_id, (100 * k)::BIGINT AS char_start, least(100 * k + 120, length(text))::BIGINT AS char_end, substring(text, (100 * k + 1)::BIGINT, 120) AS text, k FROM conversations, unnest(range(0, greatest(ceil(length(text) / 100.0)::BIGINT, 1))) u(k))"


@query("SELECT conv_id AS book_id, turn AS page_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM conversations")
def r1_reconstruct(t, spark):
    c = t("conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("page_id"), "text", F.explode(F.expr("sequence(0, greatest(cast(ceil(length(text) / 100.0) as int) - 1, 0))")).alias("k"))
    k = F.col("k") * 100
    cuts = c.select("book_id", "page_id", "k", k.alias("char_start"), F.least(k + 120, F.length("text")).alias("char_end"), F.substring("text", k + F.lit(1), F.lit(120)).alias("text"))
    return corpus.reconstruct(cuts, ["book_id", "page_id"], "k").select("book_id", "page_id", F.md5("text").alias("text_md5"))


@query("SELECT conv_id AS book_id, turn AS sequence_num, md5(text) AS text_md5 FROM conversations WHERE conv_id = 3 AND turn BETWEEN greatest((SELECT min(turn) FROM conversations WHERE conv_id = 3), 0) AND least((SELECT max(turn) FROM conversations WHERE conv_id = 3), 3) ORDER BY 2")
def r2_neighbours(t, spark):
    p = t("conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("sequence_num"), F.md5("text").alias("text_md5"))
    return corpus.neighbours(p, 3, 1, 2, 2)


AW = f"regexp_extract_all({AR}, '[ء-ي]+')"


@query(f"""SELECT document_id, n >= 30 AND (rev > greatest(3, fi) OR ta > greatest(4.0, n * 0.003) OR la > greatest(4, al)) AS broken FROM (SELECT doc_id AS document_id, len(w) AS n, len(list_filter(w, lambda x: x = 'يف')) AS rev, len(list_filter(w, lambda x: x = 'في')) AS fi,
 len(list_filter(w, lambda x: starts_with(x, 'ة'))) AS ta, len(list_filter(w, lambda x: starts_with(x, 'ال'))) AS al, len(list_filter(w, lambda x: ends_with(x, 'لا') AND length(x) > 3)) AS la FROM (SELECT doc_id, {AW} AS w FROM documents))""")
def a10_broken_layer(t, spark):
    return metrics.broken_documents(t("documents").select(F.col("doc_id").alias("document_id"), arabised().alias("text")))


@query(f"SELECT document_id, avg(CASE WHEN length(text) < 400 THEN 1.0 ELSE 0.0 END) > 0.5 AS is_scan FROM {PAGES} GROUP BY 1")
def a11_scan_ratio(t, spark):
    return metrics.scans(pages(t).withColumn("text", F.when(F.length("text") < 400, " \n").otherwise(F.col("text"))))


WB = "list_transform(regexp_extract_all(b.text, '[A-Za-z]+'), lambda w: lower(w))"


@query(f"SELECT item_id, CASE WHEN len({WB}) = 0 THEN 0.0 ELSE round(len(list_filter({WB}, lambda w: list_contains(list_transform(regexp_extract_all(d.text, '[A-Za-z]+'), lambda x: lower(x)), w))) * 100.0 / len({WB}), 9) END AS findable FROM benchmark b JOIN documents d ON doc_id = item_id")
def m3_findable(t, spark):
    low = lambda c: F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z]+)"), 1), lambda w: F.lower(w))
    b = t("benchmark").select("item_id", low(F.col("text")).alias("r")).join(t("documents").select(F.col("doc_id").alias("item_id"), low(F.col("text")).alias("c")), "item_id")
    return b.select("item_id", F.round(metrics.findable(F.col("r"), F.col("c")), 9).alias("findable"))


MARKED = f"translate(lower(text), '{LATIN}', 'ابتثجحخدذرزسشصضطظعغفقكلمًَُ')"


@query(f"SELECT doc_id, round(CASE WHEN l > 0 THEN m * 100.0 / l ELSE 0.0 END, 9) AS tashkil FROM (SELECT doc_id, length(regexp_replace({MARKED}, '[^ً-ْ]', '', 'g')) AS m, length(regexp_replace({MARKED}, '[^ء-ي]', '', 'g')) AS l FROM documents)")
def m4_tashkil(t, spark):
    x = F.translate(F.lower("text"), LATIN, "ابتثجحخدذرزسشصضطظعغفقكلمًَُ")
    return t("documents").select("doc_id", F.round(metrics.tashkil(x), 9).alias("tashkil"))


@query()
def m1_similarity(t, spark):
    """Each benchmark text with the whole document of its number."""
    b = t("benchmark").join(t("documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("other")), "item_id")
    return b.select("item_id", F.round(metrics.similarity(F.col("text"), F.col("other")), 9).alias("similarity"), F.round(metrics.word_order(F.col("text"), F.col("other"), "([A-Za-z]+)"), 9).alias("word_order"))


@query("""WITH b AS (SELECT l_orderkey AS page_id, l_quantity AS x, (l_linenumber - 1) // 3 AS line, (l_linenumber - 1) % 3 AS down, l_partkey::VARCHAR AS t FROM lineitem),
l AS (SELECT page_id, line, string_agg(t, ' ' ORDER BY x DESC, down, t) AS t FROM b GROUP BY 1, 2)
SELECT page_id, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY 1""")
def m5_rtl(t, spark):
    """Each order's items as boxes of height 6, of which three in turn stand one lower each and so share a text line."""
    x, n = F.col("l_quantity"), F.col("l_linenumber") - 1
    y = F.floor(n / 3) * 10.0 + n % 3
    return metrics.assemble_rtl(t("lineitem").select(F.col("l_orderkey").alias("page_id"), x.alias("x0"), (x + 5).alias("x1"), y.alias("y0"), (y + 6).alias("y1"), F.col("l_partkey").cast("string").alias("text")))


@query("SELECT l_shipmode_ AS engine, round(avg(l_quantity), 6) AS q, round(avg(l_discount), 6) AS d FROM (SELECT l_returnflag AS l_shipmode_, l_quantity, l_discount FROM lineitem) GROUP BY 1")
def m6_summary(t, spark):
    s = metrics.summary(t("lineitem").select(F.col("l_returnflag").alias("engine"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d")), "engine", ["q", "d"])
    return s.select("engine", F.round("q", 6).alias("q"), F.round("d", 6).alias("d"))


@query("SELECT p_partkey, abs(p_size - 25)::BIGINT AS deviation FROM part")
def m7_deviation(t, spark):
    return t("part").select("p_partkey", metrics.deviation(F.col("p_size"), F.lit(25)).cast("bigint").alias("deviation"))



# -- sinks, sources, streams --------------------------------------------------------------------------------------------

@query("SELECT doc_id, md5(regexp_replace(replace(text, '. ', ' \tً. '), '[ \t]+([ً-ٰ])', '\\1', 'g')) AS clean_md5 FROM documents".replace("\t", "\\t").replace("' \\tً", "' ' || chr(9) || 'ً"))
def f7_clean_pdf_text(t, spark):
    x = F.replace("text", F.lit(". "), F.lit(" \tً. "))
    return t("documents").select("doc_id", F.md5(T.clean_pdf_text(x)).alias("clean_md5"))


@query("SELECT doc_id AS document_id, CASE WHEN doc_id % 4 = 0 THEN 'exakt' ELSE 'sicher' END AS reliability FROM documents")
def p10_null_defaults(t, spark):
    raw = F.when(F.col("doc_id") % 4 == 0, "exakt").when(F.col("doc_id") % 4 == 1, "")
    return t("documents").select(F.col("doc_id").alias("document_id"), reliability(raw).alias("reliability"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def j11_in_list(t, spark):
    return t("orders").join(t("customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")


@query(f"""WITH i AS ({IMPORT}0), p AS ({IMPORT}1), n AS (SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.title = i.title AND p.page_count = i.page_count)),
k AS (SELECT * FROM n WHERE page_count IS NULL OR document_id = (SELECT min(document_id) FROM n m WHERE m.title = n.title AND m.page_count = n.page_count))
SELECT document_id, title FROM p UNION ALL SELECT (SELECT max(document_id) FROM p) + row_number() OVER (ORDER BY document_id), title FROM k""")
def s13_export_import(t, spark):
    """Even documents are exported and imported into a library of the odd ones."""
    d = t("documents").select(F.col("doc_id").alias("document_id"), F.md5("text").alias("title"), F.col("source").alias("author"), F.when(F.col("doc_id") % 10 != 0, F.col("n_chars")).alias("page_count"))
    tables = lambda k: {"documents": d.where(F.col("document_id") % 2 == k), "passages": passages(t).where(F.col("document_id") % 2 == k).select("passage_id", "document_id", "text")}
    at = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    library.export_library(tables(0), at)
    return library.import_library(spark, tables(1), at)["documents"].select("document_id", "title")


@query(f"SELECT document_id, page_no, md5(text) AS text_md5 FROM {PAGES}")
def stream_ingest(t, spark):
    """The documents as a stream of files, ingested batch by batch; the pages that have been written."""
    at = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    d = t("documents")
    folder, _, name = d.inputFiles()[0].rpartition("/")  # a file of its own, or one of a folder of files
    stream = spark.readStream.schema(d.schema).option("pathGlobFilter", "*.parquet" if folder.endswith(".parquet") else name)
    rows = stream.parquet(folder).select(F.col("doc_id").alias("document_id"), "text", "lang")
    rows.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(lambda b, n: ingest_batch(b, at, n)).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/pages").select("document_id", "page_no", F.md5("text").alias("text_md5"))


def docx(text: pd.Series, pages: pd.Series) -> pd.Series:
    """Files with a paragraph per line of a text and a noted number of pages, to read again."""

    def one(t: str, n: int) -> bytes:
        out = io.BytesIO()
        body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").split("\n"))
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", f"<w:document>{body}</w:document>")
            z.writestr("docProps/app.xml", f"<Properties><Pages>{n}</Pages></Properties>")
        return out.getvalue()

    return pd.Series([one(t, n) for t, n in zip(text, pages, strict=True)])


def as_docx() -> Column:
    return F.pandas_udf(docx, "binary")(F.coalesce("text", F.lit("")), F.ceil(F.length(F.coalesce("text", F.lit(""))) / 2000).cast("int"))


@query(f"""SELECT document_id, page_no, md5(text) AS text_md5, CASE document_id % 4 WHEN 0 THEN 'sicher' ELSE 'ungefähr' END AS reliability, CASE document_id % 4 WHEN 0 THEN 'TXT' ELSE 'DOCX' END AS engine, NULL AS error FROM {PAGES} WHERE document_id % 4 < 2
UNION ALL SELECT doc_id, unnest(range(1, len(l) + 1))::INT, md5(regexp_replace(unnest(l), '^\\s+|\\s+$', '', 'g')), 'sicher', 'PDF', NULL FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id % 4 = 2)
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, 'unsupported file type: odt' FROM documents WHERE doc_id % 4 = 3""")
def s1_dispatch(t, spark):
    """All documents as files of four kinds: text with Windows line ends, DOCX, PDF (a reader that makes a page of each line), unknown."""
    kind, id_ = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    path = F.concat(F.lit("in/"), id_, F.when(kind == 0, ".TXT").when(kind == 1, ".docx").when(kind == 2, ".pdf").otherwise(".odt"))
    plain = F.when(kind == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text")).cast("binary")
    docs = t("documents")
    rows = docs.where(kind == 1).select(path.alias("path"), as_docx().alias("content")).union(docs.where(kind != 1).select(path, plain))
    found = files.extracted(rows, pdf=lambda b: bytes(b).decode().split("\n"))
    return found.select(F.regexp_extract("path", r"(\d+)\.", 1).cast("long").alias("document_id"), "page_no", F.md5("text").alias("text_md5"), "reliability", "engine", "error")


@query("SELECT item_id, md5(replace(text, '. ', '.' || chr(10)) || chr(10)) AS text_md5 FROM benchmark")
def s2_txt(t, spark):
    """Texts with Windows line ends, written as a file each and read again."""
    at = f"{shared_dir(spark)}/txt-{uuid.uuid4().hex}"
    t("benchmark").select("item_id", F.replace("text", F.lit(". "), F.lit(".\r\n")).alias("value")).write.partitionBy("item_id").text(at)
    return files.read_txt(spark, f"{at}/*/*.txt").select(F.regexp_extract("path", r"item_id=(\d+)/", 1).cast("long").alias("item_id"), F.md5("text").alias("text_md5"))


@query("SELECT doc_id, ceil(length(text) / 2000.0)::BIGINT AS pages FROM documents")
def s18_docx_pages(t, spark):
    return t("documents").select("doc_id", as_docx().alias("content")).select("doc_id", files.docx_page_count("content").alias("pages"))


@query(f"SELECT 'document' AS kind, doc_id AS id, source AS text FROM documents WHERE doc_id IN (1, 2, 3, 5, 8, 13) UNION ALL SELECT 'passage', passage_id, md5(text) FROM {PASSAGES} WHERE document_id IN (1, 2, 3, 5, 8, 13) UNION ALL SELECT 'vector', vec_id, label::VARCHAR FROM embeddings JOIN {PASSAGES} ON passage_id = vec_id * 1000000 + 1 WHERE document_id IN (1, 2, 3, 5, 8, 13)")
def s12_export_chosen(t, spark):
    """An export of chosen documents, with their passages and the vectors of these."""
    at = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    vectors = t("embeddings").select((F.col("vec_id") * 1_000_000 + 1).alias("passage_id"), "embedding", "label")
    library.export_library({"documents": books(t), "passages": passages(t), "vectors": vectors}, at, [1, 2, 3, 5, 8, 13])
    got = lambda k: spark.read.parquet(f"{at}/{k}")
    rows = got("documents").select(F.lit("document").alias("kind"), F.col("document_id").alias("id"), F.col("author").alias("text"))
    rows = rows.union(got("passages").select(F.lit("passage"), "passage_id", F.md5("text")))
    return rows.union(got("vectors").select(F.lit("vector"), (F.col("passage_id") / 1_000_000).cast("long"), F.col("label").cast("string")))


@query(f"SELECT w AS term, count(DISTINCT passage_id) AS df, count(*) AS cf FROM (SELECT conv_id * 1000000 + turn AS passage_id, unnest(list_transform({tokens_sql('text')}, lambda x: lower(x))) AS w FROM conversations) GROUP BY w")
def t10_rebuild(t, spark):
    """The dictionary of an index that is built anew, as the stored stem version differs."""
    turns = t("conversations").select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("passage_id"), "text")
    meta = spark.createDataFrame([("stem_version", "old")], "key string, value string")
    return library.rebuilt({"passages": turns, "meta": meta}, "new").terms.where("field = 'norm'").select("term", "df", "cf")


@query("""WITH t AS (SELECT DISTINCT 'Doc' || (doc_id % 60) || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '-' || (doc_id % 7) END || '.txt' AS name FROM documents),
u AS (SELECT doc_id, 'Doc' || (doc_id % 70) AS s FROM documents), c AS (SELECT doc_id, k, s || CASE WHEN k = 1 THEN '' ELSE '-' || k END || '.txt' AS name FROM u, range(1, 9) r(k))
SELECT doc_id, arg_min(name, k) AS free FROM c WHERE name NOT IN (SELECT name FROM t) GROUP BY 1""")
def s15_upload_name(t, spark):
    """The name that each document would get among the files that are there."""
    d, n = t("documents"), F.col("doc_id")
    taken = d.select(F.concat(F.lit("Doc"), (n % 60).cast("string"), F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("-"), (n % 7).cast("string"))), F.lit(".txt")).alias("name"))
    return files.free_names(d.select("doc_id", F.concat(F.lit("in/Doc"), (n % 70).cast("string"), F.lit(".txt")).alias("name")), taken).select("doc_id", "free")
