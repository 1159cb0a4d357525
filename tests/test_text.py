"""Text functions against the pinned cases and plain Python restatements."""

import re

from pyspark.sql import functions as F

from scriptorium.functions import isri
from scriptorium.functions import text as T
from scriptorium.operators.chunk import chunk, chunks, paginate
from scriptorium.plans import query as Q


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_normalize(spark):
    for raw, want in (("كَتَبَ", "كتب"), ("أحمد", "احمد"), ("إسلام", "اسلام"), ("مكتبة", "مكتبه"), ("مصطفى", "مصطفي"), ("٥ صفحات", "5 صفحات")):
        assert one(spark, raw, T.normalize) == want
        assert " ".join(Q.tokens(raw)) == want


def test_conjugations_share_a_stem():
    assert {isri.stem(Q.tokens(w)[0]) for w in ("يكتب", "كتبت", "يكتبون", "كتب")} == {"كتب"}
    assert isri.stem("ABC") == "abc"


def test_light_stem_takes_first_affixes(spark):
    assert one(spark, "والكتاب", T.light_stem) == "كتاب"
    assert one(spark, "كتابها", T.light_stem) == "تاب"
    assert one(spark, "من", T.light_stem) == "من"


def test_sentences_split_at_unicode_space_and_blank_lines(spark):
    assert one(spark, "A b. C d!  e\n\n\nf؟ g", T.sentences) == ["A b.", "C d!", "e", "f؟", "g"]


def test_snippet(spark):
    long = "x" * 100 + " word " + "y" * 300
    f = lambda words: lambda c: T.snippet(c, F.array(*[F.lit(w) for w in words]).cast("array<string>"))
    assert one(spark, long, f([])) == long[:240] + "…"
    assert one(spark, "short", f([])) == "short"
    start = max(0, 101 - 80)
    assert one(spark, long, f(["word"])) == "…" + long[start : start + 240].strip() + "…"


def test_authors(spark):
    assert one(spark, " a ؛ b;a ;; ", T.split_authors) == ["a", "b"]
    assert one(spark, None, T.split_authors) == []
    assert one(spark, " ; ", lambda c: T.join_authors(T.split_authors(c))) is None


def test_versions(spark):
    for a, b, want in (("1.10", "1.9.9", True), ("2", "2.0.0", False), ("1.2rc", "1.2", False), ("x", "0.0.1", False)):
        assert one(spark, a, lambda c, b=b: T.newer(c, F.lit(b))) is want


def test_clean_pdf_text(spark):
    assert one(spark, "ﬁ ا ً", T.clean_pdf_text) == "fi اً"


def test_paginate(spark):
    rows = paginate(spark.createDataFrame([(1, "ab" * 1500), (2, ""), (3, None), (4, "c" * 2000)], "document_id long, text string")).orderBy("document_id", "page_no").collect()
    assert [(r.document_id, r.page_no, len(r.text)) for r in rows] == [(1, 1, 2000), (1, 2, 1000), (2, 1, 0), (3, 1, 0), (4, 1, 2000)]


def fold(text):
    """The chunking rule, restated."""
    said = [s for s in (re.sub(r"^\s+|\s+$", "", x) for x in re.split(r"(?<=[.!?؟۔])\s+|\n{2,}", text)) if s]
    out, buf, n = [], [], 0
    for s in said:
        while len(s) > 1100:
            out.append(buf + [s[:1100]])
            buf, n, s = [], 0, s[1100:]
        if n + len(s) > 700 and buf:
            out.append(buf)
            buf, n = [], 0
        buf, n = buf + [s], n + len(s) + 1
    out.append(buf)
    kept = [" ".join(b).strip() for b in out if b]
    return [k for k in kept if len(re.findall(r"[ء-يA-Za-z]", k)) >= 20]


def test_chunks_equal_the_fold(spark):
    cases = ["", "12 34 " * 100, "A" * 19, "A" * 20, "B" * 2500, "Start here. " + "C" * 1500 + ". End of it all, finally.", "s" * 349 + ". " + "t" * 348 + ". u" * 30, ("Word " * 20 + ". ") * 40]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, x string").select("i", chunks(F.col("x")).alias("y")).collect()
    assert {r.i: r.y for r in rows} == {i: fold(c) for i, c in enumerate(cases)}


def test_chunk_numbers_kept_passages(spark):
    pages = spark.createDataFrame([(1, 1, "a" * 30), (1, 2, "123"), (1, 3, "b" * 30)], "document_id long, page_no int, text string")
    assert [(r.idx, r.page_from) for r in chunk(pages).orderBy("idx").collect()] == [(0, 1), (1, 3)]
