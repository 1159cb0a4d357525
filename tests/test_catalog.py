"""Catalogue, library, corpus, metrics, sources and streaming on small tables."""

import io
import os
import random
import zipfile

from pyspark.sql import functions as F

from scriptorium import session
from scriptorium.operators import catalog as C
from scriptorium.operators import corpus, library, metrics
from scriptorium.operators.index import Index
from scriptorium.sources import files
from scriptorium.streaming.ingest import ingest_stream

DOC = "document_id long, title string, author string, page_count int"


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_author_sync_and_counts(spark):
    d = spark.createDataFrame([(1, "a", "الخوارزمي ؛ سيبويه", 1), (2, "b", "سيبويه", 1), (3, "c", None, 1), (4, "d", "", 1)], DOC)
    names, links = C.synced_links(d)
    count = lambda n, k: {r["name"]: r["n"] for r in C.with_count(n, k, "id", "n").collect()}
    assert count(names, links) == {"الخوارزمي": 1, "سيبويه": 2}
    assert pairs(C.synced_links(C.recached(d, links, names))[1]) == pairs(links)
    more = C.created(names, ["", "new", "new", "سيبويه"])
    assert count(more, links) == {"الخوارزمي": 1, "سيبويه": 2, "new": 0}


def test_merge_rename_delete(spark):
    names = spark.createDataFrame([(1, "أ"), (2, "ب")], "id long, name string")
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "document_id long, id long")
    n, k = C.renamed(names, links, "أ", "ب")
    assert pairs(n) == {(2, "ب")} and pairs(k) == {(1, 2), (2, 2)}
    d = spark.createDataFrame([(1, "x", "أ ؛ ب", 1), (2, "y", "أ", 1)], DOC)
    assert {r.document_id: r.author for r in C.recached(d, k, n).collect()} == {1: "ب", 2: "ب"}
    assert pairs(C.renamed(names, links, "أ", "ج")[0]) == {(1, "ج"), (2, "ب")}
    n, k = C.removed(n, k, "ب")
    assert n.count() == k.count() == 0 and C.recached(d, k, n).where("author is null").count() == 2


def test_import_skips_known_and_repeated(spark):
    old = spark.createDataFrame([(1, "a", None, 5)], DOC)
    new = spark.createDataFrame([(1, "a", None, 5), (2, "b", None, 3), (3, "b", None, 3), (4, "n", None, None), (5, "n", None, None)], DOC)
    assert {r.document_id for r in C.not_imported(new, old).collect()} == {2, 4, 5}


def test_bookmark_repair(spark):
    d = spark.createDataFrame([(1, "one"), (5, "two")], "document_id long, title string")
    p = spark.createDataFrame([(10, 1, 1, 1, "alpha beta"), (11, 1, 1, 2, "gamma"), (50, 5, 1, 1, "delta")], "passage_id long, document_id long, page_from int, page_to int, text string")
    b = spark.createDataFrame([(1, 1, 10, "one", 1, "alpha"), (2, 1, 99, "one", 1, "gamma"), (3, 1, 99, "one", 1, "zzz"), (4, 2, 99, "two", 1, ""), (5, 9, 99, "gone", 1, "x"), (6, 1, 99, "one", 7, "x")], "id long, document_id long, passage_id long, doc_title string, page_no int, snippet string")
    got = {r.id: (r.document_id, r.passage_id, r.missing) for r in C.repaired_bookmarks(b, d, p).collect()}
    assert got == {1: (1, 10, False), 2: (1, 11, False), 3: (1, 10, False), 4: (5, 50, False), 5: (None, 99, True), 6: (1, None, False)}


def test_toggle_and_delete(spark):
    s = "document_id long, passage_id long, page_no int"
    b = spark.createDataFrame([(1, 10, 1), (1, None, 2)], s)
    for mark, want in (((1, 10, 9), 1), ((1, None, 2), 1), ((1, None, 3), 3), ((2, 10, 1), 3)):
        assert C.toggled(b, spark.createDataFrame([mark], s)).count() == want
    out = C.without_documents({"documents": spark.createDataFrame([(1,), (2,)], "document_id long"), "bookmarks": b, "passages": spark.createDataFrame([(1, 10), (2, 20)], "document_id long, passage_id long"), "vectors": spark.createDataFrame([(10,), (20,)], "passage_id long")}, [1])
    assert pairs(out["vectors"]) == {(20,)} and out["bookmarks"].count() == 2 and pairs(out["documents"]) == {(2,)}


def test_library_files_other_than_pdf_shadow_nothing(spark):
    f = spark.createDataFrame([("in/a.docx",), ("in/b.docx",)], "path string")
    assert pairs(C.without_shadowed(f, spark.createDataFrame([("lib/a.txt",), ("lib/b.PDF",)], "path string"))) == {("in/a.docx",)}


def test_remapped_ids_of_any_spread(spark):
    """Ids that are far apart, hashed or negative: dense new ids in the order of the old."""
    import random

    rng = random.Random(1)
    ids = sorted({rng.randrange(-(2**62), 2**62) for _ in range(500)} | {k * 1_000_000 for k in range(200)})
    d = spark.createDataFrame([(i, f"t{i}") for i in rng.sample(ids, len(ids))], "id long, t string")
    got = {r.id: r.new_id for r in C.remapped(d, spark.createDataFrame([(7,), (41,)], "id long"), "id").collect()}
    assert got == {i: 42 + k for k, i in enumerate(ids)}
    assert C.remapped(d.limit(0), d, "id").count() == 0


def test_ingest_of_an_id_with_two_rows(spark, tmp_path):
    """All tables hold the same one of conflicting rows, whatever their order."""
    from scriptorium.streaming.ingest import ingest_batch

    for k, rows in enumerate(([(1, "first text"), (1, "other text")], [(1, "other text"), (1, "first text")])):
        at = str(tmp_path / str(k))
        ingest_batch(spark.createDataFrame(rows, "document_id long, text string").repartition(2), at, 0)
        pages = spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/pages").collect()
        assert [r.text for r in pages] == ["first text"] and spark.read.parquet(f"{at}/documents/batch=0").count() == 1


def test_shadowed_docx(spark):
    f = spark.createDataFrame([("a/x.pdf",), ("b/X.docx",), ("y.docx",), ("z.docx",), ("t.txt",)], "path string")
    assert pairs(C.without_shadowed(f, spark.createDataFrame([("lib/Z.pdf",)], "path string"))) == {("a/x.pdf",), ("y.docx",), ("t.txt",)}


def test_reconstruction_equals_the_merge(spark):
    rng, rows, want = random.Random(3), [], {}
    for page in range(60):
        parts = [(rng.randrange(0, 40), k, "".join(rng.choices("abc ", k=rng.randrange(0, 20)))) for k in range(rng.randrange(1, 6))]
        text, covered = "", 0
        for cs, k, tx in sorted(parts):
            ce = cs + len(tx)
            rows.append((page, cs, ce, tx, k))
            if ce > covered:
                text += tx if cs >= covered else tx[covered - cs:]
                covered = ce
        want[page] = text.strip()
    c = spark.createDataFrame(rows, "page_id long, char_start int, char_end int, text string, k int")
    assert {r.page_id: r.text for r in corpus.reconstruct(c, ["page_id"], "k").collect()} == want
    nulls = spark.createDataFrame([(1, None, None, "x", 0), (1, 0, 2, "ab", 1)], c.schema)
    assert corpus.reconstruct(nulls, ["page_id"], "k").first()["text"] == "ab"


def test_broken_layers(spark):
    good = "كلمة " * 30
    cases = {"short": ("يف " * 20, False), "plain": (good, False), "fi": (good + "يف " * 4, True), "ta": (good + "ةك " * 5, True), "la": (good + "كملا " * 5, True), "al": (good + "كملا " * 5 + "الكم " * 9, False)}
    d = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "document_id string, text string")
    assert {r.document_id: r.broken for r in metrics.broken_documents(d).collect()} == {k: w for k, (_, w) in cases.items()}
    assert {r.document_id: r.b for r in d.select("document_id", metrics.text_layer_broken(F.col("text")).alias("b")).collect()} == {k: w for k, (_, w) in cases.items()}


def test_metrics(spark):
    d = spark.createDataFrame([("كتاب جديد", "كتاب جديد"), ("abc", "")], "a string, b string")
    rows = d.select(metrics.similarity(F.col("a"), F.col("b")).alias("s"), metrics.word_order(F.col("a"), F.col("b")).alias("o")).collect()
    assert [tuple(r) for r in rows] == [(100.0, 100.0), (0.0, 0.0)]
    box = spark.createDataFrame([(1, 0.0, 5.0, 0.0, 10.0, "left"), (1, 9.0, 20.0, 1.0, 11.0, "right"), (1, 0.0, 5.0, 20.0, 30.0, "below")], "page_id long, x0 double, x1 double, y0 double, y1 double, text string")
    assert metrics.assemble_rtl(box).first()["text"] == "right left\nbelow"


def test_export_import(spark, tmp_path):
    doc = lambda rows: spark.createDataFrame(rows, DOC)
    p = lambda rows: spark.createDataFrame(rows, "passage_id long, document_id long, text string")
    v = lambda rows: spark.createDataFrame(rows, "passage_id long, vec array<float>")
    source = {"documents": doc([(1, "a", "x ؛ y", 1), (2, "b", "y", 2)]), "passages": p([(1, 1, "one"), (2, 2, "two"), (3, 2, "three")]), "vectors": v([(3, [1.0])])}
    library.export_library(source, str(tmp_path / "all"))
    library.export_library(source, str(tmp_path / "some"), [2])
    assert spark.read.json(str(tmp_path / "some/manifest")).first()["documents"] == 1
    mine = {"documents": doc([(7, "a", "x", 1)]), "passages": p([(70, 7, "old")]), "vectors": v([])}
    out = library.import_library(spark, mine, str(tmp_path / "all"))
    assert {(r.document_id, r.title) for r in out["documents"].collect()} == {(7, "a"), (8, "b")}
    assert pairs(out["passages"].select("passage_id", "document_id", "text")) == {(70, 7, "old"), (71, 8, "two"), (72, 8, "three")}
    assert [r.passage_id for r in out["vectors"].collect()] == [72] and {r.name for r in out["author_names"].collect()} == {"x", "y"}
    meta = spark.createDataFrame([("stem_version", "1")], "key string, value string")
    assert library.rebuilt(out | {"meta": meta}, "1") is None and isinstance(library.rebuilt(out | {"meta": meta}, "2"), Index)


def docx(text, pages=None):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", "<w:document>" + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in text) + "</w:document>")
        if pages:
            z.writestr("docProps/app.xml", f"<Properties><Pages>{pages}</Pages></Properties>")
    return b.getvalue()


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\xff\rthree")
    (tmp_path / "b.docx").write_bytes(docx(["first &amp; last", "second"], 7))
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.docx").write_bytes(b"no zip")
    rows = {r.path.rpartition("/")[2]: r for r in files.extract(spark, str(tmp_path), pdf=lambda b: [" p1 "]).collect()}
    assert rows["a.txt"].text == "one\ntwo�\nthree" and rows["a.txt"].page_no == 1
    assert rows["b.docx"].text == "first & last\nsecond" and rows["b.docx"].reliability == "ungefähr"
    assert rows["c.pdf"].text == "p1" and rows["c.pdf"].engine == "PDF" and rows["d.docx"].error
    assert files.read_txt(spark, str(tmp_path / "a.txt")).first()["text"] == "one\ntwo�\nthree"
    assert files.docx_pages(docx(["x"], 7)) == 7 and files.docx_pages(docx(["x"])) is None and files.docx_pages(b"") is None
    assert files.free_name("x/a.b.txt", {"a.b.txt", "a.b-2.txt"}) == "a.b-3.txt" and files.free_name("n", {"n"}) == "n-2"


def test_free_names_equal_one_upload_each(spark):
    taken = ["n", "n-3", "a.b.txt", "a.b-2.txt", "a.b-02.txt", ".txt", ".txt-2", "-2.txt", "x-2-2.txt", "x-2.txt", "..", "q.", "q-2.", ".a.b-2", ".a.b", "z-2.txt"]
    up = ["n", "in/a.b.txt", "in\\a.b-2.txt", ".txt", "-2.txt", "x-2.txt", "..", "q.", ".a.b", "z.txt", "new", "n"]
    free = files.free_names(spark.createDataFrame([(u, k) for k, u in enumerate(up)], "name string, free int").withColumnRenamed("free", "k"), spark.createDataFrame([(x,) for x in [*taken, None, "n"]], "name string"))
    assert {r.k: r.free for r in free.collect()} == {k: files.free_name(u, set(taken)) for k, u in enumerate(up)}
    assert not files.free_names(spark.createDataFrame([], "name string"), spark.createDataFrame([], "name string")).collect()


def test_scratch_deletes_what_is_not_kept(spark):
    with session.scratch(spark):
        session.stored(spark.range(3), "gone")
        kept = session.stored(spark.range(5), "there", keep=True)
        with session.scratch(spark):
            session.stored(spark.range(3), "inner")
        assert any(x.startswith("gone-") for x in os.listdir(session.shared_dir(spark)))
    assert kept.count() == 5
    assert not any(x.startswith(("gone-", "inner-")) for x in os.listdir(session.shared_dir(spark)))


def test_streaming_ingest_is_exactly_once(spark, tmp_path):
    land, out, ck = (str(tmp_path / x) for x in ("land", "out", "ck"))
    schema = "document_id long, title string, text string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)
    put([(1, "a", "word " * 600), (2, "b", "another text of some length here")])
    ingest_stream(spark, land, out, ck, schema).awaitTermination(120)
    put([(2, "b", "again"), (3, "c", "a third text with enough letters")])
    ingest_stream(spark, land, out, ck, schema).awaitTermination(120)
    read = lambda t: spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/{t}")
    assert sorted(r.document_id for r in read("documents").collect()) == [1, 2, 3]
    assert sorted((r.document_id, r.page_no) for r in read("pages").collect()) == [(1, 1), (1, 2), (2, 1), (3, 1)]
    assert read("passages").where("document_id = 3").count() == 1


def test_similarity_reads_the_whole_document(spark):
    from scriptorium.plans import registry

    tables = {"benchmark": spark.createDataFrame([(1, "alpha beta")], "item_id long, text string"), "documents": spark.createDataFrame([(1, "gamma wordy alpha beta")], "doc_id long, text string")}
    row = registry.m1_similarity(tables.__getitem__, spark).first()
    assert (row.similarity, row.word_order) == (62.5, round(200 * 2 / 6, 9))
