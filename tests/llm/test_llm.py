"""Training-data operators against brute force, exact round trips and held-out accuracy, with the defined edge cases."""

from __future__ import annotations

import hashlib
import importlib.util
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import chat, common, decontam, line_dedup, minhash, packing, pii, quality, queries, substring, toxicity, warc

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash with the operators' own."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = " ".join(rng.choice(words) for _ in range(120))
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, base), (5, base), (5, base), (6, base.upper()), (7, base + " tail"), (8, ("long text " * 9000) + "\n" + base), (9, "a\n\na\nb c\na"), (None, "no id here at all"), (None, None)]
    rows += [(10 + i, " ".join(base.split()[: 100 + i]) + " x" * (i % 3)) for i in range(20)]
    data = [(i, t, "en", "src0", len(t or ""), 1, "x", 2.0, 7) for i, t in rows]
    return spark.createDataFrame(data, DOCS + ", n_words int, kept string, score double, n int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return {t: spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark", "labels", "pages", "conversations")}


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def check(got, want):
    """Rows as multisets."""
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


# -- quality ------------------------------------------------------------------------------------------------------------

def base_figures(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cov = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cov), len(w) < 10 or 100 * len(cov) > 20 * len(w))


@pytest.mark.parametrize("which", ["edge", "small", "none"])
def test_quality_figures(request, which):
    d = request.getfixturevalue(which)
    d = d["documents"] if which == "small" else d
    got = quality.op2(d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    check(got, [(i, *base_figures(t)) for i, t in texts(d)])


def test_quality_verdicts(spark):
    good = "This is a plain line of text, nothing odd about it. " * 3
    rows = [(1, good), (2, "Home | About | News | Contact | Login | Help | More | Top | End | Map"), (3, good + "\nAll rights reserved."), (4, "BUY!! NOW!! THIS!! IS!! THE!! BEST!! OF!! ALL!! DEALS!! EVER!!"), (5, "thing%%% word*** more&&& odd$$$ stuff### here%%% and*** there&&& now$$$ end###"), (6, good.replace("plain", "fine") + "\n" + "1234 5678 " * 4)]
    out = {r.doc_id: r for r in quality.annotate(spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)).collect()}
    assert not any(out[i].kept for i in (2, 4, 5))
    assert out[3].cleaned == good and out[6].cleaned == good.replace("plain", "fine")
    fails = lambda line: spark.createDataFrame([(line,)], "l string").select(quality.line_fails(F.col("l"))).first()[0]
    for line in ("Products Services Blog Careers Press", "Home › Shop › Shoes.", "no sentence here", "Alle Rechte vorbehalten.", "Nous respectons: tous droits réservés.", "Leer más.", "BUY NOW OR NEVER AGAIN."):
        assert fails(line), line
    long = "It has been said that cookies taste best when they are warm, and that nobody who has ever eaten one in the kitchen of a friend would say otherwise. " * 3
    for line in ("A plain sentence.", "He said “no.”  ", "The text goes on. And it is cut off in the mid", long, "ما هذا؟"):
        assert not fails(line), line
    d = spark.createDataFrame([(9, " ".join(f"word{i}" for i in range(40)) + ".\nAll rights reserved.", "en", "s", 1)], DOCS)
    kept = quality.clean_documents(d)
    assert kept.columns == d.columns and kept.first()["n_chars"] == len(kept.first()["text"]) and "reserved" not in kept.first()["text"]


# -- line dedup ---------------------------------------------------------------------------------------------------------

def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    p = next((i for i in range(n) if a[i] != b[i]), n)
    s = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
    return p + s >= max(len(a), len(b)) - 1


def alike(a, b):
    """Equal, or one edit apart: of words from 8 words on, else of characters but digits from 20 characters on. a, b: words."""
    if a == b:
        return True
    x, y = " ".join(a), " ".join(b)
    if len(a) >= 8 and len(b) >= 8:
        return near(a, b)
    if len(a) >= 8 or len(b) >= 8 or min(len(x), len(y)) < 20 or not near(x, y):
        return False
    at = next(i for i in range(max(len(x), len(y))) if x[i : i + 1] != y[i : i + 1])
    edited = (x[at] if len(x) >= len(y) else "") + (y[at] if len(y) >= len(x) else "")
    return not any(c.isnumeric() for c in edited)


def dedup(rows):
    seen, out = [], {}
    for i, t in rows:
        kept, gone = [], 0
        for line in (t or "").split("\n"):
            w = tuple(WORD.findall(line))
            dup = w and any(alike(w, x) for x in seen)
            if w and w not in seen:
                seen.append(w)
            gone += bool(dup)
            kept += [] if dup else [line]
        out[i] = (gone, hashlib.sha256("\n".join(kept).encode()).hexdigest() if t is not None else hashlib.sha256(b"").hexdigest())
    return out


def test_line_dedup_equals_brute_force(spark, none):
    rng, vocabulary, pool, rows = random.Random(2), [f"v{i}" for i in range(25)], [], []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 4)):
            w = list(rng.choice(pool)) if pool and rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 18))]
            for _ in range(rng.choice([0, 1, 1, 2])):
                at, kind = rng.randrange(len(w) + 1), rng.random()
                if kind < 0.33:
                    w.insert(at, rng.choice(vocabulary))
                elif kind < 0.66 and len(w) > 1:
                    w.pop(min(at, len(w) - 1))
                else:
                    w[min(at, len(w) - 1)] = rng.choice(vocabulary)
            pool.append(w)
            lines.append(("  " if rng.random() < 0.1 else " ").join(w))
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n \n")]
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in line_dedup.op1(d).collect()} == dedup(rows)
    assert line_dedup.dedup_lines(d).columns == d.columns and line_dedup.dedup_lines(d).count() == len(rows)
    assert line_dedup.op1(none).count() == 0
    twice = spark.createDataFrame([(1, "a b\nc", "en", "s", 5), (2, "c\n\na b", "en", "s", 7), (3, "", "en", "s", 0), (4, "c\nd", "en", "s", 3)], DOCS)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(twice, drop_emptied=True).collect()} == {1: "a b\nc", 3: "", 4: "d"}


def unbounded(rows):
    """op1's figures by brute force, with one edit for every line of 8 words or more."""
    seen, out = [], {}
    for i, t in rows:
        kept = []
        for line in t.split("\n"):
            w = tuple(WORD.findall(line))
            kept += [] if w and any(alike(w, x) for x in seen) else [line]
            seen += [w] if w else []
        out[i] = (t.count("\n") + 1 - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def edited(rng, words, vocabulary, times):
    w = list(words)
    for _ in range(times):
        at, kind = rng.randrange(max(len(w), 1)), rng.randrange(3)
        w[at : at + (kind > 0)] = [rng.choice(vocabulary)] * (kind < 2)
    return w


@pytest.mark.parametrize("bound", [512, 8])
def test_line_dedup_of_long_lines(spark, monkeypatch, bound):
    """Lines around and far above the length from which pairs are compared by blocks; few distinct words, so that edits have several places."""
    monkeypatch.setattr(line_dedup, "BLOCKED", bound)
    rng, vocabulary, pool, rows = random.Random(6), [f"v{i}" for i in range(4)], [], []
    for n in [511, 512, 513, 600, 1023, 1024, 1025, 3000] if bound == 512 else range(8, 40):
        pool.append([rng.choice(vocabulary) for _ in range(n)])
        pool += [edited(rng, rng.choice(pool[-5:]), vocabulary, rng.choice([1, 1, 2])) for _ in range(6)]
        pool += [pool[-1][1:], pool[-1][:-1]]
    rng.shuffle(pool)
    rows = [(i, " ".join(w)) for i, w in enumerate(pool)]
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    want = unbounded(rows)
    assert sum(n for n, _ in want.values()) > 20
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in line_dedup.op1(d).collect()} == want


def test_line_dedup_of_short_lines(spark):
    """One character for lines of fewer than 8 words, and no digit; around the bounds of words and characters."""
    rng, letters, pool = random.Random(14), "ab é1²\U0001f600", []
    for n in [*range(17, 45), 64, 65, 127, 600]:
        pool.append("".join(rng.choice(letters) for _ in range(n)))
        for _ in range(5):
            x, at, kind = pool[-1], rng.randrange(len(pool[-1])), rng.randrange(3)
            pool.append(x[:at] + rng.choice(letters) * (kind < 2) + x[at + (kind > 0) :])
    pool += ["please read our terms and rules", "please read our terms and rulez", "please read our terms and rule", "See chapter 12 of the report", "See chapter 13 of the report", "one two three four five six sev", "one two three four five six sev eight"]
    rng.shuffle(pool)
    rows = [(i, "\n".join(pool[k : k + 3])) for i, k in enumerate(range(0, len(pool), 3))]
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    want = dedup(rows)
    assert sum(n for n, _ in want.values()) > 40
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in line_dedup.op1(d).collect()} == want


def test_line_dedup_edges(edge):
    got = line_dedup.op1(edge).collect()
    assert len(got) == edge.count()
    same = [r for r in got if r.doc_id == 5]
    assert same[0] == same[1] and same[0].n_removed == 1  # repeated rows are one document, its text stands in document 4
    assert [r.n_removed for r in got if r.doc_id == 9] == [2]


def test_line_dedup_by_shuffle(edge, monkeypatch):
    want = line_dedup.op1(edge).collect()
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    check(line_dedup.op1(edge).collect(), want)


# -- near-duplicates ----------------------------------------------------------------------------------------------------

def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(rows, size=4):
    sets = {i: shingle_set(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_minhash_equals_brute_force(small, none):
    d = small["documents"]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.op5(d).collect()}
    assert got == components(texts(d))
    assert minhash.op5(none).count() == 0


def test_minhash_large_group_with_links_off_the_hub(spark, monkeypatch):
    """Copies of copies: chains whose ends are far apart, in buckets of many members, split into several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng, rows = random.Random(7), []
    base = [f"t{rng.randrange(10**6)}" for _ in range(90)]
    for i in range(160):
        w = list(base if i % 3 else rows[-1][1].split() if rows else base)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"m{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.op5(d).collect()}
    assert got == components(rows)
    out = minhash.drop_near_duplicates(d, 5, 80)
    assert {r.doc_id for r in out.collect()} == {i for i, (_, _, kept) in components(rows, 5).items() if kept} and out.columns == d.columns


def test_minhash_edges(edge):
    got = minhash.op5(edge).collect()
    assert len(got) == edge.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[0].n_shingles, by[1].component_id, by[2].kept) == (0, 1, True)
    assert by[3].n_shingles == 1 and by[4].component_id == by[5].component_id == by[6].component_id == 4
    assert by[4].component_id == components([(i, t) for i, t in texts(edge) if i is not None])[7][1]


def test_pruning_bounds_grow():
    bounds = minhash.least_matches(0.8)
    assert list(bounds) == [16, 32, 48, 64, 80, 96] and all(0 < m < 0.8 * n for n, m in bounds.items())


# -- decontamination ----------------------------------------------------------------------------------------------------

def brute_hits(rows, items):
    token = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = {}
    for item, t in items:
        w = token(t)
        for i in range(max(1, len(w) - 7)):
            if w:
                grams.setdefault(tuple(w[i : i + 8]), set()).add(item)
    out = []
    for doc, t in rows:
        w, cov, ids = token(t), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if found := grams.get(tuple(w[i : i + k])):
                    cov |= set(range(i, i + k))
                    ids |= found
        out.append((doc, len(w), len(cov), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), len(ids) >= 2))
    return out


@pytest.mark.parametrize("bound", [500_000, -1])
def test_decontamination_equals_brute_force(spark, edge, small, none, monkeypatch, bound):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", bound)
    items = [(1, "The Quick, brown fox: jumps over THE lazy dog again"), (2, "short one"), (3, None), (4, "..."), (11, "brown fox jumps over the lazy dog again and on"), (12, "w1")]
    b = spark.createDataFrame(items, "item_id long, text string")
    extra = spark.createDataFrame([(90, "x THE quick brown fox jumps over the lazy dog again, short one Short One"), (91, "élan Short... one")], "doc_id long, text string")
    d = edge.select("doc_id", "text").union(extra)
    check(decontam.op6(d, b).collect(), brute_hits(texts(d), items))
    s = small["documents"]
    check(decontam.op6(s, small["benchmark"]).collect(), brute_hits(texts(s), [(r.item_id, r.text) for r in small["benchmark"].collect()]))
    assert decontam.op6(none, b).count() == 0 and decontam.op6(d, b.limit(0)).where("n_hit > 0").count() == 0
    kept = {r.doc_id: r.text for r in decontam.clean_documents(d, b).collect() if r.doc_id and r.doc_id >= 90}
    assert 90 not in kept and kept[91] == "élan \n"


# -- packing ------------------------------------------------------------------------------------------------------------

def test_tokens_equal_the_tokenizers_library(small):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    said = [x for _, x in texts(small["documents"])] + ["", " ", "it's  we'll\n\n x", "日本語 ١٢٣ é̀ 🙂", "<|endoftext|>", "a\x00b\x1f", "   x"]
    e = packing.tokenizer()
    assert [x.ids for x in t.encode_batch(said, add_special_tokens=False)] == [e.encode_ordinary(x) for x in said]


def test_tokens_of_texts_that_hold_an_added_token(spark):
    """Against tokenizers with its defaults: the literal of an added token is one id."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(P.path("byte_bpe_50k.json")), random.Random(8)
    parts = ["<|endoftext|>", "<|endof", "text|>", "<|", " ", "\n", "a word", "'s", "é", "日", "12"]
    said = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n"] + ["".join(rng.choices(parts, k=8)) for _ in range(500)]
    want = [[*x.ids, packing.END] for x in t.encode_batch(said, add_special_tokens=False)]
    assert any(50256 in x for x in want)
    d = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    assert {r.doc_id: list(r.ids) for r in packing.cut(d, with_ids=True).collect()} == dict(enumerate(want))


def placed(rows, docs):
    e = packing.tokenizer()
    ids = Counter()
    whole = {}
    for i, t in docs:
        a = np.array([*e.encode_ordinary(t or ""), 0], dtype="<u4")
        whole.setdefault(i, a)
        ids[i] += 1
    for r in rows:
        part = whole[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(whole[r.doc_id])
    assert Counter({i: len(whole[i]) * n for i, n in ids.items()}) == sum((Counter({r.doc_id: r.length}) for r in rows), Counter())
    spots = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (s, o, n), (s2, o2, _) in zip(spots, spots[1:], strict=False):
        assert (s2 == s and o2 == o + n) or (s2 != s and o2 == 0)
    return Counter({s: n for s, n in Counter().items()}) or {s: sum(n for s2, _, n in spots if s2 == s) for s, _, _ in spots}


def test_leaked_words_are_cut_out(spark, none):
    passage = "one two three four five six seven eight nine ten"
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    cases = [(1, f"Before it. {passage}! After it."), (2, passage), (3, f"«{passage.title()}» {passage}"), (4, "one two three"), (5, None), (6, f"... {passage} ? x {passage}")]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in cases], DOCS)
    out = decontam.clean_documents(d, b)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == d.columns
    assert got == {1: "Before it. \n! After it.", 2: "\n", 3: got[3], 4: "one two three", 5: None, 6: "... \n ? x \n"}
    assert not any(n for _, _, n, _, _, _ in brute_hits(list(got.items()), [(1, passage)]))
    assert decontam.clean_documents(none, b).count() == 0


def test_packing(small, edge, none):
    rows = packing.op3(small["documents"]).collect()
    full = placed(rows, texts(small["documents"]))
    assert max(full.values()) <= 1024
    assert sum(full.values()) / (1024 * len(full)) > 0.97
    d = edge.where("doc_id is not null")
    assert max(placed(packing.op3(d).collect(), texts(d)).values()) <= 1024
    assert packing.op3(none).count() == 0
    said = {r.sequence_id: r.ids for r in packing.sequences(small["documents"].limit(20)).collect()}
    assert sum(map(len, said.values())) == sum(r.length for r in packing.op3(small["documents"].limit(20)).collect())


def test_patterns_cover_the_histogram_in_few_bins():
    rng = random.Random(1)
    for _ in range(6):
        h = {rng.randint(1, 128): rng.randint(1, 400) for _ in range(40)}
        got = packing.patterns(h, 128)
        used = Counter()
        for p, times in got:
            assert sum(s * c for s, c in p.items()) <= 128
            used.update({s: c * times for s, c in p.items()})
        assert used == Counter(h)
        assert sum(t for _, t in got) <= sum(s * n for s, n in h.items()) / 128 * 1.1 + sum(n for s, n in h.items() if s > 64) * 0.5 + 20


# -- toxicity -----------------------------------------------------------------------------------------------------------

def test_toxicity_on_held_out_rows(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.op4(d, labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    p, n = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n])
    assert auc > 0.9 and sum(r.predicted and not r.toxic for r in rows) <= 2
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out.collect())
    # held-out labels are never read
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    check([(r.doc_id, round(r.score, 9)) for r in toxicity.op4(d, flipped).collect()], [(r.doc_id, round(r.score, 9)) for r in out.collect()])


def test_toxicity_edges(spark, edge, none):
    labels = spark.createDataFrame([(4, 1), (99, 0)], "doc_id long, toxic int")
    assert toxicity.op4(edge, labels).count() == edge.count()
    assert toxicity.op4(none, labels).count() == 0
    assert {r.score for r in toxicity.op4(edge, labels.limit(0)).collect()} == {0.0}


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=500)
    knots, values = toxicity.isotonic(raw, (rng.random(500) < 1 / (1 + np.exp(-2 * raw))).astype(float))
    assert (np.diff(knots) > 0).all() and (np.diff(values) > 0).all()


# -- WARC ---------------------------------------------------------------------------------------------------------------

def test_warc_round_trip(spark, small, tmp_path):
    import base64

    rows = [(r.page_id, r.url, r.html) for r in small["pages"].collect()] + [(900, "http://x/", "same"), (901, None, "same"), (902, "http://x/\r\nInjected: 1", None), (903, "u", ""), (904, "u", "é\r\n\r\nWARC/1.1\r\n")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    at = str(tmp_path / "a")
    got = {r.page_id: tuple(r)[1:] for r in warc.op7(spark, p, at).collect()}
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(i, top.get(h or "", -1))
    want = {}
    for i, _, h in rows:
        b = (h or "").encode()
        t = top[h or ""]
        want[i] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if t == i else "revisit", None if t == i else t)
    assert got == want
    assert spark.read.parquet(f"{at}/payloads").count() == len(top)
    warc.export_warc(spark, at, str(tmp_path / "w"))
    found = {}
    for f in (tmp_path / "w").glob("part-*"):
        data, pos = f.read_bytes(), 0
        while pos < len(data):
            assert data.startswith(b"WARC/1.1\r\n", pos)
            end = data.index(b"\r\n\r\n", pos)
            head = dict(x.split(": ", 1) for x in data[pos + 10 : end].decode().split("\r\n"))
            n = int(head["Content-Length"])
            found[head["WARC-Record-ID"]] = (head["WARC-Type"], data[end + 4 : end + 4 + n])
            pos = end + 4 + n + 4
    assert found == {f"<urn:page:{i}>": (want[i][2], (h or "").encode() if want[i][2] == "response" else b"") for i, _, h in rows}


def test_warc_small_payloads_and_broken_store(spark, tmp_path):
    p = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    at = str(tmp_path / "a")
    warc.write_archive(p, at, least=4)
    assert {(r.page_id, r.record_type) for r in warc.read_archive(spark, at).collect()} == {(1, "response"), (2, "response"), (3, "revisit"), (4, "response")}
    spark.createDataFrame([("0" * 64, bytearray(b"zz"))], "address string, payload binary").write.mode("append").parquet(f"{at}/payloads")
    spark.createDataFrame([(bytearray(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:5>\r\nWARC-Payload-Digest: sha1:X\r\nContent-Length: 2\r\n"), "0" * 64)], "header binary, address string").write.mode("append").parquet(f"{at}/headers")
    with pytest.raises(Exception, match="address"):
        warc.read_archive(spark, at).collect()
    assert warc.op7(spark, p.limit(0), str(tmp_path / "e")).count() == 0


# -- PII ----------------------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"\D", "", m[0])
            double = [int(c) for c in d[::-1]]
            luhn = (sum(double[::2]) + sum(sum(divmod(2 * x, 10)) for x in double[1::2])) % 10 == 0
            if {"email": True, "ip": kind != "ip" or max(map(int, m[0].split("."))) <= 255, "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_pii_base_equals_the_patterns(small, edge, none):
    rng = random.Random(4)
    odd = ["".join(rng.choices("ab1234.@+- ()\n4111", k=60)) for _ in range(4000)] + ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "0001.002.3.255", "4111 1111 1111 1111", "+49 (30) 1234-567 ", "x@y", "@a.b", "é a.b@c-d.e-f.g."]
    for t in odd:
        assert pii.spans(t) == plain_spans(t), t
    d = small["documents"]
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.op8(d).collect()}
    for i, t in texts(d):
        s = plain_spans(t)
        assert got[i] == (*(sum(k == x for x, _, _ in s) for k in pii.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest())
    assert pii.op8(edge).count() == edge.count() and pii.op8(none).count() == 0


def test_pii_takes_linear_time():
    import time

    t = time.time()
    for x in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + " " * 400_000, "1 " * 200_000, "a@" * 200_000):
        pii.spans(x)
    assert time.time() - t < 20


def test_pii_disclosing_terms(spark):
    rows = [(i, f"yesterday Zorbalon wrote from zor@mail.example about work item{i}") for i in range(5)]
    rows += [(100 + i, f"yesterday someone wrote about work number{i} and more") for i in range(200)] + [(400, "Zorbalon alone")]
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    out = {r.doc_id: r for r in pii.op8(d).collect()}
    assert out[0].n_email == 1 and out[0].n_term >= 1 and out[100].n_term == 0
    kinds = [(s.split(":")[0], rows[0][1][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in out[0].spans.split(",")]
    assert ("email", "zor@mail.example") in kinds and ("term", "Zorbalon") in kinds and ("term", "yesterday") not in kinds
    clean = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert "zor@" not in clean[0] and "Zorbalon" not in clean[0] and clean[100] == rows[5][1]


def test_pii_terms_far_from_the_entity(spark, monkeypatch):
    """Terms are counted over whole documents and marked wherever they stand, also without the entity; both ways of marking agree."""
    far = " ".join(["plain words of no weight"] * 60)
    rows = [(i, f"Zorbalon {far} zor@mail.example {far} Zorbalon") for i in range(5)] + [(10, f"{far} zorbalon {far}"), (11, None)]
    rows += [(100 + i, far) for i in range(200)]
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    want = {i: [m.span() for m in re.finditer("zorbalon", (t or "").lower())] for i, t in rows}
    for bound in (pii.BROADCAST_TERMS, -1):
        monkeypatch.setattr(pii, "BROADCAST_TERMS", bound)
        out = {r.doc_id: r for r in pii.op8(d).collect()}
        assert len(out) == len(rows)
        for i in want:
            assert [tuple(map(int, s.split(":")[1:])) for s in out[i].spans.split(",") if s.startswith("term")] == want[i] and out[i].n_term == len(want[i])
    assert "zorbalon" not in " ".join((r.text or "").lower() for r in pii.sanitise(d).collect())


def test_pii_terms_with_combining_marks(spark):
    """Both sides of the counts take the same words, also of decomposed accents."""
    rows = [(i, "Jose\u0301phine writes from jo@mail.example") for i in range(4)] + [(100 + i, "nothing of weight writes from here") for i in range(200)]
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    got = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert "Jose" not in got[0] and "phine" not in got[0]


# -- chat ---------------------------------------------------------------------------------------------------------------

def test_chat_rotation(spark, small):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (None, 0, "x", "t"), (2, 0, "system", "s"), (3, None, None, "q")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.perspective): r for r in chat.dialogues(chat.rotate(c)).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "x"), (3, "unknown")}
    ann = got[1, "ann"]
    assert ann.dialogue == "<|im_start|>system\nbe nice<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n" + "<|im_start|>user name=bob\nyo<|im_end|>\n" * 2 + "<|im_start|>assistant\n<|im_end|>\n"
    assert [ann.dialogue[a:b] for a, b in ann.masks] == ["hi<|im_end|>\n", "<|im_end|>\n"]
    assert [got[1, "bob"].dialogue[a:b] for a, b in got[1, "bob"].masks] == ["yo<|im_end|>\n"] * 2
    many = spark.createDataFrame([(7, i, "ab"[i % 2], f"t{i}") for i in range(1000)], c.schema)
    for r in chat.dialogues(chat.rotate(many)).collect():
        assert [r.dialogue[a:b] for a, b in r.masks] == [f"t{i}<|im_end|>\n" for i in range(r.perspective == "b", 1000, 2)]
    assert chat.op9(c.limit(0)).count() == 0 and chat.op9(small["conversations"]).count() > 0


# -- substring dedup ----------------------------------------------------------------------------------------------------

def removed(rows):
    seen, out = set(), []
    for i, t in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        w = WORD.findall(t or "")
        cov = set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                cov |= set(range(k, k + 20))
            seen.add(g)
        out.append((i, len(w), len(cov), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in cov).encode()).hexdigest()))
    return out


def test_substring_equals_brute_force(spark, small, edge, none):
    d = small["documents"]
    check(substring.op10(d).collect(), removed(texts(d)))
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 90)))) for i in range(80)]
    r = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    check(substring.op10(r).collect(), removed(rows))
    some = edge.where("doc_id is not null")
    check(set(substring.op10(some).collect()), removed(texts(some)))
    assert substring.op10(edge).count() == edge.count() and substring.op10(none).count() == 0


def test_substring_automaton(spark):
    rng = random.Random(3)
    ref = [[rng.choice([b"a", b"b", b"c"]) for _ in range(60)] for _ in range(3)]
    a = substring.Automaton([w for k, r in enumerate(ref) for w in [*r, b"\n%d" % k]])
    doc = [rng.choice([b"a", b"b", b"c"]) for _ in range(80)]
    for end, n in enumerate(a.matching(doc)):
        inside = lambda k: any(doc[end + 1 - k : end + 1] == r[i : i + k] for r in ref for i in range(len(r) - k + 1))  # noqa: B023, E731
        assert inside(n) and (end + 1 - n <= 0 or not inside(n + 1))
    known = " ".join(f"k{i}" for i in range(30))
    d = spark.createDataFrame([(1, f"a {known} b"), (2, None), (3, "k1 k2")], "doc_id long, text string")
    assert {r.doc_id: (r.text, r.n_removed) for r in substring.remove_known(d, [known]).collect()} == {1: ("a b", 30), 2: ("", 0), 3: ("k1 k2", 0)}


@pytest.mark.parametrize("bound", [30, 200_000])
def test_substring_known_over_shards(spark, edge, none, monkeypatch, bound):
    """A reference of many shards, also with texts longer than one, against brute force."""
    monkeypatch.setattr(substring, "SHARD_WORDS", bound)
    rng, size = random.Random(12), 5
    reference = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 70))) for _ in range(4)] + ["", "\t\n"]
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(60, None), (None, reference[0])]
    known = {tuple(w[i : i + size]) for w in map(str.split, reference) for i in range(len(w) - size + 1)}
    want = []
    for i, t in rows:
        w = (t or "").split()
        gone = {j for k in range(len(w) - size + 1) if tuple(w[k : k + size]) in known for j in range(k, k + size)}
        want.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(gone)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    check(substring.remove_known(d, reference, size).collect(), want)
    assert substring.remove_known(edge, reference, size).count() == edge.count() and substring.remove_known(none, reference).count() == 0
    assert substring.remove_known(d, [], size).count() == len(rows)


def test_substring_by_shuffle(small, monkeypatch):
    want = substring.op10(small["documents"]).collect()
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    check(substring.op10(small["documents"]).collect(), want)


def test_words_and_hashes_of_arrow_texts():
    """Slices, nulls, empty texts, other blanks, long words; equal words have equal hashes, other words others."""
    import pyarrow as pa

    from scriptorium.llm import wordhash as H

    rng = random.Random(13)
    said = ["".join(rng.choice(["a", "B", "é", "\u00a0", "\x1c", " ", "\t", "\x0b", "\r\n", "", "x" * 300]) for _ in range(rng.randrange(0, 40))) for _ in range(300)] + [None, "", " "]
    rng.shuffle(said)
    for lower in (False, True):
        for column in (pa.array(said), pa.array(said).slice(7, 200)):
            names, rows = {}, column.to_pylist()
            for k, to, w in H.steps(column, lower):
                for i in range(k, to):
                    b = (rows[i] or "").encode()
                    b = (b.lower() if lower else b).split()
                    h = w.h[w.first[i - k] : w.first[i - k + 1]].tolist()
                    assert len(h) == len(b) and all(names.setdefault(x, y) == y for x, y in zip(b, h, strict=True))
            assert len(set(names.values())) == len(names)


# -- callers' columns, long texts, ties --------------------------------------------------------------------------------

NAMES = "__gone __d __h __n __runs __t __ws __lines kept n_words cleaned lost_chars spans row th gone starts items n_items n_gone a b s rid root key digest n place h h2 line keys wanted marks __id".split()


@pytest.mark.parametrize("stage", ["quality", "lines", "near", "decontam", "pii"])
def test_stages_give_back_columns_of_any_name(spark, stage):
    said = "Some plain words that make a sentence which is long enough to stay here. "
    rows = [(1, said + "\nIt is one more line of text."), (2, "It is one more line of text.\n" + said * 2), (3, said + "one two three four five six seven eight nine. mail jo@mail.example now."), (4, None), (None, said)]
    extra = {c: [f"{c} {k}" for k in range(len(rows))] for c in NAMES + ["a.b", "x y"]}
    d = spark.createDataFrame([(i, t, "en", "s", 5, *(extra[c][k] for c in extra)) for k, (i, t) in enumerate(rows)], DOCS + "".join(f", `{c}` string" for c in extra))
    b = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    run = {"quality": quality.clean_documents, "lines": lambda x: line_dedup.dedup_lines(x, drop_emptied=True), "near": minhash.drop_near_duplicates, "decontam": lambda x: decontam.clean_documents(x, b), "pii": pii.sanitise}[stage]
    out = run(d)
    assert out.columns == d.columns
    got = out.collect()
    assert got
    for r in got:
        k = [i for i, _ in rows].index(r.doc_id)
        assert all(r[c] == extra[c][k] for c in extra)
    plain = Counter((r.doc_id, r.text, r.n_chars) for r in run(d.select("doc_id", "text", "lang", "source", "n_chars")).collect())
    assert Counter((r.doc_id, r.text, r.n_chars) for r in got) == plain


def test_long_texts_take_linear_time(spark):
    import time

    many = 300_000
    d = spark.createDataFrame([(1, "\n".join(["an equal line"] * many)), (2, "\n".join(f"line number {k} of many" for k in range(many)))], "doc_id long, text string").repartition(2)
    passage = "one two three four five six seven eight nine ten"
    leaked = spark.createDataFrame([(1, " and then ".join([passage] * 30_000)), (2, passage)], "doc_id long, text string")
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    t = time.time()
    assert {r.doc_id: r.n for r in line_dedup.dedup_lines(d).select("doc_id", F.length("text").alias("n")).collect()} == {1: 13, 2: sum(len(f"line number {k} of many") + 1 for k in range(many)) - 1}
    assert {r.doc_id: r.text for r in decontam.clean_documents(leaked, b).collect()} == {1: " and then ".join(["\n"] * 30_000), 2: "\n"}
    assert time.time() - t < 120


def test_cut_runs_equal_brute_force(spark):
    """Windows of several lengths that overlap, touch and stand apart, from items of 1 to 12 words."""
    rng = random.Random(15)
    items = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.choice([2, 3, 5, 8, 12])))) for k in range(40)]
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    token = lambda t: t.split()
    grams = {tuple(token(t)[i : i + 8]) for _, t in items for i in range(max(1, len(token(t)) - 7))}
    want = {}
    for i, t in rows:
        w = token(t)
        hit = {j for k in {len(g) for g in grams} for a in range(len(w) - k + 1) if tuple(w[a : a + k]) in grams for j in range(a, a + k)}
        parts = ["\n" if k in hit else x for k, x in enumerate(w) if k not in hit or k - 1 not in hit]
        want[i] = " ".join(parts)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.text for r in decontam.clean_documents(d, b, min_items=1000).collect()}
    assert got == want


def test_rows_of_one_id_with_different_texts(spark):
    """Each row is linked by its own text; copies of each go, and only they."""
    rng = random.Random(16)
    a, b, c = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(60)) for k in "abc")
    rows = [(5, a), (5, b), (5, b), (6, a + " more"), (7, b), (3, b), (8, c), (None, a)]
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.op5(d).collect())
    assert got == Counter({(5, 57, 5, True): 1, (5, 57, 3, False): 2, (6, 58, 5, False): 1, (7, 57, 3, False): 1, (3, 57, 3, True): 1, (8, 57, 8, True): 1, (None, 57, None, True): 1})
    assert Counter(texts(minhash.drop_near_duplicates(d))) == Counter([(5, a), (3, b), (8, c), (None, a)])


def test_minhash_bucket_with_a_large_component(spark, monkeypatch):
    """A bucket of one large component and others: the large one's members meet only the others, and no link is lost."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(17)
    base = [f"t{k}" for k in range(100)]
    rows = [(i, " ".join(base[:-1] + [f"u{i}"])) for i in range(50)]
    for i in range(50, 90):
        w = list(base)
        for _ in range(rng.choice([4, 5, 6])):
            w[rng.randrange(len(w))] = f"m{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.op5(d).collect()} == components(rows)


def test_packing_of_one_document_repeated(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 50)
    d = spark.createDataFrame([(1, "the same row again")], "doc_id long, text string").crossJoin(spark.range(2000)).select("doc_id", "text")
    rows = packing.op3(d).collect()
    spots = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert len(rows) == 2000 and len({x[:2] for x in spots}) == 2000
    full = Counter()
    for s, o, n in spots:
        assert o == full[s]
        full[s] += n
    assert max(full.values()) <= 1024


def test_toxicity_of_conflicting_rows(spark):
    """The model doesn't depend on the order of rows: of conflicting labels the larger counts, of texts that with the least hash."""
    rng = random.Random(18)
    d = [(i, " ".join(rng.choice(["you", "are", "vile"] if i % 2 else ["the", "day", "goes"]) for _ in range(12))) for i in range(200)]
    d += [(i, "another text " + t) for i, t in d[:50]]
    labels = [(i, i % 2) for i in range(200)] + [(i, 1 - i % 2) for i in range(0, 60)]
    found = []
    for seed in (1, 2):
        random.Random(seed).shuffle(d)
        random.Random(seed).shuffle(labels)
        out = toxicity.op4(spark.createDataFrame(d, "doc_id long, text string").repartition(seed), spark.createDataFrame(labels, "doc_id long, toxic int").repartition(3 - seed))
        found.append(Counter((r.doc_id, round(r.score, 9)) for r in out.collect()))
    assert found[0] == found[1]


def test_chat_null_conversation_is_not_conversation_zero(spark):
    c = spark.createDataFrame([(None, 0, "a", "x"), (0, 0, "b", "y")], "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.perspective, r.name) for r in chat.op9(c).collect()} == {(None, "a", "a"), (0, "b", "b")}


def weighed(rows):
    """pii.disclosing by brute force: pairs of what is protected and term, with bits."""
    from math import log2, sqrt

    held, df = [], Counter()
    for t in rows:
        s = plain_spans(t)
        df.update(set(pii.vocabulary(t, s)))
        if s:
            said = {(k, t[a:b].lower()) for k, a, b in s}
            e = {f"{k}:{x}" for k, x in said} | {"email:@" + x.split("@")[1] for k, x in said if k == "email"}
            names = {w for k, x in said if k == "email" for w in re.findall("[a-z]{3,}", x.split("@")[0])}
            held.append((t, {k for k, _ in said}, e, pii.vocabulary(t, s), names))
    total, out = len(rows), {}
    distinct = list({h[0]: h for h in held}.values())
    for t, n_t in df.items():
        mine = [h for h in held if t in h[3]]
        for e in {e for h in mine for e in h[2]}:
            n_e, n = sum(e in h[2] for h in held), sum(e in h[2] for h in mine)
            if n >= 3 and n / n_t >= 0.5 and log2(n / n_t / (n_e / total)) >= 4:
                out[e, t] = log2(n / n_t / (n_e / total))
        if (n := sum(t in h[4] for h in mine)) and n / n_t >= 0.5:
            out["name:" + t, t] = log2(n / n_t * total / n)
        for k in ("any", *pii.KINDS):
            n = sum(t in h[3] and (k == "any" or k in h[1]) for h in distinct)
            p = n / n_t
            low = (p + 4.5 / n_t - 3 * sqrt(p * (1 - p) / n_t + 2.25 / n_t**2)) / (1 + 9 / n_t)
            share = max(1, sum(k == "any" or k in h[1] for h in held)) / total
            if n and low >= 0.5 and log2(low / share) >= 3:
                out[k, t] = log2(low / share)
    return out


def test_pii_information_equals_brute_force(spark):
    rng = random.Random(19)
    rows = []
    for i in range(2000):
        w = [rng.choice(["plain", "words", "of", "every", "day", "talk"]) for _ in range(12)]
        if rng.random() < 0.05:
            who = rng.choice(["jane", "omar", "lin"])
            w[3] = f"{who}.x{rng.randrange(3)}@{rng.choice(['mail.example', 'post.example'])}"
            w[5] = who if rng.random() < 0.7 else "someone"
            w[7:9] = ["token", f"{rng.randrange(16**40):040x}"] if rng.random() < 0.6 else ["a", "b"]
            w[1] = "secretary" if rng.random() < 0.5 else "clerk"
        elif rng.random() < 0.02:
            w[2] = f"+1 (990) 555-{rng.randrange(1000, 9999)}"
            w[4] = "desk"
        elif rng.random() < 0.005:
            w[6] = rng.choice(["secretary", "jane", "token", "7663683147833391"])
        rows.append(" ".join(w))
    rows += [rows[0]] * 3 + [r for r in rows if "token" in r][:1] * 4
    d = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("th"), "text")
    got = {(r.e, r.t): r.bits for r in pii.disclosing(d).collect()}
    want = weighed(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {("any", "token"), ("any", "#hex40"), ("name:jane", "jane")} <= got.keys()
    clean = [r.text for r in pii.sanitise(d).collect()]
    assert not any(re.search(r"token|[0-9a-f]{40}|\bjane\b", t) for t in clean) and any("<hex40>" in t for t in clean)


# -- registration and the pipeline --------------------------------------------------------------------------------------

def test_every_operator_is_registered_and_runs(spark):
    spec = importlib.util.find_spec("__spark_entry__")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in entry.queries())] == []
    for name in set(queries.QUERIES) - {"op4_toxicity"}:
        assert entry.queries()[name](spark, SMALL).count() > 0, name


def test_pipeline_equals_its_stages_by_hand(spark, small):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near duplicates", "decontamination", "packing"]
    d = small["documents"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = corpus_pipeline.stored(stage(spark, d, SMALL), "stage")
        assert d.columns == small["documents"].columns
    kept = texts(d)
    first = {r.doc_id for r in quality.op2(small["documents"]).where("kept").collect()}
    assert {i for i, _ in kept} <= first and kept
    items = [(r.item_id, r.text) for r in small["benchmark"].collect()]
    assert not any(n for _, _, _, n, _, _ in brute_hits(kept, items))
    assert all(k for _, _, k in components(kept, 5).values())
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert max(placed(rows, kept).values()) <= 1024
