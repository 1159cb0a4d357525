"""Benchmark decontamination: every window of every item against every document.

A window is 8 consecutive words of an item; an item of fewer words, but not none, is one window.
Native DataFrame functions only: window hashes are exploded inside one codegen stage and probed
against the hash table of benchmark windows; only hits, verified word by word, are shuffled.

Broadcast rule: the windows are counted first. Up to BROADCAST_WINDOWS they are broadcast (below 256 bytes each);
beyond it windows are shuffled as hashes, where AQE splits hot ones, and what is met is verified on the texts of its documents.

Defined cases: null text or item has no words; repeated document rows get equal results each;
empty tables give no hits; repeated items count once per item_id; null item_id is not counted as an item; extra columns come back
as they are from clean_documents, whatever their names; hits are merged and cut out in time linear in text and hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bound, meet, packed, stored, unpacked, word_hashes

SIZE = 8
BROADCAST_WINDOWS = 500_000
SEPARATORS = "".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))
SEPARATOR_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    t = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(SEPARATORS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SEPARATOR_RUN))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, w (the window's words), h (its hash, led by its length)."""
    b = benchmark.select(F.col("item_id"), words(F.col("text")).alias("ws")).withColumn("n", F.size("ws")).where("n > 0 and item_id is not null")
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - F.lit(SIZE - 1), F.lit(1)))
    b = b.select("item_id", "ws", F.explode(starts).alias("i")).select("item_id", F.slice("ws", F.col("i"), F.lit(SIZE)).alias("w"))
    b = b.withColumn("h0", word_hashes(F.col("w")))
    lengths = range(1, SIZE + 1)
    h = F.coalesce(*[F.when(F.size("w") == k, F.xxhash64(F.lit(k), *[F.get(F.col("h0"), F.lit(j)) for j in range(k)])) for k in lengths])
    return b.select("item_id", "w", h.alias("h"))


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), starts (array of struct(s, l)), items (item_ids with an occurring window)."""
    windows = benchmark_windows(benchmark).distinct()
    facts = windows.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.size("w")).alias("l")).first()  # one row, at most 8 lengths
    lengths = sorted(facts["l"], reverse=True) or [SIZE]
    small = facts["n"] <= BROADCAST_WINDOWS

    n = F.col("n")
    d = docs.select("doc_id", F.xxhash64(text).alias("th"), words(F.col(text)).alias("ws"))
    d = d.select("doc_id", "th", "ws", F.size("ws").alias("n"), word_hashes(F.col("ws")).alias("wh"))
    hash_at = lambda i, k: F.get(F.col("wh"), i + F.lit(k))

    def hashes(k):
        each = F.transform(F.sequence(F.lit(0), n - F.lit(k)), lambda i: F.xxhash64(F.lit(k), *[hash_at(i, j) for j in range(k)]))
        return F.when(n >= k, each).otherwise(F.array().cast("array<bigint>"))

    all_hashes = F.concat(*[hashes(k) for k in lengths]) if len(lengths) > 1 else hashes(lengths[0])
    # beyond the broadcast bound windows are shuffled, and then without the words of their document
    words_too = ["ws"] if small else []
    d = d.select("doc_id", "th", *words_too, "n", all_hashes.alias("hs"))
    # outer: else the optimizer derives a filter on the array and pushes it, with all that it holds, below the word split
    d = d.select("doc_id", "th", *words_too, "n", F.posexplode_outer("hs").alias("p", "h"))
    grams = windows.groupBy("h", "w").agg(F.collect_set("item_id").alias("ids"))

    def start(size):
        base, out = F.lit(0), F.lit(None).cast("int")
        for k in lengths:
            out = F.when((size == k) & out.isNull(), F.col("p") - base).otherwise(out)
            base = base + F.greatest(n - F.lit(k - 1), F.lit(0))
        return out

    at = lambda s, size: F.struct(s.alias("s"), size.alias("l")).alias("at")
    if small:
        s = start(F.size("w"))
        hits = d.join(F.broadcast(grams), "h").where(F.slice("ws", s + F.lit(1), F.size("w")) == F.col("w"))
        hits = hits.select("doc_id", "th", at(s, F.size("w")), "ids")
    else:
        met = d.join(grams.select("h", F.size("w").alias("l")).distinct(), "h").groupBy("doc_id", "th").agg(F.collect_set(F.struct(start(F.col("l")).alias("s"), "l", "h")).alias("x"))
        c = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a.th") == F.col("b.th")]
        texts = docs.select("doc_id", F.xxhash64(text).alias("th"), F.col(text).alias("text"))
        read = texts.alias("a").join(met.alias("b"), c).select("a.doc_id", "a.th", "x", words(F.col("a.text")).alias("ws"))
        spots = read.select("doc_id", "th", F.explode_outer(F.transform("x", lambda x: F.struct(x["s"].alias("s"), x["h"].alias("h"), F.slice(F.col("ws"), x["s"] + F.lit(1), x["l"]).alias("w")))).alias("x"))
        hits = spots.select("doc_id", "th", "x.*").join(grams, ["h", "w"]).select("doc_id", "th", at(F.col("s"), F.size("w")), "ids")
    found = hits.groupBy("doc_id", "th").agg(F.collect_set("at").alias("starts"), F.collect_set("ids").alias("ids"))
    return found.select("doc_id", "th", F.sort_array("starts").alias("starts"), F.array_distinct(F.flatten("ids")).alias("items"))


def hit_words(starts: Column) -> Column:
    zero = F.struct(F.lit(0).alias("e"), F.lit(0).cast("bigint").alias("t"))

    def step(a, x):
        end = x["s"] + x["l"]
        return F.struct(F.greatest(a["e"], end).alias("e"), (a["t"] + F.greatest(end - F.greatest(x["s"], a["e"]), F.lit(0))).cast("bigint").alias("t"))

    return F.coalesce(F.aggregate(starts, zero, step, lambda a: a["t"]), F.lit(0).cast("bigint"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 2) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, starts, th."""
    hits = find_hits(docs, benchmark)
    a = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    k = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a.th") == F.col("b.th")]
    ids = F.sort_array(F.transform(F.coalesce("b.items", F.array().cast("array<bigint>")), lambda x: x.cast("string")))
    out = a.alias("a").join(hits.alias("b"), k, "left").select("a.doc_id", "a.th", "n_words", hit_words(F.col("b.starts")).alias("n_hit"), ids.alias("ids"), "b.starts")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.size("ids") >= min_items).alias("contaminated"), "starts", "th"
    )


def _merged(starts: Column) -> Column:
    """Ascending runs (s, e) of the words covered by starts: (s, l) ascending, l at most SIZE. Runs that touch are one.

    Of each start the longest window counts. No window reaches beyond the SIZE - 1 starts after its own, so each is compared with so many.
    """
    last = F.filter(starts, lambda x, i: F.coalesce(F.get(starts, i + F.lit(1))["s"] != x["s"], F.lit(True)))

    def runs(x):
        end = lambda k: F.coalesce(F.get(x, k)["s"] + F.get(x, k)["l"], F.lit(-1))
        upto = lambda k: F.greatest(*[end(k - F.lit(j)) for j in range(1, SIZE)])  # noqa: E731  (the furthest end before k)
        first = F.filter(F.sequence(F.lit(0), F.size(x) - F.lit(1)), lambda k: F.get(x, k)["s"] > upto(k))
        run = lambda f, k, i: F.struct(F.get(x, k)["s"].alias("s"), upto(F.coalesce(F.get(f, i + F.lit(1)), F.size(x))).alias("e"))
        return bound(first, lambda f: F.transform(f, lambda k, i: run(f, k, i)))

    return bound(last, runs)


def without_words(text: Column, runs: Column) -> Column:
    """text without the words in runs; each run's first word becomes a line end, which no window crosses unseen."""
    pieces = F.regexp_extract_all(text, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)

    def rest(p, runs):
        # words and separators take turns: word k is piece 2 k + 1, counted from 1, or one more where a separator comes first
        shift = F.when(F.get(p, F.lit(0)).rlike(r"^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.lit(1)).otherwise(F.lit(2))

        def part(k):
            start = F.when(k == 0, F.lit(1)).otherwise(F.get(runs, k - F.lit(1))["e"] * 2 - F.lit(1) + shift)
            stop = F.coalesce(F.get(runs, k)["s"] * 2 + shift, F.size(p) + F.lit(1))
            return F.concat(F.slice(p, start, stop - start), F.when(k < F.size(runs), F.array(F.lit("\n"))).otherwise(F.array().cast("array<string>")))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), part)), "")

    return bound(F.struct(pieces.alias("p"), runs.alias("r")), lambda x: rest(x["p"], x["r"]))


def clean_documents(docs: DataFrame, benchmark: DataFrame, min_items: int = 2) -> DataFrame:
    """docs without documents in which min_items items or more occur, and without the words of occurring windows in the others; the columns of docs."""
    hits = stored(find_hits(docs, benchmark).select("doc_id", "th", "starts", F.size("items").alias("n_items")), "hits")
    j = meet(packed(docs), hits, "left", F.lit(80) + F.size("starts") * 32).where(F.coalesce("n_items", F.lit(0)) < min_items)
    text = F.when(F.col("starts").isNotNull(), without_words(F.col("text"), _merged(F.col("starts")))).otherwise(F.col("text"))
    j = j.select("row", text.alias("text"))
    return unpacked(j, docs.columns, {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")})


def op6(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
