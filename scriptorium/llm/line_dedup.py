"""Line dedup by a deletion-neighbourhood join. Native DataFrame functions only.

A line's symbols are its words if it has MIN_WORDS or more, else its characters if it has MIN_CHARS or more (words joined by one
space). Lines with symbols of one kind are equal within one edit: a symbol inserted, deleted or replaced. Among characters a digit
is no edit, as numbers tell apart lines that are equal otherwise (`chapter 1`, `chapter 2`). Shorter lines are equal when their words are.
A line that has such an earlier line (smaller doc_id, then line number) goes; the earliest stays. Blank lines stay.

1. Lines become hashes: only hashes are shuffled. Equal lines are one from here on (partially aggregated minimum).
2. One edit leaves the first or the last symbols of a line whole: only lines that share their first or last P symbols with another line
   (P: the power of two from a quarter to half of their symbols) are candidates, and only their texts are read again.
3. Each candidate emits its variants as hashed keys: the line itself and the line without one word (an insertion or deletion
   makes one line's variant the other line), and the line without word i under i (a replacement makes those equal).
   Words that the shared beginning or end rules out as the edit are not deleted.
   Pairs whose longer line has over BLOCKED words go by blocks, as n variants of n words are too many: a line is cut at each of about
   sqrt(n) blocks of sqrt(n) words, and only blocks outside which it equals another line emit variants, of the block's words alone.
4. Keys are counted; those met once go. Of lines with equal variants the earliest is kept, by an aggregation by key: no pairs
   within a group, so a variant that thousands of lines share costs thousands of rows.
5. Each line and the earlier one found for it are compared symbol by symbol before anything is removed. (Lines are merged as equal by 96 bits.)

Defined cases: null text is empty, has one blank line, and comes back null; repeated rows (same id and text) are one document
and get equal results; rows of one id with other texts are in the order of the texts' hashes; empty tables give no rows; extra
columns come back as they are, whatever their names; a text of any number of lines is cut in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RUN, BLANKS, bound, meet, packed, stored, unpacked

MIN_WORDS, MIN_CHARS = 8, 20
#: Stand for the end of a character and for the space between words where symbols are characters (fixed values).
END, SPACE = "\x1f", "\x1e"
DIGIT = f"^\\p{{N}}{END}$"
#: Pairs whose longer line has more words are compared by blocks. Both ways are exact; this is a matter of speed.
BLOCKED = 512


def _plain(line: Column, odd: Column) -> Column:
    """The line's words joined by single spaces. odd: whether the text has other blanks or two in a row."""
    t = F.btrim(line, F.lit(BLANKS))
    return F.when(odd, F.regexp_replace(t, BLANK_RUN, " ")).otherwise(t)


def _odd(text: Column) -> Column:
    out = F.lit(False)
    for s in ("  ", "\t", "\x0b", "\x0c", "\r"):
        out = out | F.contains(text, F.lit(s))
    return out


def _symbols(plain: Column) -> Column:
    """The symbols joined by single spaces; null for lines that are compared whole."""
    chars = F.rtrim(F.regexp_replace(F.translate(plain, " ", SPACE), "(?s)(.)", f"$1{END} "))
    return F.when(_n_words(plain) >= MIN_WORDS, plain).when(F.length(plain) >= MIN_CHARS, chars)


def _n_words(plain: Column) -> Column:
    return F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit(" "), F.lit(""))) + F.lit(1)


def _first(text: Column, n: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(" "), n.cast("int"))


def _p(n: Column) -> Column:
    """The power of two from a quarter to half of n."""
    return F.call_function("shiftleft", F.lit(1), (F.floor(F.log2(n.cast("double")) + F.lit(1e-9)) - F.lit(1)).cast("int"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Lines with a word, as hashes: doc_id, th, i (line number), h, h2 (96 bits name a line) and the keys of their ends.

    A line of 2^k symbols has keys of both sizes, as a line of one symbol less has the smaller.
    """
    # two steps: in one, what stands beside the generator is computed for each line, from the whole text
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), _odd(F.col("text")).alias("odd"), F.split("text", "\n").alias("raw"))
    d = d.select("doc_id", "th", "odd", F.posexplode_outer("raw").alias("i", "raw"))
    d = d.select("doc_id", "th", "i", _plain(F.col("raw"), F.col("odd")).alias("plain")).where("plain != ''").withColumn("line", _symbols(F.col("plain")))
    d = d.withColumn("n", _n_words(F.col("line")))
    d = d.withColumn("p", _p(F.col("n")))
    ends = lambda p: [F.xxhash64(F.lit(1), p, _first(F.col("line"), p)), F.xxhash64(F.lit(2), p, _first(F.col("line"), -p))]
    small = F.floor(F.col("p") / 2).cast("int")
    both = (F.col("n") == F.col("p") * 2) & (F.col("n") > MIN_WORDS)
    keys = F.when(F.col("p").isNull(), F.lit(None).cast("array<bigint>")).when(both, F.array(*ends(F.col("p")), *ends(small))).otherwise(F.array(*ends(F.col("p"))))
    return d.select("doc_id", "th", "i", F.xxhash64("plain").alias("h"), F.hash("plain").alias("h2"), keys.alias("keys"))


def _candidates(docs: DataFrame, keyed: DataFrame, kinds: DataFrame) -> DataFrame:
    """place, h, h2, line, n (words), lo, hi (the words that may be deleted) of the lines that share an end with another line."""
    ends = keyed.where("keys is not null").select("h", "h2", F.posexplode_outer("keys").alias("e", "k"))
    shared = ends.groupBy("k").agg(F.min("h2").alias("a"), F.max("h2").alias("b")).where("a != b").select("k")
    shared = stored(shared, "shared")  # a table of its own, so that the join can split a hot end
    close = ends.join(shared, "k").groupBy("h", "h2").agg(F.max(F.col("e") % 2 == 0).alias("first"), F.max(F.col("e") % 2 == 1).alias("last"))
    close = stored(close.join(kinds, ["h", "h2"]), "close")
    where = stored(close.groupBy("place.doc_id", "place.th").agg(F.collect_list(F.struct("place.i", "h", "h2", "first", "last")).alias("at")), "where")
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    read = meet(texts, where, "inner", F.lit(64) + F.size("at") * 64).select("doc_id", "th", "at", F.split("text", "\n").alias("raw"))
    read = read.select("doc_id", "th", F.explode_outer(F.transform("at", lambda x: F.struct(x.alias("at"), F.get(F.col("raw"), x["i"]).alias("raw")))).alias("x"))
    x, raw = "x.at.", F.col("x.raw")
    lines = read.select(F.struct("doc_id", "th", F.col(x + "i").alias("i")).alias("place"), x + "h", x + "h2", x + "first", x + "last", _symbols(_plain(raw, F.lit(True))).alias("line")).withColumn("n", _n_words(F.col("line")))
    n = F.col("n")
    p = F.when((n == _p(n) * 2) & (n > MIN_WORDS), F.floor(_p(n) / 2).cast("int")).otherwise(_p(n))
    lines = lines.select("place", "h", "h2", "line", "n", F.when(F.col("last"), F.lit(1)).otherwise(p + F.lit(1)).alias("lo"), F.when(F.col("first"), n).otherwise(n - p).alias("hi"))
    return stored(lines, "candidates")


def _blocks(lines: DataFrame) -> DataFrame:
    """h, h2, out, line, n, longer: the blocks outside which lines equal another line, for pairs whose longer line has m > BLOCKED words.

    m is a line's own number of words (longer) or one more. Word i of the longer line is in block (i - 1) / w; outside of it are the
    words before and those after, as many for the other line. out is their hash, line the words between, n their number.
    """
    n = F.col("n")

    def cuts(m):
        w = F.ceil(F.sqrt(m.cast("double"))).cast("int")
        block = lambda i: F.floor((i - F.lit(1)) / w).cast("int")

        def cut(j):
            before, after = (j * w).cast("int"), F.greatest(m - (j + F.lit(1)) * w, F.lit(0)).cast("int")
            return F.struct((m == n).alias("longer"), before.alias("before"), after.alias("after"), F.xxhash64(m, j, _first(F.col("line"), before), _first(F.col("line"), -after)).alias("out"))

        return F.transform(F.sequence(block(F.col("lo")), block(F.col("hi") + m - n)), cut)

    sizes = F.filter(F.array(n, n + F.lit(1)), lambda m: m > BLOCKED)
    cut = lines.where(n >= BLOCKED).select("h", "h2", F.flatten(F.transform(sizes, cuts)).alias("cuts"))
    cut = stored(cut.select("h", "h2", F.explode_outer("cuts").alias("x")).select("h", "h2", "x.*"), "blocks")
    shared = cut.groupBy("out").agg(F.min("h2").alias("a"), F.max("h2").alias("b")).where("a != b").select("out")
    shared = stored(shared, "shared-blocks")
    of = cut.join(shared, "out").groupBy("h", "h2").agg(F.collect_set(F.struct("longer", "before", "after", "out")).alias("cuts"))

    def between(x):
        size = (n - x["before"] - x["after"]).cast("int")
        return F.struct(x["out"].alias("out"), _first(_first(F.col("line"), x["before"] + size), -size).alias("line"), size.alias("n"), x["longer"].alias("longer"))

    found = lines.join(of, ["h", "h2"]).select("h", "h2", F.transform("cuts", between).alias("x"))
    return found.select("h", "h2", F.explode_outer("x").alias("x")).select("h", "h2", "x.*")


def _variants(lines: DataFrame, own: Column, less: Column) -> DataFrame:
    """h, h2, kind, key: hashes of `line` with `out` (null: none), where own, and without each word from lo to hi, where less."""

    def without(i):
        return F.trim(F.concat(_first(F.col("line"), i - F.lit(1)), F.lit(" "), _first(F.col("line"), i - F.col("n"))))

    places = F.sequence(F.col("lo"), F.col("hi"))
    edits = F.when(F.contains("line", F.lit(END)), F.filter(places, lambda i: ~_first(_first(F.col("line"), i), F.lit(-1)).rlike(DIGIT))).otherwise(places)
    cut = F.transform(edits, lambda i: F.struct(i.alias("i"), F.xxhash64("out", without(i)).alias("key")))
    v = lines.select("h", "h2", F.when(own, F.xxhash64("out", "line")).alias("own"), F.when(less, cut).otherwise(F.array().cast("array<struct<i:int,key:bigint>>")).alias("less"))
    own = F.filter(F.array(F.struct(F.lit(0).alias("kind"), F.col("own").alias("key"))), lambda x: x["key"].isNotNull())
    # a line and its shorter variants share keys; replacements have keys of their own
    shorter = F.array_distinct(F.transform("less", lambda x: F.struct(F.lit(1).alias("kind"), x["key"].alias("key"))))
    swap = F.transform("less", lambda x: F.struct(F.lit(2).alias("kind"), F.xxhash64(x["key"], x["i"]).alias("key")))
    return v.select("h", "h2", F.explode_outer(F.concat(own, shorter, swap)).alias("x")).select("h", "h2", F.col("x.kind").cast("byte").alias("kind"), "x.key")


def _similar(lines: DataFrame) -> DataFrame:
    """h, h2 of the lines that have an earlier line within one edit."""
    whole = lines.where(F.col("n") <= BLOCKED).withColumn("out", F.lit(None).cast("bigint"))
    blocks = _blocks(lines).withColumns({"lo": F.lit(1), "hi": F.greatest("n", F.lit(1))})
    v = _variants(whole, F.lit(True), F.lit(True)).union(_variants(blocks, ~F.col("longer"), F.col("longer")))
    v = stored(v, "variants")
    twice = v.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    met = v.join(twice, "key", "left_semi").join(lines.select("h", "h2", "place"), ["h", "h2"])
    met = stored(met.select("key", "kind", F.struct("place", "h", "h2").alias("line")), "met")
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("line")))
    least = met.groupBy("key").agg(of(0).alias("own"), of(1).alias("less"), of(2).alias("swap"))
    pairs = met.join(least, "key").select("line", F.when(F.col("kind") == 2, F.col("swap")).when(F.col("kind") == 0, F.col("less")).otherwise(F.col("own")).alias("other"))
    pairs = pairs.where(F.col("other.place") < F.col("line.place")).distinct()
    pairs = pairs.select(F.col("line.h").alias("h"), F.col("line.h2").alias("h2"), F.col("other.h").alias("oh"), F.col("other.h2").alias("oh2"))
    t = lines.select("h", "h2", F.split("line", " ").alias("w"))
    both = pairs.join(t, ["h", "h2"]).join(t.select(F.col("h").alias("oh"), F.col("h2").alias("oh2"), F.col("w").alias("ow")), ["oh", "oh2"])
    return both.where(within_one(F.col("w"), F.col("ow"))).select("h", "h2").distinct()


def _shared(x: Column, y: Column) -> Column:
    """How many symbols two arrays share in front."""
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    return bound(F.array_position(same, F.lit(False)), lambda at: F.when(at == 0, F.greatest(F.size(x), F.size(y)).cast("bigint")).otherwise(at - 1))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, th, gone: the line numbers that go, of documents that lose any (stored)."""
    keyed = stored(_keyed(docs), "lines")
    kinds = keyed.groupBy("h", "h2").agg(F.min(F.struct("doc_id", "th", "i")).alias("place"))
    similar = _similar(_candidates(docs, keyed, kinds)).withColumn("gone", F.lit(True))
    fate = stored(kinds.join(similar, ["h", "h2"], "left"), "fate")  # a table of its own, so that the join can split a hot line
    seen = keyed.select("doc_id", "th", "i", "h", "h2").join(fate, ["h", "h2"])
    gone = seen.where(F.coalesce("gone", F.lit(False)) | (F.struct("doc_id", "th", "i") != F.col("place")))
    return stored(gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("i")).alias("gone")), "gone")


def within_one(a: Column, b: Column) -> Column:
    """Whether two symbol arrays are at most one edit apart: what they share in front and behind covers all but one, which is no digit among characters."""
    front, longer = _shared(a, b), F.greatest(F.size(a), F.size(b))
    digit = lambda x, y: (F.size(x) >= F.size(y)) & F.coalesce(F.get(x, front.cast("int")).rlike(DIGIT), F.lit(False))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (front + _shared(F.reverse(a), F.reverse(b)) >= longer - 1) & ~digit(a, b) & ~digit(b, a)


def _joined(docs: DataFrame) -> DataFrame:
    """row, doc_id, th, text, kept, n_gone (null where no line goes)."""
    found = meet(packed(docs), repeats(docs), "left", F.lit(64) + F.size("gone") * 4)
    return found.select("row", "doc_id", "th", "text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("gone"))).alias("kept"), F.size("gone").alias("n_gone"))


def without_lines(text: Column, gone: Column) -> Column:
    """text without the lines whose numbers are in gone (ascending): the slices between them, so time is linear."""

    def rest(lines, gone):
        start = lambda k: F.when(k == 0, F.lit(1)).otherwise(F.get(gone, k - F.lit(1)) + F.lit(2))
        stop = lambda k: F.coalesce(F.get(gone, k), F.size(lines))
        parts = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(lines, start(k), stop(k) - start(k) + F.lit(1)))
        return F.array_join(F.flatten(parts), "\n")

    return bound(F.struct(F.split(text, "\n").alias("l"), gone.alias("g")), lambda x: rest(x["l"], x["g"]))


def dedup_lines(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """docs without repeated lines, n_chars brought up to date. All rows stay, but for drop_emptied those that lost all they said."""
    j = _joined(docs)
    if drop_emptied:
        j = j.where(F.col("n_gone").isNull() | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return unpacked(j, docs.columns, {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")})


def op1(docs: DataFrame) -> DataFrame:
    out = _joined(docs.select("doc_id", "text"))
    n = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("bigint")
    return out.select("doc_id", n.alias("n_lines"), F.coalesce("n_gone", F.lit(0)).cast("bigint").alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
