"""The inverted index as Parquet, and Q6-Q9 over it.

Postings carry the positions of a term in a passage and the passage's length, so ranking joins nothing. A passage is one row (its id is a
key): its postings are built within the row, no token is shuffled. Only Arabic words, whose stems come from a join, are gathered by passage.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import isri
from ..functions import text as T
from ..plans.query import Group

#: BM25 (fixed values) and the weight of each field.
K1, B, FLOOR = 1.2, 0.75, 1e-6
WEIGHT = {"norm": 2.0, "stems": 1.0}
#: Postings are dealt into this many directories by term, so that a query reads the directories of its terms.
BUCKETS = 64
#: Arabic letters, and the one beyond them that folds to a letter.
MAY_BE_ARABIC = "[ء-يٱ]"


def bucket(term: Column) -> Column:
    return F.crc32(term.cast("binary")) % BUCKETS


def _by_term(tokens: Column) -> Column:
    """(term, positions) of each distinct lower-case token, from one sort of the row's tokens."""

    def grouped(x):
        first = F.filter(F.sequence(F.lit(0), F.size(x) - F.lit(1)), lambda k: F.coalesce(F.get(x, k)["term"] != F.get(x, k - F.lit(1))["term"], F.lit(True)))

        def posting(f, k, i):
            stop = F.coalesce(F.get(f, i + F.lit(1)), F.size(x))
            return F.struct(F.get(x, k)["term"].alias("term"), F.transform(F.slice(x, k + F.lit(1), stop - k), lambda e: e["pos"]).alias("positions"))

        return F.transform(F.array(first), lambda f: F.transform(f, lambda k, i: posting(f, k, i)))[0]

    ordered = F.sort_array(F.transform(tokens, lambda w, i: F.struct(F.lower(w).alias("term"), i.alias("pos"))))
    none = F.array().cast("array<struct<term:string,positions:array<int>>>")
    return F.when(F.size(tokens) > 0, F.transform(F.array(ordered), grouped)[0]).otherwise(none)


def postings(passages: DataFrame, passage: str = "passage_id", text: str = "text", stem_words: bool = True) -> DataFrame:
    """(field, term, passage_id, positions, d): one row per field, term and passage; d is the passage's length in both fields.

    Arabic words are stemmed once per distinct word of the corpus and joined back; others are their own stem in lower case.
    """
    rows = passages.select(F.col(passage).alias("passage_id"), T.tokenize(F.col(text)).alias("tokens"))
    d = (F.size("tokens") * 2).cast("bigint").alias("d")
    norm = rows.select("passage_id", d, _by_term(F.col("tokens")).alias("x")).select("passage_id", "d", F.explode_outer("x").alias("x")).where("x is not null")
    # without Arabic letters the stem is the word in lower case: one posting serves both fields
    fields = F.when(F.col("x.term").rlike(T.ARABIC), F.array(F.lit("norm"))).otherwise(F.array(F.lit("norm"), F.lit("stems")))
    out = norm.select(F.explode(fields).alias("field"), "x.term", "passage_id", "x.positions", "d")
    if not stem_words:
        return out
    # only texts with such a letter (or one that folds to one) are tokenised again
    arabic = passages.where(F.col(text).rlike(MAY_BE_ARABIC)).select(F.col(passage).alias("passage_id"), T.tokenize(F.col(text)).alias("tokens"))
    arabic = arabic.select("passage_id", d, F.posexplode("tokens").alias("pos", "token")).where(F.col("token").rlike(T.ARABIC))
    stems = arabic.join(isri.stem_map(arabic, "token"), "token").groupBy("passage_id", F.col("stem").alias("term")).agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.max("d").alias("d"))
    return out.union(stems.select(F.lit("stems").alias("field"), "term", "passage_id", "positions", "d"))


def lengths(passages: DataFrame, passage: str = "passage_id", text: str = "text") -> DataFrame:
    """(passage_id, d): tokens in both fields together."""
    return passages.select(F.col(passage).alias("passage_id"), (F.size(T.tokenize(F.col(text))) * 2).cast("bigint").alias("d"))


def terms(posts: DataFrame) -> DataFrame:
    """(field, term, df, cf): passages with a term and its occurrences."""
    return posts.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("positions").cast("bigint")).alias("cf"))


class Index:
    """postings, lengths, terms and statistics (n passages, d average length) as DataFrames; from a folder, or lazily from passages."""

    def __init__(self, posts: DataFrame, sizes: DataFrame, dictionary: DataFrame, stats: DataFrame, stored: bool = False):
        self.postings, self.lengths, self.terms, self.stats, self.stored = posts, sizes, dictionary, stats, stored

    @classmethod
    def of(cls, passages: DataFrame, **names) -> Index:
        posts = postings(passages, **names)
        sizes = lengths(passages, **{k: v for k, v in names.items() if k != "stem_words"})
        return cls(posts, sizes, terms(posts), sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("d")))

    def write(self, path: str, parts: int | None = None) -> None:
        """parts: into how many the postings of a bucket are dealt, so that a frequent term is no single task; by default as many as
        shuffle partitions allow for."""
        spark = self.postings.sparkSession
        parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)
        p = self.postings.withColumn("bucket", bucket(F.col("term")))
        p = p.repartition(F.col("bucket"), F.pmod(F.xxhash64("passage_id"), F.lit(parts)))
        p.sortWithinPartitions("bucket", "field", "term", "passage_id").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        # from what is written: nothing is tokenised twice
        terms(spark.read.parquet(f"{path}/postings")).withColumn("bucket", bucket(F.col("term"))).repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.mode("overwrite").parquet(f"{path}/terms")
        sizes = spark.read.parquet(f"{path}/lengths")
        sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("d")).write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "terms", "stats")), stored=True)

    def of_terms(self, words: list[str]) -> DataFrame:
        p = self.postings.where(F.col("term").isin(words))
        if self.stored:
            p = p.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % BUCKETS for t in words})))
        return p


def _operands(groups: list[Group]) -> list[tuple[str, str]]:
    """(field, text) of all that has to be looked up; a text of several words is a phrase."""
    found = []
    for g in groups:
        found += [x for t in g.include + g.exclude for x in (("norm", t.norm), ("stems", t.stem))]
        found += [("norm", p) for p in g.phrases + g.neg_phrases]
    return list(dict.fromkeys(found))


def match(index: Index, groups: list[Group]) -> tuple[DataFrame, dict[tuple[str, str], Column]]:
    """Rows of passages with any operand (passage_id, d), and each operand's number of occurrences as a column."""
    ops = _operands(groups)
    words = list(dict.fromkeys((f, w) for f, text in ops for w in text.split(" ")))
    rows = index.of_terms(list(dict.fromkeys(w for _, w in words)))
    at = [F.max(F.when((F.col("field") == f) & (F.col("term") == w), F.col("positions"))).alias(f"p{k}") for k, (f, w) in enumerate(words)]
    rows = rows.groupBy("passage_id").agg(F.max("d").alias("d"), *at)
    column = {x: F.coalesce(F.col(f"p{k}"), F.array().cast("array<int>")) for k, x in enumerate(words)}

    def occurrences(f: str, text: str) -> Column:
        first, *rest = text.split(" ")
        places = column[f, first]
        for k, w in enumerate(rest, 1):
            places = F.array_intersect(places, _shifted(column[f, w], k))
        return F.size(places)

    rows = rows.select("passage_id", "d", *[occurrences(*x).alias(f"f{k}") for k, x in enumerate(ops)])
    return rows, {x: F.col(f"f{k}") for k, x in enumerate(ops)}


def _shifted(places: Column, k: int) -> Column:
    back = F.lit(k)
    return F.transform(places, lambda p: p - back)


def _both(count, terms) -> list[Column]:
    return [(count["norm", t.norm] > 0) | (count["stems", t.stem] > 0) for t in terms]


def _seen(index: Index, rows: DataFrame, count: dict[tuple[str, str], Column]) -> dict[tuple[str, str], int]:
    """Passages with each operand: words of a stored index from its dictionary, phrases from the rows at hand."""
    words = [x for x in count if " " not in x[1]] if index.stored else []
    found = dict.fromkeys(words, 0)
    if words:
        wanted = sorted({w for _, w in words})
        near = index.terms.where(F.col("bucket").isin(sorted({zlib.crc32(w.encode()) % BUCKETS for w in wanted})) & F.col("term").isin(wanted))
        found |= {x: r["df"] for r in near.collect() if (x := (r["field"], r["term"])) in found}
    if rest := [x for x in count if x not in found]:
        n = rows.agg(*[F.count_if(count[x] > 0).alias(f"n{k}") for k, x in enumerate(rest)]).first()
        found |= {x: n[f"n{k}"] for k, x in enumerate(rest)}
    return found


def search(index: Index, groups: list[Group]) -> DataFrame:
    """(passage_id, score) of the passages that a query matches; lower is better. Groups without positives are not used.

    Statistics are of the whole index, whatever is filtered afterwards. They are one row of numbers, gathered before the plan is built.
    """
    groups = [g for g in groups if g.positive]
    rows, count = match(index, groups)
    size, seen = index.stats.first(), _seen(index, rows, count)
    idf = {x: max(math.log((size["n"] - n + 0.5) / (n + 0.5)), FLOOR) for x, n in seen.items()}
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("d") / F.lit(float(size["d"] or 1.0)))

    def part(x):
        f = count[x] * F.lit(WEIGHT[x[0]])
        return F.lit(idf[x]) * (f * F.lit(K1 + 1) / (f + norm))

    scores, hits = [], []
    for g in groups:
        yes = _both(count, g.include) + [count["norm", p] > 0 for p in g.phrases]
        no = _both(count, g.exclude) + [count["norm", p] > 0 for p in g.neg_phrases]
        hit = reduce(lambda a, b: a & b, yes + [~x for x in no])
        used = [x for t in g.include for x in (("norm", t.norm), ("stems", t.stem))] + [("norm", p) for p in g.phrases]
        hits.append(hit)
        scores.append(F.when(hit, sum((part(x) for x in used), F.lit(0.0))).otherwise(F.lit(0.0)))
    return rows.where(reduce(lambda a, b: a | b, hits)).select("passage_id", (-sum(scores, F.lit(0.0))).alias("score"))
