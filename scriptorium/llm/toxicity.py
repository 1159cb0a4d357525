"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Features of a text: densities and strengths of a lexicon (words and word beginnings, learned from labelled rows by their
odds), how near they stand to second-person words, capitals, punctuation, obfuscation. The lexicon for a training row comes from the other
half of the training rows, so that its own label is not in its features.

Bounds: at most MAX_ROWS labelled rows are fitted (those with the least hash of doc_id; the parameter bounds the sample), so what is
learned from them is bounded too: every unit of at least MIN_DOCS of them with the odds for it is in the lexicon, none is dropped.
Counts for the lexicon are aggregated on the executors; the driver gets the units that pass, with their numbers.
Every whole text of the table is scored; labels, lang, source and doc_id are never inputs of a score.

Defined cases: null text is empty; without labelled rows of both kinds the score is their share (0 without any);
repeated rows get equal results; rows of labels without a document are not used; of conflicting labels of one doc_id the larger
counts, of several texts of one doc_id that with the least hash is fitted; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_ROWS, MIN_DOCS, MIN_SHARE = 50_000, 5, 0.5
ROUNDS, DEPTH, RATE, BINS, MIN_LEAF, RIDGE = 80, 3, 0.12, 48, 15, 2.0
PREFIXES = (4, 5, 6, 7, 8, 9)
CUT = 0.7
NEAR = 3
#: Second-person words of the languages at hand (fixed values).
YOU = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi vous votre vos ton usted ustedes tú ti vosotros su".split())
WORD = re.compile(r"[^\W\d_]+")
OBFUSCATED = re.compile(r"(?<=[^\W\d_])[*@$#0-9]+(?=[^\W\d_])")
MASKS = [ord(c) for c in "*@$#0123456789"]
#: ASCII punctuation by byte.
PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum() and c != 95]
N_FEATURES = 13


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def units(word: str) -> list[str]:
    """A word and its beginnings (marked by *)."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


class Lexicon:
    """Log-odds of units; a word's weight is its strongest unit's."""

    def __init__(self, odds: dict[str, float]):
        self.odds, self.known = odds, {}
        self.heads = {u.rstrip("*")[: PREFIXES[0]] for u in odds}  # a word that begins otherwise has no unit here

    def __getstate__(self):
        return {"odds": self.odds, "heads": self.heads, "known": {}}

    def weight(self, word: str) -> float:
        return max((self.odds.get(u, 0.0) for u in units(word)), default=0.0)

    def weights(self, words: list[str]) -> list[float]:
        """The weight of each word, from a bounded store of what has been asked for."""
        if len(self.known) > 500_000:
            self.known.clear()
        found = list(map(self.known.get, words))
        if None in found:
            for w in set(words).difference(self.known):
                self.known[w] = self.weight(w) if w[: PREFIXES[0]] in self.heads else 0.0
            found = list(map(self.known.get, words))
        return found


def features(text: str, lexicon: Lexicon) -> list[float]:
    words = WORD.findall(text.lower())
    n = max(1, len(words))
    hits = [(i, w) for i, w in enumerate(lexicon.weights(words)) if w]
    weights = sorted((w for _, w in hits), reverse=True)
    strong = sum(w > 3 for w in weights)
    distinct = sorted({words[i]: w for i, w in hits}.values(), reverse=True)
    near = sum(any(words[j] in YOU for j in range(max(0, i - NEAR), min(len(words), i + NEAR + 1))) for i, _ in hits)
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    count, size = np.bincount(data, minlength=256), max(1, len(data))
    same = data[1:] == data[:-1]
    odd = int((same[2:] & same[1:-1] & same[:-2]).sum()) + (len(OBFUSCATED.findall(text)) if count[MASKS].any() else 0)
    return [
        weights[0] if weights else 0.0, weights[1] if len(weights) > 1 else 0.0, weights[2] if len(weights) > 2 else 0.0, 1000 * strong / n, 1000 * len(hits) / n, 1000 * sum(weights) / n, sum(distinct[:5]), float(strong),
        1000 * near / n, count[65:91].sum() / size, (count[33] + count[63]) / size, count[PUNCTUATION].sum() / size, 1000 * odd / size,
    ]


class Trees:
    """Histogram gradient boosting for the logistic loss."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self.binned(x)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        f = np.full(len(y), self.start)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-f))
            tree = self.grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += self.leaf(tree, b)
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)

    def grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> list:
        """Nodes as [feature, cut, left, right, value]; feature -1 is a leaf."""
        nodes, todo = [], [(np.arange(len(g)), 0, None)]
        while todo:
            rows, depth, slot = todo.pop()
            at = len(nodes)
            if slot:
                nodes[slot[0]][slot[1]] = at
            nodes.append([-1, 0, 0, 0, RATE * g[rows].sum() / (h[rows].sum() + RIDGE)])
            best = (1e-6, None)
            if depth < DEPTH and len(rows) >= 2 * MIN_LEAF:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for j in range(b.shape[1]):
                    k = len(self.cuts[j]) + 1
                    cg, ch, cn = (np.cumsum(np.bincount(b[rows, j], weights=w, minlength=k))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                    gain = cg**2 / (ch + RIDGE) + (total_g - cg) ** 2 / (total_h - ch + RIDGE) - total_g**2 / (total_h + RIDGE)
                    gain[(cn < MIN_LEAF) | (len(rows) - cn < MIN_LEAF)] = -1
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), (j, int(gain.argmax())))
            if best[1]:
                j, cut = best[1]
                nodes[at][:2] = [j, cut]
                left = b[rows, j] <= cut
                todo += [(rows[left], depth + 1, (at, 2)), (rows[~left], depth + 1, (at, 3))]
        return nodes

    @staticmethod
    def leaf(tree: list, b: np.ndarray) -> np.ndarray:
        at = np.zeros(len(b), dtype=int)
        feature, cut, left, right, value = (np.array([n[k] for n in tree]) for k in range(5))
        for _ in range(DEPTH):
            inner = feature[at] >= 0
            go = b[np.arange(len(b)), np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        return value[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.start + sum((self.leaf(t, b) for t in self.trees), np.zeros(len(x)))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and values of the calibrated share, for np.interp."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum, count, sum of raw
    for r, v in zip(raw[order], y[order], strict=True):
        blocks.append([v, 1, r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    def __init__(self, lexicon: Lexicon, trees: Trees | None, knots: tuple[np.ndarray, np.ndarray], share: float):
        self.lexicon, self.trees, self.knots, self.share = lexicon, trees, knots, share

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.trees:
            return np.full(len(texts), self.share)
        raw = self.trees.raw(np.array([features(t, self.lexicon) for t in texts], dtype=float).reshape(len(texts), N_FEATURES))
        # a trace of the raw score keeps the order within a calibrated block
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-raw)), 0, 1)


def _half(doc_id: object) -> int:
    return zlib.crc32(f"half {doc_id}".encode()) % 2


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """The model of the labelled rows that are not held out."""
    spark = docs.sparkSession
    mine = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    n = mine.count()
    if n > MAX_ROWS:
        mine = mine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS)
    # at most MAX_ROWS ids are broadcast, so the texts of the corpus are not shuffled
    rows = docs.select("doc_id", "text").join(F.broadcast(mine), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = stored(rows.select("doc_id", "text", "y"), "labelled")

    totals = {(r["h"], r["y"]): r["n"] for r in rows.select(F.pmod(F.crc32(F.concat(F.lit("half "), F.col("doc_id").cast("string")).cast("binary")), F.lit(2)).alias("h"), "y").groupBy("h", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, a = (sum(v for (_, y), v in totals.items() if bool(y) is k) for k in (True, False))
    if not p or not a:
        return Model(Lexicon({}), None, (np.zeros(1), np.zeros(1)), p / max(1, p + a))

    def counts(which: DataFrame, only=None) -> DataFrame:
        """u, n0, n1: documents of each half with a unit; of all units or of those in the broadcast set."""

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                seen: dict[str, list[int]] = {}
                for doc, text in zip(b["doc_id"], b["text"], strict=True):
                    h = _half(doc)
                    for u in {u for w in set(WORD.findall((text or "").lower())) for u in units(w) if only is None or u in only.value}:
                        seen.setdefault(u, [0, 0])[h] += 1
                yield pd.DataFrame([(u, *n) for u, n in seen.items()], columns=["u", "n0", "n1"]).astype({"u": object, "n0": "int64", "n1": "int64"})

        return which.mapInPandas(count, "u string, n0 long, n1 long").groupBy("u").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    # units of toxic documents first: few documents; of the others only what occurs there is counted. Both are bounded by MAX_ROWS texts
    yes = counts(rows.where("y = 1")).where(F.col("n0") + F.col("n1") >= MIN_DOCS).toPandas()
    wanted = spark.sparkContext.broadcast(frozenset(yes["u"]))
    no = counts(rows.where("y = 0"), wanted).toPandas()
    some = yes.merge(no, on="u", how="left", suffixes=("p", "a")).fillna({"n0a": 0, "n1a": 0}).rename(columns={"n0p": "p0", "n1p": "p1", "n0a": "a0", "n1a": "a1"})
    pos, neg = some["p0"] + some["p1"], some["a0"] + some["a1"]
    some = some[pos > MIN_SHARE * (pos + neg)].assign(odds=pos / (neg + 1), pos=pos).sort_values(["odds", "pos", "u"], ascending=[False, False, True])

    def lexicon(halves: tuple[int, ...]) -> Lexicon:
        p, a = sum(some[f"p{h}"] for h in halves), sum(some[f"a{h}"] for h in halves)
        np_, na = (sum(totals.get((h, y), 0) for h in halves) for y in (1, 0))
        odds = np.log((p + 0.5) / (np_ + 1)) - np.log((a + 0.5) / (na + 1))
        # by its lower bound, as a rare unit's odds mean less
        low = odds - np.sqrt(1 / (p + 0.5) + 1 / (a + 0.5)) * 0.5
        return Lexicon({u: float(o) for u, o, k in zip(some["u"], low, p, strict=True) if o > 0.5 and k >= 2})

    by_half = {0: lexicon((1,)), 1: lexicon((0,))}
    shared = spark.sparkContext.broadcast(by_half)

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = [features(t or "", shared.value[_half(d)]) for d, t in zip(b["doc_id"], b["text"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "f": f})

    data = rows.mapInPandas(featurise, "doc_id long, y int, f array<double>").toPandas().sort_values("doc_id")
    x, y = np.array(data["f"].tolist(), dtype=float), data["y"].to_numpy(dtype=float)
    fold = np.array([zlib.crc32(f"fold {d}".encode()) % 4 for d in data["doc_id"]])
    raw = np.zeros(len(y))
    for k in range(4):  # out-of-fold scores for the calibration
        if (fold == k).any() and 0 < y[fold != k].mean() < 1:
            raw[fold == k] = Trees().fit(x[fold != k], y[fold != k]).raw(x[fold == k])
    return Model(lexicon((0, 1)), Trees().fit(x, y), isotonic(raw, y), float(y.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": m.score([t if isinstance(t, str) else "" for t in b["text"]])})

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInPandas(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
