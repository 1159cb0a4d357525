"""Substring dedup: words inside a window of SIZE words whose word sequence also starts earlier are removed.

Suffix automata of broadcast reference shards answer this for a reference of bounded size, and `remove_known` does that.
With the corpus as its own reference they can't be used: every document would be streamed through an automaton of every shard,
work that grows with the square of the corpus (README has figures). `remove_repeats` finds the same words by content:

1. A document's windows are dealt into runs: consecutive windows that share one minimizer, the gram of GRAM words whose hash is
   least within the window. Equal windows have equal minimizers, so only runs whose minimizer occurs twice matter.
2. Equal runs (all words equal) are settled whole: all but the earliest are repeats.
3. Of runs with the same minimizer but other words around it, the earliest of each kind is compared window by window.

Hot passages: minima and counts are partially aggregated; rows are met again by plain equi-joins of stored tables, which AQE may split.
What is found for a document is where its runs and windows start; it meets the texts by broadcast within a bound of bytes, by shuffle
beyond. Windows are judged on the input. Equality is that of hashes: 128 bits for a window, 64 for a word, so two windows of
different words are taken for equal with a chance of about 1e-19 for each pair of distinct words compared.

Defined cases: null text has no words; texts of fewer than SIZE words lose none; repeated rows (same id and text) are one
document and get equal results; rows of one id with other texts are in the order of the texts' hashes; empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet, stored

SIZE, GRAM = 20, 8
#: remove_known broadcasts shards of so many reference words (an automaton has at most twice as many states).
SHARD_WORDS = 200_000
PLACE = np.uint64((1 << 20) - 1)


def _least(grams: np.ndarray, per: int) -> np.ndarray:
    """Position of the least gram (by 44 bits of its hash, then place) of each `per` consecutive ones."""
    n, part = len(grams) - per + 1, 1 << 16
    out = np.empty(n, dtype=np.int64)
    for k in range(0, n, part):
        x = grams[k : k + part + per - 1]
        x = (x & ~PLACE) | np.arange(len(x), dtype=np.uint64)
        size = 1
        while 2 * size <= per:
            x = np.minimum(x[:-size], x[size:])
            size *= 2
        if size < per:
            x = np.minimum(x[: size - per], x[per - size :])
        out[k : k + part] = (x & PLACE).astype(np.int64) + k
    return out


def _runs(words) -> tuple[np.ndarray, ...]:
    """row, g (minimizer), r (hash of the run's words), s (first window), z (end of windows); s and z count from the row's first word."""
    from . import wordhash as H

    p, first = words.prefix(), words.first
    if len(p) <= SIZE:
        none = np.empty(0, dtype=np.int64)
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    grams = H.windows(p, GRAM)
    at = _least(grams, SIZE - GRAM + 1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(at)]
    inside = np.flatnonzero(first[row + 1] - np.arange(len(at)) >= SIZE)  # windows of one text
    at, row = at[inside], row[inside]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])])[: len(at)])
    s, row = inside[new], row[new]
    z = np.append(inside[new[1:] - 1], inside[-1:]) + 1
    return row, grams[at[new]], H.spans(p, s, z + SIZE - 1), s - first[row], z - first[row]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64, copy=False))


def _find_minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from . import wordhash as H

    for b in batches:
        found = [_runs(w)[1] for _, _, w in H.steps(b.column("text"))]
        if found:
            yield pa.RecordBatch.from_arrays([_long(np.concatenate(found))], ["g"])


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from . import wordhash as H

    for b in batches:
        for k, _, w in H.steps(b.column("text")):
            row, g, r, s, _ = _runs(w)
            at = pa.array(row + k)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("th").take(at), _long(g), _long(r), pa.array(s.astype(np.int32))], ["doc_id", "th", "g", "r", "s"])


def _lists(column: pa.Array, k: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """row (from 0) and value of each element of the lists in rows [k, to)."""
    part = column.slice(k, to - k)
    return pc.list_parent_indices(part).to_numpy(zero_copy_only=False), part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and what, for all numbers in the ranges [start, stop)."""
    n = stop - start
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + start[which]


def _find_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, g, w, s) for each window of the runs that start at `starts`."""
    from . import wordhash as H

    for b in batches:
        for k, to, words in H.steps(b.column("text")):
            row, g, _, s, z = _runs(words)
            mine, start = _lists(b.column("starts"), k, to)
            at = np.isin((row << 32) | s, (mine << 32) | start)
            row, g, s, z = row[at], g[at], s[at], z[at]
            which, i = _ranges(s, z)
            place = pa.array(row[which] + k)
            w = H.windows(words.prefix(), SIZE)[i + words.first[row[which]]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(place), b.column("th").take(place), _long(g[which]), _long(w), pa.array(i.astype(np.int32))], ["doc_id", "th", "g", "w", "s"])


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import wordhash as H

        for b in batches:
            data, edges = H.buffer(b.column("text"))
            n_words, n_removed, digests, texts = [], [], [], []
            for k, to, words in H.steps(b.column("text")):
                row, _, _, s, z = _runs(words)
                mine, start = _lists(b.column("starts"), k, to)
                one, single = _lists(b.column("singles"), k, to)
                at = np.isin((row << 32) | s, (mine << 32) | start)
                edge = np.zeros(len(words.h) + 1, dtype=np.int64)
                np.add.at(edge, words.first[row[at]] + s[at], 1)
                np.add.at(edge, words.first[row[at]] + z[at] + SIZE - 1, -1)
                np.add.at(edge, words.first[one] + single, 1)
                np.add.at(edge, words.first[one] + single + SIZE, -1)
                keep = np.cumsum(edge[:-1]) == 0
                for i in range(k, to):
                    said = data[edges[i] : edges[i + 1]].tobytes().split()
                    of = keep[words.first[i - k] : words.first[i - k + 1]]
                    kept = b" ".join(said if of.all() else compress(said, of.tolist()))
                    n_words.append(len(said))
                    n_removed.append(len(said) - int(of.sum()))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    texts += [kept.decode("utf-8")] if with_text else []
            columns = [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th, text. th tells rows of one id apart by their texts' hashes; where ids are unique it is 0."""
    twice = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    return docs.select("doc_id", (F.xxhash64("text") if twice else F.lit(0).cast("bigint")).alias("th"), "text")


def repeats(keyed: DataFrame) -> DataFrame:
    """doc_id, th, starts (of runs), singles (starts of windows): what of each document (doc_id, th, text) repeats earlier windows."""
    run = "doc_id long, th long, g long, r long, s int"
    # twice or more; rows of the same document count once for each place, so a repeated row costs a few rows more and changes nothing
    twice = keyed.select("text").mapInArrow(_find_minimizers, "g long").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
    twice = stored(twice, "twice")  # a table of its own, so that the join can split a hot minimizer
    runs = stored(keyed.mapInArrow(_find_runs, run).join(twice, "g", "left_semi"), "runs")
    place = F.struct("doc_id", "th", "s")
    kinds = stored(runs.groupBy("g", "r").agg(F.min(place).alias("first")), "kinds")
    later = runs.join(kinds, ["g", "r"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "th", "s", F.lit(True).alias("whole"))
    mixed = stored(kinds.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"), "mixed")
    close = kinds.join(mixed, "g", "left_semi").select("first.*").groupBy("doc_id", "th").agg(F.collect_set("s").alias("starts"))
    texts = meet(keyed, stored(close, "close"), "inner", F.lit(64) + F.size("starts") * 4)
    windows = stored(texts.mapInArrow(_find_windows, "doc_id long, th long, g long, w long, s int"), "windows")
    firsts = windows.groupBy("g", "w").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("g", "w", "first")
    single = windows.join(stored(firsts, "firsts"), ["g", "w"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "th", "s", F.lit(False).alias("whole"))
    of = lambda whole: F.collect_set(F.when(F.col("whole") == whole, F.col("s")))
    return stored(later.union(single).groupBy("doc_id", "th").agg(of(True).alias("starts"), of(False).alias("singles")), "repeats")


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space)."""
    keyed = _keyed(docs.select("doc_id", "text"))
    joined = meet(keyed, repeats(keyed), "left", F.lit(80) + (F.size("starts") + F.size("singles")) * 4)
    return joined.mapInArrow(_remove(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def _words(text: object) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if isinstance(text, str) else []


class Automaton:
    """Suffix automaton over words, built online; `matching` gives for each position the longest match that ends there."""

    def __init__(self, words: list[bytes]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for w in words:
            new = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[q] == self.length[p] + 1:
                    self.link[new] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.link.append(self.link[q])
                    self.length.append(self.length[p] + 1)
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = twin
                        p = self.link[p]
                    self.link[q] = self.link[new] = twin
            last = new

    def matching(self, words: list[bytes]) -> np.ndarray:
        state = n = 0
        out = np.zeros(len(words), dtype=np.int64)
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            else:
                state = n = 0
            out[i] = n
        return out


def shards(reference: list[str], size: int = SIZE) -> list[list[bytes]]:
    """The reference's words in shards of about SHARD_WORDS. A longer text is cut with size - 1 words in common, so each window is in a shard."""
    out: list[list[bytes]] = [[]]
    for text in reference:
        words = _words(text)
        for k in range(0, max(1, len(words) - size + 1), max(1, SHARD_WORDS - size)):
            part = words[k : k + SHARD_WORDS - 1]
            if out[-1] and len(out[-1]) + len(part) >= SHARD_WORDS:
                out.append([])
            out[-1] += [*part, b"\n%d" % len(out[-1])]  # a word no text can have, so that no match crosses texts
    return out


def remove_known(docs: DataFrame, reference: list[str], size: int = SIZE) -> DataFrame:
    """doc_id, text without words in spans of at least `size` words that also stand in a reference text, and n_removed.

    The reference's shards are broadcast, one after the other; documents are streamed past each shard's automaton for their matching
    statistics. Only spans are shuffled with the documents that have any; spans are judged on the input. Rows of one id are told apart by text.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")

    def matches(words: list[bytes]):
        shared = docs.sparkSession.sparkContext.broadcast(words)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            a = Automaton(shared.value)
            for b in batches:
                rows = []
                for doc, th, text in zip(b["doc_id"], b["th"], b["text"], strict=True):
                    m = a.matching(_words(text))
                    ends = np.flatnonzero((m >= size) & (np.append(m[1:], 0) <= m))  # where a match goes on, it holds this one
                    if len(ends):
                        rows.append((None if pd.isna(doc) else doc, th, (ends + 1 - m[ends]).tolist(), (ends + 1).tolist()))
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "th", "s", "e"]).astype({"doc_id": "Int64"})

        return keyed.mapInPandas(run, "doc_id long, th long, s array<int>, e array<int>")

    found = [matches(words) for words in shards(reference, size) if words]
    if not found:
        return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(0).cast("bigint").alias("n_removed"))
    spans = found[0]
    for f in found[1:]:
        spans = spans.union(f)
    spans = spans.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("e")).alias("e"))
    c = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a.th") == F.col("b.th")]
    joined = keyed.alias("a").join(spans.alias("b"), c, "left").select("a.doc_id", "a.text", "b.s", "b.e")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, s, e in zip(b["doc_id"], b["text"], b["s"], b["e"], strict=True):
                w = _words(text)
                edge = np.zeros(len(w) + 1, dtype=np.int64)
                if s is not None:
                    np.add.at(edge, s, 1)
                    np.add.at(edge, e, -1)
                keep = np.cumsum(edge[: len(w)]) == 0
                rows.append((doc, b" ".join(compress(w, keep.tolist())).decode("utf-8"), int((~keep).sum())))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "n_removed"])

    return joined.mapInPandas(cut, "doc_id long, text string, n_removed long")


def op10(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, with_text=False)
