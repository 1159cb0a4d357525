"""Packing by cutting stock with column generation.

Documents become token ids (byte-level BPE, plus an end id). Each is cut at multiples of the sequence length; the
rest of each document, rounded up to units, is an item of a cutting-stock problem over the histogram of lengths:
a linear program over patterns, whose columns are priced by an unbounded-knapsack dynamic program, solved on the driver from
at most 1024 / UNIT counts. Rounded-down patterns, and first-fit-decreasing patterns for what rounding leaves, are
assigned to documents by their rank within their length class.

Ranks come from counts per (class, bucket) and a window within a bucket, so no task holds a class: one class may have
a third of all rows, and one document may be repeated any number of times. Pieces are numbered when they are stored, and dealt by number. The driver sees the histogram only. Token ids are never shuffled: pieces depend on the document alone.

Defined cases: null text is empty (the end id alone); repeated rows are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LENGTH, UNIT, END = 1024, 8, 0
BUCKET_ROWS = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer(path: str | None = None):
    """The encoder of byte_bpe_50k: its vocabulary as ranks for tiktoken, and the tokens that its JSON adds.

    `encode` with allowed_special="all" gives the ids of tokenizers' defaults (tests/llm) at a quarter of the time.
    """
    import base64
    import json

    import public_tokenizers as P
    import tiktoken

    with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("bpe", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def cut(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of every document, cut at multiples of length; with_ids adds the ids themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = partial(tokenizer(path).encode, allowed_special="all")
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.array([*encode(text if isinstance(text, str) else ""), END], dtype="<u4")
                for s in range(0, len(ids), length):
                    part = ids[s : s + length]
                    rows.append((doc, s, len(part), zlib.crc32(part.tobytes()), len(ids), *([part.astype("i8")] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return docs.select("doc_id", "text").mapInPandas(run, PIECES + ", ids array<long>" * with_ids)


def _solve(costs_rows: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.linalg.solve(costs_rows, demand), np.linalg.solve(costs_rows.T, np.ones(len(demand)))


def _price(duals: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best pattern: the unbounded knapsack, by dynamic programming over capacities."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        k = np.searchsorted(sizes, c, side="right")
        best[c], last[c] = best[c - 1], -1
        if k:
            value = best[c - sizes[:k]] + duals[:k]
            j = int(value.argmax())
            if value[j] > best[c] + 1e-12:
                best[c], last[c] = value[j], j
    pattern, c = np.zeros(len(sizes), dtype=int), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), pattern


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(size -> copies, times)], covering the histogram exactly with about the fewest bins of `capacity`."""
    sizes = np.array(sorted(k for k, n in histogram.items() if n > 0), dtype=int)
    if not len(sizes):
        return []
    left = np.array([histogram[int(k)] for k in sizes])
    columns = np.diag(capacity // sizes).astype(float)  # the basis: one pattern per size
    for _ in range(40 * len(sizes)):
        amount, duals = _solve(columns, left.astype(float))
        value, new = _price(duals, sizes, capacity)
        if value <= 1 + 1e-9:
            break
        way = np.linalg.solve(columns, new.astype(float))
        steps = np.full(len(way), np.inf)
        steps[way > 1e-9] = np.maximum(amount[way > 1e-9], 0) / way[way > 1e-9]
        columns[:, int(steps.argmin())] = new
    amount, _ = _solve(columns, left.astype(float))
    found: dict[tuple[int, ...], int] = {}
    for j in np.argsort(-amount):
        column = columns[:, j].astype(int)
        times = int(min(max(0, np.floor(amount[j] + 1e-9)), *(left[column > 0] // column[column > 0])))
        if times:
            found[tuple(column)] = found.get(tuple(column), 0) + times
            left = left - times * column
    while left.any():  # what rounding leaves: the largest that fits, again and again
        room, column = capacity, np.zeros(len(sizes), dtype=int)
        for j in range(len(sizes) - 1, -1, -1):
            column[j] = min(left[j], room // sizes[j])
            room -= column[j] * sizes[j]
        times = int((left[column > 0] // column[column > 0]).min())
        found[tuple(column)] = found.get(tuple(column), 0) + times
        left = left - times * column
    return [({int(s): int(c) for s, c in zip(sizes, column, strict=True) if c}, times) for column, times in found.items()]


def numbered(pieces: DataFrame) -> DataFrame:
    """pieces as a stored table, each row with a number of its own, __id."""
    return stored(pieces.withColumn("__id", F.monotonically_increasing_id()), "pieces")


def assign(pieces: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """Numbered pieces with sequence_id and offset."""
    spark = pieces.sparkSession
    size = F.ceil(F.col("length") / F.lit(unit)).cast("int")
    p = pieces.withColumn("__size", size)
    counts = p.groupBy("__size").count()
    histogram = {r[0]: r[1] for r in counts.collect()}  # at most length / unit rows
    buckets = max(1, -(-sum(histogram.values()) // BUCKET_ROWS))
    p = p.withColumn("__bucket", F.pmod(F.xxhash64("__id"), F.lit(buckets)).cast("int"))
    # slots of a size, in the order of its ranks: a run of ranks for each pattern that has it
    runs, base, seen = [], 0, dict.fromkeys(histogram, 0)
    for pattern, times in patterns(histogram, length // unit):
        place = 0
        for s, copies in sorted(pattern.items(), reverse=True):
            runs.append((s, seen[s], seen[s] + times * copies, copies, base, place))
            seen[s] += times * copies
            place += copies
        base += times
    table = spark.createDataFrame(runs, "__size int, __lo long, __hi long, __copies long, __base long, __place int")
    per = p.groupBy("__size", "__bucket").count()
    w = Window.partitionBy("__size").orderBy("__bucket")
    offsets = per.select("__size", "__bucket", (F.sum("count").over(w) - F.col("count")).alias("__before"))
    mine = Window.partitionBy("__size", "__bucket").orderBy("__id")
    # both tables are bounded: sizes x buckets rows of three numbers, and one row for each size in each of at most 2 x sizes patterns
    p = p.withColumn("__n", F.row_number().over(mine)).join(offsets, ["__size", "__bucket"])
    p = p.withColumn("__rank", F.col("__before") + F.col("__n") - F.lit(1)).drop("__bucket", "__n", "__before")
    r = F.col("__rank")
    p = p.join(F.broadcast(table), (p["__size"] == table["__size"]) & (r >= F.col("__lo")) & (r < F.col("__hi"))).drop(table["__size"])
    p = p.withColumn("sequence_id", F.col("__base") + F.floor((r - F.col("__lo")) / F.col("__copies")).cast("bigint"))
    p = p.withColumn("__at", F.col("__place") + ((r - F.col("__lo")) % F.col("__copies")))
    inside = Window.partitionBy("sequence_id").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = p.withColumn("offset", F.sum("length").over(inside) - F.col("length"))
    return p.select(*[c for c in pieces.columns if c != "__id"], "sequence_id", "offset")


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most LENGTH tokens."""
    return assign(numbered(cut(docs, path)))


def sequences(docs: DataFrame, path: str | None = None) -> DataFrame:
    """sequence_id and its token ids, without padding: the training file."""
    placed = assign(numbered(cut(docs, path, with_ids=True)))
    g = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return g.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def op3(docs: DataFrame) -> DataFrame:
    return pack(docs)
