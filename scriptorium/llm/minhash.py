"""MinHash near-duplicates with sequential Bayesian verification.

1. Each document's set of distinct word shingles gives its size, a 128-bit digest and PERMUTATIONS min-hashes.
2. Equal sets form a class (partially aggregated minimum of doc_id); the work goes on with one document per class.
3. Bands of ROWS min-hashes make buckets. In each bucket every member is paired with up to three hubs, so that pairs grow
   with the members, not with their square.
4. Pairs are compared in batches of BATCH min-hashes; one goes when the posterior probability that its similarity reaches the
   threshold falls below MISS. Survivors are verified on full sets, first the best of each document, then those whose ends
   are still in different components.
5. Buckets of more than three members in which different components meet yet are dealt into blocks of BLOCK members; pairs of blocks
   are tasks of bounded size, in which full sets are compared by one matrix product, and which return a spanning set
   of new links, so fewer than they have members. Members of a bucket's largest component meet only the others, and of buckets with
   the same members one is compared.

Links are confirmed on full sets of 48-bit shingle hashes; classes of equal sets are told by 128 bits. A pair at the threshold is missed with probability (1 - 0.8^4)^24 = 3e-6 by banding, MISS by pruning.
Full sets are made only for documents that have candidates. Nothing but counts reaches the driver. The ids of those documents are broadcast
up to BROADCAST_IDS (16 bytes each), and joined by shuffle beyond.

Defined cases: null text and text without words have an empty set, linked with nothing; fewer words than a shingle: the whole
sequence is one; repeated rows fall in one class; rows of one doc_id with different texts are each linked by their own set; rows
without doc_id are linked with nothing and kept; ties go to the smallest doc_id; an empty table gives no rows; extra columns come
back as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet, packed, stored, unpacked
from .components import apart, components

ROWS, BANDS, BATCH, MISS = 4, 24, 16, 1e-6
PERMUTATIONS = ROWS * BANDS
BLOCK = 512
BROADCAST_IDS = 2_000_000


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text."""
    from . import wordhash as H

    for _, _, words in H.steps(texts, lower=True):
        p = words.prefix()
        all_ = H.windows(p, size)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a > size:
                yield np.unique(all_[a : b - size + 1])
            else:
                yield H.spans(p, np.array([a] * (b > a), dtype=np.int64), np.array([b] * (b > a), dtype=np.int64))


def _keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band and what it holds."""
    from . import wordhash as H

    pairs = sig.view(np.uint64).reshape(BANDS, ROWS // 2)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS // 2):
        key = H.mixed(key + pairs[:, k])
    return key.view(np.int64)


def _features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rng = np.random.default_rng(20240229)
        a = rng.integers(1 << 62, size=(PERMUTATIONS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(1 << 62, size=(PERMUTATIONS, 1), dtype=np.uint64)
        for batch in batches:
            n, digests, sigs, keys = [], [], [], []
            for s in shingle_sets(batch.column("text"), size):
                low = np.full((PERMUTATIONS, 1), np.iinfo(np.uint64).max, dtype=np.uint64)
                for k in range(0, len(s), 4096):
                    low = np.minimum(low, ((s[k : k + 4096] ^ b) * a).min(axis=1, keepdims=True))
                sig = (low[:, 0] >> np.uint64(32)).astype(np.uint32)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append(sig.tobytes())
                keys.append(_keys(sig))
            flat = np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), lists], ["doc_id", "th", "n", "digest", "sig", "keys"])

    return run


def _packed(s: np.ndarray) -> bytes:
    """48 bits of each hash: within a pair of sets of a thousand, a chance match has probability 1e-8."""
    return np.unique(s & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(b, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64)[:, 0]


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for k in range(0, len(batch), 500):
                sets = list(shingle_sets(batch.column("text").slice(k, 500), size))
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, 500), pa.array(digests, pa.binary()), pa.array(map(_packed, sets), pa.binary())], ["doc_id", "digest", "s"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = _unpacked(x), _unpacked(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both * 100 >= (len(x) + len(y) - both) * percent)
            yield batch.loc[good, ["a", "b"]]

    return run


def _block(percent: int):
    """Spanning links between the components of a block pair's members (rid, root, s)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("rid").sort_values("rid")
        sets = [_unpacked(s) for s in rows["s"]]
        ids, sizes = rows["rid"].to_numpy(), np.array([len(s) for s in sets])
        names, at = np.unique(np.concatenate(sets), return_inverse=True)
        of = np.repeat(np.arange(len(sets)), sizes)
        often = np.bincount(at, minlength=len(names)) > 1
        root = dict(zip(ids, rows["root"], strict=True))
        parent = {r: r for r in root.values()}

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        column = np.cumsum(often) - 1
        keep = often[at]
        c, r = column[at[keep]], of[keep]
        order = np.argsort(c, kind="stable")
        c, r = c[order], r[order]
        for k in range(0, int(often.sum()), 4096):  # bounded memory: 4096 shingles at a time
            lo, hi = np.searchsorted(c, [k, k + 4096])
            m = np.zeros((len(sets), 4096), dtype=np.float32)
            m[r[lo:hi], c[lo:hi] - k] = 1
            both += m @ m.T
        similar = both * 100 >= (sizes[:, None] + sizes[None, :] - both) * percent
        out = []
        for i, j in zip(*np.nonzero(np.triu(similar, 1)), strict=True):
            x, y = find(root[ids[i]]), find(root[ids[j]])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((ids[j], ids[i]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


@cache
def least_matches(threshold: float) -> dict[int, int]:
    """For n compared min-hashes, the fewest matches that leave P(similarity >= threshold) at MISS or more (uniform prior)."""
    grid = (np.arange(20000) + 0.5) / 20000
    found = {}
    for n in range(BATCH, PERMUTATIONS + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[grid >= threshold].sum() / p.sum() >= MISS:
                found[n] = m
                break
    return found


def _prune(percent: int):
    least = least_matches(percent / 100)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch[c]), dtype=np.uint32).reshape(-1, PERMUTATIONS) for c in ("sa", "sb"))
            alive, est = np.arange(len(batch)), np.zeros(len(batch), dtype=np.int32)
            for n, m in least.items():
                est[alive] += (x[alive, n - BATCH : n] == y[alive, n - BATCH : n]).sum(axis=1, dtype=np.int32)
                alive = alive[est[alive] >= m]
            yield pd.DataFrame({"a": batch["a"].to_numpy()[alive], "b": batch["b"].to_numpy()[alive], "est": est[alive]})

    return run


def prune(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b, est) of the pairs (a, b) whose signatures pass every batch."""
    s = reps.select("rid", "sig", "n")
    p = pairs.join(s.select(F.col("rid").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na")), "a")
    p = p.join(s.select(F.col("rid").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb")), "b")
    p = p.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)  # else the sizes alone decide
    return p.select("a", "b", "sa", "sb").mapInPandas(_prune(percent), "a long, b long, est int")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar by their full sets. The hubs' sets, fewer, join last."""
    hubs = sets.join(pairs.select(F.col("b").alias("rid")).distinct(), "rid", "left_semi")
    hubs = hubs.select(F.col("rid").alias("b"), F.col("s").alias("y"))
    one = pairs.join(sets.select(F.col("rid").alias("a"), F.col("s").alias("x")), "a")
    two = one.join(*apart(hubs, "b"))
    return two.select("a", "b", "x", "y").mapInPandas(_verify(percent), "a long, b long")


def _bands(reps: DataFrame) -> DataFrame:
    return reps.select("rid", F.explode_outer("keys").alias("key"))


def _stars(bands: DataFrame) -> DataFrame:
    """Pairs of each member with the bucket's hubs: the least id, and the ends of an order by hash."""
    h = F.xxhash64("rid")
    hubs = bands.groupBy("key").agg(F.min("rid").alias("h1"), F.max("rid").alias("h0"), F.min(F.struct(h.alias("o"), F.col("rid").alias("rid"))).alias("h2"), F.max(F.struct(h.alias("o"), F.col("rid").alias("rid"))).alias("h3")).where("h0 != h1")
    hubs = stored(hubs, "hubs")  # a table of its own, so that the join can split a hot bucket
    p = bands.join(hubs, "key").select("rid", F.explode_outer(F.array("h1", F.col("h2.rid"), F.col("h3.rid"))).alias("hub"))
    return p.where("rid != hub").select(F.greatest("rid", "hub").alias("a"), F.least("rid", "hub").alias("b")).distinct()


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return _groups(docs, size, percent).drop("th")


def _groups(docs: DataFrame, size: int, percent: int) -> DataFrame:
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = stored(keyed.mapInArrow(_features(size), "doc_id long, th long, n long, digest binary, sig binary, keys array<long>"), "minhash")
    full = found.where("n > 0 and doc_id is not null")
    # a class, the documents of one set, is named by its least doc_id; by a hash of the set where an id has rows with different texts
    repeated = not full.groupBy("doc_id").agg(F.count_distinct("digest").alias("n")).where("n > 1").isEmpty()
    name = (lambda least: F.xxhash64("digest")) if repeated else (lambda least: F.col(least))
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("least"))
    classes = stored(classes.select("digest", "least", name("least").alias("rid")), "classes")
    mine = classes.select(F.col("digest").alias("__g"), "rid", "least")
    reps = full.join(mine, (F.col("digest") == F.col("__g")) & (F.col("doc_id") == F.col("least"))).select("rid", "n", "sig", "keys", "least")
    reps = stored(reps.dropDuplicates(["rid"]), "reps")

    def open_pairs(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components."""
        c = comps.select("a", "root")
        p = pairs.join(c.withColumnRenamed("root", "ra"), "a", "left").join(c.select(F.col("a").alias("b"), F.col("root").alias("rb")), "b", "left")
        return p.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    tested = stored(prune(_stars(_bands(reps)), reps, percent), "pairs")
    large = _bands(reps).groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("rid").cast("decimal(38,0)")).alias("who"), F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("m > 3")
    # groups of near copies make the same bucket in many bands: one of those with the same members stays
    large = stored(large.groupBy("m", "who", "lo", "hi").agg(F.min("key").alias("key")).select("key", "m"), "large")
    large = stored(_bands(reps).join(large, "key"), "buckets")
    ids = stored(tested.select(F.explode_outer(F.array("a", "b")).alias("rid")).union(large.select("rid")).distinct(), "ids")
    n_ids = ids.count()
    if not n_ids:
        return _result(found, classes, ids.select(F.col("rid").alias("a"), F.col("rid").alias("root")), repeated)
    wanted = reps.join(ids, "rid", "left_semi").select(F.col("least").alias("doc_id")).distinct() if repeated else ids.select(F.col("rid").alias("doc_id"))
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if n_ids <= BROADCAST_IDS else wanted, "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets(size), "doc_id long, digest binary, s binary")
    # an id has one set, in one row or several equal ones; where it has others, the names of the sets tell
    sets = sets.select((F.xxhash64("digest") if repeated else F.col("doc_id")).alias("rid"), "s")
    sets = stored(sets.join(ids, "rid", "left_semi").groupBy("rid").agg(F.min("s").alias("s")) if repeated else sets, "sets")
    if not repeated and sets.count() > n_ids:  # repeated rows
        sets = stored(sets.groupBy("rid").agg(F.min("s").alias("s")), "sets")

    best = tested.groupBy("a").agg(F.max_by("b", F.struct("est", "b")).alias("b"))
    links = stored(verify(best, sets, percent), "links")
    comps = components(links)
    rest = open_pairs(tested.select("a", "b").join(best, ["a", "b"], "left_anti"), comps)
    comps = components(_stars_of(comps).union(verify(rest, sets, percent)))

    named = large.join(comps.withColumnRenamed("a", "rid"), "rid", "left").select("key", "m", "rid", F.coalesce("root", "rid").alias("root"))
    named = stored(named, "named")
    # members of a bucket's largest component are compared with the others only
    sizes = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    open_ = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.max("size").alias("size"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    open_ = stored(open_.select("key", "main", "size"), "open")
    rows = named.join(open_, "key").join(sets, "rid").withColumn("in_main", F.col("root") == F.col("main"))
    # blocks of the others: 0 to n - 1; of the main component: -1 to -k. Each row goes to the pairs of blocks that its own block is in
    blocks = lambda rows: F.ceil(rows / F.lit(BLOCK)).cast("int")
    others, mains = blocks(F.col("m") - F.col("size")), blocks(F.col("size"))
    own = F.when(F.col("in_main"), -F.lit(1) - F.pmod(F.xxhash64("rid"), mains).cast("int")).otherwise(F.pmod(F.xxhash64("rid"), others).cast("int"))
    partner = F.sequence(F.when(F.col("in_main"), F.lit(0)).otherwise(-mains), others - F.lit(1))
    rows = rows.select("key", "rid", "root", "s", own.alias("mine"), F.explode_outer(partner).alias("other"))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "rid", "root", "s")
    found_links = rows.groupBy("key", "i", "j").applyInPandas(_block(percent), "a long, b long")
    return _result(found, classes, components(_stars_of(comps).union(found_links)), repeated)


def _stars_of(comps: DataFrame) -> DataFrame:
    """Components as links, from which new links go on in few passes."""
    return comps.select("a", F.col("root").alias("b"))


def _result(found: DataFrame, classes: DataFrame, comps: DataFrame, repeated: bool) -> DataFrame:
    roots = classes.join(comps.withColumnRenamed("a", "rid"), "rid", "left").select("digest", "least", F.coalesce("root", "rid").alias("root"))
    if repeated:
        roots = stored(roots, "roots")
        roots = roots.join(*apart(roots.groupBy("root").agg(F.min("least").alias("component")), "root"))
    else:
        roots = roots.withColumn("component", F.col("root"))
    roots = stored(roots.select("digest", "component"), "components")
    out = found.select("doc_id", "th", "digest", "n").join(roots, "digest", "left").select("doc_id", "th", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group (with its repeated rows); the columns of docs."""
    gone = stored(_groups(docs, size, percent).where(~F.col("kept")).select("doc_id", "th").distinct(), "gone")
    return unpacked(meet(packed(docs), gone, "left_anti", F.lit(32)), docs.columns, {})


def op5(docs: DataFrame) -> DataFrame:
    return groups(docs, size=4, percent=80)
