"""N-gram Jaccard self-join by chosen paths.

Sets of word 5-grams (the whole word sequence where a text is shorter) are joined at similarity
0.8. Texts with equal sets collapse first to one representative, so copies never meet each other.
Representatives carry t minhash values, their tokens. A run starts all sets in one node; a node
picks random token positions (1/threshold of them on average) and sends each set to the child
named by its value there. Nodes small enough are leaves; larger ones are split again, level by
level, down to a depth limit, unless a split keeps most of a node together: such a node, a family of
near copies, is a leaf as it stands. Runs are repeated until the chance to miss a pair at the threshold
is below 1 - recall, over the minhash values and the positions drawn.

Inside a leaf all pairs are compared, first by their minhash values, and what remains exactly on
the 5-gram sets. A leaf that is too large for one task is cut
into blocks, and pairs of blocks are compared in tasks of their own, so none is left out. A pair
is counted only in the smallest leaf that its sets share. Tasks emit one row for each set in a
leaf (links counted there, and the root of its component there), never the pairs.

Results: doc_id, copy_id (smallest doc_id with the same set), class_id (smallest doc_id of the
connected component) and n_links (other documents at the threshold or above, copies included).

Defined results: words are runs of non-white-space (ASCII), compared as they stand; texts that
are null or have no word have no set, link to nothing and form classes of their own; rows that
repeat a doc_id and its text are one document; rows that share a doc_id, or have none, but differ
in text are documents of their own, each with a row, and those without an id come last in the
order that picks the smallest one; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import common

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Pairs that agree in fewer than NEED of T minhash values are not compared; at the threshold about one in 10 million is such.
T, NEED, LEAF, DEPTH = 64, 32, 1000, 6
#: A node is a leaf, whatever its size, if a child holds this share of it: near copies do, as their minhash values agree.
DENSE = 0.75
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _final(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = _final((out + h[i : len(h) - n + 1 + i]) * _MIX + np.uint64(i))
    return np.unique(out)


_RNG = np.random.default_rng(97)
_A, _B = (_RNG.integers(0, 2**64, T, dtype=np.uint64) | np.uint64(1)), _RNG.integers(0, 2**64, T, dtype=np.uint64)


def minhash(s: np.ndarray) -> np.ndarray:
    """T minima under different hash functions, 32 bits each."""
    best = np.full(T, 2**32 - 1, np.uint64)
    for i in range(0, len(s), 1024):
        best = np.minimum(best, ((s[i : i + 1024, None] * _A + _B) >> np.uint64(32)).min(axis=0))
    return best.astype(np.uint32)


def fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def missed(runs: int, similarity: float, depth: int, threshold: float = THRESHOLD) -> float:
    """Probability that runs miss a pair of this similarity, if all depth is needed.

    All runs draw from the same T positions, so the share of them where the pair agrees is binomial,
    not the similarity itself. Given the share, runs are independent: one position is always chosen,
    a second, other one with probability 1/threshold - 1; lost is the probability that no shared node
    remains at some level. Pairs that agree in too few positions never become candidates.
    """
    total, more = 0.0, (1 / threshold - 1) * (1 - 1 / T)
    for agree in range(T + 1):
        share, lost = agree / T, 0.0
        for _ in range(depth):
            one = 1 - share + share * lost
            lost = (1 - more) * one + more * one * one
        total += math.comb(T, agree) * similarity**agree * (1 - similarity) ** (T - agree) * (1.0 if agree < NEED else lost**runs)
    return total


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Runs until a pair at the threshold is missed with probability 1 - recall at most, if all depth is needed."""
    for runs in range(1, 1000):
        if missed(runs, threshold, depth, threshold) <= 1 - recall:
            return runs
    raise ValueError(f"recall {recall} is out of reach with {T} positions")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n (size of the set), fp, sig and sig8 (its low bytes) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, fps, sigs = [], [], []
            for t in b["text"]:
                s = shingles(t.as_py())
                sizes.append(len(s))
                fps.append(fingerprint(s))
                sigs.append(minhash(s))
            flat = np.concatenate(sigs) if sigs else np.empty(0, np.uint32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * T, pa.int32()), pa.array(flat.view(np.int32)))
            low = [x.astype(np.uint8).tobytes() for x in sigs]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["th"], pa.array(sizes, pa.int32()), pa.array(fps, pa.binary()), lists, pa.array(low, pa.binary())], ["doc_id", "th", "n", "fp", "sig", "sig8"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "doc_id long, th long, n int, fp binary, sig array<int>, sig8 binary")


def numbered(sketch: DataFrame) -> tuple[DataFrame, bool]:
    """One row for each doc_id and text, with a unique `key` in the order of doc_id (nulls last) and text hash; whether it is other than doc_id.

    The key is doc_id itself where all are there and none has two texts. Otherwise the distinct
    pairs, of 16 bytes each, are sorted and written out with their numbers.
    """
    per_id = sketch.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("th").alias("low"), F.max("th").alias("high"))
    most, odd = per_id.agg(F.max("n"), F.max(F.col("doc_id").isNull() | (F.col("low") != F.col("high")))).first()
    if most and most > 1:
        rows = F.first(F.struct("n", "fp", "sig", "sig8")).alias("row")  # of one text, so all alike
        sketch = common.written(sketch.groupBy("doc_id", "th").agg(rows).select("doc_id", "th", "row.*"), "sketch")
    if not odd:
        return sketch.withColumn("key", F.col("doc_id")), False
    order = sketch.select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th")).orderBy(F.asc_nulls_last("__doc"), "__th")
    order = common.written(order.withColumn("key", F.monotonically_increasing_id()), "keys")
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("th") == F.col("__th"))
    return common.written(sketch.join(order, same).drop("__doc", "__th"), "sketch"), True


def _children(df: DataFrame) -> DataFrame:
    """One row for each set and child node: the node's positions are a function of its name."""
    second = F.lit(1 / THRESHOLD - 1)
    one, two = (F.pmod(F.xxhash64("path", F.lit(k)), F.lit(T)).cast("int") for k in (1, 2))
    wants = F.pmod(F.xxhash64("path", F.lit(3)), F.lit(1 << 20)) < second * (1 << 20)
    chosen = F.when(wants & (one != two), F.array(one, two)).otherwise(F.array(one))
    return df.withColumn("parent", F.col("path")).withColumn("path", F.explode(F.transform(chosen, lambda c: F.xxhash64("path", c, F.get("sig", c)))))


def leaves(reps: DataFrame, leaf: int = LEAF, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """rep_id, path, size: the leaves with two sets or more, and who is in them.

    A level goes through the sets once: who is in its nodes is written out, without the minhash values.
    """
    spark = reps.sparkSession
    runs = runs_for(recall, THRESHOLD, depth)
    nodes = reps.select("rep_id", "sig", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(runs).cast("long"))).alias("path"))
    found, counted, above, large = [], [], None, None
    for level in range(1, depth + 1):
        children = _children(nodes)
        members = common.written(children.select("rep_id", "path", "parent"), "members")
        sizes = common.written(members.groupBy("path").agg(F.count("*").alias("size"), F.first("parent").alias("parent")).where("size > 1"), "sizes")
        counted += [members, sizes]
        if above is not None:
            kept = sizes.groupBy(F.col("parent").alias("path")).agg(F.max("size").alias("most")).join(large, "path").where(F.col("most") >= DENSE * F.col("size"))
            dense = common.written(kept.select("path", "size"), "dense")
            counted.append(dense)
            if not dense.isEmpty():
                found.append(_gathered(above, dense))
                sizes = sizes.join(dense.select(F.col("path").alias("parent")), "parent", "left_anti")
        sizes = sizes.select("path", "size")
        found.append(_gathered(members, sizes if level == depth else sizes.where(F.col("size") <= leaf)))
        large = sizes.where(F.col("size") > leaf)
        if level == depth or large.isEmpty():
            break
        # Sets go on where they are, by their own minhash values: no table is joined with itself. The bitmap
        # may let a smaller node through, whose sets then share some more leaves, each pair still counted once.
        above, nodes = members, possible(children, large, ["path"]).select("rep_id", "sig", "path")
    common.remove(spark, *counted)
    return reduce(DataFrame.unionByName, found)


def _gathered(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """rep_id, path, size of the sets in these nodes. A node may hold a very common passage: its rows stay where they are."""
    rows = possible(members.select("rep_id", "path"), nodes, ["path"])
    total = nodes.agg(F.sum("size")).first()[0] or 0
    return common.written(common.by_heavy(rows, nodes, "path", "size", total).select("rep_id", "path", "size"), "nodes")


def blocked(found: DataFrame, leaf: int = LEAF) -> DataFrame:
    """found with the task a row goes to: (path, a, b) for each pair of blocks a <= b that it takes part in.

    side is 0 for rows of block a, 1 for rows of block b where a < b.
    """
    n = F.ceil(F.col("size") / leaf).cast("int")
    own = F.pmod(F.xxhash64("rep_id", F.lit(29)), n).cast("int")
    df = found.withColumns({"__n": n, "__own": own})
    df = df.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    a, b = F.least("__own", "__other"), F.greatest("__own", "__other")
    return df.withColumns({"a": a, "b": b, "side": F.when(F.col("__own") == a, 0).otherwise(1)}).drop("__n", "__own", "__other")


class Groups:
    """Row groups of equal (path, a, b) out of sorted batches, small ones many at a time."""

    def __init__(self, batches: Iterator[pa.RecordBatch], rows: int = 4000):
        self.batches, self.rows = batches, rows

    def __iter__(self) -> Iterator[pa.Table]:
        """Tables of whole groups."""
        kept: list[pa.RecordBatch] = []
        for batch in self.batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            if sum(b.num_rows for b in kept) < self.rows:
                continue
            whole = pa.Table.from_batches(kept)
            cut = int(self.starts(whole)[-1])
            if cut:
                yield whole.slice(0, cut)
                kept = whole.slice(cut).combine_chunks().to_batches()
            else:
                kept = whole.combine_chunks().to_batches()
        if kept:
            yield pa.Table.from_batches(kept)

    @staticmethod
    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for c in ("path", "a", "b"):
            x = t[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)


def _bytes_matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def candidates(sig: np.ndarray, side: np.ndarray, split: bool, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a group whose one-byte minhash values agree often enough, by blocks of rows."""
    n, left, right = len(sig), [], []
    if n <= 48:
        x, y = np.nonzero((sig[:, None, :] == sig[None, :, :]).sum(axis=2) >= need)
        fine = (x < y) & ((side[x] != side[y]) if split else True)
        return x[fine], y[fine]
    for i in range(0, n, 128):
        part = sig[i : i + 128]
        agree = np.zeros((len(part), n), np.uint8)
        for k in range(T):
            agree += part[:, k, None] == sig[None, :, k]
        x, y = np.nonzero(agree >= need)
        x = x + i
        fine = (x < y) & ((side[x] != side[y]) if split else True)
        left.append(x[fine])
        right.append(y[fine])
    return np.concatenate(left), np.concatenate(right)


def _common(n: int, row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many values each two of n rows share; row has the one of each value, which it holds once."""
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1  # values of one row only meet nothing
    use = count[column] > 1
    row, column = row[use], shared[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        lo, hi = np.searchsorted(column, [c, c + 2048])
        m = np.zeros((n, 2048), np.float32)
        m[row[lo:hi], column[lo:hi] - c] = 1
        both += m @ m.T
    return both


def first_shared(paths: list[np.ndarray], x: np.ndarray, y: np.ndarray, path: int) -> np.ndarray:
    """Whether the smallest leaf that the sets of each pair share is this one. paths: sorted leaves of each set."""
    if len(x) > 4 * len(paths):
        low = [p[p < path] for p in paths]
        row = np.repeat(np.arange(len(low)), [len(p) for p in low])
        return _common(len(low), row, np.concatenate(low))[x, y] == 0
    width = max(len(p) for p in paths)
    below = np.full((len(paths), width), -1, np.int64)
    names: dict[int, int] = {}
    for i, p in enumerate(paths):
        low = p[p < path]
        below[i, : len(low)] = [names.setdefault(int(v), len(names)) for v in low]
    out = np.ones(len(x), bool)
    for s in range(0, len(x), 8192):
        bx, by = below[x[s : s + 8192]], below[y[s : s + 8192]]
        out[s : s + 8192] = ~((bx[:, :, None] == by[:, None, :]) & (bx[:, :, None] >= 0)).any(axis=(1, 2))
    return out


def _active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Who takes part in some candidate pair of a task that the task has to count."""
    for t in Groups(batches):
        starts = [*Groups.starts(t).tolist(), t.num_rows]
        sig, side = _bytes_matrix(t["sig8"], T), t["side"].to_numpy()
        path, a, b, rep = (t[c].to_numpy() for c in ("path", "a", "b", "rep_id"))
        lists = t["paths"].to_pylist()
        hit = np.zeros(t.num_rows, bool)
        for s, e in zip(starts, starts[1:], strict=False):
            if e - s > 1:
                x, y = candidates(sig[s:e], side[s:e], bool(a[s] != b[s]), NEED)
                if len(x):
                    mine = first_shared([np.array(p, np.int64) for p in lists[s:e]], x, y, int(path[s]))
                    hit[s + x[mine]] = hit[s + y[mine]] = True
        on = np.flatnonzero(hit)
        yield pa.RecordBatch.from_arrays([pa.array(v[on]) for v in (path, a, b, side, rep)], ["path", "a", "b", "side", "rep_id"])


def intersections(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the common part of pairs of sorted sets."""
    if len(x) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x, y, strict=True)], np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return _common(len(sets), row, np.concatenate(sets))[x, y].astype(np.int64)


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each index the smallest index of its component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep_id, root_id, links of each set that has a link in its task; exact on the 5-gram sets."""
    for t in Groups(batches, rows=500):
        starts = [*Groups.starts(t).tolist(), t.num_rows]
        sig, side, copies = _bytes_matrix(t["sig8"], T), t["side"].to_numpy(), t["copies"].to_numpy()
        path, a, b, rep = (t[c].to_numpy() for c in ("path", "a", "b", "rep_id"))
        lists = t["paths"].to_pylist()
        ids, tops, links = [], [], []
        for s, e in zip(starts, starts[1:], strict=False):
            if e - s < 2:
                continue
            x, y = candidates(sig[s:e], side[s:e], bool(a[s] != b[s]), NEED)
            if not len(x):
                continue
            mine = first_shared([np.array(p, np.int64) for p in lists[s:e]], x, y, int(path[s]))
            x, y = x[mine], y[mine]
            sets = [shingles(v) for v in t["text"].slice(s, e - s).to_pylist()]
            sizes = np.array([len(v) for v in sets])
            both = intersections(sets, x, y)
            near = both >= THRESHOLD * (sizes[x] + sizes[y] - both) - 1e-9
            x, y = x[near], y[near]
            own = copies[s:e]
            n = np.bincount(x, own[y], e - s) + np.bincount(y, own[x], e - s)
            root, who = roots(e - s, x, y), np.flatnonzero(n)
            ids.append(rep[s + who])
            tops.append(rep[s + root[who]])
            links.append(n[who].astype(np.int64))
        cols = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (ids, tops, links)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rep_id", "root_id", "links"])


def components(edges: DataFrame, plain: int = 1_000_000) -> DataFrame:
    """Smallest id in each connected component of the edges (x, y): id, top. Written out in each round.

    Rounds alternate: every node's larger neighbours, then its smaller ones, move to the smallest
    node near it, until only stars are left, which takes a number of rounds that grows with the
    logarithm of the nodes; the number of edges never grows. Beyond `plain` edges, of 16 bytes each,
    the edges of hubs stay where they are, so that no task gets more than a bounded part of them.
    """
    spark = edges.sparkSession
    both = lambda df: df.select("x", "y").union(df.select(F.col("y").alias("x"), F.col("x").alias("y")))

    def lowest(df: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        near = df.groupBy("x").agg(F.least("x", F.min("y")).alias("m"), F.count("*").alias("n"))
        if n <= plain:
            return df.join(near, "x"), []
        near = common.written(near, "near")
        return common.by_heavy(df, near, "x", "n", near.agg(F.sum("n")).first()[0] or 0), [near]

    edges, seen = common.written(edges.where("x <> y").selectExpr("greatest(x, y) as x", "least(x, y) as y").distinct(), "edges"), None
    n = edges.count()
    while True:
        moved, near = lowest(both(edges))
        large = common.written(moved.where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct(), "edges")
        moved, close = lowest(large)
        small = moved.select(F.col("y").alias("x"), F.col("m").alias("y")).union(moved.select("x", F.col("m").alias("y"))).where("x <> y").distinct()
        new = common.written(small, "edges")
        sign = new.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        common.remove(spark, edges, large, *near, *close)
        edges, n = new, sign[0]
        if sign == seen:
            return edges.select(F.col("x").alias("id"), F.col("y").alias("top"))
        seen = sign


def possible(df: DataFrame, wanted: DataFrame, key: list[str], bits: int = 26) -> DataFrame:
    """The rows of df whose key's hash is that of some wanted key; a few others may pass, none is lost.

    The hashes make a bitmap of 2**bits bits, 8 MB in all whatever the tables' sizes, which is
    broadcast. So rows that no join needs are dropped before any shuffle.
    """
    h = F.pmod(F.xxhash64(*key, F.lit(61)), F.lit(1 << bits))
    marks = wanted.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("__bitmap"))
    df = df.withColumn("__h", h).withColumns({"__bucket": F.bitmap_bucket_number("__h"), "__at": F.bitmap_bit_position("__h")}).join(F.broadcast(marks), "__bucket")
    byte = F.conv(F.hex(F.substring("__bitmap", F.shiftright("__at", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("(__byte >> CAST(__at % 8 AS INT)) & 1 = 1")
    return df.withColumn("__byte", byte).where(hit).drop("__h", "__bucket", "__at", "__bitmap", "__byte")


def joined(docs: DataFrame, leaf: int = LEAF, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """doc_id, th (xxhash64 of the text), copy_id, class_id, n_links, is_first (of its class) for each document of docs (doc_id, text)."""
    sketch, other = numbered(common.written(sketches(docs), "sketch"))
    reps = sketch.where("n > 0").groupBy("fp").agg(F.min(F.struct(F.col("key").alias("rep_id"), F.col("doc_id").alias("doc"), "th", "sig", "sig8")).alias("rep"), F.count("*").alias("copies"))
    reps = common.written(reps.select("fp", "copies", "rep.*"), "reps")
    found = common.written(leaves(reps, leaf, depth, recall), "leaves")
    paths = found.groupBy("rep_id").agg(F.sort_array(F.collect_list("path")).alias("paths"))  # as many as runs give
    known = reps.select("rep_id", "doc", "copies", "th", "sig8").join(paths, "rep_id")
    known = common.written(known, "known")
    tasks = blocked(found, leaf).join(known, "rep_id")
    key = ["path", "a", "b"]
    active = tasks.repartition(*key).sortWithinPartitions(*key, "rep_id").select(*key, "side", "rep_id", "sig8", "paths")
    active = common.written(active.mapInArrow(_active, "path long, a int, b int, side int, rep_id long").join(known, "rep_id"), "active")
    wanted = active.select("rep_id", "doc", "th").distinct()
    if other:
        texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.xxhash64("text").alias("__th"), "text")
        wanted = wanted.select("rep_id", F.col("doc").alias("__doc"), F.col("th").alias("__th"))
        pairs = wanted.select("rep_id", F.col("__doc").alias("doc"), F.col("__th").alias("th"))
        texts = possible(texts, wanted, ["__doc", "__th"]).join(pairs, F.col("__doc").eqNullSafe(F.col("doc")) & (F.col("__th") == F.col("th"))).select("rep_id", "text")
    else:
        texts = docs.select(F.col("doc_id").cast("long").alias("rep_id"), F.xxhash64("text").alias("th"), "text")
        # An inner join on distinct keys: the optimizer would move a semi join below the bitmap's.
        texts = possible(texts, wanted, ["rep_id", "th"]).join(wanted.select("rep_id", "th"), ["rep_id", "th"]).select("rep_id", "text")
    checked = active.join(texts.dropDuplicates(["rep_id"]), "rep_id").repartition(*key).sortWithinPartitions(*key, "rep_id").select(*key, "side", "rep_id", "sig8", "paths", "copies", "text")
    rows = common.written(checked.mapInArrow(_verified, "rep_id long, root_id long, links long"), "links")
    common.remove(docs.sparkSession, found, known, active)
    tops = components(rows.select(F.col("rep_id").alias("x"), F.col("root_id").alias("y"))).withColumnRenamed("id", "rep_id")
    if other:  # a class goes by the doc_id of its first document, not by its key
        sizes = tops.groupBy("top").agg(F.count("*").alias("__n")).join(reps.select(F.col("rep_id").alias("top"), F.col("doc").alias("top_doc")), "top")
        tops = common.by_heavy(tops, common.written(sizes, "tops"), "top", "__n", tops.count()).drop("__n")
    else:
        tops = tops.withColumn("top_doc", F.col("top"))
    per_rep = rows.groupBy("rep_id").agg(F.sum("links").alias("links")).join(tops, "rep_id", "left")
    per_rep = reps.select("fp", "rep_id", "doc", "copies").join(per_rep, "rep_id", "left")
    of = sketch.select("doc_id", "th", "key", F.when(F.col("n") > 0, F.col("fp")).alias("fp")).join(per_rep, "fp", "left")
    copy = F.when(F.col("rep_id").isNull(), F.col("doc_id")).otherwise(F.col("doc"))
    links = (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long")
    first = F.coalesce("top", "rep_id", "key") == F.col("key")
    return of.select("doc_id", "th", copy.alias("copy_id"), F.when(F.col("top").isNull(), copy).otherwise(F.col("top_doc")).alias("class_id"), links.alias("n_links"), first.alias("is_first"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(common.table(spark, sf_dir, "documents")).drop("th", "is_first")
