"""Exact top-k inner-product search by MaxScore over sharded vectors.

Every dimension and sign is a term; its posting list in a shard holds, in id order, the vectors
with such a component. Bounds on what a query's terms can add within a block of rows split them
into essential and non-essential ones: a vector in no essential posting list cannot reach the
k-th best score, so only essential postings are traversed, and the other terms are probed for the
vectors that are still competitive; a block whose terms together stay below is passed over.
Postings are built once for each shard and block of queries. Shards yield their own top k, which
are then merged.

Defined results: vectors that are null or hold null, NaN or infinite components take no part;
an empty vector scores 0; shorter vectors count as padded with zeros; rows that repeat a
query's id are never its candidates, other repeated ids are separate candidates; of repeated
query rows the smallest vector is used; ties go to the smaller id. An empty table yields no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.llm import common

RESULT = "query_id long, vec_id long, score long"


def scaled(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) for each component, or null where the vector takes no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Postings:
    """The rows of a shard by dimension and sign: positions in order and values, with what each chunk of rows can add at most."""

    def __init__(self, x: np.ndarray, chunk: int = 1024):
        self.x, self.chunk, self.starts = x, chunk, np.arange(0, len(x) + chunk, chunk)
        self.lists, blocks = [], range(0, len(x), chunk)
        for sign in (1, -1):
            for j in range(x.shape[1]):
                rows = np.flatnonzero(sign * x[:, j] > 0)
                self.lists.append((rows, x[rows, j], np.searchsorted(rows, self.starts)))
        self.high, self.low = (np.stack([f(x[i : i + chunk], axis=0) for i in blocks]) if len(x) else np.zeros((0, x.shape[1]), x.dtype) for f in (np.max, np.min))

    def of(self, j: int, q, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a block, counted from its start, to which dimension j of a query adds a positive amount, and their values."""
        rows, values, at = self.lists[j if q > 0 else self.x.shape[1] + j]
        part = slice(at[block], at[block + 1])
        return rows[part] - self.starts[block], values[part]


def maxscore(ids: np.ndarray, postings: Postings, query_id: int, q: np.ndarray, k: int, work: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows (ordered by id) for q: their positions and scores. work counts postings read, rows scored and blocks passed over."""
    x, n = postings.x, len(postings.x)
    best, at = np.empty(0, x.dtype), np.empty(0, np.int64)
    work = {} if work is None else work
    for block, start in enumerate(range(0, n, postings.chunk)):
        size = min(postings.chunk, n - start)
        most = np.maximum(0, np.maximum(q * postings.high[block], q * postings.low[block]))
        order = np.argsort(most, kind="stable")  # least useful term first
        reach = np.cumsum(most[order])  # what the first i + 1 terms can add together
        full = len(best) >= k
        bar = best[k - 1] if full else None
        if full and reach[-1] < bar:
            work["passed"] = work.get("passed", 0) + 1
            continue
        # order[:cut] is non-essential: together these terms stay below the k-th best score.
        cut = int(np.searchsorted(reach, bar, side="left")) if full else 0
        listed, plus = np.zeros(size, bool), np.zeros(size, x.dtype)
        for j in order[cut:].tolist():
            if q[j] and most[j]:
                rows, values = postings.of(j, q[j], block)
                plus[rows] += values * q[j]
                listed[rows] = True
                work["postings"] = work.get("postings", 0) + len(rows)
        if not full or not (cut or bar > 0):
            listed[:] = True  # a row in no posting list, at 0 or below, can still be among the best
        listed &= ids[start : start + size] != query_id
        own = np.flatnonzero(listed)
        if full and cut:
            own = own[plus[own] + reach[cut - 1] >= bar]
        essential = order[cut:]
        score = x[own + start][:, essential] @ q[essential]  # with what these terms take away
        for hi in range(cut, 0, -8):  # probe the most promising of the rest first
            lo = max(0, hi - 8)
            alive = score + reach[hi - 1] >= bar
            own, score = own[alive], score[alive]
            if not len(own):
                break
            score = score + x[np.ix_(own + start, order[lo:hi])] @ q[order[lo:hi]]
        work["scored"] = work.get("scored", 0) + len(own)
        best, at = np.concatenate([best, score]), np.concatenate([at, own + start])
        top = np.lexsort((ids[at], -best))[:k]
        best, at = best[top], at[top]
    return at, best


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _searcher(k: int):
    def search(group: pa.Table) -> pa.Table:
        ids = group["vec_id"].to_numpy()
        width = max([1, *(n or 0 for n in pa.compute.list_value_length(group["ints"]).to_pylist())])
        x, asks = _matrix(group["ints"], width), group["asks"].to_numpy()
        docs, asked = np.flatnonzero(~asks), np.flatnonzero(asks)
        docs = docs[np.argsort(ids[docs], kind="stable")]
        found: tuple[list, list, list] = ([], [], [])
        if len(docs) and len(asked):
            d, q = x[docs], x[asked]
            if float(np.abs(d).max()) * float(np.abs(q).max()) * width < 2**52:  # sums stay exact in doubles
                d, q = d.astype(np.float64), q.astype(np.float64)
            postings = Postings(d)
            for i, row in zip(asked, q, strict=True):
                at, score = maxscore(ids[docs], postings, ids[i], row, k)
                found[0].append(np.full(len(at), ids[i], np.int64))
                found[1].append(ids[docs][at])
                found[2].append(score.astype(np.int64))
        cols = [np.concatenate(c) if c else np.empty(0, np.int64) for c in found]
        return pa.table(cols, names=["query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 32768, block_rows: int = 8192) -> DataFrame:
    """vectors, queries: (vec_id long, ints array<long>). Returns query_id, rank, vec_id, score.

    Both sides meet per (shard of vectors, block of queries): a group holds at most about
    shard_rows + block_rows rows, whatever the tables' sizes.
    """
    spark = vectors.sparkSession
    n, nq = vectors.count(), queries.count()
    shards = max(common.partitions(spark), -(-n // shard_rows))
    blocks = max(1, -(-nq // block_rows))
    docs = vectors.select(
        "vec_id", "ints", F.lit(False).alias("asks"), F.expr(f"int(pmod(xxhash64(vec_id, 17), {shards}))").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    )
    asks = queries.groupBy("vec_id").agg(F.min("ints").alias("ints")).select(
        "vec_id", "ints", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.expr(f"int(pmod(xxhash64(vec_id, 5), {blocks}))").alias("block")
    )
    each = docs.unionByName(asks).groupBy("shard", "block").applyInArrow(_searcher(k), RESULT)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", scaled(F.col("embedding")).alias("ints")).where("vec_id is not null and ints is not null")
    return top_k(rows, rows.where("vec_id % 100 = 0"))


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, d.vec_id as vec_id,
    cast(coalesce(list_sum(list_transform(range(1, least(len(q.e), len(d.e)) + 1), lambda i: q.e[i] * d.e[i])), 0) as bigint) as score
  from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 100 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""
