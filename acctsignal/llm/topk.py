"""Exact top-k search by inner product: every pair is scored, and histograms of the scores find each k-th value.

Queries go through the candidates in blocks. A pass counts each query's scores by bins of its open score interval;
summed over all tasks, the counts tell in which bin the k-th highest score lies. The interval shrinks to that bin until it
is one value. A last pass keeps the scores from that value up, and ties at it go to the smaller ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acctsignal.session import materialize

#: Queries scored in one pass over the candidates: the block is sent to every task.
QUERIES_AT_ONCE = 1024
#: Bins of a query's open interval.
BINS = 2048
#: Pairs scored at once inside a task.
_PAIRS_AT_ONCE = 1 << 20
#: Whole numbers up to this size are exact as doubles.
_EXACT = 1 << 53


def integer_vectors(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component x as double; null or non-finite vectors are left out."""
    x = F.col(vector)
    usable = (F.col(key).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull()
              & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))))
    return vectors.where(usable).select(
        F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _by_length(ids: list, vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix (whole numbers as doubles) of the vectors of each length."""
    found: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        found.setdefault(len(v), []).append(i)
    return {n: (np.array([ids[i] for i in at], np.int64), np.array([vectors[i] for i in at], np.float64).reshape(len(at), n))
            for n, at in found.items()}


class QueryBlock:
    """Queries of one pass with the score interval ``low`` to ``low + bins * width`` of each that is still open."""

    def __init__(self, ids: list[int], vectors: list[np.ndarray], bound: int):
        self.parts = _by_length(list(range(len(ids))), vectors)
        self.ids = np.array(ids, np.int64)
        self.low = np.full(len(ids), -bound, np.int64)
        self.high = np.full(len(ids), bound + 1, np.int64)  # the first score above the interval
        self.width = -(-(2 * bound + 1) // BINS)  # of a bin
        self.above = np.zeros(len(ids), np.int64)  # pairs with a score above the interval

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query positions, candidate ids, score matrix); a query's own row has the smallest 64-bit number."""
        rows = [np.asarray(v.values.to_numpy(), np.float64) for v in batch.column(1)]
        for n, (ids, matrix) in _by_length(batch.column(0).to_pylist(), rows).items():
            if n not in self.parts:
                continue
            at, queries = self.parts[n]
            step = max(1, _PAIRS_AT_ONCE // len(at))
            for first in range(0, len(ids), step):
                part = ids[first:first + step]
                scores = (queries @ matrix[first:first + step].T).astype(np.int64)
                scores[self.ids[at][:, None] == part[None, :]] = np.iinfo(np.int64).min
                yield at, part, scores


def _histogram(block: QueryBlock, k: int):
    """Counts of the scores in the bins of the open interval, from the k-th highest of the task up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(block.ids), BINS), np.int32)
        for batch in batches:
            for at, _, scores in block.scores(batch):
                q, c = np.nonzero((scores >= block.low[at][:, None]) & (scores < block.high[at][:, None]))
                slot = at[q] * BINS + (scores[q, c] - block.low[at[q]]) // block.width
                used, times = np.unique(slot, return_counts=True)
                counts.reshape(-1)[used] += times.astype(np.int32)
        # bins below the task's own k-th score in the interval cannot hold the k-th score of all tasks
        from_above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (from_above < k))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(b, pa.int64()),
                                          pa.array(counts[q, b], pa.int64())], ["q", "b", "n"])

    return run


def _highest(block: QueryBlock, k: int):
    """The task's k best pairs of each query among those with at least the query's k-th score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_kept, ids_kept, s_kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for at, ids, scores in block.scores(batch):
                q, c = np.nonzero((scores >= block.low[at][:, None]) & (scores > np.iinfo(np.int64).min))
                q_kept = np.r_[q_kept, at[q]]
                ids_kept, s_kept = np.r_[ids_kept, ids[c]], np.r_[s_kept, scores[q, c]]
                order = np.lexsort((ids_kept, -s_kept, q_kept))
                q_kept, ids_kept, s_kept = q_kept[order], ids_kept[order], s_kept[order]
                first = np.searchsorted(q_kept, q_kept)
                best = np.arange(len(q_kept)) - first < k
                q_kept, ids_kept, s_kept = q_kept[best], ids_kept[best], s_kept[best]
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[q_kept]), pa.array(ids_kept), pa.array(s_kept)],
                                         ["query_id", "vec_id", "score"])

    return run


def _narrow(block: QueryBlock, counts: pa.Table, k: int) -> bool:
    """Shrink each interval to the bin that holds the k-th score; whether bins were wider than one score.

    A query with fewer than k scores keeps the lower end, which lets all of them pass, and has no interval any more.
    """
    table = np.zeros((len(block.ids), BINS + 1), np.int64)
    table[counts["q"].to_numpy(), counts["b"].to_numpy()] = counts["n"].to_numpy()
    at_least = block.above[:, None] + np.cumsum(table[:, ::-1], axis=1)[:, ::-1]
    enough = at_least[:, 0] >= k
    last = np.sum(at_least >= k, axis=1) - 1  # the highest bin from which up there are k scores
    block.above = np.where(enough, at_least[np.arange(len(last)), last + 1], block.above)
    low = block.low + last * block.width
    block.high = np.where(enough, np.minimum(low + block.width, block.high), block.low)
    block.low = np.where(enough, low, block.low)
    wide, block.width = block.width > 1, -(-block.width // BINS)
    return wide


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", *,
          scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest inner products, ties to the smaller id.

    Components are turned into whole numbers first. A candidate with the query's own id takes no part, nor do
    vectors that are null, hold null or non-finite components, have no id, or have another length than the query.
    Repeated candidates count each; of several queries with one id the smallest vector counts. Products that a double can't hold exactly are an error. Queries are scored
    ``QUERIES_AT_ONCE`` at a time, which bounds what is sent to a task and counted by the driver.
    """
    spark = candidates.sparkSession
    rows = materialize(integer_vectors(candidates, key, vector, scale), "vectors")
    asked = materialize(integer_vectors(queries, key, vector, scale), "queries")
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    longest = [df.agg(F.sqrt(F.max(norm))).first()[0] or 0.0 for df in (rows, asked)]
    bound = int(longest[0] * longest[1] * (1 + 1e-9)) + 1
    if bound >= _EXACT:
        raise ValueError("inner products are too large to be exact")
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    total = asked.count()
    blocks = 1 if total <= QUERIES_AT_ONCE else -(-5 * total // (4 * QUERIES_AT_ONCE))
    placed = materialize(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "blocks")
    found = None
    for (part,) in placed.select("block").distinct().orderBy("block").collect():
        mine = placed.where(F.col("block") == part).toArrow()
        block = QueryBlock(mine["vec_id"].to_pylist(), [np.array(v, np.float64) for v in mine["v"].to_pylist()], bound)
        wide = True
        while wide:
            counts = (rows.mapInArrow(_histogram(block, k), "q long, b long, n long")
                      .groupBy("q", "b").agg(F.sum("n").alias("n")).toArrow())
            wide = _narrow(block, counts, k)
        kept = materialize(rows.mapInArrow(_highest(block, k), "query_id long, vec_id long, score long"), "highest")
        found = kept if found is None else found.union(kept)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
