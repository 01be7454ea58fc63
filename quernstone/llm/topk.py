"""Exact top-k inner products by aggregation without random access (NRA).

Candidates are dealt into blocks by a hash of their id, queries into query blocks; each
pair of blocks meets in one task. There, each dimension has a list of the block's vectors
sorted by that component. The lists are read in step, for a query from the end that gives
the largest terms. A vector's lower bound is the sum of its terms read so far and, for
its other dimensions, the smallest terms that the lists hold; the upper bound has the
terms last read instead. A query stops as soon as few vectors can have an upper bound
that reaches the k-th best lower bound; those contenders' final scores are then resolved
exactly, and nobody else's. What no bound settles before the lists end is settled there,
where both bounds are the score. The k best of each block meet in a last top k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries in a block, about.
BLOCK, QUERY_BLOCK = 8192, 32768
#: Queries of a block whose bounds are kept at once.
BATCH = 128
#: Parts of the lists after which bounds are compared.
DEPTHS = (1 / 32, 1 / 8, 1 / 2, 7 / 8, 1.0)
#: A query stops at so many contenders for each result wanted.
CONTENDERS = 8


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null if the vector or a component
    is null or not finite, or if it is empty. Components beyond 64 bits are an error."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    wide = F.raise_error(F.lit("a component is beyond 64 bits")).cast("long")
    whole = lambda x: F.when(F.abs(x.cast("double") * scale) < float(1 << 63), F.floor(x.cast("double") * scale).cast("long")).otherwise(wide)
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.transform(vector, whole))


class SortedLists:
    """The lists of one block: for each dimension the rows in ascending order.

    Queries are taken in batches. Where a list has been read to some depth, a row has its
    component there, elsewhere the least that it can have or the most; one such matrix is
    of lists read from their ends (for positive weights), one of lists read from their
    starts. A batch's bounds are products with these. stops counts the queries that
    stopped at each depth.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.whole = ids[by_id], vectors[by_id]
        self.vectors = self.whole.astype(np.float64)
        self.order = np.argsort(self.vectors, axis=0, kind="stable")
        self.largest = float(np.abs(self.vectors).max(initial=0))
        self.stops: dict[float, int] = {}
        self._held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _read(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """What rows have at least, and at most, in lists read from their ends, and beside
        them in lists read from their starts, once depth entries of each are read."""
        if depth not in self._held:
            n, columns, least, most = len(self.ids), np.arange(self.vectors.shape[1]), [], []
            for prefix, rest in ((self.order[n - depth :], self.order[0]), (self.order[:depth], self.order[-1])):
                read = np.zeros(self.vectors.shape, bool)
                read[prefix, columns] = True
                frontier = self.vectors[prefix[-1] if least else prefix[0], columns]
                least.append(np.where(read, self.vectors, self.vectors[rest, columns]))
                most.append(np.where(read, self.vectors, frontier))
            self._held[depth] = np.hstack(least), np.hstack(most)
        return self._held[depth]

    def _bounds(self, up: np.ndarray, down: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds, rows by queries, once depth entries of each list are
        read. up and down hold the queries' positive and negative weights."""
        weights = np.hstack((up, down)).T
        if depth == len(self.ids):
            lower = upper = self.vectors @ (up + down).T
        else:
            least, most = self._read(depth)
            lower, upper = least @ weights, most @ weights
        return lower, upper

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query id, id, score) of each query's k best, ties to the smaller id, of the
        rows with another id."""
        out: list[tuple[int, int, int]] = []
        n, weights = len(self.ids), queries.astype(np.float64)
        # what sums of doubles may be off by; none where they are whole numbers within 2**53
        sums = np.abs(weights).sum(axis=1) * self.largest
        slack = np.where(sums < 2.0**52, 0.0, sums * 2.0**-52 * (queries.shape[1] + 8))
        own = np.searchsorted(self.ids, query_ids, "right") - np.searchsorted(self.ids, query_ids, "left")
        wanted = k + int(own.max(initial=0))  # rows with the query's own id may be among the best
        waiting = np.arange(len(queries))
        for part in DEPTHS if wanted < n else (1.0,):
            depth = max(1, int(n * part))
            lower, upper = self._bounds(np.maximum(weights[waiting], 0), np.minimum(weights[waiting], 0), depth)
            bar = np.partition(lower, n - wanted, axis=0)[n - wanted] if wanted < n else np.full(len(waiting), -np.inf)
            able = upper >= bar - 2 * slack[waiting]
            settled = (able.sum(axis=0) <= CONTENDERS * wanted) | (depth == n)
            for j in np.flatnonzero(settled).tolist():
                out += self._resolved(query_ids[waiting[j]], queries[waiting[j]], np.flatnonzero(able[:, j]), k)
            self.stops[part] = self.stops.get(part, 0) + int(settled.sum())
            waiting = waiting[~settled]
            if not len(waiting):
                break
        return out

    def _resolved(self, query_id: int, query: np.ndarray, contenders: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        contenders = contenders[self.ids[contenders] != query_id]
        if float(np.abs(query.astype(np.float64)).sum()) * self.largest < 2.0**62:
            scores = self.whole[contenders] @ query
            best = np.lexsort((self.ids[contenders], -scores))[:k]
        else:  # whole numbers of any size
            scores = [sum(a * b for a, b in zip(row, query.tolist(), strict=True)) for row in self.whole[contenders].tolist()]
            best = sorted(range(len(scores)), key=lambda x: (-scores[x], self.ids[contenders[x]]))[:k]
            if any(not -(1 << 63) <= scores[x] < 1 << 63 for x in best):
                raise OverflowError("a score is beyond 64 bits")
        return [(int(query_id), int(self.ids[contenders[x]]), int(scores[x])) for x in best]


def _block_tops(k: int):
    def tops(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            width = max(rows["v"].map(len).max(), queries["v"].map(len).max())
            lists = SortedLists(rows["vec_id"].to_numpy(np.int64), _matrix(rows["v"], width))
            asked, weights = queries["vec_id"].to_numpy(np.int64), _matrix(queries["v"], width)
            for at in range(0, len(asked), BATCH):
                found += lists.top(asked[at : at + BATCH], weights[at : at + BATCH], k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    return tops


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best of vectors.

    Both tables have vec_id and v, an array of whole numbers (see quantised). Rows with
    a null id or v take no part; a query is not its own candidate, nor is any row of its
    id. Rows that repeat a query id ask together: the k best of all pairs of such a row
    and a candidate, so a candidate may come once for each row. If fewer than k pairs
    remain, all are given. Shorter vectors count as if padded with zeros. Candidates
    that repeat an id are rows of their own. Scores are exact, and an error beyond 64
    bits. Other columns take no part, and empty tables give an empty result.
    """
    rows = vectors.where("vec_id is not null and v is not null").select("vec_id", "v")
    asked = queries.where("vec_id is not null and v is not null").select("vec_id", "v")
    n_blocks, n_query_blocks = (max(1, -(-df.count() // size)) for df, size in ((rows, BLOCK), (asked, QUERY_BLOCK)))
    block, query_block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)), F.pmod(F.xxhash64("vec_id"), F.lit(n_query_blocks))
    left = asked.select("vec_id", "v", query_block.alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("cb"))
    right = rows.select("vec_id", "v", block.alias("cb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query_blocks - 1).cast("long"))).alias("qb"))
    tops = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(_block_tops(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return tops.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
