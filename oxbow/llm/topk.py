"""Exact top-k inner-product search by columnar branch-and-bound.

Vectors are quantised to integers. Candidates stay where they lie; blocks of queries, of bounded size, are broadcast to them one after
the other. A task lays out its candidates by dimension and adds up scores one group of dimensions at a time. After each group a pair
of query and candidate is dropped where even the most that the remaining dimensions can add, the product of the remaining norms
(Cauchy-Schwarz), does not reach the query's floor; candidates that no query of a chunk needs any more are compacted away, and once few
pairs are left these go on as pairs. A query's floor is its exact k-th best score so far, carried from batch to batch. A window over
the tasks' winners gives the top k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K = 20
SCALE = 64
QUERY_EVERY = 20
CANDIDATE_BLOCK = 8_192
#: Queries a broadcast: QUERY_BLOCK vectors of integers, however many queries there are.
QUERY_BLOCK = 8_192
DIMENSION_GROUP = 16
#: Below this share of live pairs a chunk goes on pair by pair.
FEW_PAIRS = 0.02
_CHUNK = 256


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v, dim) with v = floor(scale * x) as longs, without vectors that are null or hold null or non-finite components.

    `row` numbers the rows, so that rows of one id stay apart; rows without an id take no part.
    """
    x = F.col(vector_col)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    whole = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, finite))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return whole.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), ints.alias("v"), F.size(ints).alias("dim")
    )


def limbs(vectors: np.ndarray, most: int) -> list[tuple[int, np.ndarray]]:
    """(shift, part) with the vectors as the sum of part << shift, parts below 2^most in size and as exact doubles."""
    found, shift, rest = [], 0, vectors.astype(np.int64)
    while True:
        low = rest & ((1 << most) - 1)
        rest = rest >> most  # floor: the last part carries the sign
        if ((rest == 0) | (rest == -1)).all():  # nothing but the signs is left
            found.append((shift, (low + (rest << most)).astype(np.float64)))
            return found
        found.append((shift, low.astype(np.float64)))
        shift += most


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, row by row, exact: as longs, or as Python integers where these may be
    too large for a long. Products beyond exact doubles are added up from limbs."""
    dim = max(a.shape[1], 1)
    size_a, size_b = (float(np.abs(x.astype(float)).max(initial=0)) for x in (a, b))
    if size_a * size_b * dim < 2.0**52:
        return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)
    most = (52 - int(dim).bit_length()) // 2
    total: np.ndarray | int = np.zeros(len(a), object)
    for shift_a, part_a in limbs(a, most):
        for shift_b, part_b in limbs(b, most):
            part = np.einsum("ij,ij->i", part_a, part_b)
            total = total + np.array([int(x) << (shift_a + shift_b) for x in part.tolist()], object)
    return total


class Search:
    """The k best candidates of each query of a block, over batches of candidates; ties go to the smaller id.

    Rows have an id and a number of their own (where none is given, the id); a query's own row is no candidate for it.

    `alive` sums up, for each group of dimensions, the pairs that its bound left and the pairs there were.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, group: int = DIMENSION_GROUP, own: np.ndarray | None = None):
        self.ids, self.queries, self.k, self.group = ids, queries, k, group
        self.own = ids if own is None else own
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), sorted
        self.floor = np.full(len(ids), -np.inf)
        self.alive: dict[int, list[int]] = {}

    def add(self, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray | None = None) -> None:
        n, dim = vectors.shape
        own = ids if own is None else own
        if not n or not len(self.ids):
            return
        real, asked = vectors.astype(np.float64), self.queries.astype(np.float64)
        order = np.argsort(-np.square(real).sum(axis=0), kind="stable")  # heaviest dimensions first
        columns, rows = np.ascontiguousarray(real.T[order]), asked[:, order]
        spans = [slice(a, min(a + self.group, dim)) for a in range(0, dim, self.group)] or [slice(0, 0)]
        tails = [(np.sqrt(np.square(rows[:, s.stop :]).sum(axis=1)), np.sqrt(np.square(columns[s.stop :]).sum(axis=0))) for s in spans]
        # Rounding of sums and bounds, far below 1 while scores are exact doubles.
        slack = 0.25 + 2.0**-40 * (np.sqrt(np.square(rows).sum(axis=1)).max() * np.sqrt(np.square(columns).sum(axis=0)).max())
        for begin in range(0, len(rows), _CHUNK):
            at = slice(begin, begin + _CHUNK)
            floor, lead = self.floor[at], rows[at]
            left = np.arange(n)
            score = np.zeros((len(lead), n))
            pairs = None
            for g, span in enumerate(spans):
                if pairs is None:
                    score += lead[:, span] @ columns[span][:, left]
                    if g == 0:
                        self._raise_floors(at, score, own, vectors)
                        floor = self.floor[at]
                    open_ = score + tails[g][0][at, None] * tails[g][1][None, left] >= (floor - slack)[:, None]
                    share = open_.mean()
                    self._count(g, int(open_.sum()), n * len(lead))
                    if share < FEW_PAIRS or g == len(spans) - 1:
                        i, j = np.nonzero(open_)
                        pairs, sums = (i, left[j]), score[i, j]
                    else:
                        needed = open_.any(axis=0)
                        if not needed.all():
                            left, score = left[needed], score[:, needed]
                else:
                    i, j = pairs
                    sums = sums + np.einsum("ij,ji->i", lead[i, span], columns[span][:, j])
                    open_ = sums + tails[g][0][begin + i] * tails[g][1][j] >= floor[i] - slack
                    self._count(g, int(open_.sum()), n * len(lead))
                    pairs, sums = (i[open_], j[open_]), sums[open_]
            self._merge(begin, *pairs, ids, own, vectors)

    def _raise_floors(self, at: slice, score: np.ndarray, own: np.ndarray, vectors: np.ndarray) -> None:
        """Exact scores of the candidates that lead after the first group, where a query has no floor yet."""
        for i in np.flatnonzero(np.isinf(self.floor[at])):
            if len(own) > self.k:
                first = np.argpartition(-score[i], min(4 * self.k, len(own) - 1))[: 4 * self.k]
                first = first[own[first] != self.own[at][i]]
                if len(first) >= self.k:
                    exact = exact_scores(np.broadcast_to(self.queries[at][i], vectors[first].shape), vectors[first])
                    self.floor[at.start + i] = float(sorted(exact.tolist(), reverse=True)[self.k - 1])

    def _merge(self, begin: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray, own: np.ndarray, vectors: np.ndarray) -> None:
        other = own[j] != self.own[begin + i]
        i, j = i[other], j[other]
        exact = exact_scores(self.queries[begin + i], vectors[j])
        edges = np.searchsorted(i, np.arange(len(self.ids[begin : begin + _CHUNK]) + 1))
        for q, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                found = self.best[begin + q] + [(-int(s), int(c)) for s, c in zip(exact[a:b].tolist(), ids[j[a:b]].tolist())]
                self.best[begin + q] = best = sorted(found)[: self.k]
                if len(best) == self.k:
                    self.floor[begin + q] = max(self.floor[begin + q], float(-best[-1][0]))

    def _count(self, group: int, open_: int, of: int) -> None:
        seen = self.alive.setdefault(group, [0, 0])
        seen[0], seen[1] = seen[0] + open_, seen[1] + of

    def rows(self) -> list[tuple[int, int, int]]:
        """(query id, id, score)."""
        return [(int(q), c, -s) for q, best in zip(self.ids, self.best) for s, c in best]

    def owners(self) -> list[int]:
        """The query's own row number for each of `rows`."""
        return [int(o) for o, best in zip(self.own, self.best) for _ in best]


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, group: int = DIMENSION_GROUP
) -> list[tuple[int, int, int]]:
    """(query id, id, score) of each query's k best among `vectors` (one row each, integers), ties to the smaller id."""
    search = Search(query_ids, queries, k, group)
    search.add(ids, vectors)
    return search.rows()


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    every: int = QUERY_EVERY,
    candidate_block: int = CANDIDATE_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best among all other rows, or all of them if fewer.

    Queries are the rows whose id is divisible by `every`, rows that share an id each for itself; such rows are candidates for each other.
    Vectors are compared with those of the same length only. Ties go to the smaller id. See `quantise` for nulls; scores beyond a long fail; an empty table gives an empty result; other
    columns are ignored. The driver sees one block of `query_block` queries at a time; each block is one pass over the candidates.
    """
    spark = vectors.sparkSession
    rows = quantise(vectors, id_col, vector_col)
    rows = cut(rows.repartition(max(1, -(-vectors.count() // candidate_block)), "row"))
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // query_block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(blocks)))
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    results: DataFrame | None = None
    for block in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.col("block") == block)).select("row", "vec_id", "v", "dim").toPandas()
        by_dim = {int(d): (g["vec_id"].to_numpy(), np.stack(g["v"].to_numpy()), g["row"].to_numpy()) for d, g in part.groupby("dim")}
        sent = spark.sparkContext.broadcast(by_dim)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            searches = {d: Search(ids, queries, k, own=own) for d, (ids, queries, own) in sent.value.items()}
            for batch in batches:
                for d, g in batch.groupby("dim"):
                    if d in searches:
                        searches[d].add(g["vec_id"].to_numpy(), np.stack(g["v"].to_numpy()), g["row"].to_numpy())
            found = [(o, *r) for s in searches.values() for o, r in zip(s.owners(), s.rows())]
            yield pd.DataFrame(found, columns=["query_row", "query_id", "vec_id", "score"]).astype("int64")

        best = rows.mapInPandas(run, "query_row long, query_id long, vec_id long, score long")
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if blocks > 1:
            ranked = cut(ranked)
        results = ranked if results is None else results.unionByName(ranked)
    return results.select("query_id", "rank", "vec_id", "score")
