"""Exact top-k inner products by reading sorted lists, without random access."""

from __future__ import annotations

from dataclasses import dataclass
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from glosswork.llm.storage import materialise

_EXACT = 1 << 53  # below it, all bounds of a block are exact in doubles
_RESULT = "query_row long, query_id long, vec_id long, score long"


@dataclass(frozen=True)
class ListParams:
    """Sizes of the blocks that meet in a task, and when the lists need not be read further."""

    candidates_per_block: int = 8192
    queries_per_block: int = 4096
    queries_at_once: int = 128
    finalists: int = 2048
    depths: tuple[float, ...] = (0.5, 0.75, 1.0)  # shares of the lists; the last must be the whole
    scale: float = 256.0


def _integers(vectors: pa.Array, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) of each component; Python integers where some are too large to add as doubles."""
    scaled = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dims))
    if np.abs(scaled).max(initial=0.0) < _EXACT:
        return scaled
    return np.array([[floor(x) for x in row] for row in scaled], object).reshape(scaled.shape)


class SortedLists:
    """One list of a block's candidates for each dimension, in the order of their components."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        order = np.argsort(vectors, axis=0, kind="stable").T
        self.values = np.take_along_axis(vectors.T, order, axis=1)
        self.place = np.empty(order.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(len(vectors), dtype=np.int32)[None, :], axis=1)

    def bounds(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores (queries x candidates) when all lists have been read to ``depth``.

        A query reads a list from its high end where its own component is positive, else from its low end. What has not
        been met in a list adds at least the worst of its products, and at most that of the place read last. Which
        candidates an end shows is the same for all queries, so the bounds of many are a few matrix products.
        """
        n, kind = len(self.vectors), self.vectors.dtype
        high, low = np.maximum(queries, 0), np.minimum(queries, 0)
        shown = np.vstack([self.place >= n - depth, self.place < depth]).astype(kind)
        met = np.hstack([high, low]) @ (shown * np.vstack([self.vectors.T, self.vectors.T]))
        first, last = self.values[:, 0], self.values[:, -1]
        worst = np.hstack([high * first, low * last])
        here = np.hstack([high * self.values[:, n - depth], low * self.values[:, depth - 1]])
        lower = met + worst.sum(axis=1)[:, None] - worst @ shown
        upper = met + here.sum(axis=1)[:, None] - here @ shown
        return lower, upper

    def finalists(self, queries: np.ndarray, k: int, p: ListParams) -> list[np.ndarray]:
        """For each query, candidates among which are all that have one of its k highest scores, ties included.

        All lists are read to the depths of ``p.depths`` one after the other. Candidates whose upper bound is below the
        k-th lower bound are out, those that no list has shown yet like the others. A query stops when at most
        ``finalists`` are left, or at the lists' end, where the bounds are the scores.
        """
        n = len(self.vectors)
        found = [np.arange(n)] * len(queries)
        open_rows = np.arange(len(queries)) if n > max(k, p.finalists) else np.zeros(0, np.int64)
        for share in p.depths:
            late = []
            for rows in np.array_split(open_rows, -(-len(open_rows) // p.queries_at_once)) if len(open_rows) else []:
                lower, upper = self.bounds(queries[rows], min(n, int(-(-n * share // 1))))
                least = np.partition(lower, n - k, axis=1)[:, n - k]
                alive = upper >= least[:, None]
                for row, left in zip(rows, alive, strict=True):
                    found[row] = np.flatnonzero(left)
                late.append(rows[alive.sum(axis=1) > p.finalists])
            open_rows = np.concatenate(late) if late else open_rows
        return found


def _block_answers(candidates: pa.Table, queries: pa.Table, k: int, p: ListParams) -> pa.Table:
    """The k best candidates of one block for each query of another; fewer if the block has fewer."""
    out: list[tuple] = []
    if candidates.num_rows and queries.num_rows:
        dims = candidates["dims"][0].as_py()
        mine, theirs = (_integers(t["vector"].combine_chunks(), dims, p.scale) for t in (candidates, queries))
        reach = int(abs(mine).max(initial=0)) * int(abs(theirs).max(initial=0)) * max(dims, 1) * 4
        exact = np.float64 if reach < _EXACT else object  # sums of products as doubles, or as Python integers
        mine, theirs = mine.astype(exact), theirs.astype(exact)
        ids = candidates["id"].combine_chunks()
        rows = candidates["row"].to_numpy()
        names = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        unnamed = ids.is_null().to_numpy(zero_copy_only=False)
        found = SortedLists(mine).finalists(theirs, k + 1, p)  # one more, as the query itself may be in the block
        for row, name, query, left in zip(queries["row"].to_pylist(), queries["id"].to_pylist(), theirs, found, strict=True):
            left = left[rows[left] != row]
            scores = mine[left] @ query if dims else np.zeros(len(left))
            if len(left) > k:
                best = scores >= np.partition(scores, len(left) - k)[len(left) - k]
                left, scores = left[best], scores[best]
            first = np.lexsort((rows[left], names[left], unnamed[left], -scores))[:k]
            out += [(row, name, ids[int(i)].as_py(), int(s)) for i, s in zip(left[first], scores[first], strict=True)]
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_row", "query_id", "vec_id", "score"])


def usable(vector: Column, scale: float) -> Column:
    """Whether a vector is given and its scaled components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x * scale) & (F.abs(x * scale) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def top_inner_products(
    rows: DataFrame, is_query: Column, k: int, params: ListParams = ListParams(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row with all other rows.

    Components become floor(scale * x). Candidates and queries are dealt into blocks of bounded size; every block of
    queries meets every block of candidates in a task of its own, which answers from sorted lists of that block, and the
    answers, k a block at most, are merged. Ties go to the smaller id, null ids come last. Vectors that are null or hold null or non-finite components take no part; vectors of different lengths are not compared. Every row counts: a repeated row
    is a candidate for its twin, and a query of its own. A score beyond 64 bits raises an error. ``is_query`` is an
    expression over the columns of ``rows``; a null means no. Other columns are not read.
    """
    thin = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    thin = thin.where(usable(F.col("vector"), params.scale)).withColumn("row", F.monotonically_increasing_id())
    thin = materialise(thin.withColumn("dims", F.size("vector")), "topk-vectors")
    total, asking = thin.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks, groups = (max(1, -(-n // most)) for n, most in ((total, params.candidates_per_block), (asking, params.queries_per_block)))

    def dealt(side: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        numbers = F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))
        return side.select("dims", F.pmod(F.xxhash64("row"), F.lit(n_own)).alias(own), F.explode(numbers).alias(other), "row", "id", "vector")

    keys = ["dims", "block", "part"]
    candidates = dealt(thin, "block", blocks, "part", groups).groupBy(*keys)
    queries = dealt(thin.where("asks"), "part", groups, "block", blocks).groupBy(*keys)
    answers = candidates.cogroup(queries).applyInArrow(lambda a, b: _block_answers(a, b, k, params), _RESULT)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
