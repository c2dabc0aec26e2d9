"""Nearest neighbours by inner product: collision-counting hashing.

Every vector is projected on single random lines; per line the projections are
kept sorted.  A query looks at windows centred on its own projection, which
grow round by round (virtual rehashing: no table is built twice).  A vector that
falls into the windows of at least ``share`` of the lines is verified with the
exact measure.  The search of a query ends when its k-th best is no farther than
the radius that the windows stand for: nearer vectors have been met with high
probability then.

Largest inner products become nearest points on a sphere: vectors are divided
by the greatest norm of their block and given one more component that makes
their norm 1; queries are normalised.

Rows are dealt into blocks by hash of their id, queries into groups; each pair
of a block and a group is one bounded task that returns k rows per query, and
those of all blocks are merged.  All rows are indexed, none is sampled.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those whose length is not the most common one
(the smallest of equally common ones); rows that share an id count once, with
the least vector; equal vectors tie, smaller ids first; an empty table gives an
empty result; fewer than k candidates are all returned.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ensure_columns

LINES = 64
WIDTH = 1.0
SHARE = 0.58
FIRST, GROWTH = 0.5, 1.25
BLOCK_ROWS = 8_192
GROUP_ROWS = 2_048
SEED = 7


@lru_cache(4)
def _lines(size: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, count))


class Index:
    """Sorted projections of a block of vectors (rows of ``vectors``, with ascending ``ids`` for equal ones)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: int = LINES, seed: int = SEED, copies: int = 21):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        # Equal vectors are one; of their ids the first ``copies`` can be among a query's nearest.
        _, first, which = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        by = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[by], np.arange(len(first) + 1))
        self.ids = [ids[by[a : min(b, a + copies)]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.vectors = vectors[first].astype(np.float64)
        norm = np.sqrt((self.vectors**2).sum(axis=1))
        self.scale = norm.max()
        lifted = np.concatenate([self.vectors / self.scale, np.sqrt(np.maximum(0, 1 - (norm / self.scale) ** 2))[:, None]], axis=1)
        self.lines = _lines(lifted.shape[1], lines, seed)
        projected = lifted @ self.lines
        self.order = np.argsort(projected, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.take_along_axis(projected.T, self.order.astype(np.int64), axis=1)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float = SHARE) -> list[tuple[int, int, float]]:
        """(query id, vector id, inner product) of the nearest found, at most k per query, its own id left out."""
        queries = queries.astype(np.float64)
        norms = np.sqrt((queries**2).sum(axis=1))
        n, m = len(self.vectors), len(self.order)
        projected = (np.concatenate([queries / norms[:, None], np.zeros((len(queries), 1))], axis=1) @ self.lines).T
        need = max(1, int(np.ceil(share * m)))
        counts = np.zeros((len(queries), n), np.uint8 if m < 256 else np.int32)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        low = np.stack([np.searchsorted(s, p) for s, p in zip(self.sorted, projected, strict=True)])
        high = low.copy()
        open_, radius = np.arange(len(queries)), FIRST
        while len(open_):
            reach = WIDTH * radius
            all_in = radius >= 2.0  # no two points of the sphere are farther apart
            left = np.stack([np.searchsorted(s, p, "left") for s, p in zip(self.sorted, projected[:, open_] - reach, strict=True)])
            right = np.stack([np.searchsorted(s, p, "right") for s, p in zip(self.sorted, projected[:, open_] + reach, strict=True)])
            still = []
            for i, q in enumerate(open_.tolist()):
                if all_in:
                    new = np.flatnonzero(counts[q] < need)
                else:
                    rings = [r for o, a, b, c, d in zip(self.order, left[:, i].tolist(), low[:, q].tolist(), high[:, q].tolist(), right[:, i].tolist(), strict=True) for r in (o[a:b], o[c:d])]
                    more = np.bincount(np.concatenate(rings), minlength=n)
                    before = counts[q]
                    after = before + more
                    new = np.flatnonzero((before < need) & (after >= need))
                    counts[q] = after
                if len(new):
                    at, score = best[q]
                    # summed along each row by itself, so equal vectors have equal scores everywhere
                    at, score = np.concatenate([at, new]), np.concatenate([score, (self.vectors[new] * queries[q]).sum(axis=1)])
                    if len(at) > k + 1:
                        keep = score >= np.partition(score, len(score) - (k + 1))[len(score) - (k + 1)]
                        at, score = at[keep], score[keep]
                    best[q] = at, score
                found = best[q][1]
                if all_in:
                    continue
                if len(found) > k:
                    worst = np.partition(found, len(found) - (k + 1))[len(found) - (k + 1)]
                    if 2 - 2 * worst / (self.scale * norms[q]) <= radius**2:
                        continue
                still.append(q)
            kept = np.isin(open_, still)
            low[:, open_], high[:, open_] = left, right
            open_, radius = open_[kept], radius * GROWTH
        out: list[tuple[int, int, float]] = []
        for q, (at, score) in zip(query_ids.tolist(), best, strict=True):
            hits = sorted((-s, int(i)) for a, s in zip(at.tolist(), score.tolist(), strict=True) for i in self.ids[a] if i != q)
            out += [(q, i, -s) for s, i in hits[:k]]
        return out


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    vectors = table.column("vector").combine_chunks()
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    return table.column("id").to_numpy().astype(np.int64), values.reshape(len(vectors), -1)


def nearest(vectors: DataFrame, queries: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", lines: int = LINES, share: float = SHARE, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of ``vectors`` for which ``queries`` holds, among all others."""
    ensure_columns(vectors, id_col, vector_col)
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), queries.alias("query")).where(F.col("id").isNotNull() & F.col("vector").isNotNull() & whole)
    with Scratch(vectors.sparkSession, "ann") as scratch:
        rows = scratch.table(rows.groupBy("id").agg(F.min("vector").alias("vector"), F.max("query").alias("query")))
        sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"), F.count(F.when(F.col("query"), 1)).alias("q")).collect()
        if not sizes:
            return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        size, n, n_queries = min(((r["size"], r["n"], r["q"]) for r in sizes), key=lambda x: (-x[1], x[0]))
        rows = rows.where(F.size("vector") == size)
        blocks, groups = max(1, -(-n // block_rows)), max(1, -(-n_queries // group_rows))
        every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        part = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
        left = rows.select("id", "vector", part(blocks).alias("block"), every(groups).alias("group"))
        right = rows.where("query").select("id", "vector", part(groups).alias("group"), every(blocks).alias("block"))
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

        def search(data: pa.Table, asked: pa.Table) -> pa.Table:
            if not data.num_rows or not asked.num_rows:
                return schema.empty_table()
            index = Index(*_matrix(data), lines=lines, copies=k + 1)
            ids, wanted = _matrix(asked)
            found = []
            for i in range(0, len(ids), 256):
                found += index.search(ids[i : i + 256], wanted[i : i + 256], k, share)
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema) if found else schema.empty_table()

        found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(search, "query_id long, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return scratch.keep(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
