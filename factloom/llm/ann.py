"""Operator 9: approximate nearest neighbours by a permutation index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import materialise, table
from .vectors import matrix, usable

#: Vectors picked as pivots: the bounded, documented sample that the index is fitted on.
PIVOTS = 384
#: Pivots that stand for a vector: its nearest ones, in order.
PREFIX = 64
#: Share of a block's rows that are reranked exactly.
RERANK = 0.25
#: Rows of a block whose cosines tell what a footrule distance is worth for a query.
PROBES = 64
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 4_000


def permutations(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The PREFIX nearest pivots of each vector, nearest first (largest cosine, ties to the earlier pivot)."""
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T
    k = min(PREFIX, len(pivots))
    return np.argsort(-near, axis=1, kind="stable")[:, :k]


class PivotIndex:
    """Inverted files of one block of vectors: for each pivot, the rows near it and its place in their order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray) -> None:
        self.ids, self.x, self.pivots = ids, x, pivots
        self.norm = np.linalg.norm(x, axis=1)
        order = permutations(x, pivots)
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.rows, self.places = (by // order.shape[1]).astype(np.int32), (by % order.shape[1]).astype(np.int32)
        self.bounds = np.searchsorted(flat[by], np.arange(len(pivots) + 1))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, id, inner product) of the k best found for each query, its own row left out.

        Rows are ranked by footrule distance between their pivot order and the query's: a shared
        pivot saves 2 * (PREFIX - later place), a pivot that one order lacks counts as last. Orders
        tell directions only, and nearness is an inner product: what a distance means in cosine is
        read off PROBES of the nearest rows, and rows go by that cosine times their length. The
        best RERANK of the rows, ten times k at least, are then ranked by exact inner product.
        """
        out, n = [], len(self.ids)
        most = min(n, max(int(np.ceil(RERANK * n)), 10 * k))
        prefix = permutations(queries, self.pivots)
        width = prefix.shape[1]
        for q, vector, order in zip(query_ids, queries, prefix):
            lists = [slice(self.bounds[p], self.bounds[p + 1]) for p in order]
            rows = np.concatenate([self.rows[s] for s in lists])
            saved = np.concatenate([width - np.maximum(self.places[s], i) for i, s in enumerate(lists)])
            credit = np.bincount(rows, saved, n)
            cand = np.argpartition(-self._worth(credit, vector, most), most - 1)[:most] if most < n else np.arange(n)
            cand = cand[self.ids[cand] != q]
            exact = np.einsum("ij,j->i", self.x[cand], vector)
            if len(cand) > k:
                kth = np.partition(exact, len(exact) - k)[len(exact) - k]
                best = np.flatnonzero(exact >= kth)
                cand, exact = cand[best], exact[best]
            pick = np.lexsort((self.ids[cand], -exact))[:k]
            out.append((np.full(len(pick), q), self.ids[cand[pick]], exact[pick]))
        return out


    def _worth(self, credit: np.ndarray, vector: np.ndarray, most: int) -> np.ndarray:
        """The inner product that each row's footrule distance and length lead one to expect."""
        top = np.argpartition(-credit, most - 1)[:most]
        top = top[np.argsort(-credit[top], kind="stable")]
        probe = top[np.unique(np.linspace(0, most - 1, PROBES).astype(np.int64))]
        cosine, c = self.x[probe] @ vector / self.norm[probe], credit[probe]
        spread = c - c.mean()
        slope = spread @ cosine / max(spread @ spread, 1e-300)
        return self.norm * (cosine.mean() + slope * (credit - c.mean()))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows of largest inner product found for each query.

    rows, queries: (vec_id long, embedding array of numbers); a query's own vec_id is no candidate.
    Rows are cut into blocks, each a permutation index with its inverted files; every block of
    queries meets every block of rows, in a task of bounded size, and a task returns k rows a
    query at most. Vectors that are null, empty, zero or hold null or non-finite components take
    no part, nor do vectors of another length than the query's; fewer rows than k are all
    returned; ties go to the smaller vec_id; rows that repeat a vec_id count once, with the best
    score; empty tables give no rows.
    """
    rows, queries = (usable(d).select("vec_id", "embedding", F.size("embedding").alias("dim")) for d in (rows, queries))
    n, m = rows.count(), queries.count()
    nb, mb = max(1, -(-n // block_rows)), max(1, -(-m // block_queries))
    picked: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64(F.lit(17), "vec_id"), "vec_id").limit(PIVOTS).collect():
        picked.setdefault(r["dim"], []).append(r["embedding"])
    pivots = {}
    for dim, vectors in picked.items():
        p = np.array(vectors, dtype=np.float64)
        pivots[dim] = p / np.linalg.norm(p, axis=1, keepdims=True)
    data = rows.select("*", F.lit(False).alias("is_query"), F.pmod(F.xxhash64("vec_id"), F.lit(nb)).alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(mb - 1).cast("long"))).alias("qb"))
    asked = queries.select("*", F.lit(True).alias("is_query"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))).alias("rb"), F.pmod(F.xxhash64("vec_id"), F.lit(mb)).alias("qb"))

    def search(group: pa.Table) -> pa.Table:
        dim = group["dim"][0].as_py()
        is_query = group["is_query"].to_numpy()
        ids, x = group["vec_id"].to_numpy(), matrix(group["embedding"])
        # a length that the sample lacks is ranked against its own first vectors
        p = pivots.get(dim)
        if p is None:
            p = x[np.argsort(ids)[:PIVOTS]]
            p = p / np.linalg.norm(p, axis=1, keepdims=True)
        if is_query.all() or not is_query.any():
            found = []
        else:
            index = PivotIndex(ids[~is_query], x[~is_query], p)
            found = index.search(ids[is_query], x[is_query], k)
        cat = lambda i, t: np.concatenate([f[i] for f in found]).astype(t) if found else np.zeros(0, dtype=t)
        return pa.table({"query_id": cat(0, np.int64), "vec_id": cat(1, np.int64), "score": cat(2, np.float64)})

    met = data.unionByName(asked).groupBy("rb", "qb", "dim").applyInArrow(search, "query_id long, vec_id long, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), "embedding").where("vec_id is not null")
    rows = materialise(rows.select("vec_id", "embedding"))
    return nearest(rows, rows.where("vec_id % 20 = 0"))
