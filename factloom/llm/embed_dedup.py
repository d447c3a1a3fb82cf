"""Operator 8: near-duplicate vectors by cross-polytope hashing, multiprobe buckets and verified pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialise, table
from .components import components
from .vectors import matrix, usable

#: Hash tables; each joins two cross-polytope hashes, each taken at its two nearest vertices.
#: A pair of 64 components at cosine 0.93 meets in a table with probability 0.78, so misses all with 5e-6.
TABLES = 8
PROBES = 2
#: Rows of a bucket that are compared in one task; larger buckets are cut into pairs of such blocks.
BLOCK = 2048
#: Buckets up to this size are compared together.
SMALL = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), -1, 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def codes(x: np.ndarray) -> np.ndarray:
    """Buckets of each vector: TABLES * PROBES**2 numbers, those of a table together."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    out = []
    for t in range(TABLES):
        probes = []
        for h in range(2):
            rng, y = np.random.default_rng([t, h, size]), x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            far = np.abs(y)
            top = np.argpartition(-far, PROBES - 1, axis=1)[:, :PROBES]
            probes.append(top * 2 + (np.take_along_axis(y, top, 1) < 0))
        both = probes[0][:, :, None] * (2 * size) + probes[1][:, None, :]
        out.append(t * (2 * size) ** 2 + both.reshape(len(x), -1))
    return np.concatenate(out, axis=1).astype(np.int64)


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest common bucket of rows that have one."""
    width = PROBES**2
    out = np.full(len(a), -1, dtype=np.int64)
    for t in range(TABLES):
        left = np.flatnonzero(out < 0)
        if not len(left):
            break
        x, y = a[left, t * width : (t + 1) * width], b[left, t * width : (t + 1) * width]
        common = np.where((x[:, :, None] == y[:, None, :]).any(axis=2), x, np.iinfo(np.int64).max).min(axis=1)
        hit = common < np.iinfo(np.int64).max
        out[left[hit]] = common[hit]
    return out


def _pairs(x: np.ndarray, y: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine of at least ``least``; within x (i < j) if y is None."""
    nx = np.linalg.norm(x, axis=1)
    y_, ny = (x, nx) if y is None else (y, np.linalg.norm(y, axis=1))
    cos = (x @ y_.T) / (nx[:, None] * ny[None, :])
    i, j = np.nonzero(cos >= least - 1e-12)
    if y is None:
        i, j = i[i < j], j[i < j]
    exact = np.einsum("ij,ij->i", x[i], y_[j]) / (nx[i] * ny[j])
    return i[exact >= least], j[exact >= least]


def _spanning(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id reachable from each row by the pairs: label propagation with halving."""
    root = np.arange(len(ids))
    order = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    by_rank = np.argsort(order)
    root = order.copy()
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[by_rank[new]])
        if (new == root).all():
            return ids[by_rank[root]]
        root = new


def near_vectors(rows: DataFrame, least: float = 0.93, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding, label).

    Rows of equal, non-null label and equal length are linked at cosine ``least`` or more, in
    double precision. Equal vectors are one class with a weight. Classes meet in the buckets of
    TABLES cross-polytope hashes; tasks read buckets in blocks, verify by matrix products and
    return, for each class, how many vectors it links with there and the smallest class it
    reaches there: never pairs. A pair that meets in several buckets counts in the first.

    Invalid vectors (null, empty, zero, null or non-finite components) and null labels link with
    nothing and are kept; rows that repeat a vec_id with one vector count as one; an empty table
    gives no rows.
    """
    rows = rows.select(F.col("vec_id").cast("long"), "embedding", "label")
    good = usable(rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull())).select("vec_id", F.transform("embedding", lambda v: v + F.lit(0).cast("float")).alias("embedding") if "float" in rows.schema["embedding"].dataType.simpleString() else F.transform("embedding", lambda v: v + F.lit(0.0)).alias("embedding"), "label")
    good = materialise(good.dropDuplicates(["vec_id", "embedding", "label"]))
    groups = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("weight"))
    groups = materialise(groups)
    width = TABLES * PROBES**2

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sizes = b.column("embedding").value_lengths().to_numpy()
            for size in np.unique(sizes):
                part = b.take(np.flatnonzero(sizes == size))
                for lo in range(0, part.num_rows, 4096):
                    piece = part.slice(lo, 4096)
                    posts = codes(matrix(piece.column("embedding"))).ravel()
                    yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("label", "rep", "weight", "embedding")), pa.FixedSizeListArray.from_arrays(pa.array(posts), width).cast(pa.list_(pa.int64()))], ["label", "rep", "weight", "embedding", "posts"])

    kind = groups.schema["label"].dataType.simpleString()
    vector = groups.schema["embedding"].dataType.simpleString()
    posted = materialise(groups.select("label", "rep", "weight", "embedding").mapInArrow(hashed, f"label {kind}, rep long, weight long, embedding {vector}, posts array<long>"))
    bucket = posted.select(F.xxhash64("label", F.size("embedding")).alias("key"), "rep", "weight", "embedding", "posts", F.explode("posts").alias("code"))
    sizes = bucket.groupBy("key", "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bucket = bucket.join(sizes, ["key", "code"])
    # a large bucket becomes pairs of blocks; a row lies in one block and joins each pair that has it
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    split = bucket.withColumn("parts", parts).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = split.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def told(part: pa.Table, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            """What linked pairs of rows of ``part``, each pair in one bucket, say of each row."""
            if not len(i):
                return
            ids, weight, code = (part[c].to_numpy() for c in ("rep", "weight", "code"))
            posts = matrix_of_longs(part["posts"])
            first = np.concatenate([_first_meeting(posts[i[k : k + 65536]], posts[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) == code[i]
            links = np.bincount(i[first], weight[j[first]], len(ids)) + np.bincount(j[first], weight[i[first]], len(ids))
            names, at = np.unique(ids, return_inverse=True)
            root = _spanning(at[i], at[j], names)[at]
            use = np.zeros(len(ids), dtype=bool)
            use[i], use[j] = True, True
            yield pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array(links[use].astype(np.int64)), pa.array(root[use])], ["rep", "links", "root"])

        def large(part: pa.Table) -> Iterator[pa.RecordBatch]:
            mine, x, y = part["mine"].to_numpy(), part["x"][0].as_py(), part["y"][0].as_py()
            vectors = matrix(part["embedding"])
            if x == y:
                i, j = _pairs(vectors, None, least)
            else:
                a, b = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
                i, j = _pairs(vectors[a], vectors[b], least)
                i, j = a[i], b[j]
            yield from told(part, i, j)

        def work(part: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Buckets between edges: large ones by matrix products, all small ones together pair by pair."""
            size = np.diff(edges)
            for k in np.flatnonzero(size > SMALL).tolist():
                yield from large(part.slice(int(edges[k]), int(size[k])))
            dims = part["embedding"].combine_chunks().value_lengths().to_numpy()
            end = np.repeat(edges[1:], size)
            row = np.flatnonzero(np.repeat(size, size) <= SMALL)
            x_cross = part["x"].to_numpy() != part["y"].to_numpy()
            mine = part["mine"].to_numpy()
            for dim in np.unique(dims[row]).tolist():
                rows = row[dims[row] == dim]
                later = end[rows] - rows - 1
                where = np.full(part.num_rows, -1, dtype=np.int64)
                where[rows] = np.arange(len(rows))
                sub = part.take(rows)
                vectors = matrix(sub["embedding"])
                unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
                cuts = np.searchsorted(np.cumsum(later), np.arange(0, int(later.sum()) + 1, 200_000))
                cuts = np.unique(np.r_[0, cuts, len(rows)])
                got = []
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    i = np.repeat(rows[lo:hi], later[lo:hi])
                    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later[lo:hi]) - later[lo:hi], later[lo:hi])
                    fair = ~x_cross[i] | (mine[i] != mine[j])
                    i, j = where[i[fair]], where[j[fair]]
                    near = np.einsum("ij,ij->i", unit[i], unit[j]) >= least - 1e-9
                    i, j = i[near], j[near]
                    exact = np.einsum("ij,ij->i", vectors[i], vectors[j]) / (np.linalg.norm(vectors[i], axis=1) * np.linalg.norm(vectors[j], axis=1))
                    got.append((i[exact >= least], j[exact >= least]))
                if got:
                    yield from told(sub, *(np.concatenate(g) for g in zip(*got)))

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            keys = np.stack([held[c].to_numpy().astype(np.int64) for c in ("key", "code", "x", "y")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            edges = np.r_[0, cuts]
            if len(cuts):
                yield from work(held.slice(0, int(edges[-1])), edges)
            held = held.slice(int(edges[-1]))
        if held is not None and held.num_rows > 1:
            yield from work(held, np.array([0, held.num_rows]))

    order = ["key", "code", "x", "y"]
    met = split.select(*order, "mine", "rep", "weight", "embedding", "posts").repartition(*order).sortWithinPartitions(*order)
    met = materialise(met.mapInArrow(verified, "rep long, links long, root long"))
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(met.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = groups.join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select(
        "label", "embedding", F.coalesce("root", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n")
    )
    told = good.join(named, ["label", "embedding"]).select(F.col("vec_id").alias("_id"), "component", "n")
    told = told.groupBy("_id").agg(F.min("component").alias("component"), F.max("n").alias("n"))
    out = rows.select("vec_id").join(told, F.col("vec_id") == F.col("_id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def matrix_of_longs(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
