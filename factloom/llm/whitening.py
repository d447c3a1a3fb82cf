"""Operator 11: embedding whitening from an exact integer scatter matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import fresh, materialise, small, table

#: An entry c becomes the integer floor(SCALE * c) + SHIFT; SHIFT is subtracted again before anything is summed.
SCALE, SHIFT = 1024, 100_000
#: Entries count as at most this far from 0, so that the integer is a long.
FARTHEST = 2.0**52
COMPONENTS = 8
#: Sums travel as digits of so many bits, which add up natively without overflow over 2**31 tasks.
BITS = 32
#: Rows whose products are summed in longs at a time, and bytes of fits that go to every task; beyond them a fit joins each row.
ROWS, FITS = 4096, 64 << 20


def complete(embedding: Column) -> Column:
    """Not null, and no entry null or non-finite."""
    x = embedding.cast("array<double>")
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def integers(x: np.ndarray) -> np.ndarray:
    """Entries as longs, less SHIFT."""
    return np.floor(np.clip(x, -FARTHEST, FARTHEST) * SCALE).astype(np.int64)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix of longs) of each length of list in a column of lists of doubles."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        part = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield size, rows, integers(part.reshape(len(rows), size))


def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of the rows of longs, exact, as Python integers."""
    s, c = np.zeros(x.shape[1], dtype=object), np.zeros((x.shape[1],) * 2, dtype=object)
    for lo in range(0, len(x), ROWS):
        part = x[lo : lo + ROWS]
        most = int(np.abs(part).max(initial=0))
        if most * most * ROWS < 1 << 53:  # every sum is a whole number that a double holds, so the fast product is exact
            real = part.astype(np.float64)
            cross = (real.T @ real).astype(np.int64)
        else:
            part = part.astype(np.int64 if most * most * ROWS < 1 << 62 else object)
            cross = part.T.dot(part)
        s, c = s + part.sum(axis=0).astype(object), c + cross.astype(object)
    return s, c


def digits(values: list[int]) -> list[tuple[int, int, int]]:
    """(place of the value, place of the digit, digit) with value = sum of digit * 2**(BITS * place); the last digit has the sign."""
    out, mask, top = [], (1 << BITS) - 1, 1 << (BITS - 1)
    for i, v in enumerate(values):
        k = 0
        while not -top <= v < top:
            out.append((i, k, v & mask))
            v >>= BITS
            k += 1
        if v:
            out.append((i, k, v))
    return out


def scatter(rows: DataFrame) -> DataFrame:
    """(dim, n, cells) of each length of vector: the count, and the exact sums as (i, j, digit place, digit).

    rows: array<double> vectors in ``embedding``. Cells i < 0 hold the sums S, others the upper
    triangle of X'X. Tasks add up Python integers; their digits are added by a native aggregation.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for dim, at, x in _by_length(b.column(0)):
                s, c = moments(x)
                n, s0, c0 = held.get(dim, (0, 0, 0))
                held[dim] = [n + len(at), s0 + s, c0 + c]
        for dim, (n, s, c) in held.items():
            upper = np.triu_indices(dim)
            place = [(-2, -2), *((-1, j) for j in range(dim)), *zip(*(u.tolist() for u in upper))]
            found = digits([n, *s.tolist(), *c[upper].tolist()])
            told = [(dim, *place[i], k, v) for i, k, v in found]
            yield pa.RecordBatch.from_arrays([pa.array([t[q] for t in told], t_) for q, t_ in enumerate((pa.int32(),) * 4 + (pa.int64(),))], ["dim", "i", "j", "k", "v"])

    parts = rows.select("embedding").mapInArrow(added, "dim int, i int, j int, k int, v long")
    return parts.groupBy("dim", "i", "j", "k").agg(F.sum("v").alias("v"))


FIT = "dim int, n long, sums array<string>, axes array<double>, values array<double>, total double"


def fit(cells: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(dim, n, sums, axes, values, total) of each length: S exactly, the leading eigenvectors of V row by row, their eigenvalues, V's trace.

    n X'X - S S' is formed in whole numbers and divided once by n**2, correctly rounded; one
    length's matrix is decomposed in one task, whose memory grows with its square only.
    """

    def decomposed(group: pa.Table) -> pa.Table:
        dim = group["dim"][0].as_py()
        sums, cross, n = [0] * dim, [[0] * dim for _ in range(dim)], 0
        for i, j, k, v in zip(*(group[c].to_pylist() for c in "ijkv")):
            v <<= BITS * k
            if i == -2:
                n += v
            elif i == -1:
                sums[j] += v
            else:
                cross[i][j] += v
        cov = np.zeros((dim, dim))
        for i in range(dim):
            for j in range(i, dim):
                cov[i, j] = cov[j, i] = (n * cross[i][j] - sums[i] * sums[j]) / (n * n)
        values, axes = np.linalg.eigh(cov)
        lead = np.argsort(-values, kind="stable")[: min(components, dim)]
        total = float(np.trace(cov))
        # what rounding leaves of an eigenvalue 0
        values = np.where(values > dim * np.finfo(float).eps * max(values.max(), 0.0), values, 0.0)
        return pa.table([[dim], [n], [[str(s) for s in sums]], [axes[:, lead].T.ravel().tolist()], [values[lead].tolist()], [total]], names=["dim", "n", "sums", "axes", "values", "total"]).cast(
            pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("axes", pa.list_(pa.float64())), ("values", pa.list_(pa.float64())), ("total", pa.float64())])
        )

    return cells.groupBy("dim").applyInArrow(decomposed, FIT)


class Projection:
    """One fit, ready for rows of its length."""

    def __init__(self, n: int, sums: list[str], axes: list[float], values: list[float]) -> None:
        self.n, self.sums = n, [int(s) for s in sums]
        self.mean = np.array([s / n for s in self.sums])
        self.axes = np.array(axes).reshape(-1, len(sums))
        e = np.array(values)
        self.per = np.where(e > 0, 1 / np.sqrt(np.where(e > 0, e, 1)), 0.0)
        self.square = sum(s * s for s in self.sums)
        self.most = max(1, *(abs(s) for s in self.sums))

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.axes.T) * self.per

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum of (n x - S)**2 over dimensions, as n**2 x.x - 2 n x.S + S.S in whole numbers."""
        high = max(int(np.abs(x).max(initial=0)), 1)
        dim = x.shape[1]
        y = x if high * max(high, self.most) * dim < 1 << 62 else x.astype(object)
        sums = np.array(self.sums, dtype=y.dtype)
        squares, crossed = (y * y).sum(axis=1).tolist(), y.dot(sums).tolist()
        return [self.n * self.n * q - 2 * self.n * p + self.square for q, p in zip(squares, crossed)]


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``rows`` with white_n, white_deviation (decimal), white_values, white_explained and white_identity_error.

    Vectors (column embedding, any numeric entries) become whole numbers; their sums and
    cross-products are added exactly, whatever their number, and turned to floating point only
    when the covariance is formed. white_values holds the leading components' coordinates, scaled
    to unit variance; white_explained their shares of the variance; white_identity_error the
    largest absolute entry of the covariance of the values written, less the identity.

    Rows whose vector is null or holds null or non-finite entries are left out, rows that repeat
    count as often as they occur. Vectors of different lengths are fitted by length, each list
    with its own n, and an empty vector has empty lists. Shorter vectors than ``components`` have
    as many components as entries. A component without variance (all vectors equal, fewer vectors
    than components) has values and shares of 0 and does not count in the identity error. Entries
    beyond 2**52 count as 2**52. Deviations of 38 digits and more are null. Columns called as the
    new ones are replaced, all others pass through; an empty table stays empty.
    """
    own = ["white_n", "white_deviation", "white_values", "white_explained", "white_identity_error"]
    plain = rows.where(complete(F.col("embedding"))).drop(*own)
    vectors = plain.select(F.col("embedding").cast("array<double>").alias("embedding"))
    fits = materialise(fit(scatter(vectors), components))
    dim_, sums_, axes_, values_, total_, error_, x_ = fresh(plain, "_dim", "_sums", "_axes", "_values", "_total", "_error", "_x")
    wide = plain.withColumn(x_, F.col("embedding").cast("array<double>")).withColumn(dim_, F.size(x_))
    size = fits.agg(F.coalesce(F.sum(F.col("dim") * (components + 1) * 8), F.lit(0))).first()[0]
    told = ["n", "sums", "axes", "values"]
    fixed = {r["dim"]: Projection(*(r[c] for c in told)) for r in fits.select("dim", *told).collect()} if size <= FITS else None
    if fixed is None:
        of = fits.select(F.col("dim").alias("_d"), F.col("n").alias(own[0]), F.col("sums").alias(sums_), F.col("axes").alias(axes_), F.col("values").alias(values_))
        wide = wide.join(of, F.col(dim_) == F.col("_d"), "left").drop("_d")
    schema = plain.schema

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, deviation, white = [None] * b.num_rows, [None] * b.num_rows, [[]] * b.num_rows
            for dim, at, x in _by_length(b.column(x_)):
                to = fixed[dim] if fixed is not None else Projection(*(b.column(c)[int(at[0])].as_py() for c in (own[0], sums_, axes_, values_)))
                for i, d, w in zip(at.tolist(), to.deviation(x), to.whiten(x).tolist()):
                    n[i], deviation[i], white[i] = to.n, str(d), w
            kept = [b.column(c) for c in schema.names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(deviation, pa.string()), pa.array(white, pa.list_(pa.float64())), b.column(dim_)], [*schema.names, *own[:3], dim_])

    made = ", ".join(f"`{c.replace('`', '``')}` {t}" for c, t in [*((f.name, f.dataType.simpleString()) for f in schema), (own[0], "long"), (own[1], "string"), (own[2], "array<double>"), (dim_, "int")])
    white = materialise(wide.mapInArrow(projected, made))
    value = [F.get(own[2], F.lit(k)) for k in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    spread = white.where(F.col(dim_) > 0).groupBy(dim_).agg(*[F.covar_pop(value[i], value[j]).alias(f"c{i}_{j}") for i, j in pairs]).withColumnRenamed(dim_, "dim")
    live = lambda k: F.coalesce(F.get("values", F.lit(k)) > 0, F.lit(False))
    off = [F.when(live(i) & live(j), F.abs(F.col(f"c{i}_{j}") - (1.0 if i == j else 0.0))).otherwise(0.0) for i, j in pairs]
    shares = F.transform("values", lambda v: F.when(F.col("total") > 0, v / F.col("total")).otherwise(0.0))
    fitted = fits.join(spread, "dim").select(F.col("dim").alias(x_), shares.alias(own[3]), (F.greatest(*off) if len(off) > 1 else off[0]).alias(own[4]))
    out = white.join(small(materialise(fitted)), F.col(dim_) == F.col(x_), "left")
    kept = [F.col(f"`{c}`") for c in schema.names]
    return out.select(*kept, F.coalesce(own[0], F.lit(0)).cast("long").alias(own[0]), F.col(own[1]).try_cast("decimal(38,0)").alias(own[1]), own[2], F.coalesce(own[3], F.array().cast("array<double>")).alias(own[3]), own[4])


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each vector and component; deviation is null where it is no long."""
    rows = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = rows.select("vec_id", "white_n", "white_deviation", "white_identity_error", "white_explained", F.posexplode("white_values").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.col("white_n").alias("n"), F.col("white_deviation").try_cast("long").alias("deviation"), "whitened",
        F.get("white_explained", F.col("at")).alias("explained"), F.col("white_identity_error").alias("identity_error"),
    )
