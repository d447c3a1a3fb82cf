"""Operator 10: sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import materialise, table


#: Cells whose counts are added up in one window; the sums of so many cells are added up in another.
SPAN = 1024


def _offsets(counts: DataFrame, strata: list[str], cell: str) -> DataFrame:
    """``counts`` (strata, cell, _n) with _offset, the rows of the stratum's cells before: by spans of cells, then within each span."""
    spans = counts.withColumn("_span", F.floor(F.col(cell) / SPAN).cast("int"))
    sums = spans.groupBy(*strata, "_span").agg(F.sum("_n").alias("_m"))
    before = lambda over, by: Window.partitionBy(*over).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_m").over(before(strata, "_span")), F.lit(0))).select(*[F.col(k).alias(f"_{k}") for k in strata], F.col("_span").alias("_s"), "_base")
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in strata] + [F.col("_span") == F.col("_s")]
    inside = spans.withColumn("_in", F.coalesce(F.sum("_n").over(before([*strata, "_span"], cell)), F.lit(0)))
    return inside.join(sums, match).select(*strata, cell, (F.col("_base") + F.col("_in")).alias("_offset"))


def _position(df: DataFrame, strata: list[str], cell: str, order: list, out: str) -> DataFrame:
    """Rank from 0 within ``strata`` by (cell, order), with no window over a whole stratum.

    ``cell`` is a coarse, monotone function of the order; counts by cell give each cell's offset,
    and rows are numbered within a cell only.
    """
    counts = df.groupBy(*strata, cell).agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(counts, strata, cell)
    keys = [*strata, cell]
    offsets = offsets.select(*[F.col(k).alias(f"_{k}") for k in keys], "_offset")
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = df.join(offsets, match, "inner").drop(*[f"_{k}" for k in keys])
    within = Window.partitionBy(*strata, cell).orderBy(*order)
    return joined.withColumn(out, F.col("_offset") + F.row_number().over(within) - 1).drop("_offset")


def shard(docs: DataFrame, shards: int = 40, seed: int = 7, cell_rows: int = 2000, stratum: str = "source") -> DataFrame:
    """Deal rows to ``shards`` shards whose row counts differ by one at most (law ``rows``) and whose mixtures agree.

    Rows of each source are shuffled by a seeded hash and ranked; the rank's fraction of the
    source's count orders all rows, so that any run of that order holds each source in
    proportion; equal runs of it are the shards. Only ids and hashes are shuffled, never texts;
    a source of any size is ranked over cells of about ``cell_rows`` rows.

    Null ids, texts (size 16, crc 0) and sources (a stratum of their own) are dealt like others;
    repeated rows each get a place; ties go by hash, id, crc and size, and rows equal in all of
    them are interchangeable; an empty table gives an empty result.
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), F.col(stratum).alias("stratum"), F.octet_length(raw).cast("long").alias("bytes"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
    )
    rows = rows.select("*", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32").alias("h"))
    rows = materialise(rows)
    total = rows.count()
    cells = max(1, total // cell_rows)
    unit = F.col("h") / F.lit(2.0**64) + 0.5
    rows = rows.withColumn("cell", F.floor(unit * cells).cast("int"))
    order = ["h", "doc_id", "text_crc32", "bytes"]
    ranked = _position(rows, ["stratum"], "cell", order, "rank").drop("cell")
    sizes = rows.groupBy(F.col("stratum").alias("_stratum")).agg(F.count(F.lit(1)).alias("of"))
    ranked = ranked.join(sizes, F.col("stratum").eqNullSafe(F.col("_stratum"))).drop("_stratum")
    ranked = ranked.withColumn("fraction", (F.col("rank") + 0.5) / F.col("of"))
    ranked = ranked.withColumn("cell", F.floor(F.col("fraction") * cells).cast("int")).withColumn("all", F.lit(0))
    placed = _position(ranked, ["all"], "cell", ["fraction", *order, "stratum"], "place")
    n = F.lit(total).cast("long")
    placed = placed.withColumn("shard", F.floor(F.col("place") * shards / n).cast("int"))
    # the first place of shard s is the least p with p * shards >= s * total
    first = F.floor((F.col("shard").cast("long") * n + shards - 1) / F.lit(shards)).cast("long")
    return placed.select(
        "doc_id", (F.col("bytes") + 16).alias("size"), F.col("text_crc32").cast("long"), F.lit("rows").alias("law"), "shard",
        (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("stratum").alias("source"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
