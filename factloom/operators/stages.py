"""Results that several later steps read: worked out once, written where driver and executors share files, and read back."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Distinct arguments that may be broadcast to all rows.
FEW = 100_000

#: Least size of a shuffle's partition that is not joined to the next. Rows here are small and what is made of them is dear: a megabyte in one task keeps the other cores waiting.
LEAST = "spark.sql.adaptive.coalescePartitions.minPartitionSize"

#: The setting under which files of shuffles go at the end of a query, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where a local session has none, one in the warehouse. On a cluster an unset folder is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_factloom"
    return folder.rstrip("/")


class Settled:
    """Writes the frames of one run and gives back tables that hold them.

    What reads them plans from a leaf, prunes columns, and survives lost executors. They are written
    by all cores, so that what reads them runs on all. Files of their shuffles go as soon as they are
    written. The tables go with ``release``, or when the process ends.
    """

    def __init__(self) -> None:
        self._kept: list[tuple[SparkSession, str]] = []

    def __call__(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """by: a column whose values have files of their own."""
        spark = df.sparkSession
        path = f"{shared_dir(spark)}/facts-{uuid.uuid4().hex}"
        before = {name: spark.conf.get(name) for name in (LEAST, CLEANUP)}
        spark.conf.set(LEAST, "1b")
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path, partitionBy=by)
        finally:
            for name, value in before.items():
                spark.conf.set(name, value)
        self._kept.append((spark, path))
        _all.append(self)
        return spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        while self._kept:
            spark, path = self._kept.pop()
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def per_distinct(rows: DataFrame, name: str, body: Callable[..., Column], *args: Column) -> DataFrame:
    """``rows`` with ``body`` of ``args`` as column ``name``, worked out once for each distinct combination of arguments (nulls count as equal).

    For dear expressions of arguments that repeat; every row gets its own result.
    """
    keys = [f"_arg{i}" for i in range(len(args))]
    said = rows.select("*", *[a.alias(k) for a, k in zip(args, keys)])
    told = Settled()(said.select(*keys).distinct().select(*[F.col(k).alias(f"{k}_") for k in keys], body(*[F.col(k) for k in keys]).alias(name)))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    return said.join(F.broadcast(told) if told.count() <= FEW else told, same).drop(*keys, *[f"{k}_" for k in keys])


_all: list[Settled] = []


@atexit.register
def _at_end() -> None:
    for kept in _all:
        try:
            kept.release()
        except Exception:  # the JVM may be gone: nothing is left to tidy with
            return
