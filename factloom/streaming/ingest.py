"""Incremental reconciliation: facts arrive in batches, and clusters and relationships follow without a full run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import entities, reconcile
from ..operators.facts import dedupe
from ..operators.stages import Settled

#: Folders that relationships are spread over by their attribute's core; a batch rewrites those it touches.
BUCKETS = 64


class Ledger:
    """Facts, entity clusters and relationships in a folder, kept up to date batch by batch.

    facts/batch=N     the facts that batch N brought, with their entity key and attribute core
    clusters/batch=N  (key, root, was) of all entity keys after batch N
    edges/bucket=B    relationships, with the block (cluster, core_key) they belong to
    done/batch=N      written last; a batch without it counts for nothing

    Batches may come in any order and the same facts may come again: what the folder holds is what
    one run over all facts gives. A batch that failed is given again under its number; what it had
    written is written anew. Facts need the columns that ``reconcile.reconcile`` reads; rows
    without an id are left out. ``subjects`` (file_id, subject) must know a file when its facts come.
    """

    def __init__(self, spark: SparkSession, path: str, subjects: DataFrame | None = None, aliases: dict[str, str] | None = None, max_block: int = reconcile.MAX_BLOCK) -> None:
        self.spark, self.path, self.subjects, self.aliases, self.max_block = spark, path.rstrip("/"), subjects, aliases, max_block

    def _read(self, name: str) -> DataFrame | None:
        """A table of the folder; None before its first batch."""
        try:
            return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _every(self, batch: int | None = None) -> DataFrame | None:
        """Facts of the batches that are done, and of ``batch``."""
        found, done = self._read("facts"), self._read("done")
        if found is None:
            return None
        mine = F.lit(False) if batch is None else F.col("batch") == batch
        if done is None:
            return found.where(mine)
        return found.join(done.select("batch", F.lit(True).alias("_done")), "batch", "left").where(F.col("_done") | mine).drop("_done")

    def facts(self) -> DataFrame | None:
        found = self._every()
        return None if found is None else found.drop("batch", "key", "core_key")

    def edges(self) -> DataFrame | None:
        found = self._read("edges")
        return None if found is None else found.drop("bucket", "cluster", "core_key")

    def clusters(self) -> DataFrame | None:
        """(key, root) as the last batch that is done left them."""
        done = self._read("done")
        if done is None:
            return None
        last = done.agg(F.max_by("batch", "turn").alias("batch")).first()["batch"]
        return self.spark.read.parquet(f"{self.path}/clusters/batch={last}").select("key", "root")

    def _done(self, batch: int) -> bool:
        done = self._read("done")
        return done is not None and not done.where(F.col("batch") == batch).isEmpty()

    def update(self, batch_facts: DataFrame, batch: int) -> None:
        """Take in a batch: new facts by id, the clusters their names extend or join, and the relationships of every block that changes.

        A block (cluster, core) changes if it gets a fact, if its cluster was joined by another,
        or if it has a fact of a document whose vintage the batch may move.
        """
        if self._done(batch):
            return
        settled = Settled()
        new = self._write_new(batch_facts.where("id is not null"), batch, settled)
        if new.isEmpty():
            self._finish(batch, self.clusters(), settled)
            return
        every = self._every(batch)
        known = self.clusters()
        fresh = new.where("key <> ''").select("key")
        named = entities.extended(self.spark.createDataFrame([], "key string, root string") if known is None else known, fresh)
        named = settled(named)
        self._blocks(every, new, named, settled)
        self._finish(batch, named, settled)

    def _write_new(self, facts: DataFrame, batch: int, settled: Settled) -> DataFrame:
        tie = [c for c in ("extractor", "file_id", "char_start", "attribute") if c in facts.columns]
        one = dedupe(facts, ["id"], [F.col(c) for c in tie])
        every = self._every()
        if every is not None:
            one = one.join(every.where(F.col("batch") != batch).select("id"), "id", "left_anti")
        core = F.array_join(reconcile.signature(F.col("attribute"))["core"], " ")
        # worked out before it is written: a batch that is given again replaces what it reads past
        out = settled(entities.keyed(one, self.subjects, self.aliases).drop("_form").withColumn("core_key", core))
        out.write.mode("overwrite").parquet(f"{self.path}/facts/batch={batch}")
        return out

    def _blocks(self, every: DataFrame, new: DataFrame, named: DataFrame, settled: Settled) -> None:
        roots = named.select("key", F.col("root").alias("cluster"))
        placed = every.drop("batch").join(roots, "key", "left").withColumn("cluster", F.coalesce("cluster", reconcile.normalize_entity(F.col("entity"))))
        joined = named.groupBy(F.col("root").alias("cluster")).agg(F.countDistinct("was").alias("n"), F.max(F.when(F.col("was") != F.col("root"), 1).otherwise(0)).alias("renamed")).where("n > 1 or renamed = 1").select("cluster")
        in_files = placed.join(new.select("file_id").distinct(), "file_id", "left_semi").select("cluster", "core_key")
        of_joined = placed.join(joined, "cluster", "left_semi").select("cluster", "core_key")
        touched = settled(in_files.union(of_joined).distinct())
        facts = settled(placed.join(touched, ["cluster", "core_key"], "left_semi").drop("cluster", "core_key", "key"))
        profiles = reconcile.vintages(every.join(facts.select("file_id").distinct(), "file_id", "left_semi"))
        prepared = settled(reconcile.prepare(facts, profiles, self.subjects, self.aliases, roots.withColumnRenamed("cluster", "root")))
        made = reconcile.reconcile(facts, max_block=self.max_block, prepared=prepared, with_block=True)
        bucket = lambda d: d.withColumn("bucket", F.pmod(F.xxhash64("core_key"), F.lit(BUCKETS)).cast("int"))
        made = bucket(made)
        old = self._read("edges")
        if old is not None:
            # a cluster that was joined has a new root; its edges are among those made anew
            now = named.where("was is not null").select(F.col("was").alias("cluster"), F.col("root").alias("_now")).distinct()
            old = old.join(bucket(touched).select("bucket").distinct(), "bucket", "left_semi").join(now, "cluster", "left").withColumn("cluster", F.coalesce("_now", "cluster")).drop("_now")
            made = made.unionByName(old.join(touched, ["cluster", "core_key"], "left_anti").select(*made.columns))
        out = settled(made)
        # a bucket whose relationships have all gone is written empty by hand: an overwrite by partition leaves it alone
        left = {r["bucket"] for r in out.select("bucket").distinct().collect()}
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/edges")
        for r in bucket(touched).select("bucket").distinct().collect():
            if r["bucket"] not in left and old is not None:
                out.limit(0).drop("bucket").write.mode("overwrite").parquet(f"{self.path}/edges/bucket={r['bucket']}")

    def _finish(self, batch: int, named: DataFrame | None, settled: Settled) -> None:
        named = self.spark.createDataFrame([], "key string, root string, was string") if named is None else named
        settled(named).write.mode("overwrite").parquet(f"{self.path}/clusters/batch={batch}")
        done = self._read("done")
        turn = 0 if done is None else done.count()
        self.spark.createDataFrame([(turn,)], "turn long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/batch={batch}")
        settled.release()


def stream(source: DataFrame, extract: Callable[[DataFrame], DataFrame], ledger: Ledger, checkpoint: str):
    """A streaming query that extracts facts of each batch of ``source`` and takes them into ``ledger`` under the batch's number, once."""
    return source.writeStream.foreachBatch(lambda df, n: ledger.update(extract(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
