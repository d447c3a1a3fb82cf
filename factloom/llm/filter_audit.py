"""Operator 13: what each filter of a chain removes, in every order the chain could have."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialise, small, table

#: The filters, in the order of the bits that hold their failures.
FILTERS = "ABCDE"
#: Least words; least distinct words in 100; most capitals in 100 characters; characters no text may hold.
WORDS, DISTINCT, CAPITALS, BARRED = 100, 80, 10, "[#$%&*|]"

_WORD = r"[^\x20\x09-\x0D]+"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; null is empty."""
    raw = F.coalesce(text, F.lit(""))

    def judged(words: Column) -> Column:
        n = F.size(words)
        capitals = F.length(raw) - F.length(F.regexp_replace(raw, "[A-Z]", ""))
        fails = (n < WORDS, F.size(F.array_distinct(words)) * 100 < n * DISTINCT, capitals * 100 > F.length(raw) * CAPITALS, raw.rlike(BARRED))
        return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))

    # bound once: named twice, the words would be cut twice
    return F.get(F.transform(F.array(F.regexp_extract_all(raw, F.lit(_WORD), F.lit(0))), judged), 0)


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, fails, good, toxic) for each document: the failure bits of all five filters and its labels.

    Copies (E) are told by the texts' SHA-256: the least id of a text is found by a pre-aggregated
    shuffle of ids and digests, never of texts. A null id is smaller than none and has no smaller
    one; rows that repeat an id are not copies of each other. Several labels of an id count as one
    that has each property any of them has.
    """
    rows = docs.select(
        F.col("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"), text_failures(F.col("text")).alias("fails"),
    )
    rows = materialise(rows)
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    told = rows.join(first, "digest", "left").select("doc_id", "part", (F.col("fails") + copy).alias("fails"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max((F.col(c) == 1).cast("int")).alias(n) for n, c in (("good", "quality"), ("toxic", "toxic"))])
    return told.join(marks, "doc_id", "left").select("part", "fails", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])


def orders(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """(filter_order, bits) of every order of the filters: 120 rows for five."""
    rows = [("".join(p), [1 << filters.index(f) for f in p]) for p in permutations(filters)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>")


def audit(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, with the counts of its documents.

    flags: (part, fails, good, toxic), as ``failures`` gives them. Every document is replayed
    through every order: crossed with the orders, which are broadcast and as many as five filters
    have, its first failure is found, and its five steps are counted by (part, order, step). The
    counts are combined before they are shuffled, so a part that holds most documents is one row
    for each task, order and step. A part that occurs has all its rows, zeros included; no
    documents, no rows.
    """
    steps = len(filters)
    hit = [F.col("fails").bitwiseAND(F.get("bits", F.lit(i))) != 0 for i in range(steps)]
    first = F.lit(steps + 1)
    for i in reversed(range(steps)):
        first = F.when(hit[i], i + 1).otherwise(first)
    replayed = flags.crossJoin(F.broadcast(orders(flags.sparkSession, filters))).select("part", "filter_order", "fails", "good", "toxic", first.alias("first"), F.posexplode("bits").alias("at", "bit"))
    step, failing = F.col("at") + 1, F.col("fails").bitwiseAND(F.col("bit")) != 0
    here = F.col("first") == step
    cases = (F.col("first") > step, here, failing & (F.col("first") < step), F.col("fails") == F.col("bit"), here & (F.col("good") == 1), here & (F.col("toxic") == 1))
    counted = replayed.groupBy("part", "filter_order", "at").agg(*[F.sum(c.cast("long")).alias(n) for n, c in zip(_COUNTS, cases)])
    told = materialise(counted.select("part", "filter_order", (F.col("at") + 1).alias("step"), *_COUNTS, F.substring("filter_order", F.col("at") + 1, F.lit(1)).alias("filter")))
    totals = told.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return told.join(small(totals), ["part", "filter"]).select("part", "filter_order", "step", *_COUNTS, "shapley", "filter")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit(failures(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))
