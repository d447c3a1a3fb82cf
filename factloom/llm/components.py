"""Connected components over DataFrames, and near-duplicate linking without all pairs.

Both are joins and aggregations only: nothing is collected, and a node or a bucket that holds
a large share of all rows is spread by pre-aggregation and by joins that Spark can split.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, materialise, tidy

#: Further rounds of pivots, and pivots an id is compared with in one, where open pairs exceed CHEAP times the posts.
ROUNDS, TRIES, CHEAP = 1, 4, 4


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root) for every node that has a link; root is the smallest node reachable.

    Union-find in rounds: each node hooks on its smallest neighbour, other links move to that
    neighbour (small star), and parents are replaced by grandparents (path halving), until each
    node has one parent that has none. Self links and repeated links are allowed; no links, no rows.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("r"))
    e = materialise(e.distinct())
    while True:
        m = e.groupBy("v").agg(F.min("r").alias("m"), F.count(F.lit(1)).alias("n"))
        up = m.select(F.col("v").alias("m"), F.col("m").alias("mm"))
        t = materialise(m.join(up, "m", "left").select("v", "n", F.col("m"), F.coalesce("mm", "m").alias("root"), F.col("mm").isNotNull().alias("deep")))
        if t.where((F.col("n") > 1) | F.col("deep")).isEmpty():
            discard(e)
            return t.select(F.col("v").alias("node"), "root").unionByName(t.select(F.col("root").alias("node"), "root").distinct())
        moved = e.join(t.where("n > 1"), "v").where(F.col("r") != F.col("root")).select(F.greatest("r", "root").alias("v"), F.least("r", "root").alias("r"))
        following = materialise(t.select("v", F.col("root").alias("r")).union(moved).distinct())
        discard(e, t)
        e = following


def _open_pairs(tagged: DataFrame) -> int:
    """Pairs of one bucket and different roots, counted by bucket without making them."""
    sizes = tagged.groupBy("bucket", "root").agg(F.count(F.lit(1)).cast("double").alias("n"))
    open_ = sizes.groupBy("bucket").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("p"))
    with tidy(tagged.sparkSession):
        return int(open_.agg(F.coalesce(F.sum("p"), F.lit(0.0))).first()[0])


def link(posts: DataFrame | list[DataFrame], attributes: DataFrame, near: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame], alike: Callable[[str, str], Column] | None = None, shared_by: int = 1, needed: Callable[[str, str], Column] | None = None) -> DataFrame:
    """(node, root) components of the graph of verified candidate pairs, where candidates share a bucket.

    posts: (bucket, id), one row per bucket and id; a list of such frames without common buckets is counted frame by frame, and only one of them is on disk at a time.
    attributes: id and what ``near`` reads.
    near(x, y): a cheap necessary condition of a link on the columns of two aliases, tested inside the join.
    verify: pairs (a, b) to the true links among them.
    alike(x, y): a dearer condition of that kind, tested last.
    shared_by: the least number of buckets shared with a pivot that a comparison with it is worth; other pairs wait for the last step.
    needed(x, y): the number of shared buckets that a comparison in the last step is worth; without it one.

    Pairs within a bucket are not all made. Each bucket has a pivot, the id that shares buckets
    with most others: among copies of one original, the original. First each id is compared with
    the pivot it shares most buckets with, then, where buckets still hold many ids of different
    components, with a few pivots more; at last all pairs of a bucket are compared whose ids the
    links so far have left in different components. The components are those of all verified
    pairs: a pair that is never compared lies in one component already.
    """
    spark = attributes.sparkSession
    by_bucket = lambda df: df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket")  # noqa: E731 one exchange for two uses, if both name all columns
    counted, compared = [], []
    for part in posts if isinstance(posts, list) else [posts]:
        dealt = by_bucket(part)
        crowds = dealt.groupBy("bucket").agg(F.count("id").alias("n")).where("n > 1")  # names the id, or the exchange is made twice
        # a row an id: ids and weights are written once, not beside each bucket
        crowded = dealt.join(crowds.hint("shuffle_hash"), "bucket").groupBy("id").agg(F.sum("n").alias("w"), F.collect_list("bucket").alias("buckets"))
        crowded = materialise(crowded)
        counted.append(crowded)
        weighed = by_bucket(crowded.select("id", "w", F.explode("buckets").alias("bucket")))
        pivots = weighed.groupBy("bucket").agg(F.max(F.struct("w", (-F.col("id")).alias("i"))).alias("p")).select("bucket", (-F.col("p.i")).alias("pivot"))
        star = weighed.join(pivots, "bucket").where(F.col("id") != F.col("pivot")).groupBy("id", "pivot").agg(F.count("w").alias("n")).where(F.col("n") >= shared_by)
        compared.append(materialise(star.groupBy("id").agg(F.max(F.struct("n", (-F.col("pivot")).alias("i"))).alias("s"))))
    shared = reduce(DataFrame.unionByName, counted)
    star = reduce(DataFrame.unionByName, compared).groupBy("id").agg((-F.max("s")["i"]).alias("b"))
    first = materialise(verify(star.select(F.col("id").alias("a"), "b")))
    discard(*compared)
    links = first
    for turn in range(ROUNDS + 1):
        roots = components(links)
        tagged = shared.join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"), F.explode("buckets").alias("bucket"))
        tagged = by_bucket(tagged)
        mixed = tagged.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("id").alias("n")).where("lo < hi and n > 1").select("bucket")
        tagged = materialise(tagged.join(mixed, "bucket"))
        if turn == ROUNDS or _open_pairs(tagged) <= CHEAP * tagged.count():
            break
        # too many pairs are open: more pivots first, drawn anew in each bucket
        draw = F.struct(F.xxhash64(F.lit(turn), "id", "bucket").alias("h"), F.col("id").alias("pivot"), F.col("root").alias("proot"))
        drawn = tagged.groupBy("bucket").agg(F.max(draw).alias("d")).select("bucket", "d.pivot", "d.proot")
        tries = tagged.join(drawn, "bucket").where("root <> proot").groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= shared_by)
        few = Window.partitionBy("id").orderBy(F.desc("n"), "pivot")
        tries = tries.withColumn("k", F.row_number().over(few)).where(F.col("k") <= TRIES)
        more = materialise(verify(tries.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()))
        links = links.unionByName(more)
        discard(tagged)
    discard(*counted)
    left = tagged
    if alike:  # a pair that shares several buckets is made in the smallest of them only; the sets of buckets would outweigh all else where an id has many
        tagged = tagged.join(tagged.groupBy("id").agg(F.collect_set("bucket").alias("buckets")), "id")
    tagged = materialise(tagged.join(attributes, "id"))
    discard(left)
    x, y = tagged.alias("x"), tagged.alias("y")
    open_ = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & near("x", "y")
    if alike:
        open_ = open_ & (F.array_min(F.array_intersect("x.buckets", "y.buckets")) == F.col("x.bucket")) & alike("x", "y")
    pairs = x.join(y, open_)
    ends = F.col("x.id").alias("a"), F.col("y.id").alias("b")
    if needed:
        pairs = pairs.select(*ends, needed("x", "y").alias("k")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k")).where("n >= k").select("a", "b")
    else:
        pairs = pairs.select(*ends).distinct()
    pairs = materialise(pairs)
    discard(tagged)
    out = components(links.unionByName(verify(pairs)))
    discard(pairs)
    return out
