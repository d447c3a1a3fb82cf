"""Entity clusters: alias edges from shared words and initials, closed by rounds of hooking and halving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .stages import Settled

# Legal forms, lead words, generic entities.
LEGAL = "limited ltd private pvt plc inc incorporated corporation corp company co llp llc group holdings".split()
LEADS = "the our its their this".split()
GENERIC_ENTITIES = ["", "company", "group", "issuer", "bank", "fund", "board"]


def normalize_entity(name: Column) -> Column:
    """Words in lower case, without lead words in front and legal forms at the end."""
    words = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    words = F.regexp_replace(words, r"^(?:(?:%s)(?:\s+|$))+" % "|".join(LEADS), "")
    return F.trim(F.regexp_replace(words, r"(?:(?:^|\s+)(?:%s))+$" % "|".join(LEGAL), ""))


def initials(key: Column) -> Column:
    return F.array_join(F.transform(F.split(key, " "), lambda w: F.substring(w, 1, 1)), "")


def alias_edges(keys: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """(a, b) of distinct ``key`` values where one's words are some of the other's, each of four letters or more, or its initials.

    Words are matched through an inverted index on each name's rarest word, never by all pairs.
    With ``fresh`` (key), only edges that have one of these at an end.
    """
    k = keys.select("key").distinct().withColumn("words", F.array_distinct(F.split("key", " ")))
    k = k.withColumn("new", F.lit(True)) if fresh is None else k.join(fresh.select("key", F.lit(True).alias("new")).distinct(), "key", "left").withColumn("new", F.coalesce("new", F.lit(False)))
    posted = k.select("key", "new", F.explode("words").alias("w"))
    rare = posted.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    pick = posted.join(rare, "w").groupBy("key").agg(F.min_by("w", F.struct("df", "w")).alias("w")).join(k, "key").where(F.forall("words", lambda x: F.length(x) >= 4))
    longer = posted.select(F.col("key").alias("b"), "w", F.col("new").alias("b_new"))
    either = F.col("new") | F.col("b_new")
    met = pick.select(F.col("key").alias("a"), "w", "words", "new").join(longer, "w").where(either & (F.col("a") != F.col("b"))).drop("w")
    met = met.join(k.select(F.col("key").alias("b"), F.col("words").alias("all")), "b")
    subset = met.where((F.size("words") < F.size("all")) & (F.size(F.array_except("words", "all")) == 0)).select("a", "b")
    short = k.select(F.col("key").alias("a"), F.replace("key", F.lit(" "), F.lit("")).alias("i"), "new")
    full = k.where(F.size("words") > 1).select(F.col("key").alias("b"), initials(F.col("key")).alias("i"), F.col("new").alias("b_new"))
    return subset.union(short.join(full, "i").where(either & (F.col("a") != F.col("b"))).select("a", "b")).distinct()


def closure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, root): the smallest key that edges (a, b) reach, for every key of ``nodes``.

    Rounds go on until nothing changes: each takes the neighbours' smallest label and then that
    label's own, which halves paths, so that rounds grow with the logarithm of the longest. Each
    is written, so that plans do not grow and a lost executor repeats one round only.
    """
    kept = Settled()
    edges = kept(edges.union(edges.select("b", "a")).distinct())
    labels = kept(nodes.select("key").distinct().withColumn("root", F.col("key")))
    if edges.isEmpty():
        return labels
    while True:
        near = edges.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("root").alias("r"))
        hooked = labels.join(near, "key", "left").select("key", F.least("root", F.coalesce("r", "root")).alias("new"), F.col("root").alias("old"))
        up = hooked.select(F.col("key").alias("new"), F.col("new").alias("top"))
        following = kept(hooked.join(up, "new", "left").select("key", F.least("new", F.coalesce("top", "new")).alias("root"), "old"))
        labels = following.drop("old")
        if following.where("root <> old").isEmpty():
            return labels


def clusters(keys: DataFrame) -> DataFrame:
    """(key, root): the smallest key that aliases reach, for every key."""
    return closure(keys, alias_edges(keys))


def extended(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """(key, root, was): ``clusters`` of known and fresh keys together, from the clusters (key, root) of the known ones; ``was`` is a known key's old root.

    Only edges of fresh keys are looked for, and they join the known clusters' roots: the graph
    that is closed has a node for each fresh key and for each cluster that one of them meets.
    """
    fresh = fresh.select("key").distinct().join(known, "key", "left_anti")
    every = known.select("key", "root").unionByName(fresh.select("key", F.col("key").alias("root")))
    at = lambda n: every.select(F.col("key").alias(n), F.col("root").alias(f"r{n}"))
    joined = alias_edges(every, fresh).join(at("a"), "a").join(at("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct()
    joined = Settled()(joined)
    nodes = joined.select(F.col("a").alias("key")).union(joined.select(F.col("b").alias("key"))).distinct()
    moved = closure(nodes, joined).select(F.col("key").alias("_old"), F.col("root").alias("_new"))
    out = every.join(moved, F.col("root") == F.col("_old"), "left").join(known.select("key", F.col("root").alias("was")), "key", "left")
    return out.select("key", F.coalesce("_new", "root").alias("root"), "was")


def keyed(facts: DataFrame, subjects: DataFrame | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """``facts`` with ``key``, the normalised name that stands for the entity, and ``_form``, that name as written.

    Generic names stand for their document's subject (file_id, subject); ``aliases`` maps names to
    names, both normalised.
    """
    f = facts.withColumn("key", normalize_entity(F.col("entity"))).withColumn("_form", F.col("entity"))
    if subjects is not None:
        generic = F.col("key").isin(*GENERIC_ENTITIES) & F.col("_s").isNotNull()
        f = f.join(subjects.select("file_id", F.col("subject").alias("_s")), "file_id", "left")
        f = f.withColumn("_form", F.when(generic, F.col("_s")).otherwise(F.col("_form"))).withColumn("key", F.when(generic, normalize_entity(F.col("_s"))).otherwise(F.col("key"))).drop("_s")
    if aliases:
        spoken = F.create_map(*[normalize_entity(F.lit(x)) for pair in aliases.items() for x in pair])
        f = f.withColumn("key", F.coalesce(F.try_element_at(spoken, F.col("key")), "key"))
    return f


def resolve(facts: DataFrame, subjects: DataFrame | None = None, aliases: dict[str, str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """``facts`` with key, cluster and canonical name: each cluster's most frequent form, then the longest, then the first.

    A generic name without a subject has no cluster. known: (key, root) where the clusters have
    been worked out already.
    """
    f = keyed(facts, subjects, aliases)
    roots = clusters(f.where("key <> ''").select("key")) if known is None else known
    f = f.join(roots.select("key", F.col("root").alias("cluster")), "key", "left")
    forms = f.where("cluster is not null").groupBy("cluster", "_form").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file_id", "id") if "id" in facts.columns else F.struct("file_id")).alias("at"))
    best = Window.partitionBy("cluster").orderBy(F.desc("n"), F.desc(F.length("_form")), "at", "_form")
    names = forms.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("cluster", F.col("_form").alias("canonical"))
    return f.drop("_form").join(names, "cluster", "left")
