"""Queries over facts and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import collapse_ws, fact_summary, locator, plain_number

LOW = 0.65


def relationships_for(edges: DataFrame, fact: Column) -> DataFrame:
    return edges.where((F.col("fact_a_id") == fact) | (F.col("fact_b_id") == fact))


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.select("id", F.explode(F.array("fact_a_id", "fact_b_id")).alias("fact_id"))


def of_type(edges: DataFrame, kind: str) -> DataFrame:
    return edges.where(F.col("relationship_type") == kind)


def cross_document(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Relationships whose facts both exist and lie in different files."""
    a, b = facts.select(F.col("id").alias("fact_a_id"), F.col("file_id").alias("_fa")), facts.select(F.col("id").alias("fact_b_id"), F.col("file_id").alias("_fb"))
    return edges.join(a, "fact_a_id").join(b, "fact_b_id").where("_fa <> _fb").drop("_fa", "_fb")


def fact(facts: DataFrame, fact_id: Column) -> DataFrame:
    return facts.where(F.col("id") == fact_id)


def search_edges(edges: DataFrame, facts: DataFrame, word: str) -> DataFrame:
    """Relationships of which either fact matches; both facts must exist."""
    found = facts.select("id", F.lower(F.concat_ws(" ", "entity", "attribute", "temporal_scope")).contains(word.lower()).alias("_hit"))
    side = lambda n: found.select(F.col("id").alias(f"fact_{n}_id"), F.col("_hit").alias(f"_{n}"))
    return edges.join(side("a"), "fact_a_id").join(side("b"), "fact_b_id").where("_a or _b").drop("_a", "_b")


def search(facts: DataFrame, word: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "entity", "attribute", "temporal_scope"))
    return facts.where(text.contains(word.lower()))


def low_confidence(facts: DataFrame, most: int = 30, least: float = LOW) -> DataFrame:
    return facts.where(F.col("confidence") < least).orderBy("confidence", "id").limit(most)


def counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relationship_type").agg(F.count(F.lit(1)).alias("n"))


def first_k(edges: DataFrame, k: int = 3) -> DataFrame:
    w = Window.partitionBy("relationship_type").orderBy(F.desc("confidence"), "fact_a_id", "fact_b_id")
    return edges.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def render(edges: DataFrame, facts: DataFrame, cut: int = 160) -> DataFrame:
    """Relationships with ``rendered``: type and confidence, both facts with citation and quote, and why; a missing fact leaves a stub."""
    value = F.coalesce(plain_number(F.col("value_num")), F.col("value_text"))
    told = F.concat_ws("\n", fact_summary(F.col("entity"), F.col("attribute"), value, F.col("unit"), F.col("temporal_scope")), F.concat(F.lit("     "), locator(F.col("file_id"), F.col("page_number"), F.col("char_start"), F.col("char_end"))), F.concat(F.lit('     "'), F.substring(collapse_ws(F.col("quote")), 1, cut), F.lit('"')))
    side = lambda n: facts.select(F.col("id").alias(f"fact_{n}_id"), told.alias(f"_q{n}"))
    out = edges.join(side("a"), "fact_a_id", "left").join(side("b"), "fact_b_id", "left")
    whole = F.concat_ws("\n", F.format_string("[%s] confidence %.2f", "relationship_type", "confidence"), F.concat(F.lit("  A: "), "_qa"), F.concat(F.lit("  B: "), "_qb"), F.concat(F.lit("  Why: "), "explanation"))
    stub = F.concat("relationship_type", F.lit(": (missing fact)"))
    return out.withColumn("rendered", F.when(F.col("_qa").isNull() | F.col("_qb").isNull(), stub).otherwise(whole)).drop("_qa", "_qb")


KINDS = ("CORROBORATED", "GENUINE_CONTRADICTION", "APPARENT_CONTRADICTION")


def first_facts(facts: DataFrame, k: int = 8) -> DataFrame:
    """The first k facts of each document, by place."""
    w = Window.partitionBy("file_id").orderBy("page_number", "char_start", "id")
    return facts.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def run_report(facts: DataFrame, edges: DataFrame, reports: DataFrame | None = None, k: int = 3, samples: int = 8) -> DataFrame:
    """(part, file_id, place, line): what a command line shows of a run, in the order of these columns.

    Part 0 has a line a document, where ``reports`` are given; part 1 each document's first facts;
    part 2 the first relationships over documents of each type, under the type as file_id.
    """
    from .pipeline import summary

    said = F.coalesce(F.col("value_text"), plain_number(F.col("value_num")))
    line = F.format_string("  [%s %.2f] %s | %s = %s @ %s", F.coalesce("extractor", F.lit("?")) if "extractor" in facts.columns else F.lit("?"), "confidence", "entity", "attribute", F.concat_ws(" ", said, "unit"), F.coalesce("temporal_scope", F.lit("no period")))
    out = first_facts(facts, samples).select(F.lit(1).alias("part"), "file_id", F.col("position").alias("place"), line.alias("line"))
    shown = render(first_k(cross_document(edges, facts).where(F.col("relationship_type").isin(*KINDS)), k), facts)
    out = out.unionByName(shown.select(F.lit(2).alias("part"), F.col("relationship_type").alias("file_id"), F.col("position").alias("place"), F.col("rendered").alias("line")))
    return out if reports is None else out.unionByName(summary(reports).select(F.lit(0).alias("part"), "file_id", F.lit(1).alias("place"), F.col("summary").alias("line")))


def sections(facts: DataFrame, edges: DataFrame, word: str = "", most: int = 30) -> dict[str, DataFrame]:
    """What a screen shows: each type of relationship over documents and the least sure facts, filtered by a word, ``most`` of each."""
    across = search_edges(cross_document(edges, facts), facts, word)
    out = {kind: of_type(across, kind).orderBy(F.desc("confidence"), "fact_a_id", "fact_b_id").limit(most) for kind in KINDS}
    return out | {"low_confidence": low_confidence(search(facts, word), most)}
