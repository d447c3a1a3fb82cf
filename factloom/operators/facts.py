"""Facts as rows: their columns, identity, validity and derived values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import units
from ..functions.text import collapse_ws, normalize_key, plain_number, stable_hash

#: Extractors in the order in which they run; of equally sure duplicates the first stays.
TABLE, ORPHAN, PROSE, MODEL = "table", "orphan", "prose", "model"
ORDER = (TABLE, ORPHAN, PROSE, MODEL)
STATEMENT_LENGTH = 400
LEAST_SPAN, SPAN_RATIO = 64, 3


def fact_id(file_id: Column, page: Column, start: Column, entity: Column, attribute: Column, value: Column, unit: Column, scope: Column) -> Column:
    """A hash of what a fact claims and where it stands: the same document again gives the same ids. ``value`` as text."""
    return stable_hash(file_id, page, start, normalize_key(entity), normalize_key(attribute), value, unit, scope)


def value_text(value_num: Column, value_text: Column) -> Column:
    return F.coalesce(plain_number(value_num), value_text)


def as_facts(
    df: DataFrame, extractor: str, *, entity: Column, attribute: Column, quantity: Column, scope: Column, statement: Column, quote: Column, start: Column, end: Column, confidence: Column, qualifiers: Column, seq: Column, text_value: Column | None = None,
    strategy: Column | None = None, score: Column | None = None, block_kind: Column | None = None, unit: Column | None = None,
) -> DataFrame:
    """The columns of facts from those of ``df``; file_id and page_number are its own. quantity: struct of value, decimals and unit, or null for a text value."""
    u = quantity["unit"]
    written = text_value if text_value is not None else F.lit(None).cast("string")
    out = df.select(
        F.col("file_id"), F.col("page_number"), collapse_ws(entity).alias("entity"), collapse_ws(attribute).alias("attribute"), quantity["value"].alias("value_num"), F.when(quantity["value"].isNull(), written).alias("value_text"),
        quantity["decimals"].cast("int").alias("decimals"), (units.describe(u) if unit is None else F.coalesce(units.describe(u), unit)).alias("unit"), F.nullif(collapse_ws(scope), F.lit("")).alias("temporal_scope"),
        F.substring(collapse_ws(statement), 1, STATEMENT_LENGTH).alias("raw_statement"), quote.alias("quote"), start.cast("int").alias("char_start"), end.cast("int").alias("char_end"),
        (strategy if strategy is not None else F.lit("EXACT")).alias("match_strategy"), (score if score is not None else F.lit(1.0)).alias("match_score"), (block_kind if block_kind is not None else F.lit("table" if extractor == TABLE else "text")).alias("block_kind"),
        confidence.cast("double").alias("confidence"), F.when(quantity["value"].isNull(), "TEXT").otherwise(units.value_kind(u)).alias("value_kind"), units.canonical_value(quantity["value"], u).alias("normalized_value"),
        F.when(quantity["value"].isNotNull(), F.coalesce(u["currency"], u["canonical"])).alias("normalized_unit"), qualifiers.cast("map<string,string>").alias("qualifiers"), F.lit(extractor).alias("extractor"),
        F.lit(ORDER.index(extractor)).alias("extractor_rank"), F.array_join(F.transform(seq, lambda x: F.lpad(x.cast("string"), 9, "0")), ".").alias("seq"),
    )
    return with_ids(out)


def with_ids(facts: DataFrame) -> DataFrame:
    """Facts with ``id`` filled where it is absent or blank."""
    made = fact_id(*[F.col(c) for c in ("file_id", "page_number", "char_start", "entity", "attribute")], value_text(F.col("value_num"), F.col("value_text")), F.col("unit"), F.col("temporal_scope"))
    has = "id" in facts.columns
    return facts.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), made) if has else made)


def tidy(facts: DataFrame) -> DataFrame:
    """White space of the text fields collapsed; blank optional ones become null."""
    optional = lambda c: F.nullif(collapse_ws(F.col(c)), F.lit("")).alias(c)
    how = {c: collapse_ws(F.col(c)).alias(c) for c in ("entity", "attribute", "raw_statement")} | {c: optional(c) for c in ("unit", "temporal_scope", "normalized_unit")}
    return facts.select(*[how.get(c, F.col(c)) for c in facts.columns])


def fault(df: DataFrame) -> Column:
    """Why a fact may not be kept, or null: blank fields, an impossible span, a quote of another length, no anchor, a share that is none."""
    blank = lambda c: F.coalesce(collapse_ws(F.col(c)), F.lit("")) == ""
    span, size = F.col("char_end") - F.col("char_start"), F.length("quote")
    return (
        F.when(blank("quote"), "blank quote").when(blank("entity"), "blank entity").when(blank("attribute"), "blank attribute").when(blank("raw_statement"), "blank statement")
        .when(F.col("char_start").isNull() | (F.col("char_start") < 0) | F.coalesce(F.col("page_number") < 1, F.lit(False)), "no position").when(F.coalesce(span, F.lit(0)) <= 0, "empty span")
        .when((span > F.greatest(F.lit(LEAST_SPAN), size * SPAN_RATIO)) | (size > F.greatest(F.lit(LEAST_SPAN), span * SPAN_RATIO)), "span and quote differ in length")
        .when(F.col("match_strategy") == "UNVERIFIED", "unverified").when(~F.coalesce(F.col("confidence").between(0, 1) & F.col("match_score").between(0, 1), F.lit(False)), "score out of range")
    )


def validate(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tidied facts that may be kept, and the others with their ``fault``: bad rows are told, they never stop a job."""
    judged = tidy(facts).withColumn("fault", fault(facts))
    return judged.where("fault is null").drop("fault"), judged.where("fault is not null")


def is_numeric(value_num: Column) -> Column:
    return value_num.isNotNull()


def comparable_value(value_num: Column, normalized: Column) -> Column:
    return F.coalesce(normalized, value_num)


def is_conflict(kind: Column) -> Column:
    return kind.isin("GENUINE_CONTRADICTION", "APPARENT_CONTRADICTION")


def relationship_id(a: Column, b: Column, kind: Column) -> Column:
    """The same for both orders of the facts."""
    return stable_hash(F.least(a, b), F.greatest(a, b), kind)


def valid_relationships(edges: DataFrame) -> DataFrame:
    """Relationships of two different facts, with ``id`` filled where it is absent or blank."""
    kept = edges.where(F.col("fact_a_id") != F.col("fact_b_id"))
    made = relationship_id(F.col("fact_a_id"), F.col("fact_b_id"), F.col("relationship_type"))
    return kept.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), made) if "id" in edges.columns else made)


def dedupe(facts: DataFrame, ident: list[str], order: list[Column]) -> DataFrame:
    """One fact by identity: the most confident, then the first by ``order``."""
    w = Window.partitionBy(*ident).orderBy(F.desc("confidence"), *order)
    return facts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def drop_conflicts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Facts whose (keys) hold one distinct number at most, to six places; others contradict themselves and go. Facts without a number stay with their key."""
    w = Window.partitionBy(*keys)
    value = F.round("value_num", 6)
    return facts.withColumn("_lo", F.min(value).over(w)).withColumn("_hi", F.max(value).over(w)).where("_lo <=> _hi").drop("_lo", "_hi")
