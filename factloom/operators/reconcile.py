"""Reconciliation of facts: attribute cores, blocking, pairs and the verdict ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import temporal, units
from ..functions.text import collapse_ws, let, normalize_key, plain_number
from .entities import GENERIC_ENTITIES, normalize_entity, resolve  # noqa: F401
from .facts import relationship_id
from .stages import Settled

# Measurement modifiers, stop words, generic labels.
MODIFIERS = (
    "adjusted adj reported restated normalised normalized consolidated standalone proforma pro forma underlying excluding including incl excl annualised annualized "
    "average estimated projected provisional revised budgeted actual"
).split()
STOP = "the a an of from for in on at to and or by with as per less add is was".split()
GENERIC_LABELS = (
    "others other total totals net gross balance miscellaneous sundry various change movement movements adjustment adjustments remaining reconciliation difference "
    "subtotal provision provisions reserve reserves addition additions deduction deductions general misc"
).split()
QUALIFIERS = ("basis", "section", "binding", "source", "context")
MAX_BLOCK = 250


def signature(attribute: Column) -> Column:
    """struct(core, modifiers): sorted words with measurement modifiers set apart; only modifiers are their own core."""
    words = F.filter(F.split(F.lower(attribute), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*STOP))
    core = F.filter(words, lambda w: ~w.isin(*MODIFIERS))
    bare = F.size(core) == 0
    mods = F.array_sort(F.array_distinct(F.filter(words, lambda w: w.isin(*MODIFIERS))))
    return F.struct(F.array_sort(F.when(bare, words).otherwise(core)).alias("core"), F.when(bare, F.array().cast("array<string>")).otherwise(mods).alias("modifiers"))


def similarity(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def prepare(facts: DataFrame, profiles: DataFrame | None = None, subjects: DataFrame | None = None, aliases: dict[str, str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Facts with everything a pair needs, worked out once before they meet: cluster of the entity, core of the attribute, period, canonical value.

    Periods and units are parsed once for each distinct label and joined back: labels repeat far more than they differ.
    """
    f = resolve(facts, subjects, aliases, known).drop("key", "canonical").withColumn("cluster", F.coalesce("cluster", normalize_entity(F.col("entity"))))
    scopes = facts.select("temporal_scope").distinct().withColumn("scope", temporal.parse_period(F.col("temporal_scope"))).withColumn("period", temporal.canonical(F.col("scope")))
    named = facts.select("unit").distinct().withColumn("u", units.parse_unit(F.col("unit")))
    labels = facts.select("attribute").distinct().withColumn("sig", signature(F.col("attribute"))).withColumn("attribute_key", normalize_key(F.col("attribute")))
    for side, key in ((scopes, "temporal_scope"), (named, "unit"), (labels, "attribute")):
        f = f.join(side.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    # facts stored without their written places have those of the number
    places = units.places(F.col("value_num"))
    f = f.withColumn("decimals", F.coalesce("decimals", places) if "decimals" in facts.columns else places)
    f = f.withColumn("v", units.canonical_value(F.col("value_num"), F.col("u"))).withColumn("h", units.half_ulp(F.col("decimals"), F.col("u"))).withColumn("k", units.unit_key(F.col("u")))
    f = f.withColumn("core_key", F.array_join("sig.core", " "))
    profiles = vintages(facts) if profiles is None else profiles
    return f.join(profiles.select("file_id", "vintage_year"), "file_id", "left")


def profile_documents(facts: DataFrame, subjects: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """A row a document: file_id, filename (its id where no name is given), subject, vintage_year (null where no fact has a year)."""
    out = facts.select("file_id").distinct().join(vintages(facts), "file_id", "left")
    out = out.join(subjects.select("file_id", "subject"), "file_id", "left") if subjects is not None else out.withColumn("subject", F.lit(""))
    out = out.join(names.select("file_id", "filename"), "file_id", "left") if names is not None else out.withColumn("filename", F.lit(None).cast("string"))
    return out.select("file_id", F.coalesce("filename", "file_id").alias("filename"), F.coalesce("subject", F.lit("")).alias("subject"), "vintage_year")


def vintages(facts: DataFrame) -> DataFrame:
    """file_id and the median year of its facts, half to even."""
    year = temporal.parse_period(F.col("temporal_scope"))["year"]
    return facts.select("file_id", year.alias("y")).where("y > 1900 and y < 2200").groupBy("file_id").agg(F.bround(F.median("y")).cast("int").alias("vintage_year"))


#: What verdicts and explanations read of a fact; quotes and statements stay out of the pairs.
PAIRED = (
    "id file_id entity attribute value_num value_text unit temporal_scope qualifiers confidence match_strategy scope period u v h k sig attribute_key vintage_year"
).split()


def pairs(prepared: DataFrame, max_block: int = MAX_BLOCK, cross_document_only: bool = False) -> DataFrame:
    """Unordered pairs within (cluster, core) blocks of at most ``max_block`` facts; larger blocks are reported, see ``blocks``."""
    sized = prepared.groupBy("cluster", "core_key").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("n") <= max_block)).drop("n")
    kept = prepared.join(sized, ["cluster", "core_key"], "left_semi")
    a, b = (kept.select(F.struct(*PAIRED).alias(side), "cluster", "core_key") for side in ("a", "b"))
    out = a.join(b, ["cluster", "core_key"]).where(F.col("a.id") < F.col("b.id"))
    return out.where(F.col("a.file_id") != F.col("b.file_id")) if cross_document_only else out


def blocks(prepared: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """Block sizes, the pairs they give and the pairs that the guard skips."""
    n = F.col("n")
    sized = prepared.groupBy("cluster", "core_key").agg(F.count(F.lit(1)).alias("n"))
    return sized.select("cluster", "core_key", "n", F.when(n <= max_block, n * (n - 1) / 2).otherwise(0).cast("long").alias("pairs"), F.when(n > max_block, n * (n - 1) / 2).otherwise(0).cast("long").alias("skipped"))


def classify(met: DataFrame) -> DataFrame:
    """Pairs with relationship, dimension and confidence, by the verdict ladder.

    Cores that overlap too little, generic labels under different headings, other dimensions and
    other periods are no relationship; nested periods only seem to conflict; values of one period
    agree, or differ for a definition, a heading, a vintage or weak evidence, or else truly conflict.
    """
    a, b = F.col("a"), F.col("b")
    same_doc = a["file_id"] == b["file_id"]
    agree = units.agreement(a["v"], a["h"], a["k"], b["v"], b["h"], b["k"])
    mods = a["sig"]["modifiers"] != b["sig"]["modifiers"]
    vintage = ~same_doc & F.coalesce(a["vintage_year"] != b["vintage_year"], F.lit(False))
    differs = [~a["qualifiers"][q].eqNullSafe(b["qualifiers"][q]) for q in QUALIFIERS]
    others = differs[0] | differs[1] | differs[2] | differs[3]
    weak = a["qualifiers"]["binding"].isNotNull() | b["qualifiers"]["binding"].isNotNull() | (F.least(a["confidence"], b["confidence"]) < 0.6) | (a["match_strategy"] == "FUZZY") | (b["match_strategy"] == "FUZZY")
    place = [normalize_key(F.coalesce(F.nullif(x["qualifiers"]["context"], F.lit("")), F.nullif(x["qualifiers"]["section"], F.lit("")))) for x in (a, b)]
    generic = a["attribute_key"].isin(*GENERIC_LABELS) | b["attribute_key"].isin(*GENERIC_LABELS)
    agree_place = place[0].contains(place[1]) | place[1].contains(place[0])
    numeric = a["v"].isNotNull() & b["v"].isNotNull()
    said = [F.lower(collapse_ws(F.coalesce(x["value_text"], plain_number(x["value_num"])))) for x in (a, b)]
    same_text = said[0] == said[1]

    def verdict(kind: str, dimension: str, confidence: float | Column) -> Column:
        return F.struct(F.lit(kind).alias("relationship_type"), F.lit(dimension).alias("dimension"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"))

    known = F.struct(
        temporal.relation(a["scope"], b["scope"]).alias("rel"), agree.alias("agree"), similarity(a["sig"]["core"], b["sig"]["core"]).alias("overlap"), same_doc.alias("same_doc"), mods.alias("mods"),
        vintage.alias("vintage"), others.alias("others"), differs[4].alias("context"), weak.alias("weak"), generic.alias("generic"), (place[0].isNull() | place[1].isNull()).alias("no_place"), agree_place.alias("agree_place"),
        numeric.alias("numeric"), F.coalesce(same_text, F.lit(False)).alias("same_text"), a["v"].alias("va"), b["v"].alias("vb"),
        (F.coalesce(a["u"]["scale"], F.lit(1.0)) != F.coalesce(b["u"]["scale"], F.lit(1.0))).alias("converted"),
    )

    def shared(k: Column) -> Column:
        first = k["rel"] == "a_contains_b"
        part = F.when(first, k["vb"]).when(k["rel"] == "b_contains_a", k["va"])
        share = F.bround(F.abs(part) / F.nullif(F.abs(F.when(first, k["va"]).otherwise(k["vb"])), F.lit(0.0)), 3)
        return F.struct(k.alias("k"), share.alias("share"))

    def told(s: Column) -> Column:
        k, share = s["k"], s["share"]
        return F.struct(_ladder(k, share, verdict).alias("verdict"), k["agree"].alias("agree"), share.alias("share"))

    out = let(let(known, shared), told)
    return met.withColumn("told", out).select("*", "told.verdict", "told.agree", "told.share").drop("told")


def _ladder(k: Column, share: Column, verdict) -> Column:
    rel, band, same_doc, mods, numeric = k["rel"], k["agree"]["band"], k["same_doc"], k["mods"], k["numeric"]
    sure = F.when(same_doc, 0.8).otherwise(0.92)
    return (
        F.when(k["overlap"] < 0.6, verdict("ORTHOGONAL", "attribute", 0.5))
        .when(k["generic"] & k["no_place"], verdict("ORTHOGONAL", "generic label", 0.4))
        .when(k["generic"] & ~k["agree_place"], verdict("ORTHOGONAL", "generic label", 0.7))
        .when(~numeric & k["same_text"], verdict("CORROBORATED", "text", 0.7))
        .when(~numeric & (rel == "same"), verdict("GENUINE_CONTRADICTION", "text", 0.6))
        .when(~numeric, verdict("APPARENT_CONTRADICTION", "text", 0.6))
        .when(band == "INCOMPARABLE", verdict("ORTHOGONAL", "unit", 0.6))
        .when((rel == "same") & (band == "MATCH") & k["converted"], verdict("CORROBORATED", "unit conversion", sure))
        .when((rel == "same") & (band == "MATCH"), verdict("CORROBORATED", "direct", sure))
        .when((rel == "same") & (band == "ROUNDING_BOUNDARY") & k["vintage"], verdict("APPARENT_CONTRADICTION", "data vintage", 0.55))
        .when((rel == "same") & (band == "ROUNDING_BOUNDARY") & mods, verdict("APPARENT_CONTRADICTION", "definition", 0.5))
        .when((rel == "same") & (band == "ROUNDING_BOUNDARY"), verdict("CORROBORATED", "rounding", 0.55))
        .when((rel == "same") & mods, verdict("APPARENT_CONTRADICTION", "definition", 0.85))
        .when((rel == "same") & k["others"], verdict("APPARENT_CONTRADICTION", "scope qualifier", 0.7))
        .when((rel == "same") & k["context"], verdict("APPARENT_CONTRADICTION", "scope qualifier", 0.55))
        .when((rel == "same") & k["vintage"], verdict("APPARENT_CONTRADICTION", "data vintage", 0.6))
        .when((rel == "same") & k["weak"], verdict("APPARENT_CONTRADICTION", "extraction uncertainty", 0.35))
        .when(rel == "same", verdict("GENUINE_CONTRADICTION", "none found", F.when(same_doc, 0.7).otherwise(0.8)))
        .when((rel == "unknown") & (band == "MATCH"), verdict("CORROBORATED", "period unknown", 0.45))
        .when(rel == "unknown", verdict("ORTHOGONAL", "period unknown", 0.3))
        .when(rel == "disjoint", verdict("ORTHOGONAL", "period", 0.8))
        .when(band == "MATCH", verdict("ORTHOGONAL", "temporal", 0.4))
        .when(share > 1.05, verdict("APPARENT_CONTRADICTION", "temporal implausible", 0.35))
        .otherwise(verdict("APPARENT_CONTRADICTION", "temporal", 0.85))
    )


def _worded(a: Column, b: Column, verdict: Column, agree: Column, share: Column) -> tuple[Column, Column]:
    """Why a pair has its verdict, in words and as a struct of what the verdict rests on."""
    value = lambda x: F.trim(F.concat_ws(" ", F.coalesce(plain_number(x["value_num"]), x["value_text"]), x["unit"]))
    both = lambda x, y: F.array_sort(F.array_union(F.array_except(x, y), F.array_except(y, x)))
    none = F.array().cast("array<string>")
    delta = both(a["sig"]["modifiers"], b["sig"]["modifiers"])
    differing = F.filter(F.array(*[F.when(~a["qualifiers"][q].eqNullSafe(b["qualifiers"][q]), F.struct(F.lit(q).alias("key"), a["qualifiers"][q].alias("a"), b["qualifiers"][q].alias("b"))) for q in QUALIFIERS]), lambda x: x.isNotNull())
    sure = F.least(a["confidence"], b["confidence"])
    weak = F.concat_ws(
        " and ", F.when(a["qualifiers"]["binding"].isNotNull() | b["qualifiers"]["binding"].isNotNull(), "a value's column was inferred"), F.when(sure < 0.6, F.format_string("a fact is held at %.2f only", sure)),
        F.when((a["match_strategy"] == "FUZZY") | (b["match_strategy"] == "FUZZY"), "a quote was matched approximately"),
    )
    va, vb = a["vintage_year"], b["vintage_year"]
    gap = F.when((a["file_id"] != b["file_id"]) & (va != vb), F.abs(va - vb))
    a_first = va < vb
    whole = F.when(share.isNotNull() | verdict["dimension"].startswith("temporal"), F.when(temporal.contains(a["scope"], b["scope"]), a["temporal_scope"]).otherwise(b["temporal_scope"]))
    part = F.when(whole.isNotNull(), F.when(temporal.contains(a["scope"], b["scope"]), b["temporal_scope"]).otherwise(a["temporal_scope"]))
    numeric = agree["band"].isNotNull()
    context = F.struct(
        verdict["dimension"].alias("dimension"), a["temporal_scope"].alias("period_a"), b["temporal_scope"].alias("period_b"), temporal.relation(a["scope"], b["scope"]).alias("period_relation"), value(a).alias("value_a"), value(b).alias("value_b"),
        a["v"].alias("normalized_a"), b["v"].alias("normalized_b"), F.round(agree["difference"], 4).alias("difference"), F.round(agree["relative"], 6).alias("relative_difference"), F.round(agree["tolerance"], 4).alias("tolerance"), agree["band"].alias("agreement_band"),
        (a["file_id"] == b["file_id"]).alias("same_document"), F.when(F.size(delta) > 0, delta).alias("modifier_delta"), F.when(F.size(differing) > 0, differing).alias("qualifier_delta"), F.when(gap.isNotNull(), F.when(a_first, a["file_id"]).otherwise(b["file_id"])).alias("older"),
        F.when(gap.isNotNull(), F.when(a_first, b["file_id"]).otherwise(a["file_id"])).alias("newer"), gap.alias("gap"), F.nullif(weak, F.lit("")).alias("weakness"), whole.alias("whole"), part.alias("part"), share.alias("part_share_of_whole"),
        F.when(verdict["dimension"] == "temporal implausible", "implausible: look at the extraction").alias("flag"),
    )
    name, scope, told = a["attribute"], F.coalesce(a["temporal_scope"], F.lit("no period")), units.explain_agreement(agree)
    say = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("?")) for p in x])
    d = verdict["dimension"]
    why = (
        F.when(d == "attribute", say("'", name, "' and '", b["attribute"], "' measure different things"))
        .when(d == "generic label", say("'", name, "' is too general a label to compare where it does not stand under the same heading"))
        .when(d == "text", F.when(verdict["relationship_type"] == "CORROBORATED", say("both say of ", name, ": ", value(a))).otherwise(say("of ", name, " one says ", value(a), " and the other ", value(b))))
        .when(d == "unit", say("the units of ", value(a), " and ", value(b), " measure different things"))
        .when(d == "unit conversion", say("both report ", name, " for ", scope, ", one in ", a["unit"], " and one in ", b["unit"], ": ", told))
        .when(d == "direct", say("both report ", name, " for ", scope, ": ", told))
        .when(d == "data vintage", say(name, " for ", scope, " is reported by documents ", gap.cast("string"), " years apart, so one may revise the other: ", told))
        .when(d == "definition", say("'", name, "' and '", b["attribute"], "' differ in ", F.array_join(F.coalesce(delta, none), ", "), ": ", told))
        .when(d == "rounding", say("both report ", name, " for ", scope, " as far as rounding lets one tell: ", told))
        .when(d == "scope qualifier", say("the figures stand under different headings (", F.array_join(F.transform(differing, lambda x: F.concat_ws(" ", x["key"], F.coalesce(x["a"], F.lit("none")), F.lit("against"), F.coalesce(x["b"], F.lit("none")))), "; "), "): ", told))
        .when(d == "extraction uncertainty", say("the figures differ, but ", weak, ", so the reading may be at fault: ", told))
        .when(d == "none found", say("same measure, period and units, and nothing that explains it: ", told))
        .when(d == "period unknown", say("at least one period is not stated: ", told))
        .when(d == "period", say("the same measure at different times, ", scope, " and ", b["temporal_scope"]))
        .when(d == "temporal implausible", say(part, " lies within ", whole, " and yet is larger, so a figure was probably misread: ", told))
        .when(verdict["relationship_type"] == "ORTHOGONAL", say(part, " lies within ", whole, " and has the same value, which is worth a look"))
        .otherwise(say(part, " lies within ", whole, " and is ", F.coalesce(F.format_string("%.1f%%", share * 100), F.lit("a part")), " of it"))
    )
    return F.when(numeric | d.isNotNull(), why), context


def reconcile(
    facts: DataFrame, emit_orthogonal: bool = False, max_block: int = MAX_BLOCK, min_confidence: float = 0.0, cross_document_only: bool = False, subjects: DataFrame | None = None, aliases: dict[str, str] | None = None, prepared: DataFrame | None = None, with_block: bool = False,
) -> DataFrame:
    """Relationships among facts, one row per related pair, with explanation and context.

    facts: id, file_id, entity, attribute, value_num, value_text, decimals, unit, temporal_scope,
    qualifiers map, confidence, match_strategy. subjects: file_id, subject, for which generic
    names stand. Facts meet where their entities are of one cluster and their attributes of one
    core; with_block adds both as columns cluster and core_key.
    """
    kept = Settled()
    prepared = kept(prepare(kept(facts), subjects=subjects, aliases=aliases)) if prepared is None else prepared
    out = classify(pairs(prepared, max_block, cross_document_only)).where(F.col("verdict.confidence") >= min_confidence)
    out = out if emit_orthogonal else out.where(F.col("verdict.relationship_type") != "ORTHOGONAL")
    explanation, context = _worded(F.col("a"), F.col("b"), F.col("verdict"), F.col("agree"), F.col("share"))
    a, b = F.col("a.id"), F.col("b.id")
    return out.select(
        relationship_id(a, b, F.col("verdict.relationship_type")).alias("id"), a.alias("fact_a_id"), b.alias("fact_b_id"), F.col("a.file_id").alias("file_a"), F.col("b.file_id").alias("file_b"),
        F.col("a.entity").alias("entity"), F.col("a.attribute").alias("attribute_a"), F.col("b.attribute").alias("attribute_b"), F.col("a.period").alias("period_a"), F.col("b.period").alias("period_b"),
        "verdict.relationship_type", "verdict.dimension", "verdict.confidence", F.col("agree.band").alias("band"), F.col("agree.difference").alias("difference"), "share", explanation.alias("explanation"), context.alias("context"), F.lit("DETERMINISTIC").alias("detector"),
        *(["cluster", "core_key"] if with_block else []),
    )


def ordered(edges: DataFrame) -> DataFrame:
    """Most confident first, then by type, then by their facts: a global sort, for what is shown."""
    return edges.orderBy(F.desc("confidence"), "relationship_type", "fact_a_id", "fact_b_id")


def report(prepared: DataFrame, every: DataFrame, max_block: int = MAX_BLOCK, min_confidence: float = 0.0) -> DataFrame:
    """One row: facts, entity clusters, blocks, largest block, pairs evaluated, pairs that the guard skipped, relationships by type.

    every: relationships of all confidences with the orthogonal ones; those count, but other ones below ``min_confidence`` do not.
    """
    b = blocks(prepared, max_block)
    sizes = b.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("facts"), F.countDistinct("cluster").alias("entity_clusters"), F.count(F.lit(1)).alias("blocks"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_block"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("pairs_skipped_budget"))
    counted = every.where((F.col("relationship_type") == "ORTHOGONAL") | (F.col("confidence") >= min_confidence)).groupBy("relationship_type").agg(F.count(F.lit(1)).alias("n"))
    by = counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("relationship_type").alias("key"), F.col("n").alias("value"))))).alias("relationships_by_type"))
    return sizes.join(every.agg(F.count(F.lit(1)).alias("pairs_evaluated")), how="inner").join(by, how="inner")
