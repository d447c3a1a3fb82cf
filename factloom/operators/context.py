"""What holds over a document: declared units, subject, country, the end of the fiscal year, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import temporal, units
from ..functions.text import collapse_ws, let, matches, nameless, normalize_key, organisation_names, titlecase_name

DECLARATION = r"\([^()\n]{2,90}\)"
STATED = "unless otherwise stated"
COVER_PAGES, FRONT_PAGES, VOTING_PAGES, MARCH, UNKNOWN = 2, 3, 20, 3, "Unknown subject"
CAPITALISED = r"\b[A-Z][a-zA-Z]{2,}\b"
# Words of measures that belong to a country's economy, not to who reports them.
COUNTRY_MEASURES = "gdp inflation cpi wpi deficit unemployment reserves exports imports remittances gni forex rupee currency trade poverty population literacy".split()


def _alone_on_line() -> str:
    """A currency and a scale word that fill a line."""
    scales = "|".join(sorted((w.replace("'", "'") for w in units.SCALES), key=len, reverse=True))
    return rf"(?im)^[ \t]*(?:₹|Rs\.?|INR|USD|\$)\s*(?:in\s+)?(?:{scales})[ \t]*$"


def unit_declarations(pages: DataFrame) -> DataFrame:
    """(file_id, page_number, char_start, char_end, text, unit, is_global): units stated in brackets or alone on a line; ratios and mere numbers are none."""

    def found(pattern: str, bracketed: bool) -> DataFrame:
        d = pages.select("file_id", "page_number", F.explode(matches(F.col("text"), pattern=pattern)).alias("m"))
        inner = F.regexp_replace("m.hit", r"^\(|\)$", "") if bracketed else F.col("m.hit")
        d = d.withColumn("inner", inner).withColumn("unit", units.parse_unit(F.col("inner"))).where("unit is not null")
        if bracketed:
            d = d.where((F.col("unit.dimension") != "RATIO") & ~F.col("inner").rlike(r"^[\d,.\s%]+$"))
        stated = F.lower("inner").contains(STATED) if bracketed else F.lit(False)
        return d.select("file_id", "page_number", F.col("m.at").alias("char_start"), (F.col("m.at") + F.length("m.hit")).alias("char_end"), collapse_ws(F.col("m.hit")).alias("text"), "unit", stated.alias("is_global"), F.lit(bracketed).alias("bracketed"))

    return found(DECLARATION, True).unionByName(found(_alone_on_line(), False))


def default_units(declarations: DataFrame, pages: DataFrame) -> DataFrame:
    """(file_id, default_unit): the first unit that holds "unless otherwise stated", else the one on most pages if on two and a quarter of them."""
    place = F.struct("page_number", "char_start")
    stated = declarations.where("is_global").groupBy("file_id").agg(F.min_by("unit", place).alias("stated"))
    key = F.concat_ws("|", units.unit_key(F.col("unit")), F.col("unit.scale").cast("string"))
    seen = declarations.where("bracketed").withColumn("k", key).groupBy("file_id", "k").agg(F.countDistinct("page_number").alias("n"), F.min(place).alias("at"), F.min_by("unit", place).alias("u"))
    order = F.struct("n", (-F.col("at.page_number")).alias("p"), (-F.col("at.char_start")).alias("s"))
    most = seen.groupBy("file_id").agg(F.max_by("u", order).alias("usual"), F.max("n").alias("n"))
    total = pages.groupBy("file_id").agg(F.countDistinct("page_number").alias("pages"))
    both = total.join(stated, "file_id", "left").join(most, "file_id", "left")
    usual = F.when(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") / 4)), F.col("usual"))
    return both.select("file_id", F.coalesce("stated", usual).alias("default_unit"))


def resolve_units(points: DataFrame, declarations: DataFrame, defaults: DataFrame | None = None, at: str = "char_start", inline: Column | None = None) -> DataFrame:
    """Points (file_id, page_number, at) with ``unit`` and ``unit_source``.

    In this order: the number's own unit (``inline``), the last declaration at or before the point
    on its page, the first on the page, the document's default (where ``defaults`` are given), none.
    An as-of join: one window over both tables, no pairs.
    """
    # ties of position: declarations come before points; a point travels as one value
    place = ["file_id", "page_number", at]
    p = points.select(*place, F.lit(1).alias("_is"), F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_p"), F.lit(None).cast(declarations.schema["unit"].dataType).alias("_u"))
    d = declarations.select("file_id", "page_number", F.col("char_start").alias(at), F.lit(0).alias("_is"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.col("unit").alias("_u"))
    w = Window.partitionBy("file_id", "page_number").orderBy(at, "_is")
    out = p.union(d).withColumn("_last", F.last("_u", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.withColumn("_first", F.first("_u", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))).where("_is = 1").select("_p.*", "_last", "_first")
    none = F.lit(None).cast(declarations.schema["unit"].dataType)
    if defaults is not None:
        out = out.join(defaults.select("file_id", F.col("default_unit").alias("_d")), "file_id", "left")
    else:
        out = out.withColumn("_d", none)
    own = none if inline is None else inline
    source = F.when(own.isNotNull(), "inline").when(F.col("_last").isNotNull(), "page-declaration").when(F.col("_first").isNotNull(), "page-declaration-after").when(F.col("_d").isNotNull(), "document-default").otherwise("none")
    return out.withColumn("unit", F.coalesce(own, "_last", "_first", "_d")).withColumn("unit_source", source).drop("_last", "_first", "_d")


def page_units(points: DataFrame, declarations: DataFrame, out: str = "page_unit") -> DataFrame:
    """Points with the unit that their own page declares, else null: a document's default does not reach single figures."""
    return resolve_units(points, declarations).withColumnRenamed("unit", out).drop("unit_source")


def year_end_months(pages: DataFrame) -> DataFrame:
    """(file_id, year_end_month): the month that the first pages name most often as the year's end, the first named of equals; March if none."""
    voting = pages.where(F.col("page_number") <= VOTING_PAGES).select("file_id", "page_number", F.posexplode(temporal.year_end_votes(F.col("text"))).alias("i", "m"))
    votes = voting.groupBy("file_id", "m").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page_number", "i")).alias("at"))
    first = F.struct("n", (-F.col("at.page_number")).alias("p"), (-F.col("at.i")).alias("i"))
    best = votes.groupBy("file_id").agg(F.max_by("m", first).alias("m"))
    return pages.select("file_id").distinct().join(best, "file_id", "left").select("file_id", F.coalesce("m", F.lit(MARCH)).cast("int").alias("year_end_month"))


def standalone_nouns(pages: DataFrame) -> DataFrame:
    """(file_id, noun, n): capitalised words next to no other capitalised word, with their counts; the first form seen names them."""
    hits = pages.select("file_id", "page_number", matches(F.col("text"), pattern=CAPITALISED).alias("m"))

    def alone(all_: Column) -> Column:
        end = lambda x: x["at"] + F.length(x["hit"])

        def keep(x: Column, i: Column) -> Column:
            before, after = F.get(all_, i - 1), F.get(all_, i + 1)
            near = F.coalesce((i > 0) & (end(before) + 1 >= x["at"]), F.lit(False)) | F.coalesce(end(x) + 1 >= after["at"], F.lit(False))
            return ~near & (F.length(x["hit"]) >= 4) & ~nameless(x["hit"]) & x["hit"].rlike("^[A-Z][a-z]+$")

        return F.filter(all_, keep)

    t = hits.select("file_id", "page_number", F.explode(let(F.col("m"), alone)).alias("x"))
    place = F.struct("page_number", "x.at")
    return t.groupBy("file_id", F.lower("x.hit").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"), F.min_by("x.hit", place).alias("noun")).drop("k")


def country_contexts(pages: DataFrame) -> DataFrame:
    """(file_id, country): the most frequent noun that stands alone; of equals the first seen."""
    order = F.struct("n", (-F.col("at.page_number")).alias("p"), (-F.col("at.at")).alias("s"))
    return standalone_nouns(pages).groupBy("file_id").agg(F.max_by("noun", order).alias("country"))


def country_report_subjects(pages: DataFrame) -> DataFrame:
    """(file_id, reported): the country of a report that calls itself a country report: a line of capitals just after the label, else a title that ends FOR a name."""
    front = pages.where(F.col("page_number") <= FRONT_PAGES).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\n").alias("front"))
    label = r"(?i)Country\s+Report\b"
    after = F.substring(F.regexp_replace("front", rf"(?s)^.*?{label}", ""), 1, 200)
    front = front.where(F.col("front").rlike(label)).withColumn("after", after)
    caps = collapse_ws(F.regexp_extract("after", r"(?m)^[ \t]*([A-Z][A-Z\s]{2,40})[ \t]*$", 1))
    titles = F.transform(F.regexp_extract_all("front", F.lit(r"(?m)\bFOR\s+(?:THE\s+)?([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,2})\b\.?\s*$"), F.lit(1)), collapse_ws)
    by_title = F.try_element_at(F.filter(titles, lambda t: ~nameless(t)), F.lit(1))
    by_line = let(caps, lambda c: F.when((F.length(c) >= 2) & (F.length(c) <= 40) & ~nameless(c), F.initcap(c)))
    return front.select("file_id", F.coalesce(by_line, by_title).alias("reported")).where("reported is not null")


def named_subjects(pages: DataFrame) -> DataFrame:
    """(file_id, named): the organisation that the cover pages name most often; of equals the one that the whole document repeats most."""
    cover = pages.where(F.col("page_number") <= COVER_PAGES).select("file_id", "page_number", F.posexplode(organisation_names(F.col("text"))).alias("i", "name"))
    counts = cover.groupBy("file_id", F.lower("name").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page_number", "i")).alias("at"), F.min_by("name", F.struct("page_number", "i")).alias("name"))
    low = F.lower("text")
    body = pages.select("file_id", low.alias("low")).join(counts.select("file_id", "k"), "file_id")
    times = body.groupBy("file_id", "k").agg(F.sum((F.length("low") - F.length(F.replace("low", F.col("k"), F.lit("")))) / F.length("k")).alias("m"))
    order = F.struct("n", "m", (-F.col("at.page_number")).alias("p"), (-F.col("at.i")).alias("i"))
    return counts.join(times, ["file_id", "k"]).groupBy("file_id").agg(F.max_by("name", order).alias("named")).select("file_id", titlecase_name(F.col("named")).alias("named"))


def infer_subjects(pages: DataFrame, titles: DataFrame | None = None, country: DataFrame | None = None) -> DataFrame:
    """(file_id, subject): a country report's country, else the organisation on the cover, else the noun that stands alone most often, else a title of up to 80 characters."""
    out = pages.select("file_id").distinct()
    for part in (country_report_subjects(pages), named_subjects(pages), country_contexts(pages) if country is None else country):
        out = out.join(part, "file_id", "left")
    title = F.lit(None).cast("string")
    if titles is not None:
        out = out.join(titles.select("file_id", collapse_ws(F.col("title")).alias("_title")), "file_id", "left")
        title = F.when((F.col("_title") != "") & (F.length("_title") <= 80), F.col("_title"))
    return out.select("file_id", F.coalesce("reported", "named", "country", title, F.lit(UNKNOWN)).alias("subject"))


def build_context(pages: DataFrame, titles: DataFrame | None = None, subject_override: dict[str, str] | None = None, declared: DataFrame | None = None) -> DataFrame:
    """One row a document: subject, country_context (where it is not the subject), year_end_month, default_unit, unit_declarations."""
    declared = unit_declarations(pages) if declared is None else declared
    subject = F.col("subject")
    for file_id, name in (subject_override or {}).items():
        subject = F.when(F.col("file_id") == file_id, name).otherwise(subject)
    country = country_contexts(pages)
    out = infer_subjects(pages, titles, country).withColumn("subject", subject).join(country, "file_id", "left")
    out = out.withColumn("country_context", F.when(normalize_key(F.col("country")) != normalize_key(F.col("subject")), F.col("country"))).drop("country")
    out = out.join(year_end_months(pages), "file_id").join(default_units(declared, pages), "file_id", "left")
    n = declared.groupBy("file_id").agg(F.count(F.lit(1)).alias("unit_declarations"))
    return out.join(n, "file_id", "left").fillna(0, ["unit_declarations"])


def reattribute(facts: DataFrame, context: DataFrame) -> DataFrame:
    """Facts of the document's subject on measures of an economy become facts of the country; all others stay as they are."""
    c = context.select("file_id", F.col("subject").alias("_s"), F.col("country_context").alias("_c"))
    macro = F.arrays_overlap(F.split(F.lower("attribute"), "[^a-z0-9]+"), F.array(*map(F.lit, COUNTRY_MEASURES)))
    moved = F.coalesce(F.col("_c").isNotNull() & (normalize_key(F.col("entity")) == normalize_key(F.col("_s"))) & macro, F.lit(False))
    return facts.join(c, "file_id", "left").withColumn("_m", moved).withColumn("entity", F.when(F.col("_m"), F.col("_c")).otherwise(F.col("entity"))).withColumn("id", F.when(~F.col("_m"), F.col("id"))).drop("_s", "_c", "_m")
