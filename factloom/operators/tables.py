"""Pipe tables with offsets: cells, period headers and value columns, label rows, collapsed rows, and the facts they hold.

Everything up to the rows of a table is worked out within the table's own row of the data, so it
needs no exchange; only what labels carry down a table goes through a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import temporal, units
from ..functions.text import clean_label, collapse_ws, defined, is_continuation, let, looks_like_label, nameless
from .facts import TABLE, as_facts

RULE = r"^\s*\|?(?:\s*[-:]+\s*\|)*\s*[-:]+\s*\|?\s*$"
FIGURE = r"(?<![\w.])-?\d[\d,]*(?:\.\d+)?(?![\w.])"
HEADER_ROWS, UNIT_ROWS, UNIT_GAP, LEAD, PAGE_HEAD = 3, 4, 2, 400, 200
CAPTION = r"\b(?:Table|Statement|Appendix|Annex(?:ure)?|Chart|Exhibit)\s*[\dIVXivx.]*\s*[.:]?\s*([A-Z][A-Za-z .&\-]{2,40}?)\s*:"
NIL_CELLS = ("-", "–", "—", "")
INFERRED = "column date under 'ended' wording"
POSITIONAL = "by position: column borders were lost"


def parts(text: Column, separator: str) -> Column:
    """array<struct<at int, text string>>: what stands between separators of one character, with offsets from 0."""
    empty = F.array().cast("array<struct<at:int,text:string>>")
    acc = lambda at, out: F.struct(at.cast("int").alias("at"), out.alias("out"))
    step = lambda a, p: acc(a["at"] + F.length(p) + 1, F.array_append(a["out"], F.struct(a["at"].alias("at"), p.alias("text"))))
    return F.aggregate(F.split(text, separator), acc(F.lit(0), empty), step)["out"]


@defined
def rows_of(text: Column, char_start: Column) -> Column:
    """array<struct<start, end, line, cells array<struct<text, start, end>>>>: the pipe lines but for rules, offsets in the page."""

    def cells(line: Column, start: Column) -> Column:
        base = start + F.instr(line, "|")
        body = F.regexp_replace(line, r"^\s*\||\|\s*$", "")

        def cell(p: Column) -> Column:
            plain = F.trim(p["text"])
            begin = base + p["at"] + F.when(plain == "", 0).otherwise(F.length(p["text"]) - F.length(F.ltrim(p["text"])))
            return F.struct(plain.alias("text"), begin.cast("int").alias("start"), (begin + F.length(plain)).cast("int").alias("end"))

        return F.transform(parts(body, r"(?<!\\)\|"), cell)

    def row(p: Column) -> Column:
        start = char_start + p["at"]
        return F.struct(start.cast("int").alias("start"), (start + F.length(p["text"])).cast("int").alias("end"), p["text"].alias("line"), cells(p["text"], start).alias("cells"))

    kept = F.filter(parts(text, "\n"), lambda p: p["text"].rlike(r"^\s*\|") & ~p["text"].rlike(RULE))
    return F.transform(kept, row)


def _with_years(periods: Column, above: Column) -> Column:
    """Quarters, halves and month runs without a year take the nearest year at or left of them in the row above."""
    annual = lambda s: s["period_type"].isin("FISCAL_YEAR", "CALENDAR_YEAR") & s["year"].isNotNull()
    years = F.transform(above, lambda c: let(temporal.parse_period(c["text"]), lambda s: F.when(annual(s), F.concat(F.lit("FY"), s["year"].cast("string")))))

    def qualified(ys: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            year = F.try_element_at(F.filter(F.slice(ys, 1, i + 1), lambda y: y.isNotNull()), F.lit(-1))
            bare = let(temporal.parse_period(p["label"]), lambda s: s["year"].isNull() & s["period_type"].isin("QUARTER", "HALF", "MONTHS"))
            named = F.struct(F.concat_ws(" ", p["label"], year).alias("label"), p["source_text"].alias("source_text"), F.lit(True).alias("refined"))
            return F.when(p.isNotNull() & bare & year.isNotNull(), named).otherwise(p)

        return F.transform(periods, one)

    return let(years, qualified)


def _columns(periods: Column, below: Column, unit: Column) -> Column:
    """array<struct<col, label, source_text, refined, unit>>: the columns that hold values, each with its period and perhaps a unit of its own."""
    labelled = F.transform(below, lambda r: let(clean_label(F.get(r["cells"], F.lit(0))["text"]), lambda t: F.coalesce((t != "") & looks_like_label(t), F.lit(False))))
    stop = F.array_position(labelled, F.lit(True)).cast("int")
    above_data = F.when(stop > 0, F.slice(below, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(below)
    read = F.transform(above_data, lambda r: F.transform(r["cells"], lambda c: F.when(c["text"] != "", units.parse_unit(c["text"]))))
    hits = F.transform(read, lambda us, i: F.struct(F.size(F.filter(F.slice(us, F.lit(2), F.greatest(F.size(us) - 1, F.lit(0))), lambda u: u.isNotNull())).alias("n"), (-i).alias("i")))

    def told(k: Column) -> Column:
        best = k["best"]
        row = F.when(best["n"] >= 2, -best["i"])
        own = F.get(k["read"], row)
        texts = F.transform(F.get(k["above"], row)["cells"], lambda c: c["text"])
        width = F.greatest(F.size(k["periods"]), F.coalesce(F.size(own), F.lit(0)))

        def column(i: Column) -> Column:
            mine, u = F.get(k["periods"], i), F.get(own, i)
            left = F.array_max(F.filter(F.sequence(F.greatest(i - UNIT_GAP, F.lit(0)), i), lambda j: F.get(k["periods"], j).isNotNull()))
            p = F.coalesce(mine, F.when(u.isNotNull(), F.get(k["periods"], left)))
            spoken = F.when(row.isNull(), None).when(mine.isNotNull() & F.coalesce(F.get(texts, i) == "", F.lit(True)), k["unit"]).otherwise(u)
            return F.when(p.isNotNull(), F.struct(i.alias("col"), p["label"].alias("label"), p["source_text"].alias("source_text"), p["refined"].alias("refined"), spoken.alias("unit")))

        return F.filter(F.transform(F.sequence(F.lit(0), width - 1), column), lambda c: c.isNotNull())

    shared = F.struct(periods.alias("periods"), above_data.alias("above"), read.alias("read"), unit.alias("unit"))
    return let(shared, lambda s: let(F.struct(s["periods"], s["above"], s["read"], s["unit"], F.array_max(hits).alias("best")), told))


@defined
def header(rows: Column, context: Column, year_end: Column) -> Column:
    """struct(row, n_periods, skipped, unit, columns) of a table; null where it has none or names a period twice.

    The header is the row of the first three with most periods, two at least, the earlier of
    equals. Its unit is in its corner, else in the table's. ``skipped`` counts its other texts.
    """
    top = F.slice(rows, 1, HEADER_ROWS)
    read = F.transform(top, lambda r: F.transform(r["cells"], lambda c: F.when(c["text"] != "", temporal.resolve_header(c["text"], context, year_end))))
    known = lambda ps: F.filter(ps, lambda p: p.isNotNull())

    def pick(k: Column) -> Column:
        best = F.array_max(F.filter(F.transform(k["read"], lambda ps, i: F.struct(F.size(known(ps)).alias("n"), (-i).alias("i"))), lambda x: x["n"] >= 2))
        return F.when(best.isNotNull(), F.struct(k["rows"].alias("rows"), k["read"].alias("read"), (-best["i"]).alias("b"), best["n"].alias("n")))

    def build(k: Column) -> Column:
        b, here = k["b"], F.get(k["rows"], k["b"])
        periods = F.when(b > 0, _with_years(F.get(k["read"], b), F.get(k["rows"], b - 1)["cells"])).otherwise(F.get(k["read"], b))
        corner = lambda r: units.parse_unit(F.get(r["cells"], F.lit(0))["text"])
        unit = F.coalesce(corner(here), F.when(b > 0, corner(F.get(k["rows"], F.lit(0)))))
        skipped = F.size(F.filter(F.transform(here["cells"], lambda c, i: (c["text"] != "") & (i > 0) & F.get(F.get(k["read"], b), i).isNull()), lambda x: x))
        return F.struct(k["rows"].alias("rows"), b.alias("b"), k["n"].alias("n"), periods.alias("periods"), unit.alias("unit"), skipped.alias("skipped"))

    def finish(k: Column) -> Column:
        labels = F.transform(known(k["periods"]), lambda p: p["label"])
        out = F.struct(
            k["b"].alias("row"), k["n"].alias("n_periods"), k["skipped"].alias("skipped"), k["unit"].alias("unit"), F.transform(known(k["periods"]), lambda p: p).alias("periods"),
            _columns(k["periods"], F.slice(k["rows"], k["b"] + 2, F.lit(UNIT_ROWS)), k["unit"]).alias("columns"),
        )
        return F.when(F.size(F.array_distinct(labels)) == F.size(labels), out)

    return let(let(let(F.struct(rows.alias("rows"), read.alias("read")), pick), lambda k: F.when(k.isNotNull(), build(k))), lambda k: F.when(k.isNotNull(), finish(k)))


@defined
def caption_entity(lead_in: Column, rows: Column) -> Column:
    """The subject in a caption such as "Table 1. India: ...", from the text before a table or its first cells; null if it names none."""
    first = F.array_join(F.transform(F.slice(F.get(rows, F.lit(0))["cells"], 1, 3), lambda c: c["text"]), " ")
    named = lambda t: let(collapse_ws(F.regexp_extract(t, CAPTION, 1)), lambda n: F.when((F.length(n) > 2) & (F.length(n) <= 40) & ~nameless(n), n))
    return F.coalesce(named(F.right(lead_in, F.lit(300))), named(first))


def with_headers(blocks: DataFrame, pages: DataFrame, context: DataFrame) -> DataFrame:
    """DATA_TABLE blocks with rows, header, near_header (which the lines below go by: only the text just above explains its dates), lead_in and caption. blocks: file_id, page_number, order_index, role, text, char_start; context: file_id, year_end_month."""
    head = pages.select("file_id", "page_number", F.col("text").alias("_page"))
    t = blocks.where("role = 'DATA_TABLE'").join(head, ["file_id", "page_number"]).join(context.select("file_id", "year_end_month"), "file_id")
    lead = F.substr(F.col("_page"), F.greatest(F.col("char_start") - LEAD, F.lit(0)) + 1, F.least(F.col("char_start"), F.lit(LEAD)))
    # few steps: each plan over the large expression of a header is looked through again
    t = t.withColumns({"rows": rows_of(F.col("text"), F.col("char_start")), "lead_in": lead})
    contexts = F.array(F.concat("lead_in", F.substring("_page", 1, PAGE_HEAD)), F.col("lead_in"))
    both = F.transform(contexts, lambda c: header(F.col("rows"), c, F.col("year_end_month")))
    named = let(both, lambda h: F.struct(F.when(F.size("rows") >= 2, F.get(h, F.lit(0))).alias("header"), F.get(h, F.lit(1)).alias("near_header")))
    kept = [c for c in t.columns if c != "_page"]
    return t.select(*kept, caption_entity(F.col("lead_in"), F.col("rows")).alias("caption"), named.alias("_h")).select(*kept, "caption", "_h.header", "_h.near_header")


def table_rows(tables: DataFrame) -> DataFrame:
    """Labelled rows below the header, with label, kind (values, collapsed, unbound or section), section and figures found in a collapsed cell."""
    keys = ["file_id", "page_number", "order_index"]
    below = F.slice(F.col("rows"), F.col("header.row") + 2, F.size("rows"))
    r = tables.where("header is not null").withColumn("_below", below).select("*", F.posexplode("_below").alias("row", "r")).drop("_below", "rows")
    first = F.get("r.cells", F.lit(0))["text"]
    r = r.withColumn("own", clean_label(first)).where((F.col("own") != "") & looks_like_label(F.col("own")))
    w = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    goes_on = is_continuation(F.col("own"))
    r = r.withColumn("_parent", F.last(F.when(~goes_on, F.col("own")), ignorenulls=True).over(w))
    r = r.withColumn("label", F.when(goes_on & F.col("_parent").isNotNull(), F.concat_ws(" — ", "_parent", "own")).otherwise(F.col("own"))).drop("_parent", "own")
    filled = F.exists(F.slice("r.cells", F.lit(2), F.greatest(F.size("r.cells") - 1, F.lit(0))), lambda c: c["text"] != "")
    r = r.withColumn("figures", F.regexp_extract_all(first, F.lit(FIGURE), F.lit(0))).withColumn("before", clean_label(F.regexp_replace(first, rf"(?s){FIGURE}.*$", "")))
    bound = (F.size("figures") == F.col("header.n_periods")) & (F.col("before") != "") & looks_like_label(F.col("before"))
    kind = F.when(filled, "values").when(bound, "collapsed").when(F.size("figures") > 0, "unbound").otherwise("section")
    r = r.withColumn("kind", kind)
    return r.withColumn("section", F.last(F.when(F.col("kind") == "section", F.col("label")), ignorenulls=True).over(w))


def _qualifiers(**items: Column) -> Column:
    """A map of the items that are not null or empty."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in items.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != "")))


def table_facts(rows: DataFrame, context: DataFrame) -> DataFrame:
    """Facts of value rows and of collapsed rows, anchored to the whole line. rows: with page_unit, the unit declared on the page; heading."""
    r = rows.join(context.select("file_id", "subject"), "file_id").withColumn("table_unit", F.coalesce("header.unit", "page_unit"))
    v = r.where("kind = 'values'").select("*", F.explode("header.columns").alias("c"))
    v = v.withColumn("cell", F.get("r.cells", F.col("c.col"))["text"]).where("cell <> ''").withColumn("q", units.parse_quantity(F.col("cell"), F.coalesce("c.unit", "table_unit"))).where("q is not null")
    share = F.when(F.col("c.unit.dimension") == "PERCENT", "share of total")
    q = _qualifiers(column=F.col("c.source_text"), cell=F.col("cell"), section=F.col("section"), context=F.col("heading"), period_inferred_from=F.when(F.col("c.refined"), INFERRED), value_type=share)
    plain = as_facts(
        v, TABLE, entity=F.coalesce("caption", "subject"), attribute=F.col("label"), quantity=F.col("q"), scope=F.col("c.label"), statement=F.col("r.line"), quote=F.col("r.line"), start=F.col("r.start"), end=F.col("r.end"),
        confidence=F.when(F.col("q.unit").isNotNull(), 0.9).otherwise(0.78), qualifiers=q, seq=F.array("order_index", "row", F.col("c.col")),
    )
    k = r.where("kind = 'collapsed'").withColumn("row_unit", F.coalesce(units.parse_unit(F.col("before")), F.col("table_unit")))
    k = k.select("*", F.posexplode(F.arrays_zip("figures", "header.periods")).alias("nth", "z")).withColumn("q", units.parse_quantity(F.col("z.figures"), F.col("row_unit"))).where("q is not null")
    q = _qualifiers(column=F.col("z.periods.source_text"), cell=F.col("z.figures"), binding=F.lit(POSITIONAL), section=F.col("section"))
    bound = as_facts(
        k, TABLE, entity=F.col("subject"), attribute=F.col("before"), quantity=F.col("q"), scope=F.col("z.periods.label"), statement=F.col("r.line"), quote=F.col("r.line"), start=F.col("r.start"), end=F.col("r.end"),
        confidence=F.lit(0.6), qualifiers=q, seq=F.array("order_index", "row", "nth"),
    )
    return plain.unionByName(bound)


def table_counters(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """(file_id, counter, n): tables read and without header, skipped columns, cells not parsed, collapsed rows bound and not."""
    n = lambda name, c: F.struct(F.lit(name).alias("counter"), F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("n"))
    one = lambda c: F.when(c, 1).otherwise(0)
    has = F.col("header").isNotNull()
    read = tables.where(F.size("rows") >= 2).groupBy("file_id").agg(F.array(n("tables_read", one(has)), n("tables_no_header", one(~has)), n("columns_skipped", F.col("header.skipped"))).alias("c"))
    cells = F.filter(F.transform("header.columns", lambda c: F.get("r.cells", c["col"])["text"]), lambda t: ~t.isin(*NIL_CELLS) & units.parse_number(t).isNull())
    odd = F.when(F.col("kind") == "values", F.size(cells)).otherwise(0)
    parsed = rows.groupBy("file_id").agg(F.array(n("cells_unparsed", odd), n("collapsed_rows_bound", one(F.col("kind") == "collapsed")), n("collapsed_rows_unbound", one(F.col("kind") == "unbound"))).alias("c"))
    return read.unionByName(parsed).select("file_id", F.explode("c").alias("x")).select("file_id", "x.counter", "x.n").where("n > 0")
