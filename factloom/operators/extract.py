"""Facts from sentences, from borderless label-and-figure lines and from a model; the readers that the pipeline puts together."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import temporal, units
from ..functions.text import clean_label, collapse_ws, defined, is_bullet_artifact, let, looks_like_label, matches, normalize_key, split_possessive
from .anchors import locate_all, with_block_kind
from .context import page_units, resolve_units
from .facts import MODEL, ORPHAN, PROSE, as_facts, dedupe, drop_conflicts, fact_id  # noqa: F401
from .layout import windows
from .tables import POSITIONAL, parts

# Reporting verbs, words and marks that may stand with a figure, words cut from an attribute's front and end, subjects that cannot be resolved.
VERBS = [
    "was", "were", "is", "are", "stood at", "stands at", "amounted to", "amounts to", "totalled", "totaled", "reached", "rose to", "grew to", "increased to", "declined to", "decreased to", "fell to",
    "moderated to", "remained at", "came in at", "is projected at", "projected at", "estimated at", "recorded at", "of",
]
BEFORE_FIGURE = ["₹", r"Rs\.?", "INR", "USD", r"US\$", r"\$"]
AFTER_FIGURE = ["per cent", "percent", "%", "bps", "basis points", "crore", "crores", "cr", "lakh", "lakhs", "million", "mn", "billion", "bn", "trillion", "days", "tonnes", "tons", "mn tons", r"sq\.? ?ft\.?"]
LEAD = (
    "in as of and or but each from with to for by on at that which while where the a an this these those its their our we it there however although though since when than "
    "then also against about into over under per was were is are been being had has have still meanwhile moreover furthermore notably importantly similarly conversely "
    "additionally accordingly thus therefore nevertheless nonetheless following consequently given amid amidst despite besides hence so"
).split()
AUXILIARY = "has have had is are was were be been being will would can could should shall may might must did do does".split()
PREPOSITIONS = "for of in at during since from to".split()
PRONOUNS = "he she him her himself herself".split()
_PHRASE = r"[A-Za-z][A-Za-z0-9 ,'’\-()/&.]{4,90}?"
_FIGURE = rf"(?:{'|'.join(BEFORE_FIGURE)})?\s?\(?-?\d[\d,]*(?:\.\d+)?\)?\s*(?:{'|'.join(AFTER_FIGURE)})?"
STATEMENT = rf"(?i)({_PHRASE})\s+(?:{'|'.join(VERBS)})\s+({_FIGURE})(?![\w.\-])"
#: White space between two sentences.
BORDER = r"(?<=[.;])\s+(?=[A-Z0-9₹])"
WINDOW = 120
PROSE_CONFIDENCE, OWN_UNIT = 0.55, 0.1
#: Label lines that are read as one label.
FOLD = 6
BY_ORDER = "by order of columns: borders are absent"


@defined
def clean_attribute(text: Column) -> Column:
    """A captured phrase without its function words, clauses and dangling ends; null if it names no measure."""
    out = F.regexp_replace(collapse_ws(text), r"(?i)^(?:(?:%s)\b[\s,]*)+" % "|".join(LEAD), "")
    out = let(out, lambda o: let(F.trim(F.regexp_extract(o, r"([^,]*)$", 1)), lambda tail: F.when(o.contains(",") & tail.contains(" "), tail).otherwise(o)))
    out = F.regexp_replace(out, r"(?i)^(?:(?:%s)\b\s*)+" % "|".join(LEAD), "")
    out = F.regexp_replace(out, r"(?i)(?:\s+(?:%s))+$" % "|".join(AUXILIARY), "")
    out = F.regexp_replace(out, temporal.PERIOD + r"\s*$", "")
    out = F.trim(F.regexp_replace(F.trim(out), r"(?i)(?:\s+(?:%s))+$" % "|".join(PREPOSITIONS), ""))

    def judged(o: Column) -> Column:
        bad = o.rlike(r"(?i)^(?:%s)\b" % "|".join(PRONOUNS)) | (F.length(o) < 6) | (F.length(o) > 60) | ~o.contains(" ")
        return F.when(~(bad | o.rlike(r"\d[\d,]{2,}|\b(?:FY|CY|Q[1-4])\s?\d{2,4}\b") | ~o.rlike("[A-Za-z]")), o)

    return let(out, judged)


def sentences(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sentence, sent_start: sentences over 20 and up to 600 characters with their offsets.

    A sentence runs from the end of one border to the start of the next.
    """
    plain = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    borders = matches(plain, pattern=BORDER)
    told = texts.select(*keys, plain.alias("_t"), borders.alias("_b"))
    starts = F.concat(F.array(F.lit(0)), F.transform("_b", lambda b: (b["at"] + F.length(b["hit"])).cast("int")))
    ends = F.concat(F.transform("_b", lambda b: b["at"]), F.array(F.length("_t")))
    spans = F.filter(F.zip_with(starts, ends, lambda a, z: F.struct(a.alias("a"), z.alias("z"))), lambda x: (x["z"] - x["a"] > 20) & (x["z"] - x["a"] <= 600))
    out = told.select(*keys, "_t", F.explode(spans).alias("x"))
    return out.select(*keys, F.substr(F.col("_t"), F.col("x.a") + 1, F.col("x.z") - F.col("x.a")).alias("sentence"), F.col("x.a").alias("sent_start"))


def prose_spans(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(file_id, page_number, span, text, start): every PROSE block by itself, then every run of two or more as one span of the page."""
    page = ["file_id", "page_number"]
    prose = blocks.where("role = 'PROSE'")
    alone = prose.select(*page, F.lit(0).alias("span"), "order_index", "text", F.col("char_start").alias("start"))
    w = Window.partitionBy(*page).orderBy("order_index")
    island = F.sum((F.col("role") != "PROSE").cast("int")).over(w)
    runs = blocks.select(*page, "order_index", "role", "char_start", "char_end").withColumn("_i", island).where("role = 'PROSE'")
    runs = runs.groupBy(*page, "_i").agg(F.count(F.lit(1)).alias("n"), F.min("order_index").alias("order_index"), F.min("char_start").alias("start"), F.max("char_end").alias("_end")).where("n > 1")
    cut = F.substr(F.col("text"), F.col("start") + 1, F.col("_end") - F.col("start"))
    runs = runs.join(pages.select(*page, "text"), page).select(*page, F.lit(1).alias("span"), "order_index", cut.alias("text"), "start")
    return alone.unionByName(runs)


def statements(spans: DataFrame) -> DataFrame:
    """Every "attribute verb value" of every sentence: attribute, value, period, quantity, offsets, and ``rejected``, why it is no fact.

    A period inside the attribute comes before one nearby (within WINDOW characters).
    """
    page = ["file_id", "page_number", "span", "order_index"]
    s = sentences(spans, [*page, "start"]).select(*page, "sentence", (F.col("start") + F.col("sent_start")).alias("at"), F.posexplode(matches(F.col("sentence"), pattern=STATEMENT)).alias("nth", "m"))
    inside = F.regexp_extract("m.hit", STATEMENT, 1)
    stop = F.col("m.at") + F.length("m.hit")
    before, after = F.substr(F.col("sentence"), F.greatest(F.lit(1), F.col("m.at") + 1 - WINDOW), F.least(F.col("m.at"), F.lit(WINDOW))), F.substr(F.col("sentence"), stop + 1, F.lit(WINDOW))
    s = s.withColumn("phrase", inside).withColumn("written", F.regexp_extract("m.hit", STATEMENT, 2))
    s = s.withColumn("scope", F.coalesce(temporal.period_label(F.col("phrase")), temporal.nearest_period(before, after)))
    s = s.withColumn("attribute", clean_attribute(F.col("phrase"))).withColumn("q", units.parse_quantity(F.col("written")))
    bare_year = F.col("written").rlike(r"^\s*\(?(?:19|20)\d{2}\)?\s*$")
    rejected = F.when(F.col("scope").isNull(), "no_period").when(F.col("attribute").isNull(), "bad_attribute").when(F.col("q").isNull(), "no_number").when(F.col("q.unit").isNull() & bare_year, "bare_year")
    return s.withColumn("rejected", rejected).withColumn("char_start", F.col("at") + F.col("m.at")).withColumn("char_end", F.col("at") + stop)


def with_page_units(told: DataFrame, declarations: DataFrame) -> DataFrame:
    """Statements with ``unit``, their own or their page's; those without are rejected for it."""
    out = page_units(told, declarations).withColumn("unit", F.coalesce("q.unit", "page_unit"))
    return out.withColumn("rejected", F.coalesce("rejected", F.when(F.col("unit").isNull(), "no_unit")))


def prose_facts(told: DataFrame, pages: DataFrame, context: DataFrame) -> DataFrame:
    """Facts of the statements that are not rejected; "X's y" is a fact of X, any other of the document's subject."""
    page = ["file_id", "page_number"]
    f = told.where("rejected is null").join(context.select("file_id", "subject"), "file_id").join(pages.select(*page, F.col("text").alias("_page")), page)
    f = f.withColumn("whose", split_possessive(F.col("attribute"), F.col("subject")))
    quote = F.substr(F.col("_page"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    quantity = F.struct(F.col("q.value").alias("value"), F.col("q.decimals").alias("decimals"), F.col("unit").alias("unit"))
    sure = F.lit(PROSE_CONFIDENCE) + F.when(F.col("q.unit").isNotNull(), OWN_UNIT).otherwise(0.0)
    return as_facts(
        f.withColumn("quantity", quantity), PROSE, entity=F.col("whose.entity"), attribute=F.col("whose.attribute"), quantity=F.col("quantity"), scope=F.col("scope"), statement=F.col("sentence"), quote=quote, start=F.col("char_start"), end=F.col("char_end"),
        confidence=sure, qualifiers=F.create_map(F.lit("source"), F.lit("prose")), seq=F.array("span", "order_index", "char_start"),
    )


def prose_counters(spans: DataFrame, told: DataFrame) -> DataFrame:
    """(file_id, counter, n): sentences read, and statements rejected by reason."""
    read = sentences(spans, ["file_id"]).groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).select("file_id", F.lit("prose_sentences").alias("counter"), "n")
    why = told.where("rejected is not null").groupBy("file_id", "rejected").agg(F.count(F.lit(1)).alias("n"))
    return read.unionByName(why.select("file_id", F.concat(F.lit("prose_rejected_"), "rejected").alias("counter"), "n"))


def preceding_headers(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """PROSE blocks with ``slots`` and ``header_unit`` of the nearest table at most two blocks above them; others are left out.

    blocks: classified; tables: with ``near_header``. Slots are the table's value columns in their order.
    """
    keys = ["file_id", "page_number", "order_index"]
    b = blocks.join(tables.select(*keys, "near_header"), keys, "left")
    w = Window.partitionBy("file_id", "page_number").orderBy("order_index")
    seen = F.struct((F.col("role") == "DATA_TABLE").alias("is"), F.col("near_header").alias("h"))
    b = b.withColumn("_1", F.lag(seen, 1).over(w)).withColumn("_2", F.lag(seen, 2).over(w))
    b = b.withColumn("_h", F.when(F.col("_1.is"), F.col("_1.h")).when(F.col("_2.is"), F.col("_2.h"))).where("role = 'PROSE' and _h is not null")
    return b.withColumn("slots", F.col("_h.columns")).withColumn("header_unit", F.col("_h.unit")).drop("_1", "_2", "_h", "near_header")


def orphan_rows(blocks: DataFrame) -> DataFrame:
    """Label runs and the runs of figures right below them (gaps and islands), one row each.

    blocks: file_id, page_number, order_index, text, char_start, slots and what passes through.
    A label is the last FOLD lines at most of its run; as many figures are taken as there are
    slots; a first whole number is a note's where later figures have a point or comma, and a
    lone small whole number is one too. Gives labels, start, values (line, q, end) and ``note``.
    """
    keys = ["file_id", "page_number", "order_index"]
    line, own = F.col("l.text"), clean_label(F.col("l.text"))
    x = blocks.select(*keys, F.posexplode(parts(F.col("text"), "\n")).alias("pos", "l")).withColumn("own", own).withColumn("q", units.parse_quantity(line))
    label = ~is_bullet_artifact(line) & (F.col("own") != "") & looks_like_label(F.col("own")) & F.col("q").isNull()
    figure = (F.trim(line) != "") & F.col("q").isNotNull() & ~looks_like_label(F.trim(line))
    x = x.withColumn("kind", F.when(label, "label").when(figure, "figure").otherwise("other"))
    w = Window.partitionBy(*keys).orderBy("pos")
    x = x.withColumn("island", F.sum((~F.col("kind").eqNullSafe(F.lag("kind").over(w))).cast("int")).over(w))
    item = F.struct("pos", "own", "q", F.col("l.at").alias("at"), (F.col("l.at") + F.length("l.text")).alias("end"))
    runs = x.where("kind <> 'other'").groupBy(*keys, "island", "kind").agg(F.array_sort(F.collect_list(item)).alias("items"))
    last = lambda n: F.slice("items", F.greatest(F.size("items") - n + 1, F.lit(1)), F.lit(n))
    labels = runs.where("kind = 'label'").select(*keys, (F.col("island") + 1).alias("island"), last(FOLD).alias("labels"))
    met = runs.where("kind = 'figure'").join(labels, [*keys, "island"]).join(blocks, keys)
    taken = F.slice("items", F.lit(1), F.size("slots"))
    marked = F.exists(F.slice(taken, F.lit(2), F.greatest(F.size(taken) - 1, F.lit(0))), lambda i: i["q"]["raw"].rlike("[.,]"))
    is_note = let(F.get("items", F.lit(0)), lambda i: units.is_note_reference(i["q"]["raw"], i["q"]["value"]))
    met = met.withColumn("note", F.when(is_note & marked, "column").when(is_note & (F.size(taken) == 1), "reference"))
    values = F.when(F.col("note") == "column", F.slice(taken, F.lit(2), F.greatest(F.size(taken) - 1, F.lit(0)))).otherwise(taken)
    return met.withColumn("values", values).withColumn("start", F.col("char_start") + F.get("labels", F.lit(0))["at"]).drop("items", "kind", "island")


def orphan_facts(rows: DataFrame, pages: DataFrame, context: DataFrame) -> DataFrame:
    """Facts of orphan rows, each anchored from the label's start to the figure's end. rows: with page_unit, header_unit and heading."""
    page = ["file_id", "page_number"]
    r = rows.where("not (note <=> 'reference')").join(context.select("file_id", "subject"), "file_id").join(pages.select(*page, F.col("text").alias("_page")), page)
    names = F.transform("labels", lambda i: i["own"])
    r = r.withColumn("names", names).withColumn("scale", units.trailing_scale(F.col("names")))
    kept = F.when(F.col("scale").isNotNull(), F.slice("names", F.lit(1), F.size("names") - 1)).otherwise(F.col("names"))
    r = r.withColumn("label", F.array_join(kept, " ")).withColumn("row_unit", F.coalesce("header_unit", "page_unit", "scale"))
    v = r.select("*", F.posexplode("values").alias("nth", "v")).withColumn("slot", F.get("slots", F.col("nth"))).withColumn("end", F.col("char_start") + F.col("v.end"))
    v = v.withColumn("quantity", F.struct(F.col("v.q.value").alias("value"), F.col("v.q.decimals").alias("decimals"), F.coalesce("v.q.unit", "slot.unit", "row_unit").alias("unit")))
    share = F.when(F.col("slot.unit.dimension") == "PERCENT", "share of total")
    entries = F.array(*[F.struct(F.lit(k).alias("key"), x.cast("string").alias("value")) for k, x in {"binding": F.lit(BY_ORDER), "column": F.col("slot.source_text"), "context": F.col("heading"), "value_type": share}.items()])
    told = F.concat(F.col("label"), F.lit(": "), F.col("v.q.raw"), F.lit(" ("), F.col("slot.source_text"), F.lit(")"))
    out = as_facts(
        v, ORPHAN, entity=F.col("subject"), attribute=F.col("label"), quantity=F.col("quantity"), scope=F.col("slot.label"), statement=told, quote=F.substr(F.col("_page"), F.col("start") + 1, F.col("end") - F.col("start")),
        start=F.col("start"), end=F.col("end"), confidence=F.lit(0.55), qualifiers=F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != ""))), seq=F.array("order_index", F.col("v.pos"), "nth"),
    )
    return drop_conflicts(out.withColumn("_k", normalize_key(F.col("attribute"))), ["file_id", "page_number", "_k", "temporal_scope", "value_kind"]).drop("_k")


def orphan_counters(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """(file_id, counter, n): blocks scanned, rows read, note columns dropped, note references skipped."""
    named = blocks.select("file_id", F.lit("orphan_blocks_scanned").alias("counter")).unionByName(rows.where("not (note <=> 'reference')").select("file_id", F.lit("orphan_rows").alias("counter")))
    notes = rows.where("note is not null").select("file_id", F.when(F.col("note") == "column", "orphan_note_columns_dropped").otherwise("orphan_note_refs_skipped").alias("counter"))
    return named.unionByName(notes).groupBy("file_id", "counter").agg(F.count(F.lit(1)).alias("n"))


Transport = Callable[[str, str], str]


def parse_items(reply: str) -> list[dict]:
    """Objects of the outermost list in a reply, fenced or not; none if it is no list."""
    found = re.search(r"\[.*\]", reply, re.S)
    try:
        items = json.loads(found[0]) if found else []
    except ValueError:
        return []
    return [x for x in items if isinstance(x, dict)]


class Retrying:
    """A transport that tries again when the one it wraps fails for a while: after 1, 2, 4 ... seconds, 8 at most, ``tries`` times in all."""

    LONGEST = 8.0

    def __init__(self, transport: Transport, tries: int = 4, wait: Callable[[float], None] = time.sleep) -> None:
        self.transport, self.tries, self.wait = transport, tries, wait

    def __call__(self, system: str, user: str) -> str:
        for n in range(self.tries):
            try:
                return self.transport(system, user)
            except TryLater:
                if n + 1 == self.tries:
                    raise
                self.wait(min(self.LONGEST, 2.0**n))
        raise AssertionError("tries is at least 1")


class TryLater(Exception):
    """A service that is busy or broken for now."""


class HttpTransport:
    """Posts {model, system, user, max_tokens} as JSON to ``url`` and joins the reply's text parts; the key is read from the environment at each call."""

    def __init__(self, url: str, model: str, key_variable: str, max_tokens: int = 4000, timeout: float = 60.0) -> None:
        self.url, self.model, self.key_variable, self.max_tokens, self.timeout = url, model, key_variable, max_tokens, timeout

    @property
    def available(self) -> bool:
        import os

        return bool(os.environ.get(self.key_variable))

    def __call__(self, system: str, user: str) -> str:
        import os
        import urllib.error
        import urllib.request

        body = json.dumps({"model": self.model, "system": system, "user": user, "max_tokens": self.max_tokens}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ[self.key_variable]}"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                parts_ = json.load(reply)["content"]
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                raise TryLater(str(e)) from e
            raise
        return "".join(p.get("text", "") for p in parts_)


ITEM = ("entity", "attribute", "value", "unit", "temporal_scope", "quote", "confidence")


def model_items(pages: DataFrame, context: DataFrame, transport: Transport, system: str = "", most: int = 3500, overlap: int = 250) -> DataFrame:
    """What a model says of each window of each page: rows of kind ``item``, ``call``, or ``warning``; sequential by page, so in Arrow batches.

    ``transport`` takes (system, user) and returns a reply; one that says it is not available is
    never called. A failure is told as a warning and ends its page.
    """
    names = [*ITEM]
    schema = "file_id string, page_number int, kind string, nth int, note string, " + ", ".join(f"{n} string" for n in names)
    ready = getattr(transport, "available", True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for file_id, page, text, subject, spans in zip(*[b.column(c).to_pylist() for c in ("file_id", "page_number", "text", "subject", "spans")]):
                nth = 0
                for start, end in [(w["start"], w["end"]) for w in spans] if ready else ():
                    ask = f"Subject unless the text names another: {subject}\nPage {page}\n\n{text[start:end]}"
                    try:
                        items = parse_items(transport(system, ask))
                    except Exception as e:  # the service is not ours: the page's other facts stay
                        rows.append((file_id, page, "warning", nth, f"model failed on page {page}: {e}", *[None] * len(names)))
                        break
                    rows.append((file_id, page, "call", nth, None, *[None] * len(names)))
                    for x in items:
                        rows.append((file_id, page, "item", nth, None, *[x[n] if isinstance(x.get(n), str) else None if x.get(n) is None else json.dumps(x[n]) for n in names]))
                        nth += 1
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), *[pa.string()] * len(names)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["file_id", "page_number", "kind", "nth", "note", *names])

    asked = pages.join(context.select("file_id", "subject"), "file_id").select("file_id", F.col("page_number").cast("int"), "text", "subject", windows(F.col("text"), most, overlap).alias("spans"))
    return asked.mapInArrow(run, schema)


def model_facts(items: DataFrame, pages: DataFrame, blocks: DataFrame, context: DataFrame, declarations: DataFrame, defaults: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of items whose quotes stand in their pages, and (file_id, counter, n) of calls, items, invalid and ungrounded ones.

    Quotes go through all four rungs of the search, and what an approximate one costs in score it
    costs in confidence. A unit that is not named comes from the page or, unlike for other
    readers, from the document. A value that is no number stays text.
    """
    page, named = ["file_id", "page_number"], items.where("kind = 'item'")
    good = F.col("quote").isNotNull() & F.col("attribute").isNotNull() & F.col("value").isNotNull()
    met = named.where(good).join(pages.select(*page, "text"), page)
    hits = locate_all(met, [*page, "nth"])
    found = named.where(good).drop("quote").join(hits.where("start >= 0").withColumnRenamed("start", "char_start").withColumnRenamed("end", "char_end"), [*page, "nth"])
    found = with_block_kind(found, blocks, page, "nth")
    found = resolve_units(found.withColumn("own", units.parse_unit(F.col("unit"))).withColumnRenamed("unit", "unit_text"), declarations, defaults, inline=F.col("own"))
    found = found.withColumn("q", units.parse_quantity(F.col("value"), F.col("unit"))).join(context.select("file_id", "subject"), "file_id")
    sure = F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.6)) * F.col("score")))
    facts = as_facts(
        found, MODEL, entity=F.coalesce(F.nullif(collapse_ws(F.col("entity")), F.lit("")), "subject"), attribute=clean_label(F.col("attribute")), quantity=F.col("q"), scope=F.col("temporal_scope"), statement=F.col("matched"), quote=F.col("matched"),
        start=F.col("char_start"), end=F.col("char_end"), confidence=sure, qualifiers=F.create_map(F.lit("source"), F.lit("model")), seq=F.array("nth"), text_value=F.col("value"), strategy=F.col("strategy"), score=F.col("score"), block_kind=F.col("block_kind"),
        unit=F.coalesce(units.describe(F.col("unit")), "unit_text"),
    )
    told = items.select("file_id", F.when(F.col("kind") == "call", "model_calls").when(F.col("kind") == "item", "model_returned").alias("counter")).where("counter is not null")
    invalid = named.where(~good).select("file_id", F.lit("model_invalid").alias("counter"))
    lost = hits.where("start < 0").select("file_id", F.lit("model_ungrounded").alias("counter"))
    return facts, told.unionByName(invalid).unionByName(lost).groupBy("file_id", "counter").agg(F.count(F.lit(1)).alias("n"))
