"""From laid-out pages to facts: all readers, duplicates, re-attribution, and reports of what was read and what was not."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import units
from . import blocks as B, context as C, extract as E, facts as X, tables as T
from .stages import Settled


@dataclass
class Extraction:
    """facts; rejected, with why; context, a row a document; report, a row a document; classified blocks; unit declarations; what the run keeps."""

    facts: DataFrame
    rejected: DataFrame
    context: DataFrame
    report: DataFrame
    blocks: DataFrame
    declarations: DataFrame
    settled: Settled


def extract_facts(
    pages: DataFrame, blocks: DataFrame, titles: DataFrame | None = None, *, page_numbers: list[int] | None = None, subject_override: dict[str, str] | None = None, use_prose: bool = True, use_orphan_rows: bool = True,
    transport: E.Transport | None = None, window: int = 3500,
) -> Extraction:
    """Facts of documents.

    pages: file_id, page_number, text. blocks: file_id, page_number, order_index, kind, text,
    char_start, char_end. titles: file_id, title. Context and roles come from whole documents;
    ``page_numbers`` bounds the pages that facts are read from. Facts of one id are one, the most
    confident, of equals that of the earlier reader (table, orphan, prose, model). Everything is
    keyed by document and page, so documents spread over the cluster and none is collected.
    """
    settled = Settled()
    pages = settled(pages)  # every step below reads them: a plan that makes them would run once for each
    declared = settled(C.unit_declarations(pages))
    context = settled(C.build_context(pages, titles, subject_override, declared))
    classified = settled(B.classify_document(blocks))
    read = pages if page_numbers is None else pages.where(F.col("page_number").isin(*page_numbers))
    target = classified if page_numbers is None else classified.where(F.col("page_number").isin(*page_numbers))

    tables = settled(T.with_headers(target, read, context))
    rows = settled(C.page_units(T.table_rows(tables), declared))
    found, counters = [T.table_facts(rows, context)], [T.table_counters(tables, rows)]
    if use_orphan_rows:
        scanned = settled(E.preceding_headers(target, tables))
        orphan = settled(C.page_units(E.orphan_rows(scanned), declared))
        found.append(E.orphan_facts(orphan, read, context))
        counters.append(E.orphan_counters(scanned, orphan))
    if use_prose:
        spans = settled(E.prose_spans(target, read))
        told = settled(E.with_page_units(E.statements(spans), declared))
        found.append(E.prose_facts(told, read, context))
        counters.append(E.prose_counters(spans, told))
    warnings = None
    if transport is not None:
        items = settled(E.model_items(read, context, transport, most=window))
        said, counted = E.model_facts(items, read, classified, context, declared, C.default_units(declared, pages))
        found.append(said)
        counters.append(counted)
        warnings = items.where("kind = 'warning'").groupBy("file_id").agg(F.array_sort(F.collect_list("note")).alias("warnings"))

    every, rejected = X.validate(settled(functools.reduce(DataFrame.unionByName, found)))
    kept = X.dedupe(every, ["id"], [F.col("extractor_rank"), F.col("seq")])
    facts = X.with_ids(C.reattribute(kept, context)).drop("extractor_rank", "seq")
    report = _report(pages, read, classified, context, every, functools.reduce(DataFrame.unionByName, counters), warnings)
    return Extraction(facts, rejected, context, report, classified, declared, settled)


def _counts(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """(file_id, out): a map of ``key`` to summed ``value``."""
    summed = df.groupBy("file_id", key).agg(F.sum(value).alias("n"))
    return summed.groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col("n").alias("value"))))).alias(out))


def _report(pages: DataFrame, read: DataFrame, classified: DataFrame, context: DataFrame, every: DataFrame, counters: DataFrame, warnings: DataFrame | None) -> DataFrame:
    """A row a document: pages, subject, year's end, units, blocks by role, facts by the reader that found each first, duplicates, counters, warnings."""
    one = F.lit(1).cast("long").alias("one")
    roles = _counts(classified.select("file_id", "role", one), "role", "one", "blocks_by_role")
    ids = every.groupBy("file_id", "id").agg(F.min_by("extractor", "extractor_rank").alias("extractor"), F.count(F.lit(1)).alias("n"))
    by = _counts(ids.select("file_id", "extractor", one), "extractor", "one", "facts_by_extractor")
    twice = ids.groupBy("file_id").agg(F.sum(F.col("n") - 1).alias("duplicates_collapsed"), F.count(F.lit(1)).alias("total_facts"))
    done = read.groupBy("file_id").agg(F.count(F.lit(1)).alias("pages_processed"))
    out = context.select("file_id", "subject", F.col("year_end_month").alias("fiscal_year_end_month"), "unit_declarations", units.describe(F.col("default_unit")).alias("document_default_unit"))
    for part in (done, roles, by, twice, _counts(counters, "counter", "n", "counters")):
        out = out.join(part, "file_id", "left")
    empty = F.create_map().cast("map<string,bigint>")
    out = out.fillna(0, ["pages_processed", "duplicates_collapsed", "total_facts"]).withColumns({c: F.coalesce(c, empty) for c in ("blocks_by_role", "facts_by_extractor", "counters")})
    none = F.array().cast("array<string>")
    return out.join(warnings, "file_id", "left").withColumn("warnings", F.coalesce("warnings", none)) if warnings is not None else out.withColumn("warnings", none)


def summary(report: DataFrame) -> DataFrame:
    """(file_id, summary): a report in one line."""
    pairs = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    text = F.format_string(
        "%s: %d facts from %d pages; blocks %s; facts %s; %d unit declarations, default %s", "subject", "total_facts", "pages_processed", pairs("blocks_by_role"), pairs("facts_by_extractor"), "unit_declarations", F.coalesce("document_default_unit", F.lit("none"))
    )
    return report.select("file_id", text.alias("summary"))


def blocks_on(extraction: Extraction, page_number: int) -> DataFrame:
    """The classified blocks of a page of each document."""
    return extraction.blocks.where(F.col("page_number") == page_number)


def declarations_on(extraction: Extraction, page_number: int) -> DataFrame:
    """The unit declarations of a page of each document."""
    return extraction.declarations.where(F.col("page_number") == page_number)


def total_facts(report: DataFrame) -> DataFrame:
    """(file_id, n): the facts that the readers found, by the report's counters."""
    return report.select("file_id", F.aggregate(F.map_values("facts_by_extractor"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))


def page_diagnostics(extraction: Extraction, page_number: int) -> DataFrame:
    """(file_id, what, at, text): roles of a page's blocks and its unit declarations, in their order."""
    b = blocks_on(extraction, page_number).select("file_id", F.concat(F.lit("block "), "role").alias("what"), F.col("char_start").alias("at"), F.substring("text", 1, 70).alias("text"))
    d = declarations_on(extraction, page_number).select("file_id", F.concat(F.lit("unit "), units.describe(F.col("unit"))).alias("what"), F.col("char_start").alias("at"), "text")
    return b.unionByName(d)
