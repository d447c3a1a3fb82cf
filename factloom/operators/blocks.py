"""Block roles, running lines and what carries over a document: headings, units, subjects, years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import temporal, units
from ..functions.text import collapse_ws, let

# Captions and markers of charts, and boilerplate phrases.
CHART_CAPTION = r"(?i)^\s*\|?\s*(?:chart|figure|fig\.|graph|exhibit)\s*[\w.]*\s*[:.]"
CHART_MARKER = r"(?i)\(RHS\)|\(LHS\)|right axis|left axis|y-axis|x-axis"
BOILERPLATE = (
    r"(?i)forward[- ]looking statements|safe harbou?r|this presentation is prepared|no part of it shall|disclaimer|all rights reserved|private and confidential"
)


def running_key(text: Column) -> Column:
    """What running lines are told by: the first 80 characters."""
    return F.trim(F.substring(F.trim(text), 1, 80))


def running_lines(blocks: DataFrame, file: str, page: str, min_fraction: float = 0.25) -> DataFrame:
    """(file, key, n): first 80 characters of text blocks seen max(3, pages * min_fraction) times or more in a document."""
    pages = blocks.groupBy(file).agg(F.countDistinct(page).alias("pages"))
    counts = blocks.select(file, running_key(F.col("text")).alias("key")).where(F.length("key") >= 8).groupBy(file, "key").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(pages, file).where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") * min_fraction))).drop("pages")


def _told(role: str, reason: str) -> Column:
    return F.struct(F.lit(role).alias("role"), F.lit(reason).alias("reason"))


def _first_rungs(text: Column, running: Column) -> Column:
    t = F.trim(text)
    return F.when(F.coalesce(t, F.lit("")) == "", _told("EMPTY", "no content")).when(running, _told("RUNNING", "repeats over pages")).when(t.rlike(BOILERPLATE), _told("BOILERPLATE", "disclaimer wording"))


def text_role(text: Column, running: Column) -> Column:
    """EMPTY, RUNNING, BOILERPLATE, HEADING (short, one line, no figure, no closing mark) or PROSE."""
    return classified_text(text, running)["role"]


def classified_text(text: Column, running: Column) -> Column:
    """struct(role, reason) of a text block."""
    t = F.trim(text)
    heading = (F.length(t) < 60) & ~t.contains("\n") & ~t.rlike(r"\d") & ~t.rlike(r"[.:;]$") & t.rlike(r"^[^a-zß-öø-ÿ]")
    return _first_rungs(text, running).when(heading, _told("HEADING", "short line without figures")).otherwise(_told("PROSE", "running text"))


def table_rows(text: Column) -> Column:
    """array<array<string>>: cells of the pipe lines, rules left out."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"^\s*\|") & ~s.rlike(r"^[\s|:\-]*-[\s|:\-]*$"))
    return F.transform(lines, lambda s: F.transform(F.split(F.regexp_replace(F.trim(s), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(c)))


def empty_ratio(cells: Column) -> Column:
    """Share of empty cells; 1 if there are none."""
    return F.when(F.size(cells) == 0, 1.0).otherwise(F.size(F.filter(cells, lambda c: c == "")) / F.size(cells))


def numeric_ratio(cells: Column) -> Column:
    """Share of filled cells that are numbers; 0 if none is filled."""
    filled = F.filter(cells, lambda c: c != "")
    return F.when(F.size(filled) == 0, 0.0).otherwise(F.size(F.filter(filled, lambda c: units.parse_number(c).isNotNull())) / F.size(filled))


def has_tick_run(cells: Column) -> Column:
    """Whether one cell holds five loose numbers or more, as an axis does."""
    return F.exists(cells, lambda c: F.size(F.regexp_extract_all(c, F.lit(r"(?<![\w.])-?\d[\d,]*(?:\.\d+)?(?![\w.])"), F.lit(0))) >= 5)


def has_period_header(rows: Column) -> Column:
    """Whether one of the first three rows names two periods or more."""
    known = lambda c: temporal.parse_period(c)["period_type"] != "UNSPECIFIED"
    return F.exists(F.slice(rows, 1, 3), lambda r: F.size(F.filter(r, known)) >= 2)


def table_role(text: Column) -> Column:
    """EMPTY, CHART or DATA_TABLE, by caption, markers, tick runs, period header and share of figures."""
    return classified_table(text, F.lit(False))["role"]


def classified_table(text: Column, running: Column) -> Column:
    """struct(role, reason) of a table block; costly tests come last and are reached by few."""

    def ladder(rows: Column) -> Column:
        cells = F.flatten(rows)
        return (
            _first_rungs(text, running)
            .when(F.size(rows) == 0, _told("EMPTY", "no rows"))
            .when(F.get(cells, F.lit(0)).rlike(CHART_CAPTION), _told("CHART", "chart caption"))
            .when(F.substring(text, 1, 600).rlike(CHART_MARKER), _told("CHART", "axis or legend wording"))
            .when(has_tick_run(cells), _told("CHART", "a cell of axis ticks"))
            .when(has_period_header(rows), _told("DATA_TABLE", "periods in the header"))
            .when(F.size(rows) == 1, _told("CHART", "a single row"))
            .when((numeric_ratio(cells) >= 0.25) & (F.size(F.get(rows, F.lit(0))) >= 2), _told("DATA_TABLE", "many figures under labels"))
            .when(empty_ratio(cells) > 0.6, _told("CHART", "mostly empty"))
            .otherwise(_told("CHART", "few figures, no periods"))
        )

    return let(table_rows(text), ladder)


def classify_document(blocks: DataFrame, min_fraction: float = 0.25) -> DataFrame:
    """Blocks (file_id, page_number, order_index, kind, text, char_start, char_end) with role, reason and the last heading at or before each."""
    running = running_lines(blocks.where("kind = 'text'"), "file_id", "page_number", min_fraction).select("file_id", F.col("key").alias("_key"), F.lit(True).alias("_runs"))
    b = blocks.withColumn("_key", running_key(F.col("text"))).join(running, ["file_id", "_key"], "left").drop("_key")
    is_running = F.coalesce("_runs", F.lit(False))
    told = F.when(F.col("kind") == "table", classified_table(F.col("text"), is_running)).otherwise(classified_text(F.col("text"), is_running))
    b = b.withColumn("_t", told).select("*", "_t.role", "_t.reason").drop("_t", "_runs")
    return carry(b, ["file_id", "page_number"], ["order_index"], F.col("role") == "HEADING", F.substring(collapse_ws(F.col("text")), 1, 120), "heading")


def heading_before(blocks: DataFrame, points: DataFrame, at: str = "pos") -> DataFrame:
    """Points (file_id, page_number, at) with ``heading``: the last HEADING block that starts at or before each; an as-of join in one window."""
    side = blocks.where("role = 'HEADING'").select("file_id", "page_number", F.col("char_start").alias(at), F.lit(0).alias("_is"), F.substring(collapse_ws(F.col("text")), 1, 120).alias("heading"))
    both = points.withColumn("_is", F.lit(1)).unionByName(side, allowMissingColumns=True)
    w = Window.partitionBy("file_id", "page_number").orderBy(at, "_is").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("heading", F.last("heading", ignorenulls=True).over(w)).where("_is = 1").drop("_is")


def carry(df: DataFrame, keys: list[str], order: list[str], when: Column, value: Column, out: str) -> DataFrame:
    """``df`` with the last ``value`` at or before each row where ``when`` held; an as-of join within one table."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.last(F.when(when, value), ignorenulls=True).over(w))


def as_of(facts: DataFrame, declared: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Facts with ``value`` of the nearest declaration at or before ``at``, else the first of the key, and where it came from."""
    side = declared.select(*keys, at, F.lit(0).alias("_is"), F.col(value).alias("_v"))
    both = facts.withColumn("_is", F.lit(1)).unionByName(side, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "_is")
    out = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.withColumn("_first", F.first("_v", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))).where("_is = 1")
    source = F.when(F.col("_last").isNotNull(), "page-declaration").when(F.col("_first").isNotNull(), "page-declaration-after").otherwise("none")
    return out.withColumn(value, F.coalesce("_last", "_first")).withColumn("unit_source", source).drop("_is", "_v", "_last", "_first")


def mode_first(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """Most frequent value by key; of equal counts the one seen first."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("_at"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("_at"))).alias(value), F.max("n").alias("n"))
