"""Quotes in texts: exact, folded, caseless and fuzzy search with offsets of the text itself, anchors and their audit."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.text import FOLD_DASHES, FOLD_DOUBLE, FOLD_LONG, FOLD_NOTHING, FOLD_SINGLE, FOLD_SPACES, fold, let
from .stages import Settled

FUZZY = 0.82
#: Runs of matching characters that are too short to count, and the least gap that parts two groups of runs.
SHORT_RUN, LEAST_GAP = 3, 40
#: Quotes too short for a run of words that may be broadcast to all texts.
SHORT_QUOTES = 10_000
_VANISH, _BLANK = f"[{FOLD_NOTHING}]*", rf"[\s{FOLD_SPACES}]"


def folded_pattern(quote: Column) -> Column:
    """A pattern that finds in a text what the folded quote finds in the folded text."""
    # code points that are never characters; a quote that holds one all the same is found exactly or not at all
    marks = {a: chr(0xFDD2 + i) for i, a in enumerate(("ffi", "ffl", "ff", "fi", "fl", "..."))}
    out = F.translate(fold(quote), "".join(marks.values()), T.STAND_IN * len(marks))
    for a, mark in marks.items():
        out = F.replace(out, F.lit(a), F.lit(mark))
    out = F.regexp_replace(out, r"([^\p{L}\p{N}\s\ufdd2-\ufdd7-])", r"\\$1")
    out = F.regexp_replace(out, r"(\\?[^\\])(?!$)", f"$1{_VANISH}")
    forms = {" ": rf"{_BLANK}(?:{_BLANK}|[{FOLD_NOTHING}])*", "-": f"[\\-{FOLD_DASHES}]", r"\'": f"['{FOLD_SINGLE}]", r"\"": f'["{FOLD_DOUBLE}]'}
    one = {v: k for k, v in FOLD_LONG.items()}
    for a, mark in marks.items():
        spelled = _VANISH.join(re.escape(c) for c in a)
        other = {"ffi": [f"{one['ff']}{_VANISH}i", f"f{_VANISH}{one['fi']}"], "ffl": [f"{one['ff']}{_VANISH}l", f"f{_VANISH}{one['fl']}"]}.get(a, [])
        forms[mark] = "(?:" + "|".join([one[a], *other, spelled]) + ")"
    for plain, pattern in forms.items():
        out = F.replace(out, F.lit(plain), F.lit(pattern))
    return out


def locate(text: Column, quote: Column) -> Column:
    """struct(strategy, score, start, end, matched, occurrences): the first rung of exact, folded and caseless search that finds the quote.

    start and end are offsets from 0 in the text itself, also where folding brought the hit about;
    occurrences count hits of that rung that do not overlap. Null if no rung finds it.
    """
    exact = F.instr(text, quote)

    def hit(name: str, score: float, at: Column, matched: Column, times: Column) -> Column:
        return F.struct(
            F.lit(name).alias("strategy"), F.lit(score).alias("score"), (at - 1).cast("int").alias("start"), (at - 1 + F.length(matched)).cast("int").alias("end"), matched.alias("matched"), times.cast("int").alias("occurrences")
        )

    def by_pattern(name: str, score: float, pattern: Column) -> Column:
        return let(pattern, lambda p: hit(name, score, F.regexp_instr(text, p), F.regexp_substr(text, p), F.regexp_count(text, p)))

    def rungs(p: Column) -> Column:
        f, g, pattern = p["f"], p["g"], p["pattern"]
        same = (F.length(F.lower(f)) == F.length(f)) & (F.length(F.lower(g)) == F.length(g))
        return (
            F.when(g == "", None).when(F.instr(f, g) > 0, by_pattern("NORMALIZED", 0.99, pattern))
            .when(same & (F.instr(F.lower(f), F.lower(g)) > 0), by_pattern("CASE_INSENSITIVE", 0.95, F.concat(F.lit("(?iu)"), pattern)))
        )

    folds = let(F.struct(fold(text).alias("f"), fold(quote).alias("g"), folded_pattern(quote).alias("pattern")), rungs)
    found = F.when(exact > 0, hit("EXACT", 1.0, exact, quote, occurrences(text, quote))).otherwise(folds)
    return F.when(F.coalesce(F.trim(quote), F.lit("")) != "", found)


def locate_offsets(text: Column, quote: Column) -> Column:
    """struct(start, end) of the hit; -1 and -1 where there is none."""
    return let(locate(text, quote), lambda h: F.struct(F.coalesce(h["start"], F.lit(-1)).alias("start"), F.coalesce(h["end"], F.lit(-1)).alias("end")))


def occurrences(text: Column, quote: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)).cast("int")


_FOLDED = {c: to for chars, to in ((FOLD_SPACES, " "), (FOLD_NOTHING, ""), (FOLD_DASHES, "-"), (FOLD_SINGLE, "'"), (FOLD_DOUBLE, '"')) for c in chars} | FOLD_LONG
_SPELLED = str.maketrans(_FOLDED)


def fold_map(text: str) -> tuple[str, np.ndarray]:
    """A text folded, and for each folded character the place of the one it comes from."""
    width = np.fromiter((len(_FOLDED.get(c, c)) for c in text), dtype=np.int64, count=len(text))
    wide, source = text.translate(_SPELLED), np.repeat(np.arange(len(text)), width)
    pieces = np.array([m.span() for m in re.finditer(r"\S+", wide)], dtype=np.int64).reshape(-1, 2)
    # a blank has the place of the word after it
    first, size = pieces[:, 0], pieces[:, 1] - pieces[:, 0]
    blank = (np.arange(len(pieces)) > 0).astype(np.int64)
    step = np.arange(int((size + blank).sum())) - np.repeat(np.cumsum(size + blank) - size, size + blank)
    return " ".join(wide.split()), source[np.repeat(first, size + blank) + np.maximum(step, 0)].astype(np.int64)


def best_span(text: str, quote: str, least: float = FUZZY) -> tuple[int, int, float] | None:
    """Start, end and score in the text of the group of matching runs that is most like the quote; None below ``least``.

    The score of a group is twice its matched characters over its width and the quote's length.
    All groups are scored at once from running sums over the runs. Quotes too few of whose
    characters lie in pieces of SHORT_RUN that the text has are given up before they are matched.
    """
    page, wanted = (" ".join(t.translate(_SPELLED).split()) for t in (text, quote))
    if len(page.casefold()) == len(page) and len(wanted.casefold()) == len(wanted):
        page, wanted = page.casefold(), wanted.casefold()
    # what runs can match at most; a group is no narrower than what it matches
    most, reach = 0, 0
    for i in range(len(wanted) - SHORT_RUN + 1):
        if wanted[i : i + SHORT_RUN] in page:
            most, reach = most + i + SHORT_RUN - max(i, reach), i + SHORT_RUN
    if 2.0 * most < least * (most + len(wanted)) * (1 - 1e-9) or not most:
        return None
    runs = np.array([(m.a, m.size) for m in SequenceMatcher(None, page, wanted, autojunk=False).get_matching_blocks() if m.size >= SHORT_RUN], dtype=np.int64).reshape(-1, 2)
    if not len(runs):
        return None
    at, size = runs.T
    first = np.flatnonzero(np.r_[True, at[1:] - (at + size)[:-1] > max(len(wanted), LEAST_GAP)])
    last = np.r_[first[1:], len(at)] - 1
    width = at[last] + size[last] - at[first]
    score = 2.0 * np.add.reduceat(size, first) / (width + len(wanted))
    top = int(score.argmax())
    if score[top] < least:
        return None
    _, source = fold_map(text)
    return int(source[at[first[top]]]), int(source[at[last[top]] + size[last[top]] - 1]) + 1, round(float(score[top]), 4)


def locate_fuzzy(pairs: DataFrame, keys: list[str], least: float = FUZZY) -> DataFrame:
    """keys, start, end and score for (keys, text, quote) rows that the cheaper rungs have missed."""
    fields = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, s) for i, (t, q) in enumerate(zip(b.column("text").to_pylist(), b.column("quote").to_pylist())) if t and q and (s := best_span(t, q, least))]
            take = pa.array([i for i, _ in got], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(k).take(take) for k in keys] + [pa.array([s[0] for _, s in got], pa.int32()), pa.array([s[1] for _, s in got], pa.int32()), pa.array([s[2] for _, s in got], pa.float64())], [*keys, "start", "end", "score"])

    return pairs.select(*keys, "text", "quote").mapInArrow(run, f"{fields}, start int, end int, score double")


def locate_all(pairs: DataFrame, keys: list[str], least: float = FUZZY) -> DataFrame:
    """keys, strategy, score, start, end and matched for (keys, text, quote): all four rungs; UNVERIFIED with start -1 where none holds.

    Only rows that the native rungs miss go through Python. What those rungs find is written once,
    with texts and quotes of the missed rows alone.
    """
    tried = pairs.select(*keys, "text", "quote", locate(F.col("text"), F.col("quote")).alias("h"))
    tried = Settled()(tried.select(*keys, "h", *[F.when(F.col("h").isNull(), F.col(c)).alias(c) for c in ("text", "quote")]))
    cols = [F.col("h.strategy").alias("strategy"), F.col("h.score").alias("score"), F.col("h.start").alias("start"), F.col("h.end").alias("end"), F.col("h.matched").alias("matched")]
    missed = tried.where("h is null").select(*keys, "text", "quote")
    near = locate_fuzzy(missed, keys, least).select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("score").alias("_p"))
    found = missed.join(near, keys, "left")
    cut = F.substr(F.col("text"), F.col("_s") + 1, F.col("_e") - F.col("_s"))
    late = found.select(
        *keys, F.when(F.col("_s").isNull(), "UNVERIFIED").otherwise("FUZZY").alias("strategy"), F.coalesce("_p", F.lit(0.0)).alias("score"), F.coalesce("_s", F.lit(-1)).alias("start"), F.coalesce("_e", F.lit(-1)).alias("end"), F.coalesce(cut, F.lit("")).alias("matched")
    )
    return tried.where("h is not null").select(*keys, *cols).unionByName(late)


def find_quotes(texts: DataFrame, quotes: DataFrame, window: int = 4) -> DataFrame:
    """(texts' columns but text, quotes' columns, start): every quote that stands in a text, exactly, and where first.

    texts: text and keys; quotes: quote and keys. A quote is posted under the rarest of its runs of
    ``window`` whole words (of its whole words, where it has fewer), as the texts count them, and
    texts meet it by that run: an equi-join. Quotes without a whole word between blanks are
    compared with each text, in a broadcast while they are SHORT_QUOTES at most.
    """
    inner = F.split(F.regexp_replace("quote", r"^[^ ]* | [^ ]*$", ""), " ")
    whole = F.when(F.col("quote").rlike(r" [^ ]+ "), F.size(inner)).otherwise(0)
    q = quotes.withColumn("_k", F.when(whole >= window, window).when(whole > 0, 1)).withColumn("_q", F.xxhash64("quote", *[c for c in quotes.columns if c != "quote"]))
    named = texts.withColumn("_t", F.xxhash64(*texts.columns))

    def by_run(size: int) -> DataFrame:
        def runs(words: Column) -> Column:
            run = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(size))))
            return let(words, lambda w: F.when(F.size(w) >= size, run(w)))

        mine = q.where(F.col("_k") == size).withColumn("_w", F.array_distinct(runs(F.filter(inner, lambda w: w != "") if size == 1 else inner)))
        posted = mine.select("_q", F.explode("_w").alias("_r"))
        wanted = posted.select("_r").distinct()
        # only hashes leave the explode: with the text beside each run, long texts would be copied once for each of their words
        found = Settled()(named.select("_t", F.explode(F.array_distinct(runs(F.split("text", " ")))).alias("_r")).join(wanted, "_r").distinct())
        often = found.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
        rarest = posted.join(often, "_r", "left").groupBy("_q").agg(F.min_by("_r", F.struct(F.coalesce("_n", F.lit(0)), "_r")).alias("_r"))
        pairs = found.join(mine.drop("_w", "_k").join(rarest, "_q"), "_r").drop("_q", "_r")
        return named.join(pairs, "_t").where(F.expr("contains(text, quote)")).drop("_t")

    few = q.where("_k is null").drop("_k", "_q")
    short = texts.join(F.broadcast(few) if few.limit(SHORT_QUOTES + 1).count() <= SHORT_QUOTES else few, F.expr("contains(text, quote)"))
    cols = [c for c in [*texts.columns, *quotes.columns] if c not in ("text", "quote")]
    start = (F.instr(F.col("text"), F.col("quote")) - 1).alias("start")
    out = by_run(window).select(*cols, start).unionByName(short.select(*cols, start))
    return out if q.where(F.col("_k") == 1).isEmpty() or window == 1 else out.unionByName(by_run(1).select(*cols, start))


#: Rarest word pairs of a quote that look for it, and words left of and right of where they place it that are searched with it.
SEEDS, SLACK = 8, 4


def _pairs(text: Column) -> Column:
    """array<bigint>: the hash of each two neighbouring words, folded, at the place of the first; words are what stands between single blanks."""
    target = " " * len(FOLD_SPACES) + "-" * len(FOLD_DASHES)
    words = F.split(F.regexp_replace(F.lower(F.translate(text, FOLD_SPACES + FOLD_DASHES, target)), r"\s", " "), " ")
    plain = F.transform(words, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return let(plain, lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(2))))))


def find_near_quotes(texts: DataFrame, quotes: DataFrame, least: float = FUZZY, seeds: int = SEEDS) -> DataFrame:
    """(texts' columns but text, quotes' columns but quote, start, end, score): where a quote stands in a text approximately, the best place of each text.

    texts: text and keys; quotes: quote and keys; which text a quote is from need not be known. Texts
    are indexed by their pairs of neighbouring words with places, for the pairs that quotes have. A
    quote looks its ``seeds`` rarest pairs up, by the number of places that have them; what they
    find in a text is put on diagonals (place in the text less place in the quote), and only the
    stretch of words around hits of near diagonals is compared with the quote, so that the
    quadratic matcher never sees a whole page. A place at which all the seeds are damaged is not
    found; nor is a quote of one word, which has no pair.
    """
    t_cols, q_cols = [c for c in texts.columns if c != "text"], [c for c in quotes.columns if c != "quote"]
    settled = Settled()
    q = settled(quotes.withColumn("_q", F.xxhash64("quote", *q_cols)).withColumn("_n", F.size(F.split("quote", r"\s"))))
    posted = settled(q.select("_q", "_n", F.posexplode_outer(_pairs(F.col("quote"))).alias("_qp", "_h")).where("_h is not null"))
    wanted = posted.select("_h").distinct()
    named = texts.withColumn("_t", F.xxhash64(*texts.columns))
    hits = settled(named.dropDuplicates(["_t"]).select("_t", F.posexplode_outer(_pairs(F.col("text"))).alias("_tp", "_h")).where("_h is not null").join(wanted, "_h", "left_semi"))
    often = hits.groupBy("_h").agg(F.count(F.lit(1)).alias("_c"))
    rank = F.row_number().over(Window.partitionBy("_q").orderBy("_c", "_qp"))
    rare = posted.join(often, "_h").withColumn("_r", rank).where(F.col("_r") <= seeds)
    met = hits.join(rare.select("_q", "_n", "_qp", "_h"), "_h").withColumn("_d", F.col("_tp") - F.col("_qp"))
    # diagonals of one cell are at most half the quote apart; a place between two cells is found in both
    half = F.greatest(F.floor(F.col("_n") / 2), F.lit(1))
    cells = met.groupBy("_q", "_t", "_n", F.floor(F.col("_d") / half).alias("_cell")).agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    first = F.greatest(F.col("_lo") - SLACK, F.lit(0))
    size = F.col("_hi") + F.col("_n") + SLACK - first
    near = cells.select("_q", "_t", first.cast("int").alias("_a"), size.cast("int").alias("_size")).distinct()
    asked = named.dropDuplicates(["_t"]).select("_t", "text").join(near, "_t").join(q.select("_q", "quote"), "_q")

    def cut(words: Column) -> Column:
        before = F.array_join(F.slice(words, F.lit(1), F.col("_a")), " ")
        return F.struct(F.when(F.col("_a") > 0, F.length(before) + 1).otherwise(0).alias("at"), F.array_join(F.slice(words, F.col("_a") + 1, F.col("_size")), " ").alias("text"))

    # every white space is one blank here, so that lengths are those of the text
    stretch = asked.withColumn("_s", let(F.split(F.regexp_replace(F.translate("text", FOLD_SPACES, " " * len(FOLD_SPACES)), r"\s", " "), " "), cut))
    stretch = stretch.select("_q", "_t", "_a", F.col("_s.at").alias("_at"), F.substr(F.col("text"), F.col("_s.at") + 1, F.length("_s.text")).alias("text"), "quote")
    found = locate_fuzzy(stretch, ["_q", "_t", "_a", "_at"], least).select("_q", "_t", (F.col("start") + F.col("_at")).cast("int").alias("start"), (F.col("end") + F.col("_at")).cast("int").alias("end"), "score")
    best = found.groupBy("_q", "_t").agg(F.max(F.struct("score", (-F.col("start")).alias("s"), "end")).alias("b")).select("_q", "_t", (-F.col("b.s")).alias("start"), F.col("b.end").alias("end"), F.col("b.score").alias("score"))
    return named.drop("text").join(best, "_t").join(q.drop("quote", "_n"), "_q").select(*t_cols, *q_cols, "start", "end", "score")


def anchor_at(text: Column, start: Column, end: Column) -> Column:
    """struct(quote, start, end, strategy, score) of a span whose offsets are known; null if it is out of the text or blank."""
    cut = F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))
    anchor = F.struct(cut.alias("quote"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit("EXACT").alias("strategy"), F.lit(1.0).alias("score"))
    return F.when((start >= 0) & (end > start) & (end <= F.length(text)) & ~cut.rlike(r"^(?U)\s*$"), anchor)


def with_block_kind(anchors: DataFrame, blocks: DataFrame, page: list[str], key: str) -> DataFrame:
    """Anchors (page, key, char_start, char_end) with block_kind: the kind of block they start in, ``mixed`` if they end in another kind, text outside blocks."""
    b = blocks.select(*page, F.col("order_index").alias("_o"), F.col("kind").alias("_k"), F.col("char_start").alias("_a"), F.col("char_end").alias("_z"))
    last = F.greatest(F.col("char_start"), F.col("char_end") - 1)
    starts, ends = (F.col("char_start") >= F.col("_a")) & (F.col("char_start") < F.col("_z")), (last >= F.col("_a")) & (last < F.col("_z"))
    met = anchors.select(*page, key, "char_start", "char_end").join(b, page).where(starts | ends)
    first = lambda c: F.min_by(F.when(c, F.col("_k")), F.when(c, F.col("_o")))
    told = met.groupBy(*page, key).agg(first(starts).alias("_first"), first(ends).alias("_last"))
    out = anchors.join(told, [*page, key], "left")
    kind = F.when(F.col("_first").isNull(), "text").when(F.col("_last").isNotNull() & (F.col("_last") != F.col("_first")), "mixed").otherwise(F.col("_first"))
    return out.withColumn("block_kind", kind).drop("_first", "_last")


def build_anchors(quotes: DataFrame, pages: DataFrame, blocks: DataFrame, page: list[str], key: str) -> DataFrame:
    """Quotes (page, key, quote) grounded in their pages' texts: quote as the page has it, offsets, strategy, score and block kind; ungrounded ones go."""
    met = quotes.join(pages.select(*page, "text"), page)
    hits = locate_all(met, [*page, key]).where("start >= 0")
    return with_block_kind(hits.select(*page, key, F.col("matched").alias("quote"), F.col("start").alias("char_start"), F.col("end").alias("char_end"), F.col("strategy").alias("match_strategy"), F.col("score").alias("match_score")), blocks, page, key)


def verify(text: Column, start: Column, end: Column, quote: Column, strict: bool = True) -> Column:
    """Whether the slice of the text is the quote, byte for byte or but for white space and case."""
    cut = F.substr(text, start + 1, end - start)
    if strict:
        return cut.eqNullSafe(quote)
    plain = lambda c: F.lower(T.collapse_ws(c))
    return plain(cut).eqNullSafe(plain(quote))


def resolve(anchors: DataFrame, pages: DataFrame) -> DataFrame:
    """Anchors with ``resolved``, the text they point at; empty where the page is not of their file."""
    p = pages.select("file_id", "page_number", F.col("text").alias("_t"))
    cut = F.substr(F.col("_t"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return anchors.join(p, ["file_id", "page_number"], "left").withColumn("resolved", F.coalesce(cut, F.lit(""))).drop("_t")
