"""Operator 4: mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import fresh, small, table

OTHER = "(other)"


def n_tokens(text: Column) -> Column:
    """Words separated by white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(tokens: Column, text: Column) -> Column:
    """Topic where the table has no topic column: what kind of text it is, by length and digits."""
    digits = F.length(text) - F.length(F.regexp_replace(text, "[0-9]", ""))
    return (
        F.when(tokens == 0, "empty").when(digits * 20 > F.length(text), "figures").when(tokens < 100, "note")
        .when(tokens < 1000, "article").otherwise("long")
    )


def rake(tokens: np.ndarray, margins: list[np.ndarray], targets: list[np.ndarray], keep: float = 1.0, rounds: int = 20_000, tol: float = 1e-9) -> np.ndarray:
    """Cell masses of ``keep`` of all tokens with the given margins, none above what its cell has.

    tokens: mass of each cell; margins: each cell's category in each margin; targets: each
    margin's shares, summing to 1. Each pass scales to one margin and cuts at the cell's own
    mass; a category without enough mass is taken whole. Stops when a round changes nothing, and
    warns with the last change if that takes more than ``rounds``.
    """
    budget = keep * tokens.sum()
    fitted = keep * tokens
    for _ in range(rounds):
        before = fitted
        for category, target in zip(margins, targets):
            now = np.bincount(category, fitted, len(target))
            factor = np.where(now > 0, target * budget / np.where(now > 0, now, 1), 0)
            fitted = np.minimum(fitted * factor[category], tokens)
        change = np.abs(fitted - before).max(initial=0) / max(budget, 1e-300)
        if change <= tol:
            return fitted
    warnings.warn(f"targets are not met: after {rounds} rounds a cell still changes by {change:.1e} of all tokens", stacklevel=2)
    return fitted


def flattened(mass: dict[str, float], temperature: float) -> dict[str, float]:
    """Default targets: shares raised to ``temperature`` (below 1 lifts rare categories) and normalised."""
    total = sum(mass.values()) or 1.0
    lifted = {k: (v / total) ** temperature if v > 0 else 0.0 for k, v in mass.items()}
    whole = sum(lifted.values()) or 1.0
    return {k: v / whole for k, v in lifted.items()}


def weigh(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = 0.6, temperature: float = 0.9, seed: int = 11, topic: Column | None = None) -> DataFrame:
    """``docs`` with columns mix_tokens, mix_prob and mix_kept.

    targets: shares by category for any of source, lang and topic; where absent, the table's own
    token shares raised to ``temperature``. Token masses of the cells (source, lang, topic) are
    raked to the three margins at ``keep`` of all tokens; a document is kept with its cell's raked
    over present mass as probability: kept tokens then have the target margins in expectation,
    as far as categories have the tokens, and nothing is repeated. Draws are a seeded hash of
    id and text, so reruns and lost executors change nothing and rows without an id are drawn by text.

    Counts come from all documents and every category has its own target; only where ``targets``
    names a margin do categories it leaves out share ``(other)``. The driver rakes one row for
    each cell that occurs, so its memory grows with sources x langs x topics, not with documents. Null
    source or lang is the category "(null)"; documents without tokens are kept with their cell's
    probability, 1 if the cell has no tokens; copies of a row fall alike; an empty table stays empty;
    columns named mix_tokens, mix_topic, mix_prob and mix_kept are replaced, all others pass through.
    """
    s_, l_, t_ = fresh(docs, "_s", "_l", "_t")
    base = docs.withColumn("mix_tokens", n_tokens(F.col("text")))
    base = base.withColumn("mix_topic", topic if topic is not None else topic_of(F.col("mix_tokens"), F.coalesce("text", F.lit(""))))
    names = {"source": "source", "lang": "lang", "topic": "mix_topic"}
    keyed = {k: F.coalesce(F.col(c).cast("string"), F.lit("(null)")) for k, c in names.items()}
    told = {k: sorted((targets or {}).get(k) or {}) for k in names}
    fold = {k: F.when(e.isin(told[k]), e).otherwise(OTHER) if told[k] else e for k, e in keyed.items()}
    cells = base.select(*[e.alias(k) for k, e in fold.items()], "mix_tokens").groupBy(*names).agg(F.sum("mix_tokens").alias("t"))
    rows = cells.collect()
    mass = np.array([float(r["t"]) for r in rows])
    margins, shares = [], []
    for k in names:
        values = sorted({r[k] for r in rows})
        place = {v: i for i, v in enumerate(values)}
        margin = np.array([place[r[k]] for r in rows], dtype=int)
        own = dict(zip(values, np.bincount(margin, mass, len(values)).tolist()))
        want = (targets or {}).get(k) or flattened(own, temperature)
        margins.append(margin)
        share = np.array([want.get(v, 0.0) for v in values], dtype=float)
        shares.append(share / max(share.sum(), 1e-300))
    raked = rake(mass, margins, shares, keep)
    probs = [float(r / m) if m > 0 else 1.0 for r, m in zip(raked, mass)]
    spark = docs.sparkSession
    fitted = spark.createDataFrame([(r["source"], r["lang"], r["topic"], p) for r, p in zip(rows, probs)], f"{s_} string, {l_} string, {t_} string, mix_prob double")
    base = base.drop("mix_prob")
    out = base.join(small(fitted), (fold["source"] == F.col(s_)) & (fold["lang"] == F.col(l_)) & (fold["topic"] == F.col(t_)), "left").drop(s_, l_, t_)
    draw = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))) / F.lit(2.0**64) + 0.5
    return out.withColumn("mix_kept", draw < F.col("mix_prob"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tokens, topic, probability and whether the document is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = weigh(docs)
    return out.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_prob").alias("prob"), F.col("mix_kept").alias("kept"))
