"""Units, written numbers and agreement within written precision, as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .text import collapse_ws, defined, group, let

# Scale words, currencies, masses, areas, counted nouns, percent and basis-point words.
SCALES = {
    "hundred": 1e2, "thousand": 1e3, "k": 1e3, "'000": 1e3, "000s": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "mn": 1e6, "million": 1e6, "millions": 1e6,
    "mio": 1e6, "cr": 1e7, "crore": 1e7, "crores": 1e7, "bn": 1e9, "billion": 1e9, "billions": 1e9, "trillion": 1e12, "tn": 1e12, "lakh crore": 1e12,
}
CURRENCIES = {
    "₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "rupee": "INR", "rupees": "INR", "$": "USD", "us$": "USD", "usd": "USD", "us dollar": "USD", "us dollars": "USD",
    "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP",
}
MASS = {"ton": 1.0, "tons": 1.0, "tonne": 1.0, "tonnes": 1.0, "mt": 1.0, "kg": 0.001, "kgs": 0.001}
AREA = {"sq ft": 1.0, "sq. ft": 1.0, "square feet": 1.0, "sqft": 1.0, "sq m": 10.7639, "square metres": 10.7639, "square meters": 10.7639}
COUNTED = "shipments parcels customers employees people pin\\scodes pincodes centres centers vehicles units options shares gateways no\\. number count".split()
PERCENT = r"%|per cent|percent|pct"
BPS = r"bps|basis points|bp"
NIL = ("-", "–", "—", "nil", "na", "n.a.", "n/a", "", "*")
SCALE_NAMES = {1e2: "hundred", 1e3: "thousand", 1e5: "lakh", 1e6: "million", 1e7: "crore", 1e9: "billion", 1e12: "trillion"}
NUMBER = r"\d[\d, \s]*(?:\.\d+)?"


def _any(words: list[str]) -> str:
    longest = sorted(words, key=len, reverse=True)
    return r"(?<![a-z])(" + "|".join(w if "\\" in w else re.escape(w) for w in longest) + r")(?![a-z])"


def _look(table: dict, key: Column) -> Column:
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(pairs, key)


@defined
def parse_unit(label: Column) -> Column:
    """struct(dimension, scale, currency, canonical), or null where no unit is named.

    Percent and basis points come first, then currency with its scale, mass, area, days, ratio,
    counted things, and a bare scale of unknown dimension.
    """
    low = F.regexp_replace(F.lower(collapse_ws(label)), r"^[()\[\] \t]+|[()\[\] \t]+$", "")
    low = F.regexp_replace(F.regexp_replace(low, r"\b(?:in|of|amounts?|all amounts|figures)\b", " "), r"\bunless otherwise stated\b", " ")
    low = F.coalesce(collapse_ws(F.regexp_replace(low, "indian rupees", "inr")), F.lit(""))

    def unit(dimension: str, factor: Column, text: Column, code: Column | None = None) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), factor.cast("double").alias("scale"), (F.lit(None) if code is None else code).cast("string").alias("currency"), text.alias("canonical"))

    def words(low: Column) -> Column:
        area = "(" + "|".join(map(re.escape, AREA)) + ")"
        found = (("scale_word", SCALES, _any(list(SCALES))), ("currency", CURRENCIES, _any(list(CURRENCIES))), ("mass", MASS, _any(list(MASS))), ("area", AREA, area))
        return F.struct(low.alias("low"), *[_look(t, group(low, p)).alias(n) for n, t, p in found])

    def ladder(p: Column) -> Column:
        low, scale = p["low"], F.coalesce(p["scale_word"], F.lit(1.0))
        name = _look(SCALE_NAMES, scale)
        return (
            F.when(low == "", F.lit(None))
            .when(low.rlike(BPS) & ~F.regexp_replace(low, BPS, "").rlike(r"\p{L}"), unit("PERCENT", F.lit(0.01), F.lit("%")))
            .when(low.rlike(PERCENT), unit("PERCENT", F.lit(1.0), F.lit("%")))
            .when(p["currency"].isNotNull(), unit("CURRENCY", scale, F.when(scale == 1.0, p["currency"]).otherwise(F.concat(p["currency"], F.lit(" ("), name, F.lit(")"))), p["currency"]))
            .when(p["mass"].isNotNull(), unit("MASS", scale * p["mass"], F.lit("tonnes")))
            .when(p["area"].isNotNull(), unit("AREA", scale * p["area"], F.lit("sq ft")))
            .when(low.rlike(r"(?<![a-z])days?(?![a-z])"), unit("DAYS", scale, F.lit("days")))
            .when(low.rlike(r"^\d*\.?\d*x$"), unit("RATIO", F.lit(1.0), F.lit("x")))
            .when(low.rlike(_any(COUNTED)), unit("COUNT", scale, F.lit("count")))
            .when(p["scale_word"].isNotNull(), unit("UNKNOWN", scale, name))
        )

    return let(let(low, words), ladder)


def unit_key(unit: Column) -> Column:
    return F.when(unit["dimension"] == "CURRENCY", F.concat(F.lit("CURRENCY:"), F.coalesce(unit["currency"], F.lit("?")))).otherwise(unit["dimension"])


def describe(unit: Column, raw: Column | None = None) -> Column:
    """A unit's canonical name, else what was written."""
    return F.coalesce(F.nullif(unit["canonical"], F.lit("")), raw if raw is not None else F.lit(None).cast("string"))


def value_kind(unit: Column) -> Column:
    """MONEY, PERCENT or NUMBER."""
    return F.when(unit["dimension"] == "CURRENCY", "MONEY").when(unit["dimension"] == "PERCENT", "PERCENT").otherwise("NUMBER")


@defined
def trailing_scale(parts: Column) -> Column:
    """The unit of the last of several label lines where it is a bare scale word, else null."""
    last = parse_unit(F.try_element_at(parts, F.lit(-1)))
    return F.when(F.size(parts) >= 2, let(last, lambda u: F.when(u["dimension"] == "UNKNOWN", u)))


def is_note_reference(raw: Column, value: Column) -> Column:
    """A small whole number as notes are numbered: no point, no comma, below 100."""
    return ~raw.rlike("[.,]") & (F.abs(value) < 100)


@defined
def parse_quantity(label: Column, fallback: Column | None = None) -> Column:
    """struct(value, decimals, unit, raw): a written number with its own unit, else the fallback's; null without a number."""

    def told(q: Column) -> Column:
        unit = q["unit"] if fallback is None else F.coalesce(q["unit"], fallback)
        return F.when(q.isNotNull(), F.struct(q["value"].alias("value"), q["decimals"].alias("decimals"), unit.alias("unit"), collapse_ws(label).alias("raw")))

    return let(parse_number(label), told)


def places(value: Column) -> Column:
    """Decimal places of a stored number without trailing zeros, twelve at most."""
    return F.length(F.regexp_extract(F.regexp_replace(value.cast("decimal(38,12)").cast("string"), "0+$", ""), r"\.(\d*)$", 1))


@defined
def quantity_of(value: Column, unit: Column) -> Column:
    """struct(value, decimals, unit) of a stored number and its unit as text."""
    return F.when(value.isNotNull(), F.struct(value.alias("value"), places(value).alias("decimals"), parse_unit(unit).alias("unit")))


@defined
def parse_number(label: Column) -> Column:
    """struct(value, decimals, unit) of a written number; null for nil marks and texts without one.

    Brackets around all of it, or around its digits, make it negative; commas and spaces group digits.
    """
    pattern = rf"(?U)(?<![\w.])([-−]?)\s*({NUMBER})"

    def signed(raw: Column) -> Column:
        text = F.when(raw.rlike("[a-zA-Z]"), F.regexp_replace(raw, r"\(\d{1,2}\)\s*$", "")).otherwise(raw)
        whole = rf"(?i)^\(\s*[₹$€£\s]*{NUMBER}\s*(?:%|per cent|percent|bps)?\s*\)$"
        return let(text, lambda t: F.struct(
            raw.alias("raw"), t.rlike(rf"\(\s*{NUMBER}\s*\)").alias("inner"), t.rlike(whole).alias("whole"),
            F.when(t.rlike(whole), F.regexp_replace(t, r"^\(|\)$", "")).otherwise(F.regexp_replace(t, rf"\(\s*({NUMBER})\s*\)", " $1 ")).alias("text"),
        ))

    def read(s: Column) -> Column:
        text = s["text"]
        return F.struct(
            s.alias("s"), F.regexp_replace(group(text, pattern, 2), r"[,\s\u00a0]", "").alias("digits"), (group(text, pattern, 1).isNotNull() | s["whole"] | s["inner"]).alias("minus"),
            F.trim(F.regexp_replace(text, rf"(?U)^(.*?)(?<![\w.])[-−]?\s*{NUMBER}(.*)$", "$1 $2")).alias("rest"),
        )

    def number(p: Column) -> Column:
        value = p["digits"].cast("double")
        out = F.struct(F.when(p["minus"], -value).otherwise(value).alias("value"), F.coalesce(F.length(group(p["digits"], r"\.(\d+)$")), F.lit(0)).alias("decimals"), parse_unit(p["rest"]).alias("unit"))
        return F.when(F.lower(p["s"]["raw"]).isin(*NIL) | p["digits"].isNull(), F.lit(None)).otherwise(out)

    return let(let(let(collapse_ws(label), signed), read), number)


def canonical_value(value: Column, unit: Column) -> Column:
    return value * F.coalesce(unit["scale"], F.lit(1.0))


def half_ulp(decimals: Column, unit: Column) -> Column:
    return F.lit(0.5) * F.pow(F.lit(10.0), -decimals) * F.coalesce(unit["scale"], F.lit(1.0))


def agreement(va: Column, ha: Column, ka: Column, vb: Column, hb: Column, kb: Column, extra: float = 0.0) -> Column:
    """struct(band, difference, relative, tolerance, boundary) of two canonical values.

    h: half of the last written digit; k: comparison keys of the units, null or UNKNOWN compares with all.
    """
    known = (ka != "UNKNOWN") & (kb != "UNKNOWN")
    different = F.coalesce(known & (ka != kb), F.lit(False))
    gap, size = F.abs(va - vb), F.greatest(F.abs(va), F.abs(vb), F.lit(1e-12))
    tolerance, boundary = F.greatest(ha, hb) + size * extra, ha + hb + size * extra
    band = F.when(different, "INCOMPARABLE").when(gap <= tolerance, "MATCH").when(gap <= boundary, "ROUNDING_BOUNDARY").otherwise("MISMATCH")
    return F.struct(band.alias("band"), gap.alias("difference"), (gap / size).alias("relative"), tolerance.alias("tolerance"), boundary.alias("boundary"))


def values_agree(va: Column, ha: Column, ka: Column, vb: Column, hb: Column, kb: Column, extra: float = 0.0) -> Column:
    return agreement(va, ha, ka, vb, hb, kb, extra)["band"] == "MATCH"


def explain_agreement(agree: Column) -> Column:
    """An agreement in words."""
    gap, tolerance = F.format_string("%.4f", agree["difference"]), F.format_string("%.4f", agree["tolerance"])
    share = F.format_string("%.2f%%", agree["relative"] * 100)
    return (
        F.when(agree["band"] == "INCOMPARABLE", "the units measure different things")
        .when(agree["band"] == "MATCH", F.concat(F.lit("the values agree within written precision (gap "), gap, F.lit(", tolerance "), tolerance, F.lit(")")))
        .when(agree["band"] == "ROUNDING_BOUNDARY", F.concat(F.lit("the values differ by no more than rounding on both sides (gap "), gap, F.lit(")")))
        .otherwise(F.concat(F.lit("the values differ by "), gap, F.lit(" ("), share, F.lit(")")))
    )
