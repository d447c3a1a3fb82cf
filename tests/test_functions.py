import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import temporal, text, units
from factloom.operators import anchors, layout, reconcile, stages


def values(spark, items, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_periods(spark):
    cases = {
        "": "UNSPECIFIED", "FY22": "FY2022", "FY2022-23": "FY2022", "FY2024/25": "FY2024", "2024-25": "FY2024", "2024/25": "FY2024", "2024-27": "CY2024", "fiscal year 2024": "FY2024",
        "Q3 FY23": "FY2023-Q3", "Q1": "FY????-Q1", "H1 FY24": "FY2024-H1", "9M FY23": "FY2023-9M", "12M FY23": "FY2023", "TTM": "TTM", "CY2022": "CY2022", "2022": "CY2022",
        "31 March 2023": "ASOF:2023-03-31", "March 31, 2024": "ASOF:2024-03-31", "End-February 2024": "ASOF:2024-02-29", "six months ended": "UNSPECIFIED",
    }
    assert values(spark, list(cases), lambda c: temporal.canonical(temporal.parse_period(c))) == list(cases.values())
    assert values(spark, [None], lambda c: temporal.canonical(temporal.parse_period(c))) == ["UNSPECIFIED"]


def test_containment(spark):
    rows = [("FY2024", "Q3 FY24", True), ("H1 FY24", "Q1 FY24", False), ("FY2023", "Q3 FY24", False), ("CY2024", "Q1 FY24", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    got = df.select("want", temporal.contains(temporal.parse_period(F.col("a")), temporal.parse_period(F.col("b"))).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_units(spark):
    cases = {
        "₹ Cr": ("CURRENCY", 1e7, "INR (crore)"), "INR million": ("CURRENCY", 1e6, "INR (million)"), "US$": ("CURRENCY", 1.0, "USD"), "%": ("PERCENT", 1.0, "%"), "bps": ("PERCENT", 0.01, "%"),
        "(All amounts in Indian Rupees in million, unless otherwise stated)": ("CURRENCY", 1e6, "INR (million)"), "'000 Tons": ("MASS", 1000.0, "tonnes"), "kg": ("MASS", 0.001, "tonnes"),
        "Days": ("DAYS", 1.0, "days"), "2.5x": ("RATIO", 1.0, "x"), "million shipments": ("COUNT", 1e6, "count"), "million": ("UNKNOWN", 1e6, "million"), "lakh crore": ("UNKNOWN", 1e12, "trillion"), "Remarks": None,
    }
    got = values(spark, list(cases), units.parse_unit)
    assert [g and (g["dimension"], g["scale"], g["canonical"]) for g in got] == list(cases.values())


def test_numbers(spark):
    cases = {
        "8,142": (8142, 0, None), "81,415.38": (81415.38, 2, None), "(452)": (-452, 0, None), "₹(452) Cr": (-452, 0, "INR (crore)"), "−5.5": (-5.5, 1, None), "12.5%": (12.5, 1, "%"),
        "-": None, "–": None, "nil": None, "N.A.": None, "*": None, "FY24": None, "1,860(1)": (-18601, 0, None), "100 20": (10020, 0, None),
    }
    got = values(spark, list(cases), units.parse_number)
    assert [g and (g["value"], g["decimals"], g["unit"] and g["unit"]["canonical"]) for g in got] == list(cases.values())


@pytest.mark.parametrize(("a", "b", "band"), [("8,142 ₹ Cr", "81,415.38 INR million", "MATCH"), ("6.5%", "6.6%", "ROUNDING_BOUNDARY"), ("127 ₹ Cr", "76 ₹ Cr", "MISMATCH"), ("5%", "5 INR", "INCOMPARABLE")])
def test_agreement(spark, a, b, band):
    x, y = units.parse_number(F.lit(a)), units.parse_number(F.lit(b))
    side = lambda q: (units.canonical_value(q["value"], q["unit"]), units.half_ulp(q["decimals"], q["unit"]), units.unit_key(q["unit"]))
    assert spark.range(1).select(units.agreement(*side(x), *side(y))["band"]).first()[0] == band


def test_entities_and_cores(spark):
    assert values(spark, ["The Acme Logistics Private Limited", "the Company"], reconcile.normalize_entity) == ["acme logistics", ""]
    got = values(spark, ["Adjusted EBITDA", "Total income", "Consolidated"], reconcile.signature)
    assert [(g["core"], g["modifiers"]) for g in got] == [(["ebitda"], ["adjusted"]), (["income", "total"], []), (["consolidated"], [])]


def test_quotes(spark):
    q = lambda t, s: spark.range(1).select(anchors.locate(F.lit(t), F.lit(s))).first()[0]
    assert q("Revenue of 1,240", "Revenue of 1,240")["strategy"] == "EXACT"
    assert q("Revenue  of\n1,240", "Revenue of 1,240")["strategy"] == "NORMALIZED"
    assert q("Revenue of 1,240", "REVENUE OF 1,240")["strategy"] == "CASE_INSENSITIVE"
    assert q("Revenue of 1,240", "unrelated words") is None
    for told in ("office staff", "offices", "waffle (plain)", "cliff", "and so on...", "fi", "final... (1)"):  # what a ligature or an ellipsis may stand for
        got = q(f"The  {told.replace(' ', '  ')} here", f"The {told}")
        assert (got["strategy"], got["start"], got["matched"]) == ("NORMALIZED", 0, f"The  {told.replace(' ', '  ')}")
    assert q("the \ufb01nal  o\ufb03ce\u2026 here", "final office...")["matched"] == "\ufb01nal  o\ufb03ce\u2026"
    assert anchors.best_span("the net revenue for the year rose", "the revenue for the year rose")[2] >= 0.82
    assert anchors.best_span("abc", "completely different text") is None


def test_dear_expressions_of_repeated_arguments(spark):
    rows = spark.createDataFrame([(i, ["FY2024", "Q2 FY2024", None, "FY2023"][i % 4], ["FY2024", None][i % 2]) for i in range(40)], "i int, a string, b string")
    told = lambda x, y: temporal.overlaps(temporal.parse_period(x), temporal.parse_period(y))
    plain = rows.select("i", told(F.col("a"), F.col("b")).alias("o"))
    got = stages.per_distinct(rows, "o", told, F.col("a"), F.col("b")).select("i", "o")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() == 40


def test_reading_order_sorts_twice(spark):
    rows = spark.range(20).selectExpr("id % 2 as page", "id as item", "600D as width", "10D * id as x0", "10D * id + 90 as x1", "5D * id as y0")
    plan = layout.reading_order(rows, ["page"], "item")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2


def test_hopeless_quotes_are_not_matched(monkeypatch):
    def called(*_, **__):
        raise AssertionError("matched")

    monkeypatch.setattr(anchors, "SequenceMatcher", called)
    assert anchors.best_span("some words of a page " * 1000, "0 1 2 3 4 5 6 7 8 9 # @ 0") is None
    with pytest.raises(AssertionError):
        anchors.best_span("the net revenue for the year rose", "the revenue for the year rose")


def spans_of(spark, text, most, overlap):
    row = spark.createDataFrame([(text,)], "t string").select(layout.windows(F.col("t"), most, overlap).alias("w")).first()
    return [(w["start"], w["end"]) for w in row["w"]]


def test_windows_cover(spark):
    t = ("word " * 300 + "\n") * 10
    spans = spans_of(spark, t, 1000, 100)
    assert spans[0][0] == 0 and spans[-1][1] == len(t) and all(b - a <= 1000 for a, b in spans)
    assert all(s[0] <= p[1] for p, s in zip(spans, spans[1:])) and spans_of(spark, " \n", 10, 1) == [] == spans_of(spark, None, 10, 1)
    with pytest.raises(ValueError):
        layout.windows(F.lit("x"), 0, 0)


def test_windows_by_definition(spark):
    """Against a plain loop, over texts whose breaks lie anywhere, with overlaps up to half a window."""
    rng = random.Random(5)

    def loop(t, most, overlap):
        out, at, back = [], 0, min(max(overlap, 0), most // 2)
        while t.strip() and at < len(t):
            end = min(len(t), at + most)
            if end < len(t):
                w = t[at:end]
                end = next((at + w.rindex(m) + len(m) for m in ("\n\n", "\n", ". ", " ") if m in w and w.rindex(m) > most // 2), end)
            if t[at:end].strip():
                out.append((at, end))
            if end == len(t):
                break
            nxt = max(end - back, at + 1)
            line = t[:nxt].rfind("\n", at) + 1
            at = line if line > at and end - line <= most else nxt
        return out

    rows = []
    for i in range(120):
        t = "".join(rng.choice("ab é\n. \n ") if rng.random() < 0.3 else rng.choice("xyzü𝒜") for _ in range(rng.choice([0, 1, 30, 200, 900])))
        rows.append((i, t if i % 9 else t.replace(" ", "\n\n")))
    df = spark.createDataFrame(rows, "i int, t string")
    for most, overlap in ((10, 0), (10, 9), (37, 11), (100, 50), (1, 1)):
        got = {r["i"]: [(w["start"], w["end"]) for w in r["w"]] for r in df.select("i", layout.windows(F.col("t"), most, overlap).alias("w")).collect()}
        assert got == {i: loop(t, most, overlap) for i, t in rows}, (most, overlap)


def test_normalize_key(spark):
    assert values(spark, ["Étà  straße-9!", None], text.normalize_key) == ["eta_strasse_9", None]


def test_label_rules(spark):
    labels = ["Revenue #", "Net loss (A-B)", "Net loss (A-B)(3) *", "Total (1, 2)", "Gain (FX)", "(iv) Other income:", "II.1.a. Total", "A. Government", "12 Rent", "(12)Rent", "1.2.3 Sub", "ABC total", "IVX Notes ;", "I", "(i)", "  a.  b ", ""]
    want = ["Revenue", "Net loss", "Net loss", "Total (1, 2)", "Gain (FX)", "Other income", "Total", "Government", "Rent", "(12)Rent", "Sub", "ABC total", "Notes", "I", "(i)", "b", ""]
    assert values(spark, labels, text.clean_label) == want
    goes = {"Changes in inventories": False, "Marginal cost": False, "margin": True, "Y-o-Y change": True, "q-o-q": True, "per  cent of sales": True, "percentage": False, "% of total": True, "%": False, "%age": True, "growth-rate": True, "Change": True, "of revenue": True, "offer": False}
    assert values(spark, list(goes), text.is_continuation) == list(goes.values())


def test_matches_in_texts_with_any_code_points(spark):
    texts = ["ab\ue000cd 12 ef 34", "\ufdd0 12\ufdd1\ufdd0 345 \ue001", "𝒜 7", "none", None]
    got = values(spark, texts, lambda c: text.matches(c, pattern=r"\d+"))
    assert [None if g is None else [tuple(m) for m in g] for g in got] == [[(6, "12"), (12, "34")], [(2, "12"), (7, "345")], [(2, "7")], [], None]
    odd = values(spark, texts[1:2], lambda c: text.matches(c, pattern=r"[^\d\s]+"))
    assert [tuple(m) for m in odd[0]] == [(0, "\ufdd0"), (4, "\ufdd1\ufdd0"), (11, "\ue001")]


def test_keys_beyond_the_basic_plane(spark):
    assert values(spark, ["\U0001d400\U0001d41c\U0001d7d8 x", "\U0001f131"], text.normalize_key) == ["ac0_x", "b"]


def test_dates_that_are_none_end_the_search(spark):
    told = values(spark, ["2024-13-45 or 5 May 2024", "31 April 2024", "on 5 May 2024", "May 5, 2024", "end-Foo 2024, 5 May 2024"], temporal.parse_date)
    assert [None if d is None else d.isoformat() for d in told] == [None, None, "2024-05-05", "2024-05-05", "2024-05-05"]
