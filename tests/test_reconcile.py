import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import context, entities, extract, reconcile
from factloom.streaming.ingest import Ledger, stream

FACT = "id string, file_id string, entity string, attribute string, value_num double, value_text string, decimals int, unit string, temporal_scope string, qualifiers map<string,string>, confidence double, match_strategy string"


def fact(i, file="f1", attr="Net revenue", v=100.0, dec=0, unit="INR million", scope="FY24", q=None, conf=0.9, text=None, entity="Acme Ltd"):
    return i, file, entity, attr, v, text, dec, unit, scope, q or {}, conf, "EXACT"


CASES = [
    (fact("a"), fact("b", "f2"), "CORROBORATED", 0.92), (fact("a"), fact("b"), "CORROBORATED", 0.8), (fact("a"), fact("b", "f2", v=101.0), "CORROBORATED", 0.55),
    (fact("a"), fact("b", "f2", v=101.0, attr="Adjusted net revenue"), "APPARENT_CONTRADICTION", 0.5), (fact("a"), fact("b", "f2", v=150.0, attr="Adjusted net revenue"), "APPARENT_CONTRADICTION", 0.85),
    (fact("a"), fact("b", "f2", v=150.0, q={"section": "x"}), "APPARENT_CONTRADICTION", 0.7), (fact("a"), fact("b", "f2", v=150.0, q={"context": "x"}), "APPARENT_CONTRADICTION", 0.55),
    (fact("a"), fact("b", "f2", v=150.0, conf=0.5), "APPARENT_CONTRADICTION", 0.35), (fact("a"), fact("b", "f2", v=150.0), "GENUINE_CONTRADICTION", 0.8), (fact("a"), fact("b", v=150.0), "GENUINE_CONTRADICTION", 0.7),
    (fact("a"), fact("b", "f2", v=29.0, scope="Q3 FY24"), "APPARENT_CONTRADICTION", 0.85), (fact("a"), fact("b", "f2", v=290.0, scope="Q3 FY24"), "APPARENT_CONTRADICTION", 0.35),
    (fact("a"), fact("b", "f2", scope="Q3 FY24"), "ORTHOGONAL", 0.4), (fact("a"), fact("b", "f2", scope="FY20", v=3.0), "ORTHOGONAL", 0.8), (fact("a"), fact("b", "f2", scope="x"), "CORROBORATED", 0.45),
    (fact("a"), fact("b", "f2", unit="%"), "ORTHOGONAL", 0.6), (fact("a", attr="Others"), fact("b", "f2", attr="Others"), "ORTHOGONAL", 0.4),
    (fact("a", v=None, text="Yes"), fact("b", "f2", v=None, text="yes"), "CORROBORATED", 0.7), (fact("a", v=None, text="Yes"), fact("b", "f2", v=None, text="no"), "GENUINE_CONTRADICTION", 0.6),
]


def test_verdicts(spark):
    rows = []
    for i, (a, b, *_) in enumerate(CASES):
        for x in (a, b):
            rows.append((f"{x[0]}{i:02d}", f"{x[1]}-{i}", f"Entity{i}", *x[3:]))
    df = spark.createDataFrame(rows, FACT)
    even = df.select("file_id").distinct().withColumn("vintage_year", F.lit(2024))
    out = reconcile.classify(reconcile.pairs(reconcile.prepare(df, even)))
    got = {int(r["id"][1:]): (r["k"], r["c"]) for r in out.select(F.col("a.id").alias("id"), F.col("verdict.relationship_type").alias("k"), F.col("verdict.confidence").alias("c")).collect()}
    assert got == {i: (k, c) for i, (_, _, k, c) in enumerate(CASES)}


def test_guard_counts_what_it_skips(spark):
    df = spark.createDataFrame([("c", "k")] * 5, "cluster string, core_key string")
    assert [tuple(r) for r in reconcile.blocks(df, 4).select("pairs", "skipped").collect()] == [(0, 10)]


def test_aliases(spark):
    keys = ["delhivery", "delhivery logistics", "rbi", "reserve bank india", "abc", "abc motors", "rboi"]
    got = {r["key"]: r["root"] for r in entities.clusters(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    assert got["delhivery logistics"] == "delhivery" and got["reserve bank india"] == "rbi"
    assert got["abc motors"] == "abc motors" and got["rboi"] == "rboi"


def test_prose_rejects(spark):
    texts = ["In FY24, net revenue was ₹1,240 crore (audited).", "He received a salary of ₹500 crore in FY24.", "The meeting was held in 2023 in the big hall.", "The profit margin grew to 12.5% in Q2 FY25."]
    df = spark.createDataFrame([(str(i), 1, t) for i, t in enumerate(texts)], "file_id string, page_number int, text string")
    told = extract.with_page_units(extract.statements(df.selectExpr("*", "0 as span", "0 as order_index", "0 as start")), context.unit_declarations(df))
    facts = extract.prose_facts(told, df, df.selectExpr("file_id", "'x' as subject"))
    got = {int(r["file_id"]): (r["attribute"], r["value_num"], r["temporal_scope"]) for r in facts.collect()}
    assert got == {0: ("net revenue", 1240.0, "FY24"), 3: ("profit margin", 12.5, "Q2 FY25")}


def test_model_reply():
    assert extract.parse_items("```json\n[{\"a\": 1}, 2]\n```") == [{"a": 1}] and extract.parse_items("no list") == [] and extract.parse_items("[broken") == []


COLUMNS = ("id", "fact_a_id", "fact_b_id", "relationship_type", "confidence", "explanation")


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_batches_in_any_order_equal_one_run(spark, tmp_path):
    """Names that only a later name joins, a document whose vintage a later fact moves, facts that come twice."""
    names = ["Acme Foods Ltd", "Acme Foods Trading", "Acme", "Zeta Retail", "Zeta Retail Stores Pvt Ltd", "AFT", "the Company"]
    facts_ = []
    for i, name in enumerate(names):
        for j, scope in enumerate(["FY24", "FY23", "Q1 FY24"][: 2 + i % 2]):
            facts_.append(fact(f"{i}-{j}", file=f"f{i % 4}", entity=name, attr=["Net revenue", "Net revenue (adjusted)"][(i + j) % 2], v=100.0 + 10 * (i % 3), scope=scope))
    facts_ += [fact(f"old-{k}", "f1", f"Thing {k}", 1.0, scope="FY11", entity="Other Firm") for k in range(7)]
    subjects = spark.createDataFrame([("f2", "Acme Foods Limited")], "file_id string, subject string")
    whole = rows_of(reconcile.reconcile(spark.createDataFrame(facts_, FACT), subjects=subjects))
    assert len(whole) > 10 and len({r[3] for r in whole}) > 1
    for seed in (1,):
        mixed = facts_[:]
        random.Random(seed).shuffle(mixed)
        cuts = [mixed[:9], mixed[5:16], mixed[16:]]
        ledger = Ledger(spark, str(tmp_path / f"ledger{seed}"), subjects)
        assert ledger.facts() is None and ledger.edges() is None
        for n, part in enumerate(cuts):
            ledger.update(spark.createDataFrame(part, FACT), n)
        ledger.update(spark.createDataFrame(cuts[0], FACT), 99)
        assert rows_of(ledger.edges()) == whole and ledger.facts().count() == len(facts_)
        roots = {r["key"]: r["root"] for r in ledger.clusters().collect()}
        assert roots["acme foods trading"] == roots["aft"] == roots["acme"] == "acme"


def test_a_batch_that_failed_is_taken_in_again(spark, tmp_path, monkeypatch):
    facts_ = [fact(f"{i}", f"f{i}", v=100.0 + i % 2) for i in range(6)]
    df = lambda x: spark.createDataFrame(x, FACT)
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.update(df(facts_[:2]), 0)
    for step in ("_blocks", "_finish"):
        with monkeypatch.context() as m:
            m.setattr(Ledger, step, lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                ledger.update(df(facts_[2:5]), 1)
        assert ledger.facts().count() == 2
    ledger.update(df(facts_[5:]), 2)
    ledger.update(df(facts_[2:5]), 1)
    ledger.update(df(facts_[2:5]), 1)
    assert rows_of(ledger.edges()) == rows_of(reconcile.reconcile(df(facts_))) and ledger.facts().count() == 6


def test_streamed_batches(spark, tmp_path):
    df = spark.createDataFrame([fact("a"), fact("b", "f9")], FACT)
    for n in range(2):
        df.write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    stream(source, lambda d: d, ledger, str(tmp_path / "cp")).awaitTermination()
    assert ledger.facts().count() == 2 and rows_of(ledger.edges()) == rows_of(reconcile.reconcile(df))


@pytest.mark.parametrize("name", ["page_conflicts", "covered_text", "heading_carry"])
def test_oracles(spark, name):
    import duckdb

    import __spark_entry__ as entry

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("lineitem", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = entry.queries()[name](spark, sf), con.execute(entry.oracle_sql()[name]).fetchall()
    cols = [c[0] for c in con.description]
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want))
