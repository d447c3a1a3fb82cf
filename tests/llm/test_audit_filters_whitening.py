import re
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from factloom.llm import filter_audit, oracles, url_filters, whitening

DOCS = [
    (1, "word " * 150, "en"), (2, "word " * 150, "en"), (2, "word " * 150, "en"), (None, "word " * 150, "en"), (3, None, None), (4, "", "de"), (5, " \t\n", ""), (6, "A B C", "de"),
    (7, " ".join(f"w{i}" for i in range(120)), "en"), (8, " ".join(f"w{i}" for i in range(120)) + " 5%", "en"), (9, " ".join(f"W{i}" for i in range(120)), "fr"), (10, " ".join(f"w{i}" for i in range(120)), "fr"),
    (11, "Ünïcode\u00a0ÄÖ " * 60, "fr"), (12, "x" * 300_000, "de"), (None, None, None),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (10, 1, 1), (None, 1, 1), (99, 1, 1), (7, None, None)]


def audited(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("digest", F.lit("x")).withColumn("fails", F.lit(1))
    return filter_audit.audit(filter_audit.failures(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))


def test_audit_matches_brute_force(spark):
    got = {(r["part"], r["filter_order"], r["step"]): r for r in audited(spark, DOCS, LABELS).collect()}

    def fails(i, text, rows):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        out["E"] = any((t or "") == text and i is not None and j is not None and j < i for j, t, _ in rows)
        return {k for k, v in out.items() if v}

    want = {}
    for i, text, lang in DOCS:
        f = fails(i, text, DOCS)
        good, toxic = (any(x[0] == i and i is not None and x[k] == 1 for x in LABELS) for k in (1, 2))
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, name in enumerate(order, 1):
                w = want.setdefault((lang or "", order, step), [0] * 6)
                here = name in f and not gone
                w[2] += name in f and gone
                gone |= here
                w[0] += not gone
                w[1] += here
                w[3] += f == {name}
                w[4] += here and good
                w[5] += here and toxic
    assert set(got) == set(want)
    for k, w in want.items():
        assert [got[k][c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")] == w, k
        letter = k[1][k[2] - 1]
        assert got[k]["filter"] == letter and got[k]["shapley"] == sum(v[1] for q, v in want.items() if q[0] == k[0] and q[1][q[2] - 1] == letter)


def test_audit_states_its_sql_and_takes_empty_tables(spark):
    rows = [r for r in DOCS if r[0] is not None]
    got = audited(spark, rows, LABELS).toPandas()
    con = duckdb.connect()
    for name, values, schema in (("documents", rows, "doc_id long, text string, lang string"), ("labels", LABELS, "doc_id long, quality int, toxic int")):
        con.register(name, spark.createDataFrame(values, schema).toArrow())
    want = con.execute(oracles.OP13).df()[list(got.columns)]
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))
    assert audited(spark, rows[:1] * 0, LABELS).count() == 0
    assert audited(spark, rows[:1], []).where("kept + removed <> 1 and step = 1").count() == 0


URLS = [
    "https://www.example.com/en/1", "https://WWW.Example.COM/en/1?x=casino", "http://a.www.example.com/en/", "http://blog.example.com/en/3", "http://blog.example.com/EN/3", "http://blog.example.com/en", "http://example.com",
    "http://x.net/es/1", "http://x.net/fr/1#es", "http://x.net/de/1", "http://net/es/", "http://notexample.com/en/1", "ftp://poker.example.org/en", "http://x.org/a-casino.html", "http://x.org/accasino", "http://x.org/Casino",
    "http://x.org/?q=free+bets", "http://x.org/sexy-old-chatter", "http://x.org/spam-filter/", "http://x.org/spam", None, "", "no scheme casino", "://", "http://", "http://x.com:80/en/", "a://b://example.com/en/", "http://x.org/\n/en/casino",
    "http://münchen.net/es/ü", "http://x.org/" + "long/" * 50_000 + "casino", "http://x.org/wp-login.php?x", "http://x.org/wp-loginxphp", "http://X.NET/fr/", "http://.com/", "http://x.org/spam", "http://x.org/%41?y://z.com/",
]


def brute(url, hosts, patterns):
    rest = url.partition("://")[2] if url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(str.maketrans(url_filters._UPPER, url_filters._LOWER))
    fit = [(len(h + p), v == "block", h + p, v) for h, p, v in hosts if (host == h or host.endswith("." + h)) and path.startswith(p)]
    low = url.translate(str.maketrans(url_filters._UPPER, url_filters._LOWER)) if url is not None else None
    hit = [(len(r["rule"]), v == "block", r["rule"], v) for r, v in ((url_filters.pattern_rule(*p), p[1]) for p in patterns) if low is not None and re.search(r["regex"].replace(r"\z", r"\Z"), low)]
    return host, path, max(fit)[2] if fit else None, (max(fit) if fit else max(hit) if hit else (0, 0, 0, "allow"))[3], max(hit)[2] if hit else None


def test_url_filters_match_brute_force_and_sql(spark):
    pages = spark.createDataFrame([(i, u, 1, "y") for i, u in enumerate(URLS)], "page_id long, url string, low int, __url string")
    for hosts, patterns in ((url_filters.HOST_RULES, url_filters.PATTERNS), ((("x.org", "", "block"), ("x.org", "/Casino", "allow"), ("x.org", "/spa", "allow")), (("wp-login", "block"), ("*", "allow"), ("a^b*c", "block")))):
        rows = url_filters.judge(pages, url_filters.rules(spark, hosts, patterns)).collect()
        assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["pattern"]) for r in rows} == {i: brute(u, hosts, patterns) for i, u in enumerate(URLS)}
        assert len(rows) == len(URLS) and all(r["low"] == 1 and r["__url"] == "y" for r in rows)
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url").toArrow())
    want = {r[0]: r[1:] for r in con.execute("select page_id, coalesce(host, ''), coalesce(path, ''), rule, verdict, pattern from (" + oracles.OP12 + ")").fetchall()}
    assert want == {i: brute(u, url_filters.HOST_RULES, url_filters.PATTERNS) for i, u in enumerate(URLS)}
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_url_rules_are_fetched_by_their_rarest_token(spark):
    urls = spark.createDataFrame([(f"http://s{i}.example.com/en/{'casino' if i % 10 == 0 else 'page'}/{i}",) for i in range(100)], "url string")
    of = url_filters.rules(spark, [("example.com", "/en/", "block")], [("^en^casino^", "block"), ("^page^7*", "block"), ("ca*no", "block")])
    low = F.col("url")
    read = urls.select("url", low.alias("site"), low.alias("low"), F.array_distinct(F.regexp_extract_all(low, F.lit(url_filters._TOKEN), F.lit(0))).alias("tokens"))
    posted = {r["rule"]: r["token"] for r in url_filters.index(read, of).collect()}
    # "7" may be the beginning of a longer token, and "ca*no" has none: every URL is a candidate of it
    assert posted == {"example.com/en/": "com", "^en^casino^": "casino", "^page^7*": "page", "ca*no": ""}
    fetched = {r["rule"]: r["count"] for r in url_filters.candidates(read, url_filters.index(read, of)).groupBy("rule").count().collect()}
    assert fetched == {"example.com/en/": 100, "^en^casino^": 10, "^page^7*": 90, "ca*no": 100}


def exact(vectors):
    """n, deviations, eigenvalues, trace and coordinates by the definition, in fractions."""
    x = [[int(np.floor(max(-(2.0**52), min(2.0**52, v)) * 1024)) + 100_000 for v in row] for row in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    v = np.array([[float(Fraction(n * sum(r[i] * r[j] for r in x) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    y = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(r, s)] for r in x])
    return n, [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x], e, float(np.trace(v)), y @ u


def test_whitening_matches_exact_arithmetic(spark):
    rng = np.random.default_rng(3)
    sets = {1: rng.normal(size=(300, 10)) * np.arange(1, 11), 2: rng.normal(size=(40, 3)) * 1e9, 3: rng.normal(size=(20, 4)).astype(np.float32).astype(float) * 1e-2}
    rows = [(k * 1000 + i, v.tolist(), "own", 7) for k, x in sets.items() for i, v in enumerate(x)]
    odd = [(1, None), (2, [1.0, None]), (3, [float("nan")] * 10), (4, [float("inf")] * 10), (5, [])]
    df = spark.createDataFrame([*rows, *[(*r, "own", 7) for r in odd]], "vec_id long, embedding array<double>, sums string, _dim int").repartition(5)
    out = {r["vec_id"]: r for r in whitening.whiten(df).collect()}
    assert out.keys() == {r[0] for r in rows} | {5} and out[5]["white_values"] == [] and all(r["sums"] == "own" and r["_dim"] == 7 for r in out.values())
    for k, x in sets.items():
        n, deviation, e, total, y = exact(x)
        got = [out[k * 1000 + i] for i in range(len(x))]
        m = min(8, x.shape[1])
        assert {r["white_n"] for r in got} == {n} and [int(r["white_deviation"]) for r in got] == deviation
        white = np.array([r["white_values"] for r in got])
        assert white.shape == (n, m) and np.allclose(np.abs(white), np.abs(y[:, :m]) / np.sqrt(e[:m]), rtol=1e-8, atol=1e-9)
        assert np.allclose(got[0]["white_explained"], e[:m] / total, rtol=1e-9)
        assert len({r["white_identity_error"] for r in got}) == 1
        assert abs(got[0]["white_identity_error"] - np.abs(np.cov(white.T, bias=True) - np.eye(m)).max()) < 1e-12 < 1e-4


def test_whitening_of_odd_tables(spark):
    same = spark.createDataFrame([(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.5, 1.0])], "vec_id long, embedding array<float>")
    rows = whitening.whiten(same).collect()
    assert len(rows) == 3 and all(r["white_values"] == [0.0, 0.0] == r["white_explained"] and r["white_deviation"] == 0 and r["white_identity_error"] == 0 and r["white_n"] == 3 for r in rows)
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    n, deviation, *_ = exact([[1e300, 1.0], [-1e300, 2.0], [0.0, 3.0]])
    got = {r["vec_id"]: r["white_deviation"] for r in whitening.whiten(huge).collect()}
    assert got == {i: (d if d < 10**38 else None) for i, d in enumerate(deviation, 1)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert all(abs(r["white_values"][0]) > 0 or r["vec_id"] == 4 for r in whitening.whiten(line).collect())
    assert all(r["white_values"][1:] == [0.0, 0.0] and r["white_identity_error"] < 1e-9 for r in whitening.whiten(line).collect())
    assert whitening.whiten(same.limit(0)).count() == 0


def test_whitening_joins_fits_that_are_too_large_to_send(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=4 + i % 2).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    want = {r["vec_id"]: r for r in whitening.whiten(df).collect()}
    monkeypatch.setattr(whitening, "FITS", 0)
    got = {r["vec_id"]: r for r in whitening.whiten(df).collect()}
    assert got.keys() == want.keys() and all(got[k]["white_deviation"] == want[k]["white_deviation"] and np.allclose(got[k]["white_values"], want[k]["white_values"]) for k in got)


def test_exact_sums_beyond_longs():
    x = np.array([[2**61, -3], [2**61, 5], [-(2**62), 7]], dtype=np.int64)
    s, c = whitening.moments(x)
    assert s.tolist() == [0, 9] and c[0, 0] == 2 * 2**122 + 2**124 and c[0, 1] == 2**61 * 2 - 7 * 2**62
    values = [0, 1, -1, 2**31, -(2**31), -(2**31) - 1, 2**200 + 12345, -(2**200) + 99]
    back = [0] * len(values)
    for i, k, v in whitening.digits(values):
        assert -(2**63) <= v < 2**63
        back[i] += v << (whitening.BITS * k)
    assert back == values
