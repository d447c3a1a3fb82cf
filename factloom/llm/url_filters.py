"""Operator 12: URL rules indexed by their rarest literal token; only candidate rules run as regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import fresh, materialise, small, table

ALLOW, BLOCK = "allow", "block"
#: Rules on hosts and paths: (host, path, verdict).
HOST_RULES = (("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW), ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK))
#: Rules on the whole URL, for those that no host rule decides.
PATTERNS = (
    *((f"^{word}^", BLOCK) for word in (
        "adult", "ads", "adserver", "banner", "bets", "betting", "bingo", "cams", "casino", "casinos", "cialis", "clickbait", "dating", "doorway", "escort", "gambling", "jackpot",
        "keygen", "lottery", "malware", "phishing", "pills", "poker", "popunder", "porn", "roulette", "slots", "spam", "spyware", "torrent", "tracker", "viagra", "warez", "xxx",
    )),
    ("^ads^track^", BLOCK), ("^cheap^pills^", BLOCK), ("^free^bets^", BLOCK), ("^payday^loan*^", BLOCK), ("/wp-admin/", BLOCK), ("/wp-login.php", BLOCK), ("^utm_campaign=*spam", BLOCK),
    ("sex*chat", BLOCK), ("^responsible^gambling^", ALLOW), ("^spam^filter^", ALLOW), ("^torrent^of^", ALLOW),
)

_TOKEN = "[a-z0-9]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _LOWER))


def _whole(text: str, at_start: bool, at_end: bool) -> list[str]:
    """Tokens of a literal text that are whole tokens wherever it occurs; its own ends count if they are edges."""
    found = re.finditer(_TOKEN, _lowered(text))
    return [m[0] for m in found if (m.start() > 0 or at_start) and (m.end() < len(text) or at_end)]


def host_rule(host: str, path: str, verdict: str) -> dict:
    """A rule for a host and its subdomains and paths that begin with ``path``, as a regular expression on host + path."""
    host = _lowered(host)
    regex = r"\A(?:[^/]*\.)?" + re.escape(host + path) + ("" if path else r"(?:/|\z)")
    return {"kind": "host", "rule": host + path, "verdict": verdict, "regex": regex, "tokens": _whole(host + path, True, not path)}


def pattern_rule(pattern: str, verdict: str) -> dict:
    """A rule on the lower-cased URL: ``*`` is any text, ``^`` an end of the URL or a character that is no letter or digit of ASCII.

    Texts between stars are found one after the other, each at its first place and for good
    (atomic groups), so that a match takes time in proportion to the URL.
    """
    pattern = _lowered(pattern)
    edge = "[^a-z0-9]"
    pieces = [p for p in pattern.split("*") if p]
    parts = []
    for i, piece in enumerate(pieces):
        first, last = i == 0 and pattern.startswith("^"), i == len(pieces) - 1 and pattern.endswith("^")
        inner = "".join(edge if c == "^" else re.escape(c) for c in piece[first : len(piece) - last])
        parts.append((rf"(?:\A|{edge})" if first else "") + inner + (rf"(?:{edge}|\z)" if last else ""))
    regex = parts[0] if len(parts) == 1 else "".join([r"\A", *(rf"(?>[\s\S]*?{p})" for p in parts)])
    tokens = [t for piece in pieces for t in _whole(piece, False, False)]
    return {"kind": "pattern", "rule": pattern, "verdict": verdict, "regex": regex, "tokens": tokens}


def rules(spark: SparkSession, hosts: Iterable[tuple[str, str, str]] = HOST_RULES, patterns: Iterable[tuple[str, str]] = PATTERNS) -> DataFrame:
    """(kind, rule, verdict, regex, tokens): rules as ``judge`` takes them; longer lists may be read from a table."""
    made = [host_rule(*r) for r in hosts] + [pattern_rule(*r) for r in patterns]
    return spark.createDataFrame(made, "kind string, rule string, verdict string, regex string, tokens array<string>")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    return F.translate(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty as the host is."""
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def index(urls: DataFrame, of: DataFrame) -> DataFrame:
    """``of`` with the token each rule is posted under: of its own tokens the one that fewest URLs have, counted over all.

    urls: one row each with an array ``tokens``. Rules without a token that every match must hold
    are posted under the empty token, which every URL is given.
    """
    wanted = of.select(F.explode("tokens").alias("token")).distinct()
    held = urls.select(F.explode("tokens").alias("token")).join(small(wanted), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    posts = of.select("kind", "rule", F.explode("tokens").alias("token")).join(held, "token", "left")
    rarest = posts.groupBy("kind", "rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("least"))
    return of.join(rarest, ["kind", "rule"], "left").select("kind", "rule", "verdict", "regex", F.coalesce("least.token", F.lit("")).alias("token"))


def candidates(urls: DataFrame, posted: DataFrame) -> DataFrame:
    """(url, site, low, and the rule's columns) of each URL and each rule whose token it holds."""
    asked = urls.select("url", "site", "low", F.explode(F.array_append("tokens", F.lit(""))).alias("token"))
    return asked.join(small(posted), "token")


def verdicts(urls: DataFrame, of: DataFrame) -> DataFrame:
    """(url, rule, pattern, verdict) of each URL of (url, ...) that a rule fits."""
    low = F.translate("url", _UPPER, _LOWER)
    tokens = F.array_distinct(F.regexp_extract_all(low, F.lit(_TOKEN), F.lit(0)))
    read = materialise(urls.where("url is not null").select("url").distinct().select("url", F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("site"), low.alias("low"), tokens.alias("tokens")))
    of = materialise(of.dropDuplicates(["kind", "rule", "verdict"]))
    posted = materialise(index(read, of))
    fits = candidates(read, posted).where(F.rlike(F.when(F.col("kind") == "host", F.col("site")).otherwise(F.col("low")), F.col("regex")))
    weight = F.struct(F.length("rule"), (F.col("verdict") == BLOCK).alias("blocks"), "rule", "verdict")
    best = fits.groupBy("url").agg(*[F.max(F.when(F.col("kind") == k, weight)).alias(k) for k in ("host", "pattern")])
    return best.select("url", F.col("host.rule").alias("rule"), F.col("pattern.rule").alias("pattern"), F.coalesce("host.verdict", "pattern.verdict").alias("verdict"))


def judge(pages: DataFrame, of: DataFrame | None = None, default: str = ALLOW) -> DataFrame:
    """``pages`` with host, path, rule, verdict and pattern.

    Each rule is posted under the rarest of the literal tokens (runs of a-z and 0-9) that any
    match of it must hold, by how many distinct URLs hold them; a URL fetches the rules posted
    under its tokens, and only those run as regular expressions. Of the host rules that fit, the
    longest decides (ties: block, then the greater text); without one, the longest pattern that
    matches; without one, ``default``. Rules and their index are broadcast where they are few and
    joined by token where they are not.

    A null URL, or one without ``://``, has an empty host and path, and host rules never fit it; a
    null URL gets ``default``. Each distinct URL is judged once, and every row has the verdict of
    its URL; repeated rows stay repeated; an empty table stays empty. Other columns pass through
    the last join, so leave out pages' contents; columns called host, path, rule, verdict or
    pattern are replaced.
    """
    own = ("rule", "pattern", "verdict")
    of = rules(pages.sparkSession) if of is None else of
    plain = pages.drop("host", "path", *own)
    key, *made = fresh(plain, "__url", *(f"__{c}" for c in own))
    told = verdicts(plain.select("url"), of).select(F.col("url").alias(key), *[F.col(c).alias(n) for c, n in zip(own, made)])
    out = plain.join(told, F.col("url") == F.col(key), "left")
    rule, pattern, verdict = (F.col(n) for n in made)
    kept = [F.col(f"`{c}`") for c in plain.columns]
    return out.select(*kept, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), rule.alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict"), pattern.alias("pattern"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")
