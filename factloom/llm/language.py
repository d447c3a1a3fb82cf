"""Operator 6: language identification by script ranges, per-word scores and a Viterbi path."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_bucket, in_arrow, slices, table

#: Most labelled documents that the model is fitted on; beyond that a fixed hash of the id picks about so many, by language.
TRAIN_DOCS = 20_000
#: Documents of a language that are taken at least, as far as there are so many.
LEAST = 20
BUCKETS = 1 << 16
ORDERS = (2, 3, 4, 5)
#: What a change of language within a text costs, in units of the words' log scores.
SWITCH = 8.0
UNKNOWN = "und"
#: Bytes of text that are labelled together, and distinct words that are scored together.
SLICE, SCORED = 3 << 20, 50_000

#: First code points of ranges and their scripts; 0 is anything else.
RANGES = [
    (0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00AA, 1), (0x00AB, 0), (0x00B5, 1), (0x00B6, 0), (0x00BA, 1), (0x00BB, 0), (0x00C0, 1),
    (0x0250, 1), (0x0300, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0B00, 10),
    (0x0E00, 11), (0x0E80, 12), (0x0F00, 13), (0x1000, 14), (0x10A0, 15), (0x1100, 16), (0x1200, 17), (0x1380, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0),
    (0x3040, 18), (0x3100, 0), (0x3400, 19), (0xA000, 0), (0xAC00, 16), (0xD7B0, 0), (0xF900, 19), (0xFB00, 0), (0x20000, 19), (0x30000, 0),
]
SCRIPTS = 20
_STARTS, _OF = np.array([a for a, _ in RANGES]), np.array([s for _, s in RANGES])


@dataclass(frozen=True)
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: log scores of n-grams
    allowed: np.ndarray  # SCRIPTS x languages: 0, or a penalty where the language does not use the script


def _grams(words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, bucket) of all byte n-grams of the words, their borders included."""
    data = np.frombuffer(b" " + " ".join(words).encode() + b" ", dtype=np.uint8)
    blank = data == 32
    word = np.cumsum(blank) - 1  # a blank counts with the word after it
    inner = np.r_[0, np.cumsum(blank)]
    code = np.zeros(len(data), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(data) - n + 1
        if m <= 0:
            return
        code[:m] = code[:m] * np.uint64(0x100000001B3) + data[n - 1 :]
        if n in ORDERS:
            ok = inner[n - 1 : n - 1 + m] - inner[1 : 1 + m] <= 0  # no blank strictly inside
            h = code[:m][ok] + np.uint64(n)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield word[:m][ok], (h >> np.uint64(48)).astype(np.int64)


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def script_of(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each word's script (of its last letter that has one; 0 if none) and number of letters."""
    joined = " ".join(words) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    script = _OF[np.searchsorted(_STARTS, points, side="right") - 1]
    letter = _letters()[points] if not joined.isascii() else script > 0
    word = np.cumsum(points == 32) - (points == 32)
    out, seen = np.zeros(len(words), dtype=np.int64), script > 0
    out[word[seen]] = script[seen]
    return out, np.bincount(word, letter, len(words)).astype(np.int64)


def split(text: str) -> list[str]:
    return text.lower().split()


def fit(docs: DataFrame) -> Model:
    """A model from all non-null lang values of ``docs`` (text, lang) and their n-gram counts.

    What is collected is bounded by BUCKETS times the number of languages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in slices(batches):
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                by_lang.setdefault(lang, []).extend(split(text or ""))
            for lang, words in by_lang.items():
                mine = counts.setdefault(lang, np.zeros(BUCKETS + SCRIPTS, dtype=np.int64))
                if not words:
                    continue
                for _, bucket in _grams(words):
                    mine[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                script, letters = script_of(words)
                mine[BUCKETS:] += np.bincount(script, letters, SCRIPTS).astype(np.int64)
        for lang, mine in counts.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(mine[at])], ["lang", "bucket", "n"])

    labelled = docs.where(F.col("lang").isNotNull()).select("text", "lang")
    langs = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    got = in_arrow(labelled, run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    number = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((BUCKETS + SCRIPTS, len(langs)))
    counts[got["bucket"].to_numpy(), [number[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    score = (np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)) / len(ORDERS)).astype(np.float32)
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    used = (share >= 0.01) | (share.max(axis=1, keepdims=True, initial=0) < 0.01)
    used[0] = True
    if langs:
        score -= score.mean(axis=1, keepdims=True)
    return Model(langs, score, np.where(used, 0.0, -50.0))


def word_scores(model: Model, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scores (words x languages) and letters of distinct words; words without letters score 0."""
    script, letters = script_of(words)
    out = np.zeros((len(words), len(model.langs)), dtype=np.float32)
    for word, bucket in _grams(words):
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(word, model.table[bucket, k], len(words))
    out += model.allowed[script]
    out[letters == 0] = 0
    return out, letters


def viterbi(score: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word of texts laid end to end, where each change costs ``switch``.

    All texts advance together, longest first, a word a step.
    """
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    left = np.sort(lengths)[::-1]
    langs = score.shape[1]
    path = np.zeros(len(score), dtype=np.int16)
    best = np.zeros((len(order), langs))
    counts = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
    edge = np.r_[0, np.cumsum(counts)].tolist()
    # back-pointers by step: the best language before, and as bits whether a language went on from itself
    top, stay = np.zeros(edge[-1], dtype=np.int16), np.zeros((edge[-1], -(-langs // 8)), dtype=np.uint8)
    alone = int(np.searchsorted(-counts, -1))  # from here on only the longest text is left
    for t, a in enumerate(counts[:alone].tolist()):
        now = best[:a]
        top[edge[t] : edge[t + 1]] = now.argmax(axis=1)
        leap = now.max(axis=1)[:, None] - (switch if t else 0)
        on = now >= leap
        stay[edge[t] : edge[t + 1]] = np.packbits(on, axis=1)
        best[:a] = np.where(on, now, leap) + score[start[:a] + t]
    if alone < len(counts):
        now, on = best[0].tolist(), np.zeros((len(counts) - alone, langs), dtype=bool)
        rows = score[start[0] + alone : start[0] + len(counts)].astype(np.float64).tolist()
        for i, row in enumerate(rows):
            most = max(now)
            top[edge[alone + i]] = now.index(most)
            leap = most - (switch if alone + i else 0)
            on[i] = [x >= leap for x in now]
            now = [(x if x >= leap else leap) + y for x, y in zip(now, row)]
        stay[edge[alone] :] = np.packbits(on, axis=1)
        best[0] = now
    at = best.argmax(axis=1).astype(np.int16)
    for t in range(len(counts) - 1, -1, -1):
        here = slice(edge[t], edge[t + 1])
        a = edge[t + 1] - edge[t]
        now = at[:a]
        path[start[:a] + t] = now
        kept = (stay[here][np.arange(a), now >> 3] >> (7 - (now & 7))) & 1
        at[:a] = np.where(kept, now, top[here])
    return path


def label(model: Model, texts: Sequence[str], switch: float = SWITCH) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, the language of every word, and its letters; and the words' numbers."""
    words = [split(t) for t in texts]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    number: dict[str, int] = {w: i for i, w in enumerate(dict.fromkeys(x for ws in words for x in ws))}
    if not number:
        return words, np.zeros(0, dtype=np.int16), np.zeros(0, dtype=np.int64), lengths
    names = list(number)
    parts = [word_scores(model, names[i : i + SCORED]) for i in range(0, len(names), SCORED)]
    score, letters = np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])
    flat = np.fromiter((number[x] for ws in words for x in ws), dtype=np.int64, count=int(lengths.sum()))
    return words, viterbi(score[flat], lengths, switch), letters[flat], lengths


def predict(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), names: Sequence[str] = ("lang_pred", "score", "spans")) -> DataFrame:
    """Columns ``keep`` with lang_pred, score and spans (called ``names``, none of them in ``keep``) of every whole text.

    lang_pred is the language of most letters along the text's path, score their share; spans
    counts the path's runs of one language. ``und`` with score 0 where the text is null or has no
    letter. Repeated rows keep their own rows; an empty table gives none. Narrow: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        n = len(model.langs)
        for b in slices(batches, most=SLICE):
            texts = [x or "" for x in b.column("text").to_pylist()]
            _, path, letters, lengths = label(model, texts)
            doc = np.repeat(np.arange(len(texts)), lengths)
            mass = np.bincount(doc * n + path, letters, len(texts) * n).reshape(len(texts), n) if n else np.zeros((len(texts), 1))
            total, top = mass.sum(axis=1), mass.argmax(axis=1)
            change = np.r_[True, (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])] if len(path) else np.zeros(0, dtype=bool)
            langs = [model.langs[k] if t > 0 else UNKNOWN for k, t in zip(top.tolist(), total.tolist())]
            share = mass.max(axis=1) / np.maximum(total, 1)
            spans = np.bincount(doc[change], minlength=len(texts)).astype(np.int32)
            columns = [b.column(c) for c in keep] + [pa.array(langs, pa.string()), pa.array(share), pa.array(spans)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *names])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return in_arrow(docs.select(*dict.fromkeys([*keep, "text"])), run, f"{schema}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` int")


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Fit on labelled documents whose crc32(doc_id as text) mod 4 is not 2, about ``most`` of them at most.

    Beyond that each language has an equal quota (LEAST at least) and a language below it is taken whole.
    """
    docs = docs.where((crc_bucket(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if sum(counts.values()) > most:
        quota = max(most / len(counts), LEAST)
        rates = docs.sparkSession.createDataFrame([(k, int(min(1.0, quota / n) * (1 << 40))) for k, n in counts.items()], "lang string, rate long")
        docs = docs.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.col("rate")).drop("rate")
    return fit(docs)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "spans")
