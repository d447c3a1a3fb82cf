"""Operator 2: language-model scoring by a log-bilinear model with noise-contrastive estimation."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ASCII_LOWER, crc_bucket, materialise, slices, table, texts_of

#: Frequent words that go to every worker with their counts; rarer ones are joined.
DICTIONARY = 200_000
#: Words that are tokens of the neural model; others are tokens by their last bytes, each spread over its words by counts.
MODEL_WORDS = 1536
TAIL_CLASSES = 256
END = MODEL_WORDS + TAIL_CLASSES
START = END + 1  # only a context
DIM = 32
NOISE = 10.0
STEPS = 160
#: Precision of the Gaussian prior of the vectors, in observations.
PRIOR = 5.0
#: Entries at which a task hands on its word counts.
FLUSH = 300_000


def tail_class(word: bytes) -> int:
    return MODEL_WORDS + zlib.crc32(word[-3:]) % TAIL_CLASSES


def words(text: bytes) -> list[bytes]:
    """Lower-cased words: bytes.split parts at space and 0x09 to 0x0D."""
    return text.translate(ASCII_LOWER).split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, tail int, c long): counts of all words of ``docs``, summed in tasks before the shuffle."""

    def rows(counts: Counter) -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([tail_class(w) for w in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["word", "tail", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in slices(batches):
            for text in texts_of(b.column("text")):
                counts.update(words(text))
            if len(counts) > FLUSH:
                yield rows(counts)
                counts = Counter()
        yield rows(counts)

    return docs.select("text").mapInArrow(run, "word binary, tail int, c long").groupBy("word", "tail").agg(F.sum("c").alias("c"))


class Known(dict):
    """Places of dictionary words; -1 for others."""

    def __missing__(self, key: bytes) -> int:
        return -1


@dataclass
class Corpus:
    """What workers know: dictionary words in order, their counts, and the mass and types of each tail class."""

    dictionary: list[bytes]
    counts: np.ndarray
    tail_mass: np.ndarray
    tail_types: np.ndarray
    train_tokens: int
    types: int
    ends: int
    log10_p: np.ndarray | None = None

    def known(self) -> Known:
        got = self.__dict__.get("_known")
        if got is None:
            got = self._known = Known((w, i) for i, w in enumerate(self.dictionary))
            self._token = np.array([i if i < MODEL_WORDS else tail_class(w) for i, w in enumerate(self.dictionary)] + [0], dtype=np.int64)
        return got

    def tokens(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Dictionary places (-1: none) and model tokens of words, and which have no place."""
        place = np.fromiter(map(self.known().__getitem__, ws), dtype=np.int64, count=len(ws))
        token = self._token[place]
        rare = np.flatnonzero(place < 0).tolist()
        if rare:
            token[rare] = [tail_class(ws[i]) for i in rare]
        return place, token, rare


def _laid_out(corpus: Corpus, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, list[int], np.ndarray]:
    """All words; and with an END after each text: places, tokens, contexts; rare words' indices; text lengths in words."""
    split = [words(t) for t in texts]
    n = np.array([len(s) for s in split], dtype=np.int64)
    flat = [w for s in split for w in s]
    place, token, rare = corpus.tokens(flat)
    ends = np.cumsum(n)
    token = np.insert(token, ends, END)
    context = np.r_[START, token[:-1]]
    context[np.r_[0, (ends + np.arange(1, len(n) + 1))[:-1]]] = START
    return flat, place, token, context, rare, n


def pair_counts(docs: DataFrame, corpus: Corpus) -> np.ndarray:
    """Counts (context x token) over all of ``docs``; at most (END + 2) * (END + 1) cells come to the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(corpus)
    width = END + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((END + 2) * width, dtype=np.int64)
        for b in slices(batches):
            _, _, token, context, _, _ = _laid_out(shared.value, texts_of(b.column("text")))
            sums += np.bincount(context * width + token, minlength=len(sums))
        at = np.flatnonzero(sums)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[part])], ["cell", "n"])

    got = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((END + 2) * width)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(END + 2, width)


def fit(pairs: np.ndarray, steps: int = STEPS, seed: int = 3, prior: float = PRIOR) -> np.ndarray:
    """Normalised log10 probabilities (context x token) of a log-bilinear model fitted by noise contrast.

    The score of a token after a context is the product of two vectors plus the token's bias.
    Each step contrasts every observed pair with NOISE noise tokens a pair drawn from the
    unigram distribution; sums over draws are taken in expectation, so a step is three matrix
    products over all pairs of the corpus and the result depends on nothing random but the start.
    A Gaussian prior holds the vectors of contexts and tokens that the corpus shows rarely.
    """
    rng = np.random.default_rng(seed)
    n_context, n_token = pairs.shape
    total = max(pairs.sum(), 1.0)
    row = pairs.sum(axis=1, keepdims=True)
    noise = (pairs.sum(axis=0) + 0.5) / (total + 0.5 * n_token)
    shift = np.log(NOISE * noise).astype(np.float32)
    data = pairs.astype(np.float32)
    against = row.astype(np.float32) * (NOISE * noise).astype(np.float32)
    params = [rng.normal(0, 0.1, (n_context, DIM)).astype(np.float32), rng.normal(0, 0.1, (n_token, DIM)).astype(np.float32), np.log(noise).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        context, target, bias = params
        delta = context @ target.T
        delta += bias - shift
        np.clip(delta, -30, 30, out=delta)
        np.exp(-delta, out=delta)
        odds = 1.0 / (1.0 + delta)  # that the pair is data
        grad = data - (data + against) * odds
        grads = [grad @ target - prior * context, grad.T @ context - prior * target, grad.sum(axis=0)]
        rate = 0.05 * min(1.0, step / 10) * (1.0 if step < 0.7 * steps else 0.25)
        for p, g, m, v in zip(params, grads, first, second):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    context, target, bias = params
    score = (context @ target.T + bias).astype(np.float64)
    score -= score.max(axis=1, keepdims=True)
    return ((score - np.log(np.exp(score).sum(axis=1, keepdims=True))) / np.log(10)).astype(np.float32)


def frequent(counts: DataFrame, most: int = DICTIONARY) -> DataFrame:
    """The rows of (word, c) of the most frequent words, nearly ``most`` of them; words of one frequency are taken by their hashes.

    Frequencies fall into cells of a sixteenth of a doubling, and the cell that ``most`` cuts into
    a thousand by hash. Both histograms have a thousand cells or so, so that no task sorts or
    holds all words, and ties cost no more than a cell.
    """
    cell, part = F.floor(F.log2(F.col("c")) * 16).cast("int"), F.pmod(F.xxhash64("word"), F.lit(1024))
    tally = lambda d, by: sorted((r["k"], r["n"]) for r in d.groupBy(by.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect())

    def fitting(cells: list[tuple[int, int]], room: int) -> tuple[int, int]:
        """How many of the cells fit, and the room they leave."""
        for i, (_, n) in enumerate(cells):
            if n > room:
                return i, room
            room -= n
        return len(cells), room

    cells = tally(counts, cell)[::-1]
    n, room = fitting(cells, most)
    if n == len(cells):
        return counts
    cut = cells[n][0]
    parts = tally(counts.where(cell == cut), part)
    m, _ = fitting(parts, room)
    last = parts[m][0]  # never past the end: the whole cell does not fit
    return counts.where((cell > cut) | ((cell == cut) & (part < last)))


def learn(docs: DataFrame) -> tuple[Corpus, DataFrame]:
    """The model from all texts of ``docs``, and (h, crc, c): every word's count by two hashes of 96 bits together."""
    counts = materialise(word_counts(docs))
    tails = {r["tail"]: (r["m"], r["n"]) for r in counts.groupBy("tail").agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    top = frequent(counts).select("word", "c").toArrow()
    top = sorted(zip(top["word"].to_pylist(), top["c"].to_pylist()), key=lambda x: (-x[1], x[0]))
    mass, types = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for t, (m, n) in tails.items():
        mass[t - MODEL_WORDS], types[t - MODEL_WORDS] = m, n
    for w, c in top[:MODEL_WORDS]:  # tokens of their own
        mass[tail_class(w) - MODEL_WORDS] -= c
        types[tail_class(w) - MODEL_WORDS] -= 1
    ends = docs.count()
    n_words, n_types = sum(m for m, _ in tails.values()), sum(n for _, n in tails.values())
    corpus = Corpus([w for w, _ in top], np.array([c for _, c in top], dtype=np.float64), mass, types, n_words + ends, n_types + (ends > 0), ends)
    corpus.log10_p = fit(pair_counts(docs, corpus))
    return corpus, counts.select(F.xxhash64("word").alias("h"), F.crc32("word").alias("crc"), "c")


def score(docs: DataFrame, corpus: Corpus, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of every whole text.

    Each text is its words and one end. The model's probability of a word is that of its token
    after the one before, times, for a word without a token of its own, its smoothed share of
    its tail class, where all unseen words of a class count as one type: sums over all types are
    1. Words of the dictionary are scored in place; others are joined with their counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(corpus)  # bounded by DICTIONARY and the token table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        c.known()
        lc = np.r_[np.log10(c.counts + 0.5), 0.0]
        tail = np.log10(c.tail_mass + 0.5 * (c.tail_types + 1))
        end = np.log10(c.ends + 0.5)
        whole = np.log10(c.train_tokens + 0.5 * (c.types + 1))
        for b in slices(batches):
            flat, place, token, context, rare, n = _laid_out(c, texts_of(b.column("text")))
            doc, doc1 = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(n)), n + 1)
            lm = np.bincount(doc1, c.log10_p[context, token], len(n))
            inside = np.where(place < 0, 0.0, lc[place])
            wt = token[token != END] if len(flat) else np.zeros(0, dtype=np.int64)
            in_tail = wt >= MODEL_WORDS
            lm += np.bincount(doc[in_tail], (inside - tail[np.where(in_tail, wt - MODEL_WORDS, 0)])[in_tail], len(n))
            base = np.bincount(doc, inside, len(n)) + end - whole * (n + 1)
            known = np.bincount(doc[place >= 0], minlength=len(n)) + (c.ends > 0)
            per: dict[int, Counter] = {}
            for i, d in zip(rare, doc[rare].tolist()):
                per.setdefault(d, Counter())[flat[i]] += 1
            digest = lambda w: xxhash.xxh64_intdigest(w, 42)
            hashes = [[digest(w) - ((digest(w) >> 63) << 64) for w in per[d]] if d in per else [] for d in range(len(n))]
            sums = [[zlib.crc32(w) for w in per[d]] if d in per else [] for d in range(len(n))]
            times = [list(per[d].values()) if d in per else [] for d in range(len(n))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("uid"), pa.array(n + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(lm), pa.array(hashes, pa.list_(pa.int64())), pa.array(sums, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))],
                ["doc_id", "uid", "n_tokens", "n_known", "base", "lm", "rare", "crcs", "times"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, uid long, n_tokens long, n_known long, base double, lm double, rare array<long>, crcs array<long>, times array<int>"
    rows = materialise(docs.select("doc_id", "text").withColumn("uid", F.monotonically_increasing_id()).mapInArrow(run, schema))
    rare = rows.select("uid", F.explode(F.arrays_zip("rare", "crcs", "times")).alias("x")).select("uid", F.col("x.rare").alias("h"), F.col("x.crcs").alias("crc"), F.col("x.times").alias("k"))
    found = rare.join(counts, ["h", "crc"], "left").groupBy("uid").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("add"), F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("seen")
    )
    out = rows.drop("rare", "crcs", "times").join(found, "uid", "left")
    add = F.coalesce("add", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), (F.col("base") + add).alias("base_score"), (F.col("lm") + add).alias("score"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are one end token; a null id falls to the side of the empty text's crc32; repeated rows keep their own rows; an empty table gives none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket(F.col("doc_id"), 5) == 1
    corpus, counts = learn(docs.where(~held_out))
    out = score(docs, corpus, counts)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(corpus.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
