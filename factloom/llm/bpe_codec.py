"""Operator 7: BPE encoding and decoding by prefix-sharing trie traversal."""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .bpe_trie import BpeTrie
from .common import distinct_spans, in_arrow, slices, table, texts_of
from .splitter import dropping_machine, find_words

TOKENIZER = "word_bpe_49k.json"
#: Distinct words, and tokens of them, that a worker remembers between batches, and the longest of these words in bytes.
MEMO_WORDS, MEMO_TOKENS, MEMO_BYTES = 800_000, 4_000_000, 64

#: Tokens whose strings are joined at once, and bytes of text taken at once: places in arrays of both are eight bytes each.
JOINED, SLICE = 1 << 17, 2_000_000


def normalise(text: str) -> str:
    """Composed and lower case letter by letter (no rule for a final sigma); white space only parts words, so it is left."""
    text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()


def spread(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices of the runs starts[i], starts[i] + 1, ... of the given sizes, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


class Spelling:
    """A byte string for each number, laid out so that sequences of numbers are joined in one go."""

    def __init__(self, texts: Sequence[bytes]) -> None:
        self.size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)

    def join(self, tokens: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """For each run of tokens between bounds: the strings, a space between them. Runs are joined in blocks of about JOINED tokens."""
        out: list[bytes] = []
        cuts = np.r_[0, np.searchsorted(bounds, np.arange(JOINED, int(bounds[-1]), JOINED)), len(bounds) - 1]
        for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
            part = tokens[bounds[lo] : bounds[hi]]
            size = self.size[part]
            whole = self.bytes[spread(size, self.start[part])].tobytes()
            at = np.r_[0, np.cumsum(size)][bounds[lo : hi + 1] - bounds[lo]].tolist()
            out += [whole[a : max(a, b - 1)] for a, b in zip(at, at[1:])]
        return out


class Codec:
    """Encodes and decodes with a lower-casing word-end BPE vocabulary file; works on whole batches of texts."""

    def __init__(self, path: str) -> None:
        self.bpe = BpeTrie(path)
        special = sorted(self.bpe.special.items())
        self.special = {mark: len(self.bpe.token_text) + i for i, (mark, _) in enumerate(special)}
        self.vocab_id = np.r_[self.bpe.vocab_id, [i for _, i in special]].astype(np.int64)
        texts = self.bpe.token_text + [m for m, _ in special]
        self.number, self.spelled = Spelling([b"%d" % i for i in self.vocab_id.tolist()]), Spelling([t.encode() for t in texts])
        self.text_of = dict(zip(self.vocab_id.tolist(), texts))
        self.marks = regex.compile("(" + "|".join(regex.escape(m) for m in sorted(self.special, key=len, reverse=True)) + ")")
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.first, self.size, self.pool = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def _places(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where each word's tokens are in the pool; words not yet known are encoded together in one trie."""
        words, back = distinct_spans(data, start, end)
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > MEMO_WORDS or len(self.pool) > MEMO_TOKENS:
            self.forget()
            new = words
        if new:
            flat, size = self.bpe.encode(new)
            self.known.update(zip(new, range(len(self.size), len(self.size) + len(new))))
            self.first = np.r_[self.first, len(self.pool) + np.cumsum(size) - size]
            self.size, self.pool = np.r_[self.size, size], np.r_[self.pool, flat]
        places = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        for w in new:
            if len(w) > MEMO_BYTES:
                del self.known[w]
        return places[back]

    def tokens(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, one after another, and each text's bounds among them."""
        pieces, owner, inserted = [], [], []
        for i, text in enumerate(texts):
            # special strings are found before anything is normalised
            for j, part in enumerate(self.marks.split(text) if "<" in text else [text]):
                if j % 2:
                    inserted.append((len(pieces), self.special[part]))
                pieces.append("" if j % 2 else normalise(part))
                owner.append(i)
        data, start, end, piece = find_words(pieces, dropping_machine(), keep_white=False)
        place = self._places(data, start, end)
        size = self.size[place]
        flat = self.pool[spread(size, self.first[place])]
        by_piece = np.bincount(piece, size, len(pieces)).astype(np.int64)
        if inserted:
            at, token = (np.array(x) for x in zip(*inserted))
            flat = np.insert(flat, (np.cumsum(by_piece) - by_piece)[at], token)
            by_piece[at] += 1
        return flat, np.r_[0, np.cumsum(np.bincount(owner, by_piece, len(texts)).astype(np.int64))]

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        flat, bounds = self.tokens(texts)
        ids, at = self.vocab_id[flat].tolist(), bounds.tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def decode(self, ids: Sequence[int]) -> str:
        """The file names no decoder: tokens as they are spelled, a space between them."""
        return " ".join([self.text_of[i] for i in ids])

    def digest(self, texts: Sequence[str]) -> tuple[np.ndarray, list[str], list[str]]:
        """Token counts, and hashes of the joined ids and of the decoded texts."""
        flat, bounds = self.tokens(texts)
        ids, decoded = ([hashlib.sha256(x).hexdigest() for x in s.join(flat, bounds)] for s in (self.number, self.spelled))
        return np.diff(bounds), ids, decoded


@functools.cache
def _codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and token ids of every whole text; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in slices(batches, most=SLICE):
            ids = codec.encode([t.decode("utf-8", "replace") for t in texts_of(b.column("text"))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded text of (doc_id, ids); null ids decode to empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in batches:
            texts = [codec.decode(ids or []) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts)], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    Distinct words of a batch form a trie; last-token states pass down it, so that a prefix that
    words share is encoded once; texts are put together from the words. Null and empty texts have
    no tokens and the hashes of empty text; repeated rows and ids keep their own rows; an empty
    table gives none. Narrow: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in slices(batches, most=SLICE):
            n, ids, decoded = codec.digest([t.decode("utf-8", "replace") for t in texts_of(b.column("text"))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.forget()  # words of one task would stay in memory through all that the worker does later

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
