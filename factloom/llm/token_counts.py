"""Operator 3: token counts by finite-state tokenizer compilation."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe_trie import BpeTrie
from .common import distinct_spans, slices, table, texts_of
from .splitter import find_words, spaced_machine

TOKENIZER = "byte_bpe_50k.json"
#: Distinct words whose counts a worker remembers between batches, and the longest of them in bytes.
MEMO_WORDS, MEMO_BYTES = 1_000_000, 64


class TokenCounter:
    """Counts tokens of whole texts; remembers the counts of words by their bytes."""

    def __init__(self, path: str) -> None:
        self.bpe = BpeTrie(path)
        self.known: dict[bytes, int] = {}

    def _word_counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        words, back = distinct_spans(data, start, end)
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > MEMO_WORDS:
            self.known, new = {}, words
        if new:
            self.known.update(zip(new, self.bpe.counts(new).tolist()))
        got = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        for w in new:
            if len(w) > MEMO_BYTES:
                del self.known[w]
        return got[back]

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        pieces, owner, special = [], [], np.zeros(len(texts), dtype=np.int64)
        marks = sorted(self.bpe.special, key=len, reverse=True)
        for i, text in enumerate(texts):
            parts = [text.decode("utf-8", "replace")]
            for mark in marks:
                parts = [x for p in parts for x in p.split(mark)]
            special[i] = len(parts) - 1
            parts = [p for p in parts if p]
            pieces += parts
            owner += [i] * len(parts)
        if not pieces:
            return special
        data, start, end, piece = find_words(pieces, spaced_machine(), keep_white=True)
        by_piece = np.bincount(piece, self._word_counts(data, start, end), len(pieces)).astype(np.int64)
        return special + np.bincount(owner, by_piece, len(texts)).astype(np.int64)


@functools.cache
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    The splitting rule of the vocabulary file at ``path`` (byte-level BPE) is a compiled
    transducer over character classes, run in chunks joined by a prefix scan; the words' counts
    come from a trie transducer whose transitions carry emitted-token counts. Strings of special
    tokens inside a text are one token. Null and empty texts have 0 bytes and 0 tokens; repeated
    rows and ids keep their own rows; an empty table gives none. Narrow: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for b in slices(batches):
            texts = texts_of(b.column("text"))
            size, n = np.array([len(t) for t in texts], dtype=np.int64), counter(texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", F.col("text")), public_tokenizers.path(TOKENIZER))
