"""Byte-pair encoding of many distinct words at once, over the trie that they form.

The encoding of a prefix is fixed by its last token: dropping that token leaves the encoding of
the shorter prefix, and a token t may follow the last token p of a prefix exactly if p and t
encode to themselves side by side. So each trie node needs only its last token, found from its
ancestors' last tokens, and a prefix shared by many words is worked out once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import ahocorasick
import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 1 << 21
#: Words of more bytes share too little with others for the trie: each is walked on its own.
LONG = 128
_BESIDES = 1 << 20


class Lookup:
    """A map from 64-bit keys to small ints, probed for whole arrays at a time; -1 if absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 8).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, -1, dtype=np.int32)
        self.probes = 1
        for k, v, s in zip(keys.tolist(), values.tolist(), self._slot(keys).tolist()):
            n = 1
            while self.values[s] >= 0:
                s, n = (s + 1) & self.mask, n + 1
            self.keys[s], self.values[s], self.probes = k, v, max(self.probes, n)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _B) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], -1)
        for p in range(1, self.probes):
            left = np.flatnonzero(out < 0)
            if not len(left):
                break
            s = (slot[left] + p) & self.mask
            out[left] = np.where(self.keys[s] == keys[left], self.values[s], -1)
        return out


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class BpeTrie:
    """Encoder of a byte-level BPE vocabulary file; words end in a marked symbol if it has a word-end suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        model = model["model"]
        suffix = model.get("end_of_word_suffix") or ""
        base = byte_symbols() + [s + suffix for s in byte_symbols()] * bool(suffix)
        self.ends = 256 * bool(suffix)
        number = {s: i for i, s in enumerate(base)}
        left, right, spelled = list(range(len(base))), list(range(len(base))), [(i,) for i in range(len(base))]
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if a + b in number:
                raise ValueError(f"two merges make {a + b!r}")
            left.append(number[a]), right.append(number[b])
            number[a + b] = len(spelled)
            spelled.append(spelled[number[a]] + spelled[number[b]])
        self.left, self.right = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
        self.vocab_id = np.array([model["vocab"][s] for s in number], dtype=np.int64)
        self.token_text = list(number)
        self.n_base, self.longest = len(base), max(map(len, spelled))
        made = np.arange(self.n_base, len(spelled))
        self.pairs = Lookup(self._pair(self.left[made], self.right[made]), made)
        rng = np.random.default_rng(5)
        self.symbol = rng.integers(1, 1 << 63, size=self.n_base, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(self.longest, _B)])
        keys = np.zeros(len(spelled), dtype=np.uint64)
        keys[: self.n_base] = self.symbol
        size = np.array([len(s) for s in spelled])
        with np.errstate(over="ignore"):
            for i in made.tolist():  # the parts come before the whole
                keys[i] = keys[left[i]] * self.power[size[right[i]]] + keys[right[i]]
        stands = np.ones(len(spelled), dtype=bool)
        stands[made] = self._beside(self.left[made], self.right[made], made.copy())
        for i in made.tolist():
            stands[i] &= stands[left[i]] and stands[right[i]]
        self.tokens = Lookup(keys[stands], np.flatnonzero(stands))
        self.standing, self.spelled = stands, spelled
        self.automaton: ahocorasick.Automaton | None = None

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) + np.uint64(1))

    def _beside(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether the tokens a and b stay two tokens when they stand side by side.

        Merges are undone at the border, latest first; if the pieces that then face each other
        would have merged earlier than the merge just undone, the border would not have lasted.
        Of equal merges the left one happens first.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 1 << 40) if limit is None else limit.astype(np.int64)
        ok, live = np.ones(len(a), dtype=bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            merged = self.pairs.get(self._pair(x, y))
            bad = (merged >= 0) & (merged < limit[live])
            ok[live[bad]] = False
            go = ~bad & (np.maximum(x, y) >= self.n_base)
            live, x, y = live[go], x[go], y[go]
            first = x > y
            i, j = live[first], live[~first]
            limit[i], a[i] = x[first], self.right[x[first]]
            limit[j], b[j] = y[~first] + 1, self.left[y[~first]]
        return ok

    def _prepare_walk(self) -> None:
        """The automaton of the tokens that encode to themselves, and the merges by their pairs, for words walked alone."""
        self.automaton = ahocorasick.Automaton()
        for t in np.flatnonzero(self.standing).tolist():
            self.automaton.add_word("".join(map(chr, self.spelled[t])), (t, len(self.spelled[t])))
        self.automaton.make_automaton()
        self.merge = {(a, b): i for i, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist())) if i >= self.n_base}
        self.halves = self.left.tolist(), self.right.tolist()
        self.besides: dict[tuple[int, int], bool] = {}

    def _stay(self, a: int, b: int) -> bool:
        """``_beside`` of one pair, remembered."""
        got = self.besides.get((a, b))
        if got is None:
            x, y, limit, left, right = a, b, 1 << 40, *self.halves
            while (got := self.merge.get((x, y), limit) >= limit) and max(x, y) >= self.n_base:
                if x > y:
                    limit, x = x, right[x]
                else:
                    limit, y = y + 1, left[y]
            if len(self.besides) >= _BESIDES:
                self.besides.clear()
            self.besides[a, b] = got
        return got

    def walk(self, word: bytes) -> list[int]:
        """Tokens of one long word: last-token states passed down its path, candidates for each from the automaton, longest first."""
        if self.automaton is None:
            self._prepare_walk()
        symbols = word.decode("latin-1")
        symbols = symbols[:-1] + chr(ord(symbols[-1]) + self.ends)
        last, size = [-1] * len(word), [0] * len(word)
        for end, (token, k) in self.automaton.iter(symbols):
            if last[end] < 0 and (k > end or self._stay(last[end - k], token)):
                last[end], size[end] = token, k
        out, at = [], len(word) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _grow(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For sorted distinct words: lengths, and by prefix the last token, its length and the tokens so far."""
        n, lens = len(words), np.array([len(w) for w in words])
        width = int(lens.max())
        cells = np.zeros((n, width), dtype=np.int16)
        inside = np.arange(width) < lens[:, None]
        cells[inside] = np.frombuffer(b"".join(words), dtype=np.uint8)
        cells[np.arange(n), lens - 1] += self.ends
        fresh = inside.copy()  # a prefix that the word before has is not new: words are sorted
        same = (cells[1:] == cells[:-1]) & inside[1:] & inside[:-1]
        fresh[1:] &= ~np.logical_and.accumulate(same, axis=1)
        keys = np.zeros((n, width + 1), dtype=np.uint64)
        for i in range(width):
            keys[:, i + 1] = keys[:, i] * _B + self.symbol[cells[:, i]]
        last, size, count = (np.zeros((n, width), dtype=np.int32) for _ in range(3))
        row = np.arange(n)
        for i in range(width):
            todo = np.flatnonzero(fresh[:, i])
            for k in range(1, min(i + 1, self.longest) + 1):
                if not len(todo):
                    break
                token = self.tokens.get(keys[todo, i + 1] - keys[todo, i + 1 - k] * self.power[k])
                found = np.flatnonzero(token >= 0)
                if k <= i and len(found):
                    found = found[self._beside(last[todo[found], i - k], token[found])]
                at = todo[found]
                last[at, i], size[at, i] = token[found], k
                count[at, i] = 1 + (count[at, i - k] if k <= i else 0)
                keep = np.ones(len(todo), dtype=bool)
                keep[found] = False
                todo = todo[keep]
            source = np.maximum.accumulate(np.where(fresh[:, i], row, 0))
            last[:, i], size[:, i], count[:, i] = last[source, i], size[source, i], count[source, i]
        return lens, last, size, count

    def _runs(self, words: Sequence[bytes]):
        """Index blocks of about equal length and bounded size, each sorted."""
        size = np.array([len(w) for w in words], dtype=float)
        classes = np.ceil(np.log2(size))
        for k in np.unique(classes[size <= LONG]):
            order = sorted(np.flatnonzero(classes == k).tolist(), key=words.__getitem__)
            most = max(1, _CELLS >> int(k))
            for start in range(0, len(order), most):
                yield order[start : start + most]

    def counts(self, words: Sequence[bytes]) -> np.ndarray:
        """Token counts of distinct non-empty words: the sum of what the transitions on each word's path emit.

        A transition emits the tokens of its prefix less those of the prefix before, which may be
        negative where a symbol joins earlier tokens. Words over LONG bytes are walked one by one.
        """
        out = np.array([len(self.walk(w)) if len(w) > LONG else 0 for w in words], dtype=np.int64)
        for run in self._runs(words):
            lens, _, _, count = self._grow([words[i] for i in run])
            emitted = np.diff(count, axis=1, prepend=0)
            emitted[np.arange(count.shape[1]) >= lens[:, None]] = 0
            out[run] = emitted.sum(axis=1)
        return out

    def encode(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens (places in ``vocab_id`` and ``token_text``) of distinct non-empty words, one after another, and their numbers."""
        sizes, parts = np.zeros(len(words), dtype=np.int64), []
        for run in self._runs(words):
            lens, last, size, count = self._grow([words[i] for i in run])
            row, at = np.arange(len(run)), lens - 1
            total = count[row, at].astype(np.int64)
            sizes[run] = total
            stop = np.cumsum(total)
            ids, slot = np.zeros(int(stop[-1]), dtype=np.int32), stop - 1
            while len(row):  # back from the last token
                ids[slot] = last[row, at]
                at = at - size[row, at]
                live = at >= 0
                row, at, slot = row[live], at[live], slot[live] - 1
            parts.append((run, stop - total, ids))
        for i in [i for i, w in enumerate(words) if len(w) > LONG]:
            ids = np.array(self.walk(words[i]), dtype=np.int32)
            sizes[i] = len(ids)
            parts.append(([i], np.zeros(1, dtype=np.int64), ids))
        first = np.zeros(len(words), dtype=np.int64)
        base = 0
        for run, start, ids in parts:
            first[run] = base + start
            base += len(ids)
        pool = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, dtype=np.int32)
        before = np.cumsum(sizes) - sizes
        return pool[np.arange(int(sizes.sum())) + np.repeat(first - before, sizes)], sizes
