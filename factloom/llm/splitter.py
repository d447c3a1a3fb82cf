"""Splitting of texts into tokenizer words by compiled finite-state machines."""

from __future__ import annotations

import functools

import numpy as np
import regex

CHUNK = 256

# what a character does, seen with its neighbours
LETTER, NUMBER, OTHER, QUOTE2, QUOTE3, SPACE_LAST, WHITE_LAST, WHITE, RESET = range(9)
# what is open after a character
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)


@functools.cache
def spaced_machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emitted words by (symbol, state) of the byte-level splitting rule.

    The rule: contractions; runs of letters, of numbers or of other characters, each with one
    space before it; white space up to the last before a word; single white space.
    """
    step, emit = np.zeros((9, 8), dtype=np.uint8), np.ones((9, 8), dtype=np.uint8)
    for state in range(8):
        for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
            step[symbol, state], emit[symbol, state] = run, state not in (run, AFTER_SPACE)
        for symbol, following in ((QUOTE2, ONE_MORE), (QUOTE3, TWO_MORE)):
            held = state in (IN_OTHER, AFTER_SPACE)
            step[symbol, state], emit[symbol, state] = (IN_OTHER, 0) if held else (following, 1)
        step[SPACE_LAST, state], step[WHITE_LAST, state], step[WHITE, state] = AFTER_SPACE, FRESH, IN_WHITE
        emit[WHITE, state] = state != IN_WHITE
    for symbol in (LETTER, NUMBER, OTHER):  # only letters follow a contraction's quote
        step[symbol, ONE_MORE], emit[symbol, ONE_MORE] = FRESH, 0
        step[symbol, TWO_MORE], emit[symbol, TWO_MORE] = ONE_MORE, 0
    step[RESET], emit[RESET] = FRESH, 1
    return step, emit


@functools.cache
def dropping_machine() -> tuple[np.ndarray, np.ndarray]:
    """The same for a rule that drops white space: contractions, runs of letters, single numbers, runs of others."""
    step, emit = (x.copy() for x in spaced_machine())
    step[NUMBER, :ONE_MORE] = FRESH
    emit[NUMBER, :ONE_MORE] = 1
    for symbol in (SPACE_LAST, WHITE_LAST, WHITE):
        step[symbol], emit[symbol] = FRESH, 1
    return step, emit


Machine = tuple[np.ndarray, np.ndarray]


@functools.cache
def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, symbol in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"[\p{White_Space}]+", WHITE)):
        for m in regex.finditer(pattern, every):
            shift = 0x800 if m.start() >= 0xD800 else 0
            out[m.start() + shift : m.end() + shift] = symbol
    out[0xD800] = RESET
    return out


def _symbols(points: np.ndarray) -> np.ndarray:
    """Symbols of the machine for code points, each text followed by RESET."""
    out = _classes()[points]
    white = np.flatnonzero(out == WHITE)
    following = out[np.minimum(white + 1, len(out) - 1)]
    last = white[(following != WHITE) & (following != RESET)]
    out[last] = np.where(points[last] == 32, SPACE_LAST, WHITE_LAST)
    quote = np.flatnonzero(points == 39)
    if len(quote):
        padded = np.r_[points, 0xD800, 0xD800]
        a, b = padded[quote + 1], padded[quote + 2]
        two = np.isin(a, [ord(c) for c in "stmd"])
        three = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        out[quote[two]], out[quote[three]] = QUOTE2, QUOTE3
    return out


def word_starts(points: np.ndarray, symbols: np.ndarray, machine: Machine) -> np.ndarray:
    """Where words begin among the code points of texts that each end in RESET.

    Chunks are run from all states at once, which gives each chunk's map of states to states; a
    parallel prefix scan composes the maps, giving each chunk's true first state; a second run
    from it marks the emitting transitions.
    """
    step, emit = machine
    n = -(-len(symbols) // CHUNK)
    grid = np.full(n * CHUNK, RESET, dtype=np.uint8)
    grid[: len(symbols)] = symbols
    grid = np.ascontiguousarray(grid.reshape(n, CHUNK).T)
    flat = step.ravel()
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8)[:, None], (8, n)).copy()
    for row in grid:
        maps = flat[(row.astype(np.intp) * 8) + maps]
    maps = maps.T.copy()
    reach = 1
    while reach < n:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        reach *= 2
    state = np.r_[np.uint8(FRESH), maps[:-1, FRESH]]
    marks, out = np.empty((CHUNK, n), dtype=np.uint8), emit.ravel()
    for i, row in enumerate(grid):
        at = row.astype(np.intp) * 8 + state
        marks[i], state = out[at], flat[at]
    return np.flatnonzero(marks.T.ravel()[: len(symbols)])


def find_words(pieces: list[str], machine: Machine, keep_white: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pieces as UTF-8 bytes, with the words' starts and ends there and the piece of each."""
    points = np.frombuffer(("\ud800".join(pieces) + "\ud800").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    data = np.frombuffer(b"\n".join([p.encode() for p in pieces]) + b"\n", dtype=np.uint8)
    ends = points == 0xD800
    if len(data) == len(points):
        offset = np.arange(len(points) + 1)
    else:
        width = 1 + (points >= 0x80).view(np.uint8) + (points >= 0x800).view(np.uint8) + (points >= 0x10000).view(np.uint8)
        width[ends] = 1
        offset = np.r_[0, np.cumsum(width, dtype=np.int64)]
    symbols = _symbols(points)
    begin = word_starts(points, symbols, machine)
    stop = np.r_[begin[1:], len(points)]
    word = ~ends[begin] if keep_white else np.isin(symbols[begin], (SPACE_LAST, WHITE_LAST, WHITE, RESET), invert=True)
    return data, offset[begin[word]], offset[stop[word]], np.cumsum(ends)[begin[word]]
