"""Operator 5: near-duplicate documents by SuperMinHash, banding, verification and union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import discard, fresh, in_arrow, materialise, mix, slices, small, span_hashes, table, texts_of, words_of
from .components import link

SHINGLE = 5
#: Signature registers, cut into bands of ROWS. A pair with similarity 0.75 shares none of 48 bands of 5 with probability 2e-6.
BANDS, ROWS = 48, 5
#: Registers in all; two bits of each, then a byte, sift a bucket's pairs before their sets are compared.
SKETCH = 384
#: Registers whose two bits may differ before a pair is sifted out: 72 expected at similarity 0.75, standard deviation 7.7.
PLANES_MOST = 105
#: Agreeing bytes below which a pair is sifted out: 288 expected at similarity 0.75, standard deviation 8.5.
SKETCH_LEAST = 254
_BLOCK = 1 << 16
_LAZY = 12


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, sorted within each, and the bounds of each text."""
    data, start, end, n = words_of(texts)
    bounds = np.r_[0, np.cumsum(n)]
    word = span_hashes(data, start, end)
    total = len(word)
    owner = np.repeat(np.arange(len(texts)), n)
    full = np.zeros(max(0, total), dtype=np.uint64)
    for k in range(min(SHINGLE, total)):
        full[: total - k] += word[k:] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
    keep = np.arange(total) + SHINGLE <= bounds[1:][owner] if total else np.zeros(0, dtype=bool)
    many = np.maximum(n - SHINGLE + 1, 0)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    many[short] = 1  # the whole sequence is the only shingle
    at = np.r_[0, np.cumsum(many)]
    hashes = np.zeros(int(at[-1]), dtype=np.uint64)
    single = np.zeros(len(hashes), dtype=bool)
    single[at[short]] = True
    hashes[~single] = mix(full[keep])
    for t in short.tolist():
        hashes[at[t]] = sum(w * pow(0x9E3779B97F4A7C15, k + 2, 1 << 64) for k, w in enumerate(word[bounds[t] : bounds[t + 1]].tolist())) % (1 << 64)
    first = np.ones(len(hashes), dtype=bool)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        hashes[lo:hi].sort()
    first[1:] = hashes[1:] != hashes[:-1]
    first[at[:-1][many > 0]] = True
    return hashes[first], np.r_[0, np.cumsum(first)][at]


def superminhash(hashes: np.ndarray, bounds: np.ndarray, registers: int) -> np.ndarray:
    """SuperMinHash signatures (sets x registers) of the sets between bounds.

    Each element deals its ranks 0, 1, 2, ... to the registers in the order of its own random
    permutation, made by swaps as far as it is needed; a register keeps the least rank plus
    fraction. All elements of a block take one rank a step; sets whose registers all hold a value
    below the step are done, since no later rank can lower them.
    """
    sets = len(bounds) - 1
    sig = np.full((sets, registers), np.inf)
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    flat = sig.ravel()
    for lo in range(0, len(hashes), _BLOCK):
        live = np.arange(lo, min(lo + _BLOCK, len(hashes)))
        chosen: list[np.ndarray] = []  # swaps so far: places, and the values put there
        moved: list[np.ndarray] = []
        perm = None
        for j in range(registers):
            of = owner[live]
            ids = of[np.r_[True, of[1:] != of[:-1]]]
            done = np.zeros(sets, dtype=bool)
            done[ids] = sig[ids].max(axis=1) < j
            if done.any():
                keep = ~done[of]
                live = live[keep]
                chosen, moved, perm = [x[keep] for x in chosen], [x[keep] for x in moved], None if perm is None else perm[keep]
            if not len(live):
                break
            draw = mix(hashes[live] + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64)))
            k = (j + ((draw >> np.uint64(32)) * np.uint64(registers - j) >> np.uint64(32))).astype(np.int32)
            if perm is None and j == _LAZY:  # few sets are this small: hold their permutations whole
                row = np.arange(len(live))
                perm = np.broadcast_to(np.arange(registers, dtype=np.int32), (len(live), registers)).copy()
                for place, value in zip(chosen, moved):
                    perm[row, place] = value
                chosen, moved = [], []
            if perm is None:
                at, here = k.copy(), np.full(len(live), j, dtype=np.int32)
                for place, value in zip(chosen, moved):
                    at, here = np.where(place == k, value, at), np.where(place == j, value, here)
                chosen.append(k), moved.append(here)
            else:
                row = np.arange(len(live))
                at = perm[row, k]
                perm[row, k] = perm[:, j]
            np.minimum.at(flat, owner[live] * registers + at, j + (draw & np.uint64(0xFFFFFFFF)).astype(np.float64) / 4294967296.0)
    return sig


def _keys(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys, two planes of bits and sketch words of signatures."""
    bits = mix(np.ascontiguousarray(sig).view(np.uint64))
    band = np.zeros((len(sig), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        band = mix(band + bits[:, r : BANDS * ROWS : ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    planes = [np.packbits((bits >> np.uint64(at) & np.uint64(1)).astype(np.uint8), axis=1) for at in (17, 18)]
    sketch = np.ascontiguousarray((bits >> np.uint64(17)).astype(np.uint8)).view(np.int64)
    return band.view(np.int64), np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64), sketch


SIGNED = "doc_id long, key long, n long, set_a long, set_b long, bands array<long>, planes array<long>, sketch array<long>"


def row_key() -> Column:
    """What tells rows apart: a hash of id and text, so that null and repeated ids have their own."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key, set size n, two hashes that identify the set, band keys and sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hashes, bounds = shingle_sets(texts_of(b.column("text")))
            n = np.diff(bounds)
            prefix = np.zeros((2, len(hashes) + 1), dtype=np.uint64)
            np.cumsum(hashes, out=prefix[0, 1:])
            np.cumsum(mix(hashes + np.uint64(99)), out=prefix[1, 1:])
            whole = (prefix[:, bounds[1:]] - prefix[:, bounds[:-1]]).view(np.int64)
            bands, planes, sketch = _keys(superminhash(hashes, bounds, SKETCH))
            cut = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(n, pa.int64()), pa.array(whole[0]), pa.array(whole[1]), cut(bands), cut(planes), cut(sketch)], ["doc_id", "key", "n", "set_a", "set_b", "bands", "planes", "sketch"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), row_key().alias("key"), "text"), run, SIGNED)


def sets_of(docs: DataFrame) -> DataFrame:
    """key and the sorted shingle hashes of every document of ``docs`` (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hashes, bounds = shingle_sets(texts_of(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(bounds.astype(np.int32), hashes.view(np.int64))], ["key", "set"])

    return in_arrow(docs.select("key", "text"), run, "key long, set array<long>")


def near(x: str, y: str) -> Column:
    """Sizes that allow similarity 0.75, and few enough differing registers (all but 3e-5 of pairs at 0.75, fewer above).

    Kept small: the JVM does not compile the loop of a join whose condition grows beyond some thousand bytes of code.
    """

    def word(i: int) -> Column:
        return F.get(F.col(f"{x}.planes"), F.lit(i)).bitwiseXOR(F.get(F.col(f"{y}.planes"), F.lit(i)))

    plane = SKETCH // 64
    fair = F.least(f"{x}.n", f"{y}.n") * 100 >= F.greatest(f"{x}.n", f"{y}.n") * 75
    return fair & (sum(F.bit_count(word(i).bitwiseOR(word(plane + i))) for i in range(plane)) <= PLANES_MOST)


def alike(x: str, y: str) -> Column:
    """Enough agreeing bytes; for the few pairs that ``near`` leaves, as a fold that adds little code to the condition."""
    ones = F.lit(0x0101010101010101)

    def differing(z: Column) -> Column:
        for shift in (4, 2, 1):  # the lowest bit of each byte becomes whether any bit is set
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(ones))

    words = F.zip_with(F.col(f"{x}.sketch"), F.col(f"{y}.sketch"), lambda a, b: a.bitwiseXOR(b))
    return F.aggregate(words, F.lit(0), lambda n, z: n + differing(z)) <= SKETCH - SKETCH_LEAST


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, key, n, component and kept of every row; see ``near_duplicates``."""
    signed = materialise(signatures(docs))
    filled = signed.where("n > 0")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_a", "set_b", F.when(F.col("doc_id").isNull(), F.col("key")).alias("key"))
    groups = materialise(filled.groupBy("set_a", "set_b", "n").agg(F.min("key").alias("rep"), F.min(first).alias("first")))
    reps = filled.join(groups.select(F.col("rep").alias("key")), "key", "left_semi").dropDuplicates(["key"])
    posts = reps.select(F.col("key").alias("id"), F.explode("bands").alias("bucket"))
    attributes = reps.select(F.col("key").alias("id"), "n", "planes", "sketch")
    keyed = docs.select(row_key().alias("key"), "text")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs)
        needed = materialise(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct())
        sets = materialise(sets_of(keyed.join(small(needed), "key", "left_semi")).dropDuplicates(["key"]))
        a, b = sets.select(F.col("key").alias("a"), F.col("set").alias("sa")), sets.select(F.col("key").alias("b"), F.col("set").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        out = materialise(pairs.join(a, "a").join(b, "b").where(both * 100 >= (F.size("sa") + F.size("sb") - both) * 75).select("a", "b"))
        discard(pairs, needed, sets)
        return out

    roots = link(posts, attributes, near, verify, alike)
    named = materialise(groups.join(roots, F.col("rep") == F.col("node"), "left").select("set_a", "set_b", "n", "first", F.coalesce("root", "rep").alias("root")))
    keepers = named.groupBy("root").agg(F.min("first").alias("keep"))
    named = named.drop("first").join(keepers, "root").select("set_a", "set_b", "n", "keep")
    out = signed.select("doc_id", "key", "n", "set_a", "set_b").join(named, ["set_a", "set_b", "n"], "left")
    kept = F.col("keep").isNull() | first.eqNullSafe(F.col("keep"))
    return out.select("doc_id", "key", "n", F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("component"), kept.alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked when 100 * |A & B| >= 75 * |A | B| over their sets of distinct 5-word
    shingles. Equal sets are one class from the start. Band buckets of SuperMinHash signatures
    give candidates (see ``components.link`` for how few of a bucket's pairs are needed); every
    link used is confirmed on the full sets, which are worked out again for candidates only.

    component_id is the smallest id of the component, and that document is kept; if all ids of a
    component are null, component_id is null and one text of it is kept. Null and blank texts
    have an empty set, link with nothing and are kept; texts of fewer than five words are one
    shingle; rows with the same id count as one document if their sets agree, else as several,
    of which one component keeps one; rows that repeat id and text fare alike; an empty table
    gives no rows.
    """
    return _marked(docs).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps; of rows without an id and with one text, one."""
    key, one = fresh(docs, "__key", "__one")
    kept = _marked(docs).where("kept").select(F.col("key").alias(key), (F.col("doc_id").isNull() & (F.col("n") > 0)).alias(one)).distinct()
    rows = docs.withColumn(key, row_key())
    if docs.where(F.col("doc_id").isNull()).isEmpty():
        return rows.join(kept, key, "left_semi").drop(key)
    rows = rows.join(kept, key)
    return rows.where(~F.col(one)).unionByName(rows.where(F.col(one)).dropDuplicates([key])).drop(key, one)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
