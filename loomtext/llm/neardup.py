"""SimHash near-duplicates at a similarity of 0.8 over five-word shingles, for corpora.

Four bits of 64 are a similarity of about 0.95 or more; 0.8 is about 15 % of the bits, and only many bits tell
0.8 from 0.7. So a text gets 16 words of 64 bits (1024), and two steps use them:

1. Candidates, by the first four words (256 bits). The first 63 bits of a word are seven boxes of nine bits; the
   28 boxes stand in one ring. Texts meet if two boxes of one word are equal (84 keys of 18 bits). Inside a
   bucket a pair must first pass the ring: from some box on, the differences of 1 to 4 consecutive boxes
   stay within their proportional budgets; then comes the Hamming check of the 256 bits. Its limit lies one and
   a half standard deviations above what 0.8 leaves different, so that few such pairs are missed.
2. Links: inside a component of candidates, texts are linked by the full Hamming check of all 1024 bits, at what
   0.8 leaves different plus half a standard deviation. This needs no index, and each text goes there once.

The index is the one step that is not exact: see ``candidates``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, mix, saved, window_hashes, word_hashes
from .components import connected_components
from .simhash import dealt, groups

WORDS, INDEXED, BOXES, BITS = 16, 4, 7, 9
PAIRS = tuple(combinations(range(BOXES), 2))
SALTS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def budget(similarity: float, words: int = WORDS, spread: float = 0.0) -> int:
    """Bits of ``words`` words in which two sets of equal size and this Jaccard similarity differ on average, plus ``spread`` standard deviations."""
    n, p = 64 * words, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(n * p + spread * math.sqrt(n * p * (1 - p)))


def wide_fingerprint(text: str | None, size: int = 5) -> np.ndarray:
    """``WORDS`` words of bits, set where over half of the shingles' hashes have them.

    Words are as in ``simhash``; fewer words than ``size`` are one shingle; a text without words has zeros.
    """
    h = word_hashes((text or "").encode().translate(LOWER))
    if not len(h):
        return np.zeros(WORDS, np.uint64)
    shingles = window_hashes(h, min(size, len(h)))
    counts, step = np.zeros((WORDS, 64), np.int64), 255 * 64
    for i in range(0, len(shingles), step):
        for k, salt in enumerate(SALTS):
            bits = np.unpackbits(mix(shingles[i : i + step] ^ salt).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whole = len(bits) // 255 * 255
            counts[k] += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(shingles), axis=1, bitorder="little").view(np.uint64)[:, 0]


def ring_linked(x: np.ndarray, max_bits: int, chain: int = 4) -> np.ndarray:
    """Which XORs (rows of the indexed words) pass the pigeonring chain and then the Hamming check.

    The bits beyond the boxes are left out of the ring, which only makes it more lenient.
    """
    n = INDEXED * BOXES
    d = np.stack([np.bitwise_count((x[:, k] >> np.uint64(BITS * b)) & np.uint64((1 << BITS) - 1)) for k in range(INDEXED) for b in range(BOXES)])
    total, viable = d.astype(np.int64), d * n <= max_bits
    for length in range(2, chain + 1):
        total = total + np.roll(d, 1 - length, 0)
        viable &= total * n <= length * max_bits
    at = np.flatnonzero(viable.any(0))
    return at[np.bitwise_count(x[at]).sum(1) <= max_bits]


def within(x: np.ndarray, max_bits: int) -> np.ndarray:
    """Which XORs have at most ``max_bits`` bits: the full Hamming check."""
    return np.flatnonzero(np.bitwise_count(x).sum(1) <= max_bits)


def bucket_links(fps: np.ndarray, ids: np.ndarray, linked: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect a bucket as its pairs would: each found row is linked once, to its finder."""
    left, queue = np.arange(len(ids)), []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        p = queue.pop()
        at = linked(fps[left] ^ fps[p])
        if len(at):
            yield ids[left[at]], np.full(len(at), ids[p])
            queue.extend(left[at])
            left = np.delete(left, at)


def group_links(index: DataFrame, linked: Callable[[np.ndarray], np.ndarray], block: int, small: int = 16) -> DataFrame:
    """(src, dst) that connects the rows (key, fp, f1, ..., id) of each key as ``linked`` does; see ``dealt`` for keys beyond ``block`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, i, j, *words, ids in groups(batches):
            fps, src, dst = np.stack(words, 1).view(np.uint64), [], []
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            size = np.diff(np.append(new, len(key)))
            for at, n in zip(new[size > small].tolist(), size[size > small].tolist()):
                for a, b in bucket_links(fps[at : at + n], ids[at : at + n], linked):
                    src.append(a), dst.append(b)
            f = np.repeat(size, size) <= small
            gid, fps, ids = np.repeat(np.arange(len(new)), size)[f], fps[f], ids[f]
            for step in range(1, small):
                if step >= len(gid) or not (at := np.flatnonzero(gid[step:] == gid[:-step])).size:
                    break
                at = at[linked(fps[at] ^ fps[at + step])]
                src.append(ids[at]), dst.append(ids[at + step])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (src, dst)], names=["src", "dst"])

    return dealt(index, block).mapInArrow(run, "src long, dst long")


def candidates(unique: DataFrame, max_bits: int, block: int = 20_000) -> DataFrame:
    """(src, dst) between ids of different fingerprints (id, f0, f1, ...): two equal boxes in an indexed word, at most ``max_bits`` different bits in these words.

    Every pair that fulfils both is connected. Pairs within ``max_bits`` without two equal boxes in a word are
    not found (README: measured recall).
    """

    def box(k: int, i: int):
        return F.shiftrightunsigned(f"f{k}", BITS * i).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")

    keys = [F.lit((k * len(PAIRS) + p) << 2 * BITS) + F.shiftleft(box(k, a), BITS) + box(k, b) for k in range(INDEXED) for p, (a, b) in enumerate(PAIRS)]
    index = unique.select(F.explode(F.array(*keys)).alias("key"), F.col("f0").alias("fp"), *(f"f{k}" for k in range(1, INDEXED)), "id")
    return group_links(index, lambda x: ring_linked(x, max_bits), block)


def links(unique: DataFrame, similarity: float, spread: float = 1.5, margin: float = 0.5, block: int = 20_000) -> DataFrame:
    """(src, dst) between ids of different fingerprints (id, f0, f1, ...) that connects those within the budget in a component of candidates; ``margin`` is in standard deviations."""
    comp = connected_components(candidates(unique, budget(similarity, INDEXED, spread), block))
    index = unique.join(comp, F.col("id") == F.col("node")).select(F.col("root").alias("key"), F.col("f0").alias("fp"), *(f"f{k}" for k in range(1, WORDS)), "id")
    most = budget(similarity, WORDS, margin)
    return group_links(index, lambda x: within(x, most), block)


def wide_fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([wide_fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(fps[:, k]) for k in range(WORDS))], names=["id", *(f"f{k}" for k in range(WORDS))])

    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    return ids.mapInArrow(run, "id long, " + ", ".join(f"f{k} long" for k in range(WORDS)))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one of each group of near-duplicates: the smallest id's.

    Equal fingerprints fold first. Texts without words are one group. Rows that repeat an id are one
    document, one of them is kept; rows without an id are kept as they are.
    """
    words = [f"f{k}" for k in range(WORDS)]
    unique = saved(wide_fingerprints(docs, id_col, text_col, size).groupBy(*words).agg(F.min("id").alias("id")), "unique")
    comp = connected_components(links(unique, similarity))
    kept = unique.join(comp.where("node <> root"), F.col("id") == F.col("node"), "left_anti").select(F.col("id").alias("__kept"))
    named = docs.where(F.col(id_col).isNotNull()).join(kept, F.col(id_col) == F.col("__kept"), "left_semi").dropDuplicates([id_col])
    return named.unionByName(docs.where(F.col(id_col).isNull()))
