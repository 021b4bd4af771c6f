"""Shared pieces of the corpus operators: shared folders, packed rows, word hashing."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import saved, shared_dir  # noqa: F401

SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_WIN = 0xC2B2AE3D27D4EB4F | 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True


def process_cache(name: str) -> dict:
    """A dict that lives as long as this Python process, and is never shipped with a task."""
    return sys.__dict__.setdefault("_loomtext_cache", {}).setdefault(name, {})


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; the contract's fold."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], many: str, id_col: str, hot: int = 20_000, most: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has each key once and the number of its rows in ``many``.

    A key with over ``hot`` rows (or the ``most``-th part of all, if that is more) is dealt over several joins by the id's hash. At most
    ``most`` keys can be that frequent, so their list is broadcast whatever the table's size.
    """
    total = table.agg(F.sum(many)).first()[0] or 0
    limit = max(hot, total // most)
    parts = F.ceil(F.col(many) / limit).cast("int")
    if not total > limit:
        return rows.join(table, on)
    salts = table.where(F.col(many) > limit).select(*on, parts.alias("__parts"))
    rows = rows.join(F.broadcast(salts), on, "left").withColumn("__salt", F.pmod(F.xxhash64(id_col), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    dealt = F.when(F.col(many) > limit, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    return rows.join(table.withColumn("__salt", F.explode(dealt)), [*on, "__salt"]).drop("__salt")


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n; the tables grow by doubling."""
    tables = process_cache("powers")
    have = tables.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(12, int(n + 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        have = (out[0], out[1])
        if size > 1 << 23:
            return have
        tables[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where the words ``[^\\x20\\x09-\\x0D]+`` start and end."""
    a = np.frombuffer(buf, np.uint8)
    inside = np.empty(len(a) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~_IS_SPACE[a]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(buf: bytes, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word of ``buf``, in order; works in blocks of about ``step`` bytes."""
    starts, ends = word_spans(buf)
    if not len(starts):
        return np.zeros(0, np.uint64)
    out, a, i = [], np.frombuffer(buf, np.uint8), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = powers(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((a[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        i = j
    return np.concatenate(out)


def window_hashes(h: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` consecutive values of ``h``."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out, step, i, n = [], 1 << 20, 0, len(h) - size + 1
    h = mix(h + np.uint64(salt)) if salt else h
    while i < n:
        part = h[i : min(i + step, n) + size - 1]
        up, down = powers(len(part), _WIN)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        out.append(mix((total[size:] - total[:-size]) * down[: len(part) - size + 1]))
        i += step
    return np.concatenate(out)
