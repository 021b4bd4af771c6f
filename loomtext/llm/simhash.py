"""SimHash near-duplicates, candidates pruned by the pigeonring filter.

A 64-bit fingerprint is cut into six boxes that stand in a ring. If two fingerprints differ in at
most ``max_bits`` = 4 bits, at least two boxes are equal, so an index on every pair of boxes (15
keys of 20 to 22 bits) meets every link. Inside a bucket a pair must first pass the ring:
some start box must exist from which the differences of the first 1, 2, 3 boxes stay within
their proportional budgets 4/6, 8/6, 12/6. Only survivors get the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, salted_join, saved
from .components import connected_components

WIDTHS = (11, 11, 11, 11, 10, 10)
SHIFTS = tuple(sum(WIDTHS[:i]) for i in range(6))
PAIRS = tuple(combinations(range(6), 2))
#: Rows of a bucket that are compared in one group.
FEW = 256


def fingerprint(text: str | None, size: int = 4) -> int:
    """Bit b is 1 if set in over half of the XXH64 values (seed 42) of the word shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer words than ``size`` are one
    shingle; null, empty and blank texts have fingerprint 0.
    """
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, counts, step = len(words) - size + 1, np.zeros(64, np.int64), 255 * 256
    for i in range(0, n, step):
        s, e = starts[i : min(i + step, n)].tolist(), ends[i + size - 1 : min(i + step, n) + size - 1].tolist()
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, s, e)), repeat(42)), np.uint64, len(s))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        counts += bits[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, fp bigint) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return ids.mapInArrow(run, f"id {ids.schema['id'].dataType.simpleString()}, fp long")


def ring_linked(x: np.ndarray, max_bits: int = 4, chain: int = 3) -> np.ndarray:
    """Which XORs of two fingerprints pass the pigeonring chain and then the Hamming check."""
    d = [np.bitwise_count((x >> np.uint64(s)) & np.uint64((1 << w) - 1)) for s, w in zip(SHIFTS, WIDTHS)]
    viable = np.zeros(len(x), bool)
    for start in range(6):
        ok, total = d[start] <= max_bits // 6, d[start]
        for length in range(2, chain + 1):
            total = total + d[(start + length - 1) % 6]
            ok &= total <= length * max_bits // 6
        viable |= ok
    at = np.flatnonzero(viable)
    return at[np.bitwise_count(x[at]) <= max_bits]


def bucket_links(fps: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect a bucket as its pairs would: each found fingerprint is linked once, to its finder."""
    left, queue = fps, []
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
        p = queue.pop()
        at = ring_linked(left ^ p, max_bits)
        if len(at):
            found = left[at]
            yield found, np.full(len(found), p)
            queue.extend(found)
            left = np.delete(left, at)
        elif not len(left):
            break


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups only, by the first three columns: the last group of a batch waits for the next batch."""
    rest = None
    for b in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        now = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
        if not len(now[0]):
            continue
        same = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
        cut = len(same) - int(same.sum())
        rest = [x[cut:] for x in now]
        if cut:
            yield [x[:cut] for x in now]
    if rest is not None:
        yield rest


def dealt(index: DataFrame, block: int) -> DataFrame:
    """``index`` (key, fp, ...) with (i, j) after the key, grouped and sorted by the three.

    A bucket beyond ``FEW`` or ``block`` rows is dealt into blocks by fp, and every pair of blocks is a group of its own, so no
    pair is lost. The number of blocks grows with the root of the bucket's rows (and keeps blocks below ``block`` rows), so
    that one large bucket makes many groups, none of which has a large share of it.
    """
    rest = [c for c in index.columns if c != "key"]
    blocks = F.greatest(F.ceil(F.sqrt(F.col("count") / (FEW // 4))), F.ceil(F.col("count") / block))
    hot = index.groupBy("key").count().where(F.col("count") > min(FEW, block)).select("key", blocks.cast("int").alias("nb"))
    index = index.join(hot, "key", "left").withColumn("g", F.when(F.col("nb").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")))
    other = F.when(F.col("nb").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("nb") - 1))
    index = index.withColumn("o", F.explode(other)).select("key", F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"), *rest)
    return index.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def links(fps: DataFrame, max_bits: int = 4, block: int = 20_000, small: int = 16) -> DataFrame:
    """(src, dst) between different fingerprints ``fp`` (distinct) that connects all that link.

    See ``dealt`` for buckets beyond ``block``.
    """
    if max_bits > 4:
        raise ValueError("six boxes leave two equal boxes for at most 4 bits")

    def box(i: int):
        return F.shiftrightunsigned("fp", SHIFTS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1).cast("long"))

    keys = [F.lit(k << 22).cast("long") + F.shiftleft(box(a), 11) + box(b) for k, (a, b) in enumerate(PAIRS)]
    index = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    index = dealt(index, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, i, j, fp in groups(batches):
            fp, src, dst = fp.view(np.uint64), [], []
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            size = np.diff(np.append(new, len(key)))
            for at, n in zip(new[size > small].tolist(), size[size > small].tolist()):
                for a, b in bucket_links(np.unique(fp[at : at + n]), max_bits):
                    src.append(a), dst.append(b)
            gid, f = np.repeat(np.arange(len(new)), size), np.repeat(size, size) <= small
            gid, f = gid[f], fp[f]
            for step in range(1, small):
                if step >= len(gid) or not (at := np.flatnonzero(gid[step:] == gid[:-step])).size:
                    break
                at = at[ring_linked(f[at] ^ f[at + step], max_bits)]
                src.append(f[at]), dst.append(f[at + step])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (src, dst)], names=["src", "dst"])

    return index.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, max_bits: int = 4) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links, itself included.

    Exact fingerprint copies are folded first and never compared. Repeated ids keep a row each;
    a null id never becomes a component's name while another id is there.
    """
    fps = saved(fingerprints(docs, id_col, text_col, size), "fingerprints")
    unique = saved(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("many")), "unique")
    comp = connected_components(links(unique.select("fp"), max_bits))
    named = unique.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    return salted_join(fps, named.join(least, "root").select("fp", "component", "many"), ["fp"], "many", "id").drop("many")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **about) -> DataFrame:
    """The rows of ``docs`` with one of each component: the smallest id's; of rows that repeat this id, one."""
    found = near_duplicates(docs, id_col=id_col, **about)
    kept = found.where(F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias("__kept")).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("__kept")), "left_semi").dropDuplicates([id_col])


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``, repeated ones too; null and blank texts have fingerprint 0 and form one component."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
