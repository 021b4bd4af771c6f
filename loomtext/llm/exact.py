"""Exact duplicates through an extendible-hash index kept in shared files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, saved


class Bucket:
    __slots__ = ("chains", "depth", "prefix")

    def __init__(self, depth: int, prefix: int):
        self.depth, self.prefix, self.chains = depth, prefix, {}


class ExtendibleIndex:
    """Directory of buckets, addressed by the low bits of a key; an overfull bucket is split.

    When a bucket that is to be split already uses all bits of the directory, the directory
    doubles. A key's entries form a chain: an entry is [bytes, keep, size], and bytes decide equality, so
    different texts of one key stay apart. ``close`` puts digests in place of a finished key's bytes.
    """

    def __init__(self, capacity: int = 64):
        self.capacity, self.depth, self.slots = capacity, 0, [Bucket(0, 0)]

    def add(self, key: int, value: bytes, keep, size: int) -> None:
        bucket = self.slots[key & ((1 << self.depth) - 1)]
        chain = bucket.chains.setdefault(key, [])
        for entry in chain:
            if entry[0] == value:
                entry[1] = keep if entry[1] is None else entry[1] if keep is None else max(entry[1], keep)
                entry[2] += size
                return
        chain.append([value, keep, size])
        while len(bucket.chains) > self.capacity and bucket.depth < 64:
            self.split(bucket)
            bucket = self.slots[key & ((1 << self.depth) - 1)]

    def close(self, key: int) -> None:
        for entry in self.slots[key & ((1 << self.depth) - 1)].chains[key]:
            entry[0] = hashlib.sha256(entry[0]).hexdigest()

    def split(self, bucket: Bucket) -> None:
        if bucket.depth == self.depth:
            self.slots, self.depth = self.slots * 2, self.depth + 1
        bit = 1 << bucket.depth
        halves = Bucket(bucket.depth + 1, bucket.prefix), Bucket(bucket.depth + 1, bucket.prefix | bit)
        for key, chain in bucket.chains.items():
            halves[bool(key & bit)].chains[key] = chain
        for i in range(bucket.prefix, len(self.slots), bit):
            self.slots[i] = halves[bool(i & bit)]

    def entries(self) -> Iterator[tuple]:
        """(depth, prefix, key, chain position, bytes, keep, size) of every entry, bucket by bucket."""
        for bucket in {id(b): b for b in self.slots}.values():
            for key, chain in bucket.chains.items():
                for n, (value, keep, size) in enumerate(chain):
                    yield bucket.depth, bucket.prefix, key, n, value, keep, size


def signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 64, owners: int | None = None, per_owner: int = 200_000) -> DataFrame:
    """The index, written to the shared folder: one row per different text.

    Each batch folds its own copies first (by bytes), so a hot text sends one entry per
    batch; the entries go to the owner of their key range, who builds the buckets of that range. They come sorted by key
    (Spark's sort spills), so an owner holds the bytes of one key at a time and digests of the rest. There is an owner for
    each ``per_owner`` rows, or twice as many as shuffle partitions if that is more.
    """
    spark = docs.sparkSession
    if owners is None:
        owners = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // per_owner)
    bits = max(3, (owners - 1).bit_length())
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[bytes, list] = {}
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                entry = found.setdefault(t, [i, 0])
                entry[0] = i if entry[0] is None else entry[0] if i is None else max(entry[0], i)
                entry[1] += 1
            keys = [xxhash.xxh64_intdigest(t) for t in found]
            for at in range(0, len(keys), 1024):
                texts, entries = list(found)[at : at + 1024], list(found.values())[at : at + 1024]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k >> (64 - bits) for k in keys[at : at + 1024]], pa.int32()), pa.array([signed(k) for k in keys[at : at + 1024]], pa.int64()), pa.array(texts, pa.binary()), pa.array([e[0] for e in entries], b.column(0).type), pa.array([e[1] for e in entries], pa.int64())],
                    names=["owner", "key", "value", "keep", "size"],
                )

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, index, kept, last = None, None, None, None

        def flush():
            index.close(last)
            cols = list(zip(*((owner, d, signed(p), signed(k), n, v, keep, size) for d, p, k, n, v, keep, size in index.entries())))
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), kept, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["owner", "depth", "prefix", "key", "chain", "sha256", "keep", "size"])

        for b in batches:
            kept = b.column(3).type
            for o, k, v, keep, size in zip(*(c.to_pylist() for c in b.columns)):
                if o != owner:
                    if index is not None:
                        yield flush()
                    owner, index, last = o, ExtendibleIndex(capacity), None
                k %= 1 << 64
                if last is not None and k != last:
                    index.close(last)
                last = k
                index.add(k, v, keep, size)
        if index is not None:
            yield flush()

    entries = rows.mapInArrow(fold, f"owner int, key long, value binary, keep {kind}, size long")
    # key ranges that overfill an owner are its own buckets only; the range count follows the cluster's setting
    dealt = entries.repartition("owner").sortWithinPartitions("owner", "key")
    return saved(dealt.mapInArrow(own, f"owner int, depth int, prefix long, key long, chain int, sha256 string, keep {kind}, size long"), "index")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 64) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row; null text counts as empty.

    Of equal texts the largest id stays; rows that repeat this id are all marked kept. Chains
    are told apart by digest when rows look up their entry; the entry itself was made by comparing bytes.
    """
    index = build_index(docs, id_col, text_col, capacity)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([signed(xxhash.xxh64_intdigest(v)) for v in values], pa.int64()), pa.array([hashlib.sha256(v).hexdigest() for v in values])], names=["id", "key", "sha256"])

    looked = rows.mapInArrow(keyed, f"id {kind}, key long, sha256 string")
    out = salted_join(looked, index.select("key", "sha256", "keep", "size"), ["key", "sha256"], "size", "id")
    return out.select("id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha256").alias("text_sha256"))


def op8_exact(spark, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``; null and empty texts are one group. See ``exact_duplicates``."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


SQL = {
    "op8_exact": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents""",
}
