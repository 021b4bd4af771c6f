"""Exact repeated passages, by fixed-block anchors.

A window is ``size`` words. Non-overlapping blocks of ``block = (size + 1) // 2`` words of every document are
the anchors: any window holds a whole block of its own document, so if the window repeats anywhere,
that block meets a rolling block-sized window there. Steps:

1. pack: rows are packed into batches of a few MB, one written row each (bucketed by batch).
2. probe: each batch sends, to the owner of each hash range, its sorted different rolling hashes, marked where they are
   anchors; an owner answers with a bitmap of those that are an anchor somewhere and occur at least twice.
3. extend: windows around hit anchors are hashed whole (96 bits) and matched in the same way, which
   keeps exactly the windows whose word sequence starts at two places or more.
4. cut: words covered by such windows go.

Copies fold inside a batch, owners get one entry per hash and batch, and no pairs are made, so
a passage in a third of all documents costs as much as a rare one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, saved, shared_dir, window_hashes, word_hashes

ANSWER = "batch long, part int, bits binary"
ENTRY = "part int, batch long, n int, planes binary"


def pack_planes(columns: list[np.ndarray]) -> bytes:
    """Columns of bytes, plane by plane, compressed: the sorted leading bytes all but vanish."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), 1)


def byte_planes(values: np.ndarray, low: int, high: int) -> list[np.ndarray]:
    """Bytes ``high - 1`` down to ``low`` of unsigned values."""
    return [(values >> np.uint64(8 * i)).astype(np.uint8) for i in range(high - 1, low - 1, -1)]


def unpack_values(planes: np.ndarray) -> np.ndarray:
    out = np.zeros(planes.shape[1], np.uint64)
    for p in planes:
        out = (out << np.uint64(8)) | p.astype(np.uint64)
    return out


def pack(docs: DataFrame, id_col: str, text_col: str, target: int = 4 << 20) -> DataFrame:
    """(batch, n_bytes, blob), written in buckets of ``batch``; the numbers are fixed once written."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seq = TaskContext.get().partitionId() << 32, 0

        def row(parts, n):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parts[0].schema) as w:
                for p in parts:
                    w.write_batch(p)
            blob = zstandard.compress(sink.getvalue().to_pybytes(), 3)
            return pa.RecordBatch.from_arrays([pa.array([first + seq], pa.int64()), pa.array([n], pa.int64()), pa.array([blob], pa.binary())], names=["batch", "n_bytes", "blob"])

        parts, n = [], 0
        for b in batches:
            lengths = [len(x) for x in b.column(1).cast(pa.binary()).to_pylist() if x is not None] if b.column(1).null_count == 0 else [x.as_buffer().size if x.is_valid else 0 for x in b.column(1)]
            at = 0
            for i, m in enumerate(lengths):
                n += m + 16
                if n >= target:
                    parts.append(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(at, i + 1 - at)]) for c in b.columns], names=["id", "text"]))
                    yield row(parts, n)
                    parts, n, at, seq = [], 0, i + 1, seq + 1
            if at < len(lengths):
                parts.append(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(at)]) for c in b.columns], names=["id", "text"]))
        if parts:
            yield row(parts, n)

    spark, name = docs.sparkSession, f"loomtext_{uuid.uuid4().hex}"
    buckets = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = rows.mapInArrow(run, "batch long, n_bytes long, blob binary")
    packed.write.bucketBy(buckets, "batch").option("path", f"{shared_dir(spark)}/packed").option("compression", "uncompressed").format("parquet").saveAsTable(name)
    return spark.table(name)


class Batch:
    """The words of one packed batch and the hashes of its windows."""

    def __init__(self, blob: bytes, size: int):
        table = pa.ipc.open_stream(zstandard.decompress(blob)).read_all()
        self.ids, self.size, self.block = table.column(0).combine_chunks(), size, (size + 1) // 2
        self.texts = [x or b"" for x in table.column(1).cast(pa.binary()).to_pylist()]
        self.hashes, counts, at = [], [], 0
        while at < len(self.texts):
            to, n = at + 1, len(self.texts[at])
            while to < len(self.texts) and n + len(self.texts[to]) < 1 << 19:
                n += len(self.texts[to])
                to += 1
            h = word_hashes(b"\n".join(self.texts[at:to]))
            counts += [len(t.split()) for t in self.texts[at:to]]
            self.hashes.append(h)
            at = to
        self.words = np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)
        self.counts = np.array(counts, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.start = np.repeat(self.first[:-1], self.counts)
        self.end = np.repeat(self.first[1:], self.counts)

    def inside(self, size: int) -> np.ndarray:
        """Where windows of ``size`` words begin that stay in their document."""
        return np.flatnonzero(np.arange(len(self.words)) + size <= self.end)

    def rolling(self):
        """Start, hash and whether it is an anchor, for each rolling window of ``block`` words."""
        at = self.inside(self.block)
        return at, window_hashes(self.words, self.block)[at], (at - self.start[at]) % self.block == 0

    def candidates(self, at: np.ndarray, hit: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Starts of windows that hold a whole hit anchor."""
        mark = np.zeros(len(self.words) + 1, np.int64)
        a = at[hit & anchor]
        np.add.at(mark, np.maximum(a + self.block - self.size, self.start[a]), 1)
        np.add.at(mark, a + 1, -1)
        w = self.inside(self.size)
        return w[np.cumsum(mark)[w] > 0]

    def whole(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = window_hashes(self.words, self.size)[at] if len(at) else np.zeros(0, np.uint64)
        low = window_hashes(self.words, self.size, salt=0x5851F42D4C957F2D)[at] if len(at) else h
        return h, low & np.uint64(0xFFFFFFFF)


def distinct(high: np.ndarray, low: np.ndarray | None = None):
    """Order of the different values, each value's number, how often it occurs."""
    order = np.argsort(high, kind="stable") if low is None else np.lexsort((low, high))
    h = high[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if low is not None:
        new[1:] |= low[order][1:] != low[order][:-1]
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number, np.bincount(number, minlength=int(new.sum()))


def entries(batch: int, bits: int, high: np.ndarray, columns, flags: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per hash range: the planes of the sorted different hashes of a batch."""
    if not len(high):
        return
    part = (high >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    ends = np.append(cut[1:], len(part))
    blobs = [pack_planes([c[a:b] for c in columns] + [flags[a:b]]) for a, b in zip(cut.tolist(), ends.tolist())]
    yield pa.RecordBatch.from_arrays([pa.array(part[cut], pa.int32()), pa.array(np.full(len(cut), batch), pa.int64()), pa.array(ends - cut, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "batch", "n", "planes"])


def answer(rows: DataFrame, low_bytes: int, need_anchor: bool) -> DataFrame:
    """For each (batch, part) the bitmap of its hashes that occur twice or more (and are an anchor somewhere)."""

    def judge(part, got):
        planes = [np.frombuffer(zstandard.decompress(p), np.uint8).reshape(-1, n) for _, n, p in got]
        cut = np.cumsum([n for _, n, _ in got])[:-1]
        width = planes[0].shape[0] - 1 - low_bytes
        high = np.concatenate([unpack_values(p[:width]) for p in planes])
        low = np.concatenate([unpack_values(p[width:-1]) for p in planes]) if low_bytes else None
        flags = np.concatenate([p[-1] for p in planes])
        _, number, _ = distinct(high, low)
        n = int(number.max()) + 1
        often = np.bincount(number, weights=1 + (flags >> 1), minlength=n) >= 2
        if need_anchor:
            often &= np.bincount(number, weights=flags & 1, minlength=n) > 0
        out = [(b, np.packbits(x)) for (b, _, _), x in zip(got, np.split(often[number], cut)) if x.any()]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([part] * len(out), pa.int32()), pa.array([x.tobytes() for _, x in out], pa.binary())], names=["batch", "part", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, got = None, []
        for b in batches:
            for p, i, n, planes in zip(*(c.to_pylist() for c in b.columns)):
                if p != part and got:
                    yield judge(part, got)
                    got = []
                part = p
                got.append((i, n, planes))
        if got:
            yield judge(part, got)

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, ANSWER)


def hits(bits: int, high: np.ndarray, maps) -> np.ndarray:
    """Which of the sorted different hashes of a batch the owners have marked."""
    out, part = np.zeros(len(high), bool), high >> np.uint64(64 - bits)
    for m in maps or ():
        a, b = np.searchsorted(part, [np.uint64(m["part"]), np.uint64(m["part"] + 1)])
        out[a:b] = np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=b - a).astype(bool)
    return out


def with_maps(packed: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """Join a batch with its bitmaps: as many bits as it has hashes, so bounded by the batch."""
    maps = answers.groupBy("batch").agg(F.collect_list(F.struct("part", "bits")).alias(name))
    return packed.join(maps.hint("shuffle_hash"), "batch", "left")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 35) -> DataFrame:
    """(id, n_words, n_removed, kept_text, spans) for every row.

    Words are ``[^\\x20\\x09-\\x0D]+``; a word goes if a window of ``size`` words covers it whose word sequence
    also starts elsewhere, in the same row or another. ``spans`` are the removed runs as
    (first word, end word). Null and empty texts have no words; equal rows are rows of their own.
    """
    packed = pack(docs, id_col, text_col)
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(3, int(total >> 24).bit_length())  # hash ranges: one for each 16 MB of text
    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()

    def anchors(b: Batch):
        at, h, anchor = b.rolling()
        order, number, often = distinct(h)
        return at, h, anchor, order, number, often

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for batch, blob in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                _, h, anchor, order, number, often = anchors(Batch(blob, size))
                flags = np.zeros(len(order), np.uint8)
                flags[number[anchor]] = 1
                high = h[order]
                # 40 bits after the range's own: a chance hit only costs a check in the next step
                yield from entries(batch, bits, high, byte_planes((high << np.uint64(bits)) >> np.uint64(24), 0, 5), flags | ((often > 1) << 1).astype(np.uint8))

    def located(b: Batch, maps):
        at, h, anchor, order, number, _ = anchors(b)
        return b.candidates(at, hits(bits, h[order], maps)[number], anchor)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for batch, blob, maps in zip(*(c.to_pylist() for c in rows.columns)):
                b = Batch(blob, size)
                h, low = b.whole(located(b, maps))
                order, _, often = distinct(h, low)
                yield from entries(batch, bits, h[order], byte_planes(h[order], 0, 8) + byte_planes(low[order], 0, 4), ((often > 1) << 1).astype(np.uint8))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for blob, maps, found in zip(*(c.to_pylist() for c in rows.columns)):
                b = Batch(blob, size)
                gone = np.zeros(len(b.words) + 1, np.int64)
                if maps and found:
                    at = located(b, maps)
                    h, low = b.whole(at)
                    order, number, _ = distinct(h, low)
                    at = at[hits(bits, h[order], found)[number]]
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + size, -1)
                gone = np.cumsum(gone)[:-1] > 0
                kept, spans = [], []
                for i, text in enumerate(b.texts):
                    g = gone[b.first[i] : b.first[i + 1]]
                    w = text.split()
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], g, [False])).astype(np.int8)))
                    spans.append([{"first": s, "end": e} for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist())])
                    kept.append(b" ".join([x for x, y in zip(w, g.tolist()) if not y] if len(edge) else w))
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(b.first[:-1], len(gone))) * (b.counts > 0)
                span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.ids, pa.array(b.counts), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, span)], names=["id", "n_words", "n_removed", "kept_text", "spans"])

    near = saved(answer(packed.select("batch", "blob").mapInArrow(probe, ENTRY), 0, True), "near")
    with_near = with_maps(packed.select("batch", "blob"), near, "near")
    same = saved(answer(with_near.select("batch", "blob", "near").mapInArrow(extend, ENTRY), 4, False), "same")
    both = with_maps(with_near, same, "same")
    return both.select("blob", "near", "same").mapInArrow(cut, f"id {kind}, n_words long, n_removed long, kept_text string, spans array<struct<first:long,end:long>>")


def op4_substring(spark, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``; of repeated rows of 35 words or more nothing is kept. See ``repeated_passages``."""
    out = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: Every start is compared with every other by its window's words; a word goes if one of the 35 starts up to it is met twice.
SQL = {
    "op4_substring": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, len(w) AS n FROM d),
s AS (SELECT r, i, word, CASE WHEN i + 34 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS h FROM t),
m AS (SELECT r, i, word, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS twice FROM s),
c AS (SELECT r, i, word, max(twice::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM m),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""
}
