"""Token ids as binary shards: fixed-size id blocks, byte planes, zstandard, a block index.

Shard layout, little-endian: ``LTS1``, u32 block size, u32 blocks, u32 documents, u64 ids; then for each block u32 ids
and four u32 plane lengths; then u32 tokens of each document; then the planes, block by block. Plane 0 has
the lowest bytes. A shard ends with a document, so it can be read alone; block k is found from the index.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import process_cache, saved

MAGIC, HEAD = b"LTS1", "<4sIIIQ"
HEAD_SIZE = struct.calcsize(HEAD)
#: Texts of these characters need no Unicode normalisation and lower-case letter by letter.
SIMPLE = re.compile("[\t\n\r -~À-ÖØ-öø-įı-ſ]*")
#: The tokenizer's own split, for lower-cased texts of these characters.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\\sa-z0-9ß-öø-ſ]+")


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letters: printable Latin-1 bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """``encode(text, add_special_tokens=False)`` of a word-end BPE file, each different piece encoded once.

    White space and the file's split pattern bound what BPE sees, so a text's ids are its pieces' ids
    in order. Texts beyond :data:`SIMPLE`, or with a special token, go through the library whole. The cache
    is emptied when it has ``most`` pieces.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.cache = Tokenizer.from_file(path), most, {}
        self.letters, self.model = byte_letters(), self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        probe = "It's a test, ABC d'une école 42!!"
        self.splits = self.pieces(probe) == self.whole(probe)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pieces(self, text: str) -> bytes:
        cache, out = self.cache, []
        for piece in PIECE.findall(text.lower()):
            ids = cache.get(piece)
            if ids is None:
                if len(cache) >= self.most:
                    cache.clear()
                spelled = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
                ids = cache[piece] = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
            out.append(ids)
        return b"".join(out)

    def __call__(self, text: str) -> np.ndarray:
        simple = self.splits and SIMPLE.fullmatch(text) and not ("<|" in text and any(s in text for s in self.special))
        return np.frombuffer(self.pieces(text) if simple else self.whole(text), "<u4")


def encoder(path: str) -> WordEncoder:
    known = process_cache("tokenizers")
    if path not in known:
        known[path] = WordEncoder(path)
    return known[path]


def write_shard(documents: list[np.ndarray], block: int = 1 << 16, level: int = 1) -> bytes:
    ids = np.concatenate([*documents, np.zeros(0, "<u4")]).astype("<u4")
    index, planes = [], []
    press = zstandard.ZstdCompressor(level=level)
    for at in range(0, len(ids), block):
        part = ids[at : at + block]
        shuffled = np.ascontiguousarray(part.view(np.uint8).reshape(-1, 4).T)
        packed = [press.compress(p.tobytes()) for p in shuffled]
        index.append(struct.pack("<5I", len(part), *map(len, packed)))
        planes += packed
    lengths = np.array([len(d) for d in documents], "<u4").tobytes()
    return b"".join([struct.pack(HEAD, MAGIC, block, len(index), len(documents), len(ids)), *index, lengths, *planes])


def shard_index(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index rows, tokens of each document, offset where each block's planes begin)."""
    magic, _, blocks, documents, _ = struct.unpack_from(HEAD, blob)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    index = np.frombuffer(blob, "<u4", 5 * blocks, HEAD_SIZE).reshape(-1, 5).astype(np.int64)
    lengths = np.frombuffer(blob, "<u4", documents, HEAD_SIZE + 20 * blocks).astype(np.int64)
    start = HEAD_SIZE + 20 * blocks + 4 * documents
    return index, lengths, start + np.concatenate(([0], np.cumsum(index[:, 1:].sum(1))))


def read_block(blob: bytes, k: int) -> np.ndarray:
    index, _, at = shard_index(blob)
    n, at, out = int(index[k, 0]), int(at[k]), np.empty((4, int(index[k, 0])), np.uint8)
    for plane, size in enumerate(index[k, 1:].tolist()):
        out[plane] = np.frombuffer(zstandard.decompress(blob[at : at + size], n), np.uint8)
        at += size
    return np.ascontiguousarray(out.T).reshape(-1).view("<u4")


def read_shard(blob: bytes) -> list[np.ndarray]:
    index, lengths, _ = shard_index(blob)
    ids = np.concatenate([*(read_block(blob, k) for k in range(len(index))), np.zeros(0, "<u4")]).astype("<u4")
    return np.split(ids, np.cumsum(lengths)[:-1]) if len(lengths) else []


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, block: int = 1 << 16, shard: int = 1 << 20) -> DataFrame:
    """Encode every text and write shards, in ascending id order, to the shared folder.

    Returns the written table (part, shard, n_ids, ids array, blob): rows ordered by (part, shard) hold all
    documents in order. Null text is empty, and every document ends with ``end_id``; a null id comes first, equal ids are
    ordered by text. ``tokenizer`` must be a path that executors have.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4")
        held, ids, n, number, part, kept = [], [], 0, 0, None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([n], pa.int64()), pa.array([ids], pa.list_(kept)), pa.array([write_shard(held, block)], pa.binary())], names=["part", "shard", "n_ids", "ids", "blob"])

        for b in batches:
            kept = b.column(0).type
            for i, text, part in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                one = np.concatenate([encode(text.as_py()), end])
                held.append(one), ids.append(i)
                n += len(one)
                if n >= shard:
                    yield row()
                    held, ids, n, number = [], [], 0, number + 1
        if held:
            yield row()

    return saved(rows.mapInArrow(run, f"part int, shard int, n_ids long, ids array<{kind}>, blob binary"), "tokens")


def read_tokens(shards: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, decoded from the shards."""
    kind = shards.schema["ids"].dataType.elementType.simpleString()
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    # one row per written part: the only list that is summed in one place
    parts = parts.select(F.col("part"), (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("part_start"))
    at = shards.select("part", "shard", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")).alias("shard_start"))
    at = at.join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, shard, ids, blob in zip(*(c.to_pylist() for c in b.columns)):
                documents = read_shard(blob)
                sizes = np.array([len(d) for d in documents], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array([shard] * len(ids), pa.int32()), pa.array(ids, b.schema.field("ids").type.value_type), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array([zlib.crc32(d.tobytes()) for d in documents], pa.int64())], names=["part", "shard", "id", "inner_start", "n_tokens", "ids_crc32"])

    out = shards.select("part", "shard", "ids", "blob").mapInArrow(run, f"part int, shard int, id {kind}, inner_start long, n_tokens long, ids_crc32 long")
    return out.join(at, ["part", "shard"]).select("id", (F.col("first") + F.col("inner_start")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_tokens(spark, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``, repeated ones too; a null or empty text is its end id alone. See ``write_tokens``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_tokens(write_tokens(docs, default_tokenizer())).withColumnRenamed("id", "doc_id")
