"""Quality classifier: a factorisation machine over hashed words, structure statistics and length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, crc_mod, word_hashes

BITS, RANK = 14, 8
STATS, BINS = 14, 16
WIDTH = (1 << BITS) + STATS * BINS + STATS
_ASCII = np.zeros((5, 256), bool)
_ASCII[0, 65:91] = True  # upper case
_ASCII[1, 48:58] = True  # digits
_ASCII[2, list(b".,;:'\"()-")] = True  # usual punctuation
_ASCII[3, list(b"!?#$%&*|@<>{}[]=/\\^~_+`")] = True  # other marks
_ASCII[4, list(b" \t\n\x0b\x0c\r")] = True


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: hashed words (length 1), statistics, and one bin of each statistic."""
    raw = (text or "").encode()
    a = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(a, minlength=256) if len(a) else np.zeros(256, np.int64)
    share = [float(kinds[m].sum()) / max(1, len(a)) for m in _ASCII]
    words = word_hashes(raw.translate(LOWER))
    bucket, counts = np.unique(words & np.uint64((1 << BITS) - 1), return_counts=True)
    lines = raw.split(b"\n")
    n = len(words)
    sure = 1 if n >= 20 else n / 20  # a share over few words says little
    stats = np.array([
        *share, np.log1p(len(a)) / 12, np.log1p(n) / 10, min(1.0, len(a) / max(1, n) / 20), sure * (1 - len(np.unique(words)) / max(1, n)),
        1 - len(set(lines)) / len(lines), min(1.0, n / len(lines) / 100), float(counts.max()) / n if n else 0.0, float(kinds[195:].sum()) / max(1, len(a)),
        min(1.0, float(kinds.max()) / max(1, len(a))),
    ])
    bins = np.minimum((np.sqrt(np.clip(stats, 0, 1)) * BINS).astype(np.int64), BINS - 1) + np.arange(STATS) * BINS + (1 << BITS)
    v = 1 + np.log(counts) if n else np.zeros(0)
    v = v / max(1e-9, float(np.sqrt(v @ v))) if n else v
    at = np.concatenate((bucket.astype(np.int64), bins, np.arange(STATS) + (1 << BITS) + STATS * BINS))
    return at, np.concatenate((v, np.full(STATS, 0.5), stats)).astype(np.float64)


def margin(at: np.ndarray, x: np.ndarray, model) -> float:
    """w0 + w.x + all pairwise interactions, in linear time: half the sum of (sum)^2 - sum of squares."""
    w0, w, v = model
    vx = x @ v[at]
    return float(w0 + x @ w[at] + 0.5 * (vx @ vx - np.sum((x * x) @ (v[at] * v[at]))))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows, epochs: int = 6, rate: float = 0.1, l2: float = 1e-4, seed: int = 3):
    """AdaGrad on log loss over (at, x, label)."""
    rng = np.random.default_rng(seed)
    w0, g0, w, gw = 0.0, 1e-8, np.zeros(WIDTH), np.full(WIDTH, 1e-2)
    v, gv = rng.normal(0, 0.03, (WIDTH, RANK)), np.full((WIDTH, RANK), 1e-2)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            va = v[at]
            vx = x @ va
            z = w0 + x @ w[at] + 0.5 * (vx @ vx - np.sum((x * x) @ (va * va)))
            g = float(sigmoid(z)) - y
            g0 += g * g
            w0 -= rate * g / np.sqrt(g0)
            d = g * x + l2 * w[at]
            gw[at] += d * d
            w[at] -= rate * d / np.sqrt(gw[at])
            d = g * (x[:, None] * vx - va * (x * x)[:, None]) + l2 * va
            gv[at] += d * d
            v[at] = va - rate * d / np.sqrt(gv[at])
    return w0, w, v


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_per_class: int = 2500):
    """The machine, fitted on about ``sample_per_class`` labelled rows of each class, chosen by a hash of the id.

    Of several labels of an id the largest counts; null labels and labels without a document are left out, and rows that repeat an id
    are rows of their own. Without labels of both classes, the model gives the share of label 1 (or one half) to all. The mean of the training margin
    is moved so that scores follow the share of label 1 among all labels.
    """
    named = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    sizes = {r["y"]: r["count"] for r in named.groupBy("y").count().collect()}
    total = sum(sizes.values())
    if not sizes.get(0) or not sizes.get(1):
        share = np.clip(sizes.get(1, 0) / total if total else 0.5, 1e-3, 1 - 1e-3)
        return float(np.log(share / (1 - share))), np.zeros(WIDTH), np.zeros((WIDTH, RANK))
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))
    most = {y: min(1 << 30, int(sample_per_class / sizes[y] * (1 << 30)) + 1) for y in (0, 1)}
    chosen = named.where(draw < F.when(F.col("y") == 1, most[1]).otherwise(most[0])).withColumn("draw", draw)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, y, d in zip(b.column(0), b.column(1), b.column(2)):
                at, x = features(t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.list_(pa.int32())), pa.array([x], pa.list_(pa.float32())), pa.array([y.as_py()], pa.int32()), pa.array([d.as_py()], pa.int64())], names=["at", "x", "y", "draw"])

    got = sample.select("text", "y", "draw").mapInArrow(run, "at array<int>, x array<float>, y int, draw long").toArrow()
    order = np.lexsort((got["y"].to_numpy(), got["draw"].to_numpy()))
    at, x, y = (got[c].combine_chunks() for c in ("at", "x", "y"))
    rows = [(at[i].values.to_numpy().astype(np.int64), x[i].values.to_numpy().astype(float), float(y[i].as_py())) for i in order.tolist()]
    w0, w, v = train(rows)
    if rows:  # classes were drawn alike; give the odds back
        drawn = {k: sum(r[2] == k for r in rows) for k in (0, 1)}
        w0 += np.log(sizes[1] / sizes[0]) - np.log(max(1, drawn[1]) / max(1, drawn[0]))
    return float(w0), w, v


def score(docs: DataFrame, model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: 0 to 1, higher if label 1 is likelier; null and empty texts have one too.

    Rows are scored one by one, so rows that repeat or share an id keep one each, and an empty table gives no rows. A column
    that is called ``out`` already is replaced, all others pass through.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model[0], model[1].astype(np.float32), model[2].astype(np.float32)))
    rows = docs.withColumn("__text", F.col(text_col).cast("string"))
    schema = docs.drop(out).withColumn(out, F.lit(0.5)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for b in batches:
            p = [float(sigmoid(margin(*features(t.as_py()), model))) for t in b.column(b.num_columns - 1)]
            kept = [(n, c) for n, c in zip(b.schema.names[:-1], b.columns[:-1]) if n != out]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(p, pa.float64())], names=[*(n for n, _ in kept), out])

    return rows.mapInArrow(run, schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``, repeated ones too; ``held_out`` is null where doc_id is. For odd texts and labels see ``score`` and ``fit``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", 3) != 1)
    # the score only needs the text: rows carry their id
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
