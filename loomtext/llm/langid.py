"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader (FTRL-proximal, elastic net) on a bounded sample of labelled
rows; inverse document frequencies come from all labelled rows. A held-back fifth of the sample
sets the temperature.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

BITS, ORDERS = 14, (1, 2, 3)
ALPHA = re.compile(r"[^\W\d_]")
MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in ALPHA.finditer(text or ""))


def ngram_counts(text: str | None, step: int = 1 << 20) -> np.ndarray:
    """Counts of the hashed character 1- to 3-grams of the lower-cased text, in blocks of ``step`` characters."""
    out, text = np.zeros(1 << BITS, np.int64), text or ""
    for at in range(0, len(text), step):
        cp = np.frombuffer(text[at : at + step + ORDERS[-1] - 1].lower().encode("utf-32-le", "replace"), np.uint32)
        h = np.zeros(len(cp), np.uint32)
        for i, n in enumerate(ORDERS):
            if len(cp) < n:
                break
            h = h[: len(cp) - n + 1] + (cp[n - 1 :] + np.uint32(n)) * MULTIPLIERS[i]
            g = h[:step]  # grams that begin in this block
            out += np.bincount((g * np.uint32(2654435769)) >> np.uint32(32 - BITS), minlength=1 << BITS)
            h = (h << np.uint32(13)) | (h >> np.uint32(19))
    return out


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and TF-IDF values (length 1) of one text."""
    counts = ngram_counts(text)
    at = np.flatnonzero(counts)
    v = (1 + np.log(counts[at])) * idf[at]
    return at, v / max(1e-12, float(np.sqrt(v @ v)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(rows, classes: int, epochs: int = 2, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> np.ndarray:
    """Weights (buckets + bias, classes) after FTRL-proximal passes over (at, values, class)."""
    z = np.zeros(((1 << BITS) + 1, classes))
    n = np.zeros_like(z)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for at, v, y in rows:
            at, v = np.append(at, 1 << BITS), np.append(v, 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at], n[at] = zi + g - sigma * w, ni + g * g
    return weights(z, n)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = 1200, most_langs: int = 400):
    """(langs, idf, weights, temperature) from labelled rows.

    Document frequencies cover every row; weights are fitted on about ``sample_per_lang`` rows of each language, chosen by
    a hash of the id; null texts count as empty ones. Languages beyond the ``most_langs`` most frequent are refused.
    """
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for t in b.column(0):
                df += ngram_counts(t.as_py()) > 0
                n += 1
        at = np.append(np.flatnonzero(df), 1 << BITS)  # the last one counts rows
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.append(df, n)[at])], names=["bucket", "df"])

    found = known.select("text").mapInArrow(frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros((1 << BITS) + 1)
    df[found["bucket"].to_numpy()] = found["df"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs + 1).collect()}
    if len(sizes) > most_langs:
        raise ValueError(f"more than most_langs={most_langs} languages")
    langs = sorted(sizes)
    if not langs:
        return [], idf, np.zeros(((1 << BITS) + 1, 0)), 1.0
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1 << 30, int(sample_per_lang / sizes[k] * (1 << 30)) + 1))))
    sample = known.where(draw < F.element_at(share, F.col("lang"))).withColumn("draw", draw)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, lang, d in zip(b.column(0), b.column(1), b.column(2)):
                at, v = vector(t.as_py(), idf)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.list_(pa.int16())), pa.array([v], pa.list_(pa.float32())), pa.array([lang.as_py()]), pa.array([d.as_py()])], names=["at", "v", "lang", "draw"])

    got = sample.select("text", "lang", "draw").mapInArrow(features, "at array<short>, v array<float>, lang string, draw long").toArrow()
    order = np.argsort(got["draw"].to_numpy(), kind="stable")
    at, v, lang = (got[c].combine_chunks() for c in ("at", "v", "lang"))
    rows = [(at[i].values.to_numpy().astype(np.int64), v[i].values.to_numpy().astype(float), langs.index(lang[i].as_py())) for i in order.tolist()]
    fifth = len(rows) // 5
    w = train_ftrl(rows[fifth:], len(langs))
    held = rows[:fifth] or rows
    z = np.array([x @ w[a] + w[-1] for a, x, _ in held])
    y = np.array([k for _, _, k in held])
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 120))
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return langs, idf, w, float(grid[int(np.argmin(loss))])


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row; ``und`` with score 0 if the text is null or has no letter.

    Rows that repeat or share an id keep one each, an empty table gives no rows, other columns play no part. A model that saw no language says ``und``.
    """
    langs, idf, w, temperature = model
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast((idf.astype(np.float32), (w / temperature).astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, w = shipped.value
        for b in batches:
            names, scores = [], []
            for t in b.column(1):
                t = t.as_py()
                if not langs or not has_letter(t):
                    names.append("und"), scores.append(0.0)
                    continue
                at, v = vector(t, idf)
                p = softmax(v @ w[at] + w[-1])
                names.append(langs[int(p.argmax())]), scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double")


def op2_langid(spark, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``, repeated ones too; ``held_out`` is null where doc_id is, and such rows are not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(crc_mod("doc_id", 4) != 2))
    out = predict(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
