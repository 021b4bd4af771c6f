"""Toxicity: class-conditional Kneser-Ney models of spelling, compared by length-normalised log-likelihood.

A text is its words, lower-cased, letters only, one space after each. For each class c, a character x after the
``order - 1`` characters h has the interpolated Kneser-Ney probability

    P_c(x | h) = (n_c(hx) - min(n_c(hx), discount)) / n_c(h) + share_c(h) * P(x | h'),

share_c(h) being what the discounts took, and P the lower-order Kneser-Ney model, from continuation counts that both
classes and the rows without a label share: rare expressions are smoothed alike in both classes. What no class has
seen more than ``discount`` times cancels in the ratio of the classes, so the ratio of a character is

    log share_1(h) - log share_0(h), plus a term of hx if a class has seen hx more often than that.

These terms are a table of one number per context and n-gram, which grows with the corpus. It is broadcast in
blocks of ``most_entries``; beyond one block, rows are scanned once for each block and the sums are kept with them.

A text's score compares the two likelihoods over the whole text and over its best runs of a few words (``RUNS``),
each divided by its length in words, so that one abusive line in a long text counts. A bounded draw of
labelled rows, which no count has seen, calibrates the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, mix, saved

ORDER, DISCOUNT, BACKOFF = 5, 2.0, 0.75
RUNS = (1, 3, 8)
FEATURES = 3 + len(RUNS)
BLOCK = 1 << 20
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_BASE, _CONTEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5BD1E995A7C3F10D)


class Model(NamedTuple):
    """``terms`` is a written table (key long, w float); ``weights`` are those of ``describe``'s numbers."""

    terms: DataFrame
    order: int
    most_entries: int
    weights: np.ndarray


def normal(text: str | None) -> str:
    """The words in lower case, letters only, a space after each."""
    words = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return words + " " if words else ""


def pieces(norm: str, order: int, size: int = BLOCK) -> Iterator[str]:
    """``norm`` in runs of whole words of about ``size`` characters, each with the ``order - 1`` characters before it."""
    at = 0
    while at < len(norm):
        to = norm.find(" ", at + size) + 1 or len(norm)
        yield (" " * (order - 1) + norm[max(0, at - order + 1) : at])[1 - order :] + norm[at:to]
        at = to


def hashes(points: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams that begin at each code point, and of their contexts."""
    n = max(0, len(points) - order + 1)
    h = np.zeros(n, np.uint64)
    for i in range(order - 1):
        h = h * _BASE + points[i : i + n] + np.uint64(1)
    return mix(h * _BASE + points[order - 1 :] + np.uint64(1)) if n else h, mix(h ^ _CONTEXT)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


class Grams(NamedTuple):
    """Positions of some texts that a model predicts: what they are, and the word they belong to."""

    joined: str
    at: np.ndarray  # where each one's n-gram begins
    gram: np.ndarray
    context: np.ndarray
    word: np.ndarray


def grams_of(parts: list[str], order: int) -> Grams:
    joined = "".join(parts)
    points = code_points(joined)
    gram, context = hashes(points, order)
    own = np.ones(len(points), bool)
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    own[(starts[:, None] + np.arange(order - 1)).ravel()] = False
    at = np.flatnonzero(own) - (order - 1)
    ends = (points[own] == 32).astype(np.int64)
    return Grams(joined, at, gram[at], context[at], np.cumsum(ends) - ends)


def batched(texts, order: int) -> Iterator[tuple[list[int], list[str]]]:
    """(words of each row, pieces of all) of consecutive rows with about ``BLOCK`` characters, or of one longer row."""
    words, parts, size = [], [], 0
    for t in texts:
        norm = normal(t)
        if words and size + len(norm) > BLOCK:
            yield words, parts
            words, parts, size = [], [], 0
        words.append(norm.count(" "))
        parts.extend(pieces(norm, order))
        size += len(norm)
    if words:
        yield words, parts


def word_terms(parts: list[str], order: int, keys: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Summed terms of each word of the pieces."""
    out = []
    while parts:
        n, size = 0, 0
        while n < len(parts) and (not n or size + len(parts[n]) <= BLOCK):
            size, n = size + len(parts[n]), n + 1
        g = grams_of(parts[:n], order)
        codes, kinds = pd.factorize(g.gram)
        one = np.empty(len(kinds), np.int64)
        one[codes[::-1]] = np.arange(len(codes))[::-1]
        total = np.zeros(len(kinds))
        for wanted in (kinds, g.context[one]):
            at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
            total += np.where(keys[at] == wanted, w[at], 0.0) if len(keys) else 0.0
        out.append(np.bincount(g.word, total[codes]) if len(codes) else np.zeros(0))
        parts = parts[n:]
    return np.concatenate(out) if out else np.zeros(0)


def describe(words: np.ndarray) -> list[float]:
    """1, the mean log-likelihood ratio of a text's words, that of its best runs of ``RUNS`` words, and its length."""
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (FEATURES - 1)
    until = np.concatenate(([0.0], np.cumsum(words)))
    best = [float((until[m:] - until[:-m]).max() if n > m else until[-1]) / m for m in RUNS]
    return [1.0, float(until[-1]) / n, *best, float(np.log1p(n)) / 10]


def shared_model(grams: DataFrame, order: int) -> DataFrame:
    """(g, p) of the n-grams of ``order - 1``: Kneser-Ney by continuation counts, from the different n-grams (g) of ``order``."""
    levels, now = {}, grams.select("g")
    for k in range(order - 1, 0, -1):
        now = levels[k] = saved(now.groupBy(F.substr("g", F.lit(2)).alias("g")).agg(F.count("*").alias("c")), f"order{k}")
    whole = levels[1].agg(F.sum("c"), F.count("*")).first()
    total, kinds = float(whole[0] or 1), float(whole[1])
    taken = lambda c: F.greatest(c - BACKOFF, F.lit(0.0))
    p = levels[1].select("g", (taken(F.col("c")) / total + BACKOFF * kinds / total / (kinds + 1)).alias("p"))
    for k in range(2, order):
        mine = Window.partitionBy(F.substr("g", F.lit(1), F.lit(k - 1)))
        t = levels[k].withColumn("n", F.sum("c").over(mine)).withColumn("share", BACKOFF * F.count("*").over(mine) / F.col("n"))
        p = t.withColumn("s", F.substr("g", F.lit(2))).join(p.withColumnRenamed("g", "s"), "s").select("g", (taken(F.col("c")) / F.col("n") + F.col("share") * F.col("p")).alias("p"))
    return p


def class_model(grams: DataFrame, order: int, discount: float) -> tuple[DataFrame, DataFrame]:
    """((h, l), (g, w)) from counted n-grams (g, n0, n1): the ratio of the shares of each context, and what seen n-grams add to it."""
    mine = Window.partitionBy("h")
    t = grams.where("n0 + n1 > 0").withColumn("h", F.substr("g", F.lit(1), F.lit(order - 1)))

    def less(c: int) -> Column:
        return F.least(F.col(f"n{c}").cast("double"), F.lit(discount))

    for c in (0, 1):
        t = t.withColumn(f"a{c}", F.sum(f"n{c}").over(mine)).withColumn(f"b{c}", F.sum(less(c)).over(mine))
        t = t.withColumn(f"s{c}", F.when(F.col(f"a{c}") > 0, F.col(f"b{c}") / F.col(f"a{c}")).otherwise(1.0))
    t = saved(t.withColumn("l", F.log("s1") - F.log("s0")), "classes")
    contexts = t.groupBy("h").agg(F.first("l").alias("l")).where("l <> 0")
    seen = t.where(F.greatest("n0", "n1") > discount).withColumn("s", F.substr("g", F.lit(2)))
    seen = seen.join(shared_model(grams, order).withColumnRenamed("g", "s"), "s")
    p0, p1 = (F.when(F.col(f"a{c}") > 0, (F.col(f"n{c}") - less(c)) / F.col(f"a{c}")).otherwise(0.0) + F.col(f"s{c}") * F.col("p") for c in (0, 1))
    return contexts, seen.select("g", (F.log(p1) - F.log(p0) - F.col("l")).alias("w"))


def keyed(terms: DataFrame, order: int, context: bool) -> DataFrame:
    """(key, w) of contexts or n-grams (text, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                points = code_points("".join(b.column(0).to_pylist())).reshape(b.num_rows, -1)
                h = np.zeros(b.num_rows, np.uint64)
                for i in range(order - 1):
                    h = h * _BASE + points[:, i] + np.uint64(1)
                key = mix(h ^ _CONTEXT) if context else mix(h * _BASE + points[:, order - 1] + np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(1).cast(pa.float32())], names=["key", "w"])

    return terms.mapInArrow(run, "key long, w float")


def count_grams(rows: DataFrame, order: int, step: int = 4 * BLOCK) -> DataFrame:
    """(g, n0, n1) of rows (z, y): compressed normal texts, and their class or null; n-grams of the latter count 0 in both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {0: [], 1: [], None: []}
        size = dict.fromkeys(held, 0)

        def flush(y):
            g = grams_of(held[y], order)
            codes, kinds = pd.factorize(g.gram)
            one = np.empty(len(kinds), np.int64)
            one[codes] = np.arange(len(codes))
            text = [g.joined[a : a + order] for a in g.at[one].tolist()]
            n, none = np.bincount(codes, minlength=len(kinds)), np.zeros(len(kinds), np.int64)
            held[y], size[y] = [], 0
            return pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(n if y == 0 else none), pa.array(n if y == 1 else none)], names=["g", "n0", "n1"])

        for b in batches:
            for z, y in zip(b.column(0), b.column(1).to_pylist()):
                for p in pieces(zstandard.decompress(z.as_py()).decode(), order):
                    held[y].append(p)
                    size[y] += len(p)
                    if size[y] > step:
                        yield flush(y)
        for y in held:
            if held[y]:
                yield flush(y)

    return rows.mapInArrow(run, "g string, n0 long, n1 long").groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def described(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (text, ...) with ``f``, the numbers of ``describe``, in place of the text."""
    blocks = max(1, -(-model.terms.count() // model.most_entries))
    rest = [c for c in rows.columns if c != "text"]
    rows = rows.withColumn("__sum", F.lit(None).cast("array<double>"))
    for n in range(blocks):
        t = model.terms.where(F.pmod(F.col("key"), F.lit(blocks)) == n).toArrow()
        keys = t["key"].to_numpy().astype(np.int64).view(np.uint64)
        by = np.argsort(keys)
        rows = _block(rows, rest, model.order, keys[by], t["w"].to_numpy().astype(np.float32)[by], n == blocks - 1)
        rows = rows if n == blocks - 1 else saved(rows, "sums")
    return rows


def _block(rows: DataFrame, rest: list[str], order: int, keys: np.ndarray, w: np.ndarray, last: bool) -> DataFrame:
    shipped = rows.sparkSession.sparkContext.broadcast((keys, w))
    schema = rows.select(*rest, "text", "__sum").schema if not last else rows.select(*rest, F.array(F.lit(0.0)).alias("f")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, w = shipped.value
        for b in batches:
            texts, before, out = b.column(len(rest)).to_pylist(), b.column(len(rest) + 1), []
            for words, parts in batched(texts, order):
                for own in np.split(word_terms(parts, order, keys, w), np.cumsum(words)[:-1]):
                    old = before[len(out)]
                    own = own + old.values.to_numpy(zero_copy_only=False) if old.is_valid else own
                    out.append(describe(own) if last else own)
            columns = [*b.columns[: len(rest)], *([] if last else [b.column(len(rest))]), pa.array(out, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*zip(b.schema.names[: len(columns) - 1], [c.type for c in columns[:-1]]), ("f" if last else "__sum", columns[-1].type)]))

    return rows.select(*rest, "text", "__sum").mapInArrow(run, schema)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps of a weighted logistic regression with a slight ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, discount: float = DISCOUNT, calibrate_per_class: int = 4000, most_entries: int = 4_000_000) -> Model:
    """The models from labelled rows; an id with several labels takes the largest, rows that repeat count each.

    Of the labelled rows whose crc32(id as text) modulo 16 is below 4, about ``calibrate_per_class`` of each class calibrate at
    most; all others are counted, those without a label in the shared counts only. Without labels of both classes, every text
    scores below one half. Texts travel compressed to their label.
    """
    named = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press.compress(normal(t.as_py()).encode("utf-8", "replace")) for t in b.column(1)], pa.binary())], names=["id", "z"])

    fold = F.pmod(F.shiftright(F.crc32(F.col("id").cast("string").cast("binary")), 2), F.lit(4))
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))
    sizes = {r["y"]: r["count"] for r in rows.select("id").where(fold == 0).join(named.hint("shuffle_hash"), "id").groupBy("y").count().collect()}
    most = {y: int(calibrate_per_class / sizes[y] * (1 << 30)) + 1 if sizes.get(y) else 0 for y in (0, 1)}
    calibrates = (fold == 0) & (draw < F.when(F.col("y") == 1, most[1]).otherwise(most[0])) & F.col("y").isNotNull()
    # always a shuffle of both sides: labels grow with the corpus, so the plan is the same at every size
    counted = rows.mapInArrow(squeeze, f"id {kind}, z binary").join(named.hint("shuffle_hash"), "id", "left").where(~F.coalesce(calibrates, F.lit(False)))
    grams = saved(count_grams(counted.select("z", "y"), order), "grams")
    contexts, seen = class_model(grams, order, discount)
    model = Model(saved(keyed(contexts, order, True).unionByName(keyed(seen, order, False)), "terms"), order, most_entries, np.array([-1.0, *[0.0] * (FEATURES - 1)]))
    if not sizes.get(0) or not sizes.get(1):
        return model
    got = described(rows.where(fold == 0).join(F.broadcast(named.where(calibrates)), "id").select("text", "y"), model).toArrow()
    x, y = np.array(got["f"].to_pylist()).reshape(-1, FEATURES), got["y"].to_numpy().astype(float)
    drawn = np.bincount(y.astype(int), minlength=2)
    return model._replace(weights=logistic(x, y, np.where(y == 1, sizes[1] / max(1, drawn[1]), sizes[0] / max(1, drawn[0]))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row: 0 to 1, higher if label 1 is likelier; null, empty and blank texts score as no words.

    Rows that repeat or share an id keep one each, an empty table gives no rows, other columns play no part.
    """
    rows = described(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), model)
    z = sum((F.col("f")[i] * float(b) for i, b in enumerate(model.weights)), F.lit(0.0))
    return rows.select("id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``, repeated ones too; ``held_out`` is null where doc_id is, and such rows are not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", 4) != 2)
    model = fit(docs.where(crc_mod("doc_id", 4) != 2), labels)
    out = score(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
