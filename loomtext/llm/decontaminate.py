"""Benchmark decontamination with an Aho-Corasick automaton over normalised items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import process_cache, saved

#: ASCII letters and digits stay, A-Z lower-cased; other ASCII separates words; the rest are word bytes.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def automaton(items: list[tuple[str, str | None]], size: int = 13):
    """(automaton, window length in words by pattern, items by pattern) over all windows of the items.

    A pattern stands between spaces, so it matches whole words only; equal windows of several items are one pattern.
    """
    owners: dict[bytes, set] = {}
    lengths: dict[bytes, int] = {}
    for item, text in items:
        words = normal_words(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            key = b" " + b" ".join(words[i : i + size]) + b" "
            owners.setdefault(key, set()).add(item)
            lengths[key] = len(words[i : i + size])
    tree = ahocorasick.Automaton()
    for n, key in enumerate(owners):
        tree.add_word(key.decode("latin-1"), n)
    if owners:
        tree.make_automaton()
    return tree, [lengths[k] for k in owners], list(owners.values())


def scan(text: str | None, machine) -> tuple[int, list[tuple[int, int]], set]:
    """(words, hit runs of words, items) of one text, scanned once."""
    tree, lengths, owners = machine
    words = normal_words(text)
    if not words or not owners:
        return len(words), [], set()
    joined = b" " + b" ".join(words) + b" "
    found = list(tree.iter(joined.decode("latin-1")))
    if not found:
        return len(words), [], set()
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    ends = np.searchsorted(spaces, [e for e, _ in found])
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, ends - np.array([lengths[p] for _, p in found]), 1)
    np.add.at(gone, ends, -1)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], np.cumsum(gone)[:-1] > 0, [False])).astype(np.int8)))
    return len(words), list(zip(edge[0::2].tolist(), edge[1::2].tolist())), set().union(*(owners[p] for p in {p for _, p in found}))


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of words as character offsets in the text as it was."""
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]


def item_parts(items: DataFrame, item_col: str, item_text_col: str, max_bytes: int) -> list[DataFrame]:
    """(item, text) rows with an id, in parts by the item's hash whose texts have ``max_bytes`` at most."""
    bench = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item IS NOT NULL")
    bench = bench.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    total, largest = bench.agg(F.sum("size"), F.max("size")).first()
    if (largest or 0) > max_bytes:
        raise ValueError(f"a benchmark item has {largest} bytes, over max_bytes={max_bytes}")
    n = max(1, -(-(total or 0) // max_bytes))
    while n > 1:
        sizes = bench.groupBy(F.pmod(F.xxhash64("item", "text"), F.lit(n))).agg(F.sum("size").alias("s"))
        if sizes.agg(F.max("s")).first()[0] <= max_bytes:
            break
        n += 1 + n // 4
    return [bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).select("item", "text") for i in range(n)]


def shipped_items(part: DataFrame, size: int):
    """A function that gives a task the automaton of one part's items, which go to every task: see ``item_parts`` for their size."""
    listed = sorted({(r.item, r.text) for r in part.collect()}, key=str)
    stamp = hashlib.sha256(repr((size, listed)).encode()).hexdigest()
    shipped = part.sparkSession.sparkContext.broadcast(listed)

    def machine():
        known = process_cache("automata")
        if stamp not in known:
            known.clear()
            known[stamp] = automaton(shipped.value, size)
        return known[stamp]

    return machine


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def scanned(docs: DataFrame, items: DataFrame, text_col: str, item_col: str = "item_id", item_text_col: str = "text", size: int = 13, max_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` with ``__n``, ``__runs``, ``__items`` and ``__spans``: words, runs of hit words (first, end), items, and the runs as offsets in each text.

    An automaton holds items of ``max_bytes`` at most, which bounds a task's memory; a larger benchmark takes one
    automaton and one scan for each part, and what the parts find is united.
    """
    parts, at, columns = item_parts(items, item_col, item_text_col, max_bytes), docs.columns.index(text_col), len(docs.columns)
    out = docs.withColumns({"__n": F.lit(0).cast("long"), "__runs": F.array().cast("array<array<long>>"), "__items": F.array().cast("array<string>"), "__spans": F.array().cast("array<struct<start:long,end:long>>")})
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def step(machine, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = machine()
            for b in batches:
                n, runs, named, spans = [], [], [], []
                for t, r, i in zip(b.column(at), b.column(columns + 1).to_pylist(), b.column(columns + 2).to_pylist()):
                    words, found, items = scan(t.as_py(), tree)
                    n.append(words), runs.append(united([*map(tuple, r), *found])), named.append(sorted({*i, *items}))
                    spans.append(original_spans(t.as_py(), runs[-1]) if last and runs[-1] else [])
                made = [pa.array(n, pa.int64()), pa.array([list(map(list, r)) for r in runs], pa.list_(pa.list_(pa.int64()))), pa.array(named, pa.list_(pa.string())), pa.array(spans, span)]
                yield pa.RecordBatch.from_arrays([*b.columns[:columns], *made], names=b.schema.names)

        return run

    for k, part in enumerate(parts):
        out = out.mapInArrow(step(shipped_items(part, size), k == len(parts) - 1), out.schema)
        out = out if k == len(parts) - 1 else saved(out, "scanned")
    return out


#: Stands for the id of items that have none.
NO_ID = "\x00"


def with_ids(items: DataFrame, item_col: str = "item_id") -> DataFrame:
    """Items without an id keep their windows: they share the id ``NO_ID``, as one item."""
    return items.withColumn(item_col, F.coalesce(F.col(item_col).cast("string"), F.lit(NO_ID)))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 5, **about) -> DataFrame:
    """(id, n_words, n_hit, items array<string>, spans, contaminated) for every row.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is ``size`` consecutive words of an
    item, or all of a shorter one; items whose id is null are left out (see ``with_ids``). A row is contaminated if it has hit words and they are ``percent`` of its words or more. Null
    has no words; an item without words has no window; rows that repeat are scanned each.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = scanned(rows, items, "text", **about)
    out = out.select("id", F.col("__n").alias("n_words"), hit_words("__runs").alias("n_hit"), F.col("__items").alias("items"), F.col("__spans").alias("spans"))
    return out.withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words"), percent))


def hit_words(runs: str) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])


def is_contaminated(hit: Column, words: Column, percent: int) -> Column:
    return (hit > 0) & (100 * hit >= percent * words)


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", percent: int = 5, **about) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; for null, empty and repeated rows see ``contamination``."""
    out = scanned(docs, items, text_col, **about)
    return out.where(~is_contaminated(hit_words("__runs"), F.col("__n"), percent)).select(*docs.columns)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Items without an id count as one in ``n_items`` and are not named in the list of items."""
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_ids(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    named = F.array_join(F.array_remove("items", NO_ID), ",")
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), "contaminated")


def decontamination_sql(table: str = "documents") -> str:
    """CTEs ending in ``judged`` (doc_id, n_words, n_hit, n_items, items_sha256, contaminated) over ``table``."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
dw AS (SELECT doc_id, {words} AS ws FROM {table}),
bw AS (SELECT item_id, {words} AS ws FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS w
  FROM bw, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS r(i) WHERE len(ws) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS w FROM dw, lengths, unnest(range(1, len(ws) - n + 2)) AS r(p)),
found AS (SELECT g.doc_id, g.p, g.n, x.item_id FROM grams g JOIN windows x ON g.w = x.w AND g.n = x.n),
hitwords AS (SELECT DISTINCT doc_id, p + o AS k FROM (SELECT DISTINCT doc_id, p, n FROM found) AS f, unnest(range(0, n)) AS r(o)),
hits AS (SELECT doc_id, count(*) AS n_hit FROM hitwords GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id),
judged AS (SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
  FROM dw d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id))"""


SQL = {"op6_decontaminate": f"WITH {decontamination_sql()} SELECT * FROM judged"}
