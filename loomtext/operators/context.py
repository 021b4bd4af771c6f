"""Ranking, budgets, conversation compaction, vector search, routing, prompts and quality gates."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import estimate_tokens, percentage, size16
from ..limits import MAX_CHARACTERS, InputLimitError, checked_limit
from ..tables import saved
from .optimize import optimize


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None else None)


def folded(text: Column) -> Column:
    """NFKC and lower case; only texts beyond ASCII reach Python."""
    plain = text.rlike(r"\A[\x00-\x7F]*+\z")
    return F.lower(F.when(plain, text).otherwise(_nfkc(F.when(~plain, text))))


def terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}_./:-]+)"), F.lit(1)))


def query_terms(query: str) -> Column:
    """The terms of one text as a literal, so that no row works them out again."""
    found = re.findall(r"[\w./:-]+", unicodedata.normalize("NFKC", query).lower())
    words = [w for x in found for w in _split_terms(x)]
    return F.array(*map(F.lit, dict.fromkeys(words))).cast("array<string>")


def _split_terms(word: str) -> list[str]:
    """Runs of letters, numbers and ``./:-`` in a run of word characters, which has others too."""
    kept = "".join(c if c in "./:-" or unicodedata.category(c)[0] in "LN" else " " for c in word)
    return kept.split()


def ranked(df: DataFrame, query: str | Column, text: str = "text", priority: str | None = None, timestamp: str | None = None, now: int | None = None, half_life: float = 3_600_000.0, group: str | None = None, index: str = "idx", keep: list[str] | None = None) -> DataFrame:
    """Adds ``signals`` (lexical, priority, recency), ``score`` and ``rank``: score descending, then input index.

    ``query`` names a text column, or is a column of terms (``terms``, ``query_terms``). Lexical is the share of the query's terms that the text has. Ranks are within
    ``group``; rows are range-sorted by (group, score, index) and numbered with the sizes of the ranges before, so a group
    of any size is dealt over many tasks. Without a group there is no rank. Null texts have no terms; candidates must have an ``index``.
    ``keep`` names the columns that stay with the rank, so that texts need not be sorted with it.
    """
    if half_life <= 0:
        raise ValueError("half_life must be positive")
    if timestamp and now is None:
        raise ValueError("now is needed with timestamps: the clock is a parameter")
    if timestamp and not math.isfinite(now):
        raise ValueError("now must be finite")
    df = df.withColumn("__q", terms(F.col(query)) if isinstance(query, str) else query).withColumn("__t", F.coalesce(terms(F.col(text)), F.array().cast("array<string>")))
    lexical = F.when(F.size("__q") == 0, 0.0).otherwise(F.size(F.array_intersect("__q", "__t")) / F.size("__q"))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(priority).cast("double"), F.lit(0.0)))) if priority else F.lit(0.0)
    recency = F.coalesce(F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), F.lit(float(now)) - F.col(timestamp)) / half_life), F.lit(0.0)) if timestamp else F.lit(0.0)
    df = df.withColumn("signals", F.struct(lexical.alias("lexical"), weight.alias("priority"), recency.alias("recency"))).drop("__q", "__t")
    df = df.withColumn("score", F.col("signals.lexical") * 0.7 + F.col("signals.priority") * 0.2 + F.col("signals.recency") * 0.1)
    if group is None:
        return df
    return numbered(df.select(*keep, "signals", "score") if keep else df, group, [F.desc("score"), F.col(index)], "rank")


def numbered(df: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``, the place of each row in its group from 1; ties in ``order`` get different places.

    Rows are range-sorted by group and order, and written; a row's place is that in its range plus the group's rows in the
    ranges before it.
    """
    rows = saved(df.repartitionByRange(group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    mine = Window.partitionBy("__g").orderBy("__r")
    before = rows.groupBy(F.col(group).alias("__g"), F.col("__range").alias("__r")).count().withColumn("__before", F.sum("count").over(mine) - F.col("count")).drop("count")
    rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy(group, "__range").orderBy(*order)))
    rows = rows.join(before, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__range") == F.col("__r")))
    return rows.withColumn(out, (F.col("__before") + F.col("__place")).cast("int")).drop("__g", "__r", "__range", "__before", "__place")


def _refused(condition: Column, message: str, value: Column) -> Column:
    """``value``, or a failed query where ``condition`` holds."""
    return F.when(condition, F.raise_error(F.lit(message)).cast("long")).otherwise(value)


def fit_budget(df: DataFrame, group: str, budget: Column | int, tokens: str = "tokens", score: str = "score", required: str | None = None, index: str = "idx", most_items: int = 10_000) -> DataFrame:
    """Adds ``selected``: greedy by required, score per token, score, index, skipping what no longer fits.

    A group is one budget problem, gathered once (no join back). The query fails beyond ``most_items``, on a repeated or null index within a
    group, on a score that is not finite, and on tokens or a budget that are null or negative. Required items only come
    first; one that does not fit is left out.
    """
    checked_limit(most_items, "most_items", 1)
    req = F.coalesce(F.col(required), F.lit(False)) if required else F.lit(False)
    limit = (budget if isinstance(budget, Column) else F.lit(checked_limit(budget, "budget"))).cast("long")
    t, s = F.col(tokens).cast("long"), F.col(score).cast("double")
    t = _refused(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), "budget: a score is not finite", t)
    t = _refused(F.col(tokens).isNull() | (F.col(tokens) < 0) | limit.isNull() | (limit < 0), "budget: tokens and budget must not be negative", t)
    key = F.struct((~req).alias("a"), (-s / F.greatest(t, F.lit(1))).alias("b"), (-s).alias("c"), F.col(index).alias("i"), t.alias("t"), limit.alias("most"))
    rows = df.groupBy(F.col(group).alias("__g")).agg(F.collect_list(F.struct(key.alias("k"), F.struct(*df.columns).alias("r"))).alias("__l"))
    n, places = F.size("__l"), F.transform("__l", lambda x: x["k"]["i"])
    fault = F.when(n > most_items, F.lit(f"budget: more than {most_items} items in a group")).when(F.exists(places, lambda i: i.isNull()) | (F.size(F.array_distinct(places)) < n), F.lit("budget: an index is null or repeated"))
    rows = rows.withColumn("__l", F.when(fault.isNotNull(), F.raise_error(fault).cast(rows.schema["__l"].dataType)).otherwise(F.array_sort("__l")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("chosen"))

    def step(a: Column, x: Column) -> Column:
        fits = a["used"] + x["k"]["t"] <= x["k"]["most"]
        return F.struct((a["used"] + F.when(fits, x["k"]["t"]).otherwise(0)).alias("used"), F.concat(a["chosen"], F.array(fits)).alias("chosen"))

    rows = rows.withColumn("__f", F.aggregate("__l", start, step)["chosen"])
    return rows.select(F.explode(F.arrays_zip(F.col("__l.r").alias("r"), F.col("__f").alias("f"))).alias("x")).select("x.r.*", F.col("x.f").alias("selected"))


def compact_conversations(df: DataFrame, budget: int, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", preserve=("system",), keep_recent: int = 2, preset: str = "safe", query: str | None = None, count=estimate_tokens, most_messages: int = 1000, most_characters: int = MAX_CHARACTERS) -> DataFrame:
    """Adds ``idx``, ``score``, ``tokens``, ``original_tokens``, ``compacted_text`` and ``selected`` to each message.

    Raw texts are ranked against ``query``, or against the last message; every body that is not preserved is reduced; then the budget is
    filled, preserved roles and the last ``keep_recent`` first. Tokens are those of ``count``. Recency plays no part, so results do not depend on a clock.
    Messages of one turn are ordered by role and text; a null text counts as empty. Beyond ``most_messages`` or ``most_characters`` (the query's
    included) the query fails. ``conversation_totals`` sums up.
    """
    checked_limit(keep_recent, "keep_recent"), checked_limit(most_messages, "most_messages", 1), checked_limit(most_characters, "most_characters")
    w = Window.partitionBy(conv).orderBy(turn, role, text)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn(text, F.coalesce(text, F.lit("")))
    df = df.withColumn("idx", F.row_number().over(w) - 1).withColumn("__cq", F.last(text).over(whole) if query is None else F.lit(query)).withColumn("__cn", F.count("*").over(whole))
    df = df.withColumn("__cs", F.sum(size16(F.col(text))).over(whole) + size16(F.col("__cq")))
    df = df.withColumn("__cn", _refused(F.col("__cn") > most_messages, f"more than {most_messages} messages", F.col("__cn")))
    df = df.withColumn("__cn", _refused(F.col("__cs") > most_characters, str(InputLimitError(None, most_characters)), F.col("__cn")))
    kept = F.col(role).isin(*preserve)
    df = ranked(df.withColumn("__cp", kept.cast("double")), "__cq", text, "__cp")
    df = optimize(df.withColumn("__cin", F.when(~kept, F.col(text))), "__cin", preset, out="__co")
    df = df.withColumn("compacted_text", F.coalesce("__co", text)).withColumn("tokens", count(F.col("compacted_text"))).withColumn("original_tokens", count(F.col(text)))
    df = df.withColumn("required", F.coalesce(kept, F.lit(False)) | (F.col("idx") >= F.col("__cn") - keep_recent))
    df = df.drop("__cq", "__cn", "__cs", "__cp", "__cin", "__co", "detection", "decisions", "transformations", "stats", "signals")
    return fit_budget(df, conv, budget, tokens="tokens", score="score", required="required", index="idx", most_items=most_messages)


def conversation_totals(compacted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, original_tokens, compacted_tokens, omitted indices) of ``compact_conversations``."""
    omitted = F.sort_array(F.collect_list(F.when(~F.col("selected"), F.col("idx"))))
    return compacted.groupBy(conv).agg(F.sum("original_tokens").alias("original_tokens"), F.sum(F.when(F.col("selected"), F.col("tokens")).otherwise(0)).alias("compacted_tokens"), omitted.alias("omitted"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 if either has no length, a failed query if they are empty, differ in dimension or are not finite."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    odd = lambda x: F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fault = F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), F.lit("embedding dimension mismatch")).when(odd(a) | odd(b), F.lit("embedding is not finite"))
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(fault.isNotNull(), F.raise_error(fault).cast("double")).when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def vector_index(log: DataFrame, id_col: str = "id", seq: str = "seq", op: str = "op", embedding: str = "embedding", text: str | None = None, most_dimensions: int = 8192, most_characters: int = 1 << 20) -> DataFrame:
    """The documents that a log of upserts and deletes leaves: of each id the row with the largest ``seq``, unless it is a delete.

    The query fails if an upsert's embedding is empty, too long, not finite or not of the log's one dimension, or its text is too long.
    """
    up = F.col(op) != "delete"
    e = F.col(embedding)
    log = log.withColumn("__d", F.when(up, F.coalesce(F.size(e), F.lit(0))))
    log = log.withColumn("__d", _refused(up & ((F.col("__d") < 1) | (F.col("__d") > most_dimensions)), "embedding dimension out of range", F.col("__d")))
    log = log.withColumn("__d", _refused(up & F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), "embedding is not finite", F.col("__d")))
    if text:
        log = log.withColumn("__d", _refused(up & (size16(F.col(text)) > most_characters), str(InputLimitError(None, most_characters)), F.col("__d")))
    bounds = log.agg(F.min("__d"), F.max("__d")).first()
    if bounds[0] != bounds[1]:
        raise ValueError("embedding dimension mismatch")
    columns = [c for c in log.columns if c != "__d"]
    last = log.groupBy(F.col(id_col).alias("__id")).agg(F.max_by(F.struct(*columns), F.col(seq)).alias("r"))
    return last.select("r.*").where(F.col(op) != "delete").drop(op, seq)


def vector_top_k(docs: DataFrame, queries: DataFrame, k: int = 5, floor: float = -1.0, doc_id: str = "id", query_id: str = "query_id", embedding: str = "embedding", most_queries: int = 10_000, most_bytes: int = 64 << 20) -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar documents of every query, of equals those first in the ``UNICODE`` collation of the id.

    Exact. Queries go to every task in blocks, by hash, of about ``most_queries`` rows and ``most_bytes`` at most. A task multiplies Arrow
    batches with a block and keeps k rows a query, so a block's shuffle has tasks x queries x k rows at most. Vectors without length
    have similarity 0; an empty, longer, shorter or not finite vector fails the query, as does a ``floor`` outside -1 to 1.
    """
    if k < 1 or not -1 <= floor <= 1:
        raise ValueError("k must be positive, and floor between -1 and 1")
    rows, size = queries.agg(F.count("*"), F.max(F.size(embedding))).first()
    per = max(1, min(most_queries, most_bytes // (8 * max(1, size or 1))))
    blocks = max(1, -(-rows // per))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(embedding).cast("array<double>").alias("e"))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [_block_top_k(docs, q.where(block == n), k, floor, doc_id, embedding) for n in range(blocks)])


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    flat = vectors.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(float)
    if vectors.null_count or flat.null_count or len(x) != len(vectors) * size or any(n != size for n in pc.list_value_length(vectors).to_pylist()):
        raise ValueError("embedding dimension mismatch")
    if not np.isfinite(x).all():
        raise ValueError("embedding is not finite")
    return x.reshape(len(vectors), size)


def _block_top_k(docs: DataFrame, queries: DataFrame, k: int, floor: float, doc_id: str, embedding: str) -> DataFrame:
    got = queries.toArrow()
    names, vectors = got["query_id"].combine_chunks(), got["e"].combine_chunks()
    size = len(vectors[0]) if len(vectors) else 0
    if len(vectors) and not size:
        raise ValueError("embedding dimension mismatch")
    q = _matrix(vectors, size) if len(vectors) else np.zeros((0, 0))
    shipped = docs.sparkSession.sparkContext.broadcast(q)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    kind = rows.schema["id"].dataType.simpleString()
    order = F.collate(F.col("id").cast("string"), "UNICODE")

    def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # sums in the order of the dimensions, whatever the batch: equal vectors are equal to the last bit
        dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
        for i in range(a.shape[1]):
            dot, aa, bb = dot + a[:, i] * b[:, i], aa + a[:, i] ** 2, bb + b[:, i] ** 2
        norm = np.sqrt(aa * bb)
        return np.divide(dot, norm, out=np.zeros(len(a)), where=norm > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shipped.value
        length = np.sqrt((q * q).sum(1))
        unit = np.divide(q, length[:, None], out=np.zeros_like(q), where=length[:, None] > 0)
        best: list = [(np.zeros(0), []) for _ in q]
        ids = None
        for b in batches:
            for at in range(0, b.num_rows if len(q) else 0, 2048):
                ids = b.column(0).slice(at, 2048)
                x = _matrix(b.column(1).slice(at, 2048), q.shape[1])
                n = np.sqrt((x * x).sum(1))
                rough = unit @ np.divide(x, n[:, None], out=np.zeros_like(x), where=n[:, None] > 0).T
                for j in range(len(q)):
                    least = max(floor, best[j][0][-1] if len(best[j][0]) == k else -2.0) - 1e-9
                    if len(x) > k:
                        least = max(least, np.partition(rough[j], -k)[-k] - 1e-9)
                    some = np.flatnonzero(rough[j] >= least)
                    if not len(some):
                        continue
                    s = similar(x[some], np.broadcast_to(q[j], (len(some), q.shape[1])))
                    some, s = some[s >= floor], s[s >= floor]
                    every, named = np.concatenate((best[j][0], s)), best[j][1] + [ids[i].as_py() for i in some.tolist()]
                    top = np.argsort(-every, kind="stable")[:k]  # rows come in the collation's order
                    best[j] = every[top], [named[i] for i in top.tolist()]
        out = [(j, i, s) for j, (sims, named) in enumerate(best) for i, s in zip(named, sims.tolist())]
        if out:
            number, named, sims = zip(*out)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(number)), pa.array(named, ids.type), pa.array(sims)], names=["query_id", "id", "similarity"])

    found = rows.sortWithinPartitions(order).mapInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {kind}, similarity double")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), order)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


ROUTE = "array<struct<id:string,max_context_tokens:long,input_cost:double,priority:double,capabilities:array<string>,idx:long>>"


def route_models(requests: DataFrame, routes: DataFrame, prefer: str = "priority", request_id: str = "request_id", most_routes: int = 10_000, most_capabilities: int = 100) -> DataFrame:
    """(request_id, route_id, candidates, reason): the best route with room and all required capabilities; null if there is none.

    ``routes`` is a catalogue of ``most_routes`` at most, checked and put into the plan as a literal: each request is answered on its own
    row, so requests may share an id, and nothing is shuffled. Ties go to the earlier route (``idx``). The query fails on negative or null
    ``input_tokens`` and beyond ``most_capabilities``.
    """
    if prefer not in ("priority", "cost", "capacity"):
        raise ValueError("prefer must be priority, cost or capacity")
    listed = routes.select("idx", "id", "max_context_tokens", "input_cost", "priority", "capabilities").limit(most_routes + 1).collect()
    if len(listed) > most_routes or len({r.id for r in listed}) < len(listed):
        raise ValueError("too many routes, or a duplicate id")
    for r in listed:
        numbers = [x for x in (r.max_context_tokens, r.input_cost) if x is not None]
        if r.max_context_tokens is None or any(x < 0 or not math.isfinite(x) for x in numbers) or not math.isfinite(r.priority or 0):
            raise ValueError("route sizes and costs must not be negative, and all numbers finite")
    every = F.from_json(F.lit(json.dumps([r.asDict() for r in listed])), ROUTE)
    tokens, required = F.col("input_tokens").cast("long"), F.coalesce("required", F.array().cast("array<string>"))
    tokens = _refused(tokens.isNull() | (tokens < 0), "input_tokens must not be negative", tokens)
    tokens = _refused(F.size(required) > most_capabilities, f"more than {most_capabilities} required capabilities", tokens)
    requests = requests.select(F.col(request_id).alias("request_id"), tokens.alias("__t"), required.alias("__c"))
    fits = F.filter(every, lambda r: (r["max_context_tokens"] >= F.col("__t")) & (F.size(F.array_except(F.col("__c"), F.coalesce(r["capabilities"], F.array().cast("array<string>")))) == 0))
    key = {"cost": lambda r: F.coalesce(r["input_cost"], F.lit(float("inf"))), "capacity": lambda r: -r["max_context_tokens"], "priority": lambda r: -F.coalesce(r["priority"], F.lit(0.0))}[prefer]
    out = requests.withColumn("__f", fits).withColumn("__b", F.array_min(F.transform("__f", lambda r: F.struct(key(r).cast("double").alias("k"), r["idx"].alias("i"), r["id"].alias("id")))))
    reason = F.concat(F.lit(f"{prefer}: "), F.col("__t").cast("string"), F.lit(" tokens and "), F.size("__c").cast("string"), F.lit(" capabilities fit"))
    return out.select("request_id", F.col("__b.id").alias("route_id"), F.size("__f").cast("long").alias("candidates"), F.when(F.col("__b").isNotNull(), reason).alias("reason"))


@F.pandas_udf(T.StringType())
def _json_pair(role: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([json.dumps([a, b], ensure_ascii=False, separators=(",", ":")) for a, b in zip(role, text)])


def prompt_prefix(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", prefix: int = 2) -> DataFrame:
    """(conv, stable_prefix_messages, prefix_sha256) of the first ``prefix`` messages of each conversation."""
    w = Window.partitionBy(conv).orderBy(turn)
    first = df.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= prefix).withColumn("__j", _json_pair(role, text))
    got = first.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("__i", "__j"))).alias("p"))
    return got.select(conv, F.size("p").cast("long").alias("stable_prefix_messages"), F.sha2(F.array_join("p.__j", "\n").cast("binary"), 256).alias("prefix_sha256"))


def cache_aware_prompt(df: DataFrame, stable: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, messages array<struct<role,text>>, stable_prefix_messages, prefix_sha256): messages for which the boolean column ``stable`` holds come first, each part in turn order."""
    own = F.struct((~F.coalesce(F.col(stable), F.lit(False))).alias("late"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    got = df.withColumn("__j", F.when(F.col(stable), _json_pair(role, text))).groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(own.alias("m"), "__j"))).alias("p"))
    first = F.filter("p", lambda x: ~x["m"]["late"])
    messages = F.transform("p", lambda x: F.struct(x["m"]["role"].alias("role"), x["m"]["text"].alias("text")))
    return got.select(conv, messages.alias("messages"), F.size(first).cast("long").alias("stable_prefix_messages"), F.sha2(F.array_join(F.transform(first, lambda x: x["__j"]), "\n").cast("binary"), 256).alias("prefix_sha256"))


def cache_hit_percentage(hits: Column, misses: Column) -> Column:
    # twice 100, as the query's SQL: one factor of 10,000 rounds other halves
    total = hits + misses
    return F.when(total <= 0, F.lit(0.0)).otherwise(F.floor(hits / total * 100 * 100 + 0.5) / 100)


def quality_cases(df: DataFrame, run: Callable, score: Callable, text: str = "text", preset: str = "safe", **about) -> DataFrame:
    """``df`` with ``original_score``, ``optimized_score`` and the sizes that ``quality_gate`` takes: ``score(run(text))`` of both texts, in Arrow batches.

    The scored rows are written, so each text is run once, whatever is asked of them.
    """

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: float(score(run(t)))).astype(float)

    rows = optimize(df, text, preset, out="__made", **about)
    rows = rows.select(*df.columns, scored(text).alias("original_score"), scored("__made").alias("optimized_score"), "stats.original_characters", "stats.optimized_characters", "stats.reduction_percentage")
    odd = reduce(Column.__or__, (F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in ("original_score", "optimized_score")))
    return saved(rows.withColumn("original_score", F.when(odd, F.raise_error(F.lit("a case returned a score that is not finite")).cast("double")).otherwise(F.col("original_score"))), "cases")


def _thresholds(minimum_reduction: float, mean_regression: float, case_regression: float | None) -> float:
    case = mean_regression if case_regression is None else case_regression
    if not all(map(math.isfinite, (minimum_reduction, mean_regression, case))) or not 0 <= minimum_reduction <= 100 or min(mean_regression, case) < 0:
        raise ValueError("thresholds out of range")
    return case


def quality_gate(cases: DataFrame, minimum_reduction: float = 0.0, mean_regression: float = 0.0, case_regression: float | None = None) -> DataFrame:
    """One row: passed, failed_cases, means and aggregate reduction of (original_score, optimized_score, original_characters, optimized_characters).

    No cases do not pass. ``quality_failures`` lists what failed.
    """
    case = _thresholds(minimum_reduction, mean_regression, case_regression)
    delta, o, n = F.col("optimized_score") - F.col("original_score"), F.sum("original_characters"), F.sum("optimized_characters")
    out = cases.agg(F.count("*").alias("cases"), F.avg("original_score").alias("mean_original"), F.avg("optimized_score").alias("mean_optimized"), F.when(o == 0, 0.0).otherwise((o - n) / o * 100).alias("aggregate_reduction"), F.count_if(delta < -case).alias("failed_cases"))
    out = out.withColumn("mean_delta", F.col("mean_optimized") - F.col("mean_original"))
    return out.withColumn("passed", (F.col("cases") > 0) & (F.col("aggregate_reduction") >= minimum_reduction) & (F.col("mean_delta") >= -mean_regression) & (F.col("failed_cases") == 0))


def quality_failures(cases: DataFrame, case_id: str, minimum_reduction: float = 0.0, mean_regression: float = 0.0, case_regression: float | None = None) -> DataFrame:
    """(check, case_id, value): the reduction, the mean and every case that misses its threshold, a row each."""
    case = _thresholds(minimum_reduction, mean_regression, case_regression)
    whole = quality_gate(cases, minimum_reduction, mean_regression, case_regression)
    none = F.lit(None).cast("string").alias("case_id")
    out = cases.select(F.lit("case").alias("check"), F.col(case_id).cast("string").alias("case_id"), (F.col("optimized_score") - F.col("original_score")).alias("value")).where(F.col("value") < -case)
    out = out.unionByName(whole.where(F.col("aggregate_reduction") < minimum_reduction).select(F.lit("reduction").alias("check"), none, F.col("aggregate_reduction").alias("value")))
    return out.unionByName(whole.where(F.col("mean_delta") < -mean_regression).select(F.lit("mean").alias("check"), none, F.col("mean_delta").alias("value")))


def policy(df: DataFrame, original: str = "text", optimized: str = "optimized_text", minimum_reduction: float | None = None, max_output_bytes: int | None = None, detection: str | None = None) -> DataFrame:
    """Adds ``failures`` (all that apply) and ``passed``."""
    checks = []
    if minimum_reduction is not None:
        checks.append((percentage(size16(F.col(original)) - size16(F.col(optimized)), size16(F.col(original)), 2) < minimum_reduction, "reduction"))
    if max_output_bytes is not None:
        checks.append((F.octet_length(optimized) > max_output_bytes, "bytes"))
    if detection is not None:
        checks.append((F.col("detection.type") != detection, "detection"))
    failures = F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in checks))) if checks else F.array().cast("array<string>")
    return df.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)
