"""Presets, the cleaner pipeline and its routes: structured, by command, Markdown segments, messages, audits."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import estimate_tokens, percentage, size16, trim_white
from ..limits import MAX_CHARACTERS, InputLimitError, checked_limit
from .cleaners import CLEANERS, ORDER
from .detect import command_profile, detect, structured_kind

PRESETS = {"safe": ORDER[:3], "balanced": ORDER[:5], "aggressive": ORDER}
DECISIONS = "array<struct<cleaner:string,enabled:boolean,changes:int,reason:string>>"


def resolve(preset: str = "safe", overrides: dict[str, bool] | None = None) -> dict[str, bool]:
    """Which cleaners run; an unknown preset is safe, and overrides can turn cleaners on or off."""
    on = set(PRESETS.get(preset, PRESETS["safe"]))
    return {c: (overrides or {}).get(c, c in on) for c in ORDER}


def sizes(text: str, out: str, tokens: bool | Callable[[Column], Column] = False) -> Column:
    """The stats struct: characters and their reduction; with ``tokens``, also those of the estimate (``True``) or of a counter, which is exact."""
    a, b = size16(F.col(text)), size16(F.col(out))
    stats = [a.alias("original_characters"), b.alias("optimized_characters"), (a - b).alias("characters_removed"), percentage(a - b, a).alias("reduction_percentage")]
    if tokens:
        count = estimate_tokens if tokens is True else tokens
        x, y = count(F.col(text)), count(F.col(out))
        stats += [x.alias("original_tokens"), y.alias("optimized_tokens"), (x - y).alias("tokens_removed"), percentage(x - y, x).alias("token_reduction_percentage"), F.lit(tokens is not True).alias("exact")]
    return F.struct(*stats)


def optimize(df: DataFrame, text: str = "text", preset: str = "safe", overrides: dict | None = None, out: str = "optimized_text", tokens: bool | Callable[[Column], Column] = False, max_characters: int = MAX_CHARACTERS) -> DataFrame:
    """Adds ``out``, ``detection``, ``decisions`` (six, in order), ``transformations`` (changed cleaners only) and ``stats``.

    The raw text is classified once; cleaners that are off are not in the plan at all. A text beyond ``max_characters`` fails
    the query; a null text stays null.
    """
    on = resolve(preset, overrides)
    checked_limit(max_characters, "max_characters")
    guard = F.when(size16(F.col(text)) > max_characters, F.raise_error(F.lit(str(InputLimitError(None, max_characters)))).cast("string")).otherwise(F.col(text))
    df = detect(df.withColumn(out, guard), out, "detection")
    for c in ORDER:
        if not on[c]:
            df = df.withColumn(f"__n_{c}", F.lit(0))
        else:
            df = CLEANERS[c](df, out, "detection", f"__n_{c}")
    df = df.withColumns({f"__n_{c}": F.coalesce(f"__n_{c}", F.lit(0)) for c in ORDER})
    reason = {c: F.when(F.col(f"__n_{c}") > 0, "applied").otherwise("not-applicable") if on[c] else F.lit("disabled-by-preset") for c in ORDER}
    decisions = [F.struct(F.lit(c).alias("cleaner"), F.lit(on[c]).alias("enabled"), F.col(f"__n_{c}").alias("changes"), reason[c].alias("reason")) for c in ORDER]
    df = df.withColumn("decisions", F.array(*decisions)).withColumn("transformations", changed({c: F.col(f"__n_{c}") for c in ORDER}))
    return df.withColumn("stats", sizes(text, out, tokens)).drop(*(f"__n_{c}" for c in ORDER))


def changed(counts: dict[str, Column]) -> Column:
    """Map of the cleaners with changes to their number."""
    return F.map_filter(F.create_map(*(x for c, n in counts.items() for x in (F.lit(c), n))), lambda _, n: n > 0)


def observed(df: DataFrame, observation: Observation | str) -> DataFrame:
    """``df`` of ``optimize``, whose rows, characters and changes per cleaner are reported to an observer as they pass: sums only, no texts."""
    sums = [F.count(F.lit(1)).alias("rows"), F.sum("stats.original_characters").alias("original_characters"), F.sum("stats.optimized_characters").alias("optimized_characters")]
    return df.observe(observation, *sums, *(F.sum(F.col("decisions")[i]["changes"]).alias(c) for i, c in enumerate(ORDER)))


def compact_json(text: Column, kind: Column) -> Column:
    """White space outside strings goes; JSON Lines keep one line each. Numbers, keys and their order stay as spelled."""
    outside = r'("[^"\\]*+(?:\\[\s\S][^"\\]*+)*+")|\s+'
    one = F.regexp_replace(trim_white(text), outside, "$1")
    rows = F.filter(F.split(text, r"\r?\n"), lambda x: trim_white(x) != "")
    many = F.concat(F.array_join(F.transform(rows, lambda x: F.regexp_replace(trim_white(x), outside, "$1")), "\n"), F.when(text.endswith("\n"), "\n").otherwise(""))
    made = F.when(kind == "json", one).when(kind == "jsonl", many).otherwise(text)
    return F.when(size16(made) <= size16(text), made).otherwise(text)


def optimize_structured(df: DataFrame, text: str = "text", out: str = "optimized_text") -> DataFrame:
    df = df.withColumn("kind", structured_kind(F.col(text))).withColumn(out, compact_json(F.col(text), F.col("kind")))
    return df.withColumn("changed", F.col(out) != F.col(text)).withColumn("lexically_lossless", F.col("kind") != "text")


def optimize_context(df: DataFrame, text: str = "text", command: str | None = None, preset: str | None = None, structured: bool = True, out: str = "optimized_text", **about) -> DataFrame:
    """Routes each row: JSON is compacted, a command picks the preset unless one is given, the rest is generic.

    Adds ``out``, ``strategy``, ``kind``, ``lexically_lossless``, ``command_profile`` (null without a command) and all that ``optimize`` adds; a JSON row has one
    decision, ``structured-json`` or ``structured-jsonl``. Rows are split by route, so that each plan has its own cleaners only; the source
    is read once a route, three times at most.
    """
    df = optimize_structured(df, text, "__json") if structured else df.withColumns({"kind": F.lit("text"), "__json": F.col(text), "changed": F.lit(False), "lexically_lossless": F.lit(False)})
    is_json = F.col("kind") != "text"
    named = F.coalesce(F.col(command), F.lit("")) != "" if command else F.lit(False)
    profile = command_profile(F.col(command)) if command else F.lit(None).cast("struct<family:string,executable:string,preset:string,confidence:string>")
    df = df.withColumn("strategy", F.when(is_json, "structured").when(named, "command").otherwise("generic")).withColumn("command_profile", F.when(named, profile))
    chosen = F.when(named, profile["preset"]).otherwise("safe") if command and not preset else F.lit(preset or "safe")
    df = df.withColumn("__preset", F.when(is_json, "json").otherwise(chosen))
    count = F.col("changed").cast("int")
    own = F.array(F.struct(F.concat(F.lit("structured-"), "kind").alias("cleaner"), F.lit(True).alias("enabled"), count.alias("changes"), F.when(F.col("changed"), "applied").otherwise("not-applicable").alias("reason")))
    made = detect(df.where("__preset = 'json'").withColumn(out, F.col("__json")), text, "detection").withColumn("decisions", own)
    made = made.withColumn("transformations", F.map_filter(F.create_map(F.concat(F.lit("structured-"), "kind"), count), lambda _, n: n > 0))
    made = made.withColumn("stats", sizes(text, out, about.get("tokens", False)))
    for p in [preset] if preset else ["safe", "balanced"] if command else ["safe"]:
        made = made.unionByName(optimize(df.where(F.col("__preset") == p), text, p, out=out, **about))
    return made.drop("__json", "__preset", "changed")


#: fixed values: fence labels whose content counts as terminal output
TERMINAL_LABELS = ("console", "console-output", "shell-session", "terminal", "terminal-output")
_FENCE = re.compile(r"^[ \t]{0,3}(`{3,}|~{3,})[ \t]*([A-Za-z0-9_-]*)[^\r\n]*(?:\r?\n|\Z)", re.M)


def fenced_parts(text: str) -> tuple[int, list[dict]]:
    """(closed fences, the text cut at terminal fences): parts {text, label}, label null outside.

    One pass over the fence lines; the closing line is looked up by character and length.
    """
    marks = list(_FENCE.finditer(text))
    closers: dict[str, dict[int, list[int]]] = {"`": {}, "~": {}}
    for k, m in enumerate(marks):
        if not m[2]:
            closers[m[1][0]].setdefault(len(m[1]), []).append(k)
    parts, at, k, found = [], 0, 0, 0
    while k < len(marks):
        m = marks[k]
        after = [places[i] for n, places in closers[m[1][0]].items() if n >= len(m[1]) and (i := bisect_right(places, k)) < len(places)]
        if not after:
            k += 1
            continue
        close, label = min(after), m[2].lower()
        found += 1
        if label in TERMINAL_LABELS:
            parts += [{"text": text[at : m.end()], "label": None}, {"text": text[m.end() : marks[close].start()], "label": label}]
            at = marks[close].start()
        k = close + 1
    return found, [*parts, {"text": text[at:], "label": None}]


_PART = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])


@F.pandas_udf(T.StructType([T.StructField("found", T.IntegerType()), T.StructField("parts", T.ArrayType(_PART))]))
def _fences(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fenced_parts(t) if t is not None else (0, None) for t in texts], columns=["found", "parts"])


def optimize_segments(df: DataFrame, text: str = "text", preset: str = "safe", out: str = "optimized_text", overrides: dict | None = None) -> DataFrame:
    """Adds ``out``, ``segments``, ``segments_found``, ``segments_optimized``, ``detection``, ``decisions``, ``transformations`` and ``stats``.

    Only terminal-labelled Markdown fences are reduced, all else stays byte for byte. Parts are rows of their own while they are
    reduced and meet again by a number of their row, so rows may repeat; a null text stays null. As in an all-off
    run, decisions are not enabled; those with changes are applied.
    """
    doc = detect(df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__f", _fences(F.col(text))), text, "__d")
    doc = doc.select("__row", F.col("__f.found").alias("found"), F.col("__d").alias("detected"), F.struct(*df.columns).alias("doc"), F.posexplode_outer("__f.parts").alias("pos", "part"))
    first = F.coalesce("pos", F.lit(0)) == 0
    parts = doc.select("__row", "found", "detected", "pos", F.when(first, F.col("doc")).alias("doc"), F.col("part.text").alias("text"), F.col("part.label").alias("label"))
    parts = optimize(parts.withColumn("__in", F.when(F.col("label").isNotNull(), F.col("text"))), "__in", preset, overrides, out="__out")
    part = F.struct("pos", F.coalesce("__out", "text").alias("made"), "label", F.col("text").alias("was"), F.col("decisions.changes").alias("n"))
    rows = parts.groupBy("__row").agg(F.first("doc", True).alias("doc"), F.first("found").alias("segments_found"), F.first("detected").alias("detection"), F.sort_array(F.collect_list(part)).alias("p"))
    found = F.transform(
        F.filter("p", lambda x: x["label"].isNotNull()),
        lambda x, i: F.struct(i.alias("index"), x["label"].alias("language"), (x["made"] != x["was"]).alias("changed"), size16(x["was"]).alias("original_characters"), size16(x["made"]).alias("optimized_characters")),
    )
    made = F.when(F.get("p", F.lit(0))["made"].isNotNull(), F.array_join("p.made", ""))
    counts = {c: F.aggregate(F.transform("p", lambda x: x["n"][ORDER.index(c)]), F.lit(0), lambda n, x: n + x) for c in ORDER}
    rows = rows.select("doc.*", made.alias(out), found.alias("segments"), "segments_found", "detection", *(n.alias(f"__n_{c}") for c, n in counts.items()))
    n = {c: F.col(f"__n_{c}") for c in ORDER}
    decisions = F.array(*(F.struct(F.lit(c).alias("cleaner"), F.lit(False).alias("enabled"), n[c].alias("changes"), F.when(n[c] > 0, "applied").otherwise("disabled-by-preset").alias("reason")) for c in ORDER))
    a, b = size16(F.col(text)), size16(F.col(out))
    stats = F.struct(a.alias("original_characters"), b.alias("optimized_characters"), (a - b).alias("characters_removed"), F.when(a == 0, 0.0).otherwise((a - b) / a * 100).alias("reduction_percentage"))
    rows = rows.withColumns({"segments_optimized": F.size(F.filter("segments", lambda x: x["changed"])), "decisions": decisions, "transformations": changed(n), "stats": stats})
    return rows.drop(*(f"__n_{c}" for c in ORDER))


def optimize_messages(df: DataFrame, text: str = "text", role: str = "role", roles=("user", "tool"), preset: str = "safe") -> DataFrame:
    """Messages of the given roles reduced, others as they are; all other columns pass through."""
    df = optimize(df.withColumn("__in", F.when(F.col(role).isin(*roles), F.col(text))), "__in", preset)
    return df.withColumn("optimized_text", F.coalesce("optimized_text", text)).drop("__in")


def message_totals(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """Totals per conversation over the messages that were reduced, from ``optimize_messages``; percentage with two decimals.

    ``transformations`` merges the messages' changes; ``message_stats`` has (index, role, stats) of each reduced message, by its place among
    all of the conversation's. Messages with one turn are ordered by role and sizes.
    """
    a, b = F.sum("stats.original_characters"), F.sum("stats.optimized_characters")
    own = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), "stats")
    sums = [F.coalesce(F.sum(F.col("decisions")[i]["changes"]), F.lit(0)).alias(f"__n_{c}") for i, c in enumerate(ORDER)]
    out = df.groupBy(conv).agg(F.coalesce(a, F.lit(0)).alias("original_characters"), F.coalesce(b, F.lit(0)).alias("optimized_characters"), *sums, F.sort_array(F.collect_list(own)).alias("__m"))
    each = F.filter(F.transform("__m", lambda m, i: F.struct(i.alias("index"), m["role"].alias("role"), m["stats"].alias("stats"))), lambda m: m["stats"]["original_characters"].isNotNull())
    removed = F.col("original_characters") - F.col("optimized_characters")
    out = out.withColumns({"characters_removed": removed, "reduction_percentage": percentage(removed, F.col("original_characters"), 2), "transformations": changed({c: F.col(f"__n_{c}") for c in ORDER}), "message_stats": each})
    return out.drop("__m", *(f"__n_{c}" for c in ORDER))


def audited(df: DataFrame, text: str = "text", preset: str = "safe", mode: str = "apply") -> DataFrame:
    """Adds delivered text and evidence; shadow mode measures the candidate but delivers the original."""
    df = optimize(df, text, preset, out="candidate_text")
    given = F.col(text) if mode == "shadow" else F.col("candidate_text")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    evidence = F.struct(
        F.lit(1).alias("schema_version"), F.lit(mode).alias("mode"), (F.col("candidate_text") != F.col(text)).alias("changed"), sha(F.col(text)).alias("original_sha256"), sha(F.col("candidate_text")).alias("candidate_sha256"),
        sha(given).alias("delivered_sha256"), size16(F.col(text)).alias("original_characters"), size16(F.col("candidate_text")).alias("candidate_characters"), size16(given).alias("delivered_characters"), F.col("stats.reduction_percentage").alias("reduction_percentage"),
    )
    return df.withColumn("delivered_text", given).withColumn("evidence", evidence)


def retrievable(df: DataFrame, text: str = "text", preset: str = "safe") -> tuple[DataFrame, DataFrame]:
    """(rows with ``original_sha256`` where the text changed, the table of changed originals, one row per hash)."""
    df = optimize(df, text, preset).withColumn("original_sha256", F.when(F.col("optimized_text") != F.col(text), F.sha2(F.col(text).cast("binary"), 256)))
    # the condition is on an aggregate, so that it is not pushed below the cleaners and evaluated once more
    originals = df.groupBy("original_sha256").agg(F.first(text).alias("original"), F.count("original_sha256").alias("__n")).where("__n > 0").drop("__n")
    return df, originals
