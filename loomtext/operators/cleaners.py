"""The six cleaners, each a transform of a DataFrame: the text column is replaced, a count column added.

Escape sequences, white space, duplicate lines and passing tests are native expressions; stack records and repeated
blocks are greedy scans that depend on what was taken before, so they run as Arrow-batched kernels, and only
on rows that pass their gate.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import BLANK, END, HIGH_SIGNAL, MARKED, N, S, WHITE, eol_of, join_lines, lines_of, run_bounds, size16
from .detect import TERMINAL

ORDER = ("ansi", "whitespace", "duplicate-lines", "stack-trace", "test-output", "repeated-blocks")
#: fixed values: control sequences by kind (CSI, OSC, strings, other escapes, and their 8-bit forms)
ANSI = "|".join([
    r"\x1b\[[^\x40-\x7e]*+(?:[\x40-\x7e]|\z)", r"\x1b\][\s\S]*?(?:\x07|\x{9c}|\x1b\\|\z)", r"\x1b[PX^_][\s\S]*?(?:\x{9c}|\x1b\\|\z)", r"\x1b[\x20-\x2f]*+(?:[\s\S]|\z)",
    r"\x{9b}[^\x40-\x7e]*+(?:[\x40-\x7e]|\z)", r"\x{9d}[\s\S]*?(?:\x07|\x{9c}|\x1b\\|\z)", r"[\x{90}\x{98}\x{9e}\x{9f}][\s\S]*?(?:\x{9c}|\x1b\\|\z)", r"[\x{80}-\x{9f}]",
])
TRAILING = r"[\t ]++(?=[\n\r\x{2028}\x{2029}]|\z)"
BLANKS = rf"(?:[{BLANK}]*+\r?\n){{3,}}+"
SOME_BLANK = rf"\n[{BLANK}]*+\r?\n"
GAPS = rf" (?<={N} ) {{2,}}+(?={N})"  # begins with a plain character, which the search finds fast
PASS = rf"^(?:{S}*+[✓√✔]{S}+|{N}+::{N}+{S}+PASSED(?:{S}|\z)|{S}*---{S}+PASS:{S}+{N}+|test{S}+{N}+{S}+\.\.\.{S}+ok\z)"
FAILURE = rf"(?:\A|(?<=[\n\r\x{{2028}}\x{{2029}}]))(?:{S}*[×✗✘✕]{S}+|{S}*FAIL(?:ED)?{END}|{N}+::{N}+{S}+FAILED(?:{S}|\z)|{S}*---{S}+FAIL:{S}+{N}+|test{S}+{N}+{S}+\.\.\.{S}+FAILED(?=[\n\r\x{{2028}}\x{{2029}}]|\z)|test result:{S}+FAILED)"
GO_RUN, GO_PASS = rf"^{S}*=== RUN{S}+({N}+)", rf"^{S}*--- PASS:{S}+({N}+)(?:{S}+\(|\z)"


def is_terminal(detection: str, high: bool = True) -> Column:
    d = F.col(detection)
    return (d["type"] == TERMINAL) & (d["confidence"] == "high") if high else d["type"] == TERMINAL


def strip_ansi(df: DataFrame, text: str, detection: str, count: str) -> DataFrame:
    return df.withColumn(count, F.regexp_count(F.col(text), F.lit(ANSI))).withColumn(text, F.regexp_replace(text, ANSI, ""))


def normalize_whitespace(df: DataFrame, text: str, detection: str, count: str) -> DataFrame:
    """Trailing blanks go, three or more blank line ends become two, gaps inside lines without a bar become one space."""
    ok, t = is_terminal(detection), F.col(text)
    df = df.withColumn("__a", F.when(ok, F.regexp_replace(t, TRAILING, "")).otherwise(t))
    df = df.withColumn("__na", F.when(ok, F.regexp_count(t, F.lit(TRAILING))).otherwise(0))
    some = ok & F.col("__a").rlike(SOME_BLANK)
    df = df.withColumn("__nb", F.when(some, F.regexp_count("__a", F.lit(BLANKS))).otherwise(0)).withColumn("__b", F.when(some, F.regexp_replace("__a", BLANKS, "\n\n")).otherwise(F.col("__a")))
    bars, parts = F.col("__b").contains("|"), F.split("__b", "\n", -1)
    cut = F.when(~bars, F.regexp_replace("__b", GAPS, " ")).otherwise(F.array_join(F.transform(parts, lambda x: F.when(x.contains("|"), x).otherwise(F.regexp_replace(x, GAPS, " "))), "\n"))
    gaps = F.when(~bars, F.regexp_count("__b", F.lit(GAPS))).otherwise(F.aggregate(parts, F.lit(0), lambda n, x: n + F.when(x.contains("|"), 0).otherwise(F.regexp_count(x, F.lit(GAPS)))))
    return df.withColumn(count, F.col("__na") + F.col("__nb") + F.when(ok, gaps).otherwise(0)).withColumn(text, F.when(ok, cut).otherwise(F.col("__b"))).drop("__a", "__b", "__na", "__nb")


def collapse_runs(df: DataFrame, text: str, count: str, ok: Column, lines: str = "__l") -> DataFrame:
    """Runs of equal neighbour lines become one marked line where that is shorter."""
    line = F.col(lines)
    df = df.withColumn("__r", F.when(ok, run_bounds(F.size(line), lambda i: F.get(line, i).eqNullSafe(F.get(line, i - 1)))))

    def piece(r: Column) -> Column:
        x, mark = F.get(line, r["s"]), F.concat(F.lit(" [repeated "), r["n"].cast("string"), F.lit(" times]"))
        shorter = (r["n"] >= 2) & (x != "") & ~x.rlike(MARKED) & ~x.rlike(HIGH_SIGNAL) & (size16(x) * r["n"] > size16(x) + F.length(mark))
        return F.struct(F.when(shorter, F.concat(x, mark)).otherwise(join_lines(F.array_repeat(x, r["n"]), F.col("__e"))).alias("t"), shorter.alias("c"))

    df = df.withColumn("__p", F.transform("__r", piece)).withColumn(count, F.coalesce(F.size(F.filter("__p", lambda p: p["c"])), F.lit(0)))
    df = df.withColumn(count, F.when(ok, F.col(count)).otherwise(0))
    return df.withColumn(text, F.when(F.col(count) > 0, join_lines(F.col("__p.t"), F.col("__e"))).otherwise(F.col(text))).drop("__r", "__p")


def collapse_duplicates(df: DataFrame, text: str, detection: str, count: str) -> DataFrame:
    df = df.withColumn("__ok", is_terminal(detection) & F.col(text).contains("\n")).withColumn("__e", eol_of(F.col(text)))
    df = df.withColumn("__l", F.when(F.col("__ok"), lines_of(F.col(text))))
    return collapse_runs(df, text, count, F.col("__ok")).drop("__ok", "__e", "__l")


def collapse_tests(df: DataFrame, text: str, detection: str, count: str) -> DataFrame:
    """Islands of passing records (a line, or a Go run and its pass) of three tests or more, in reports without a failure."""
    df = df.withColumn("__ok", (F.col(detection)["type"] == "test-output") & ~F.col(text).rlike(FAILURE)).withColumn("__e", eol_of(F.col(text)))
    df = df.withColumn("__l", F.when(F.col("__ok"), lines_of(F.col(text))))
    line = F.col("__l")

    def flag(x: Column, i: Column) -> Column:
        run, after = F.regexp_extract(x, GO_RUN, 1), F.coalesce(F.get(line, i + 1), F.lit(""))
        return F.when(x.rlike(PASS), 1).when((run != "") & (run == F.regexp_extract(after, GO_PASS, 1)), 2).otherwise(0)

    df = df.withColumn("__f", F.transform(line, flag))
    df = df.withColumn("__r", F.when(F.col("__ok"), run_bounds(F.size("__f"), lambda i: (F.get("__f", i) > 0) == (F.get("__f", i - 1) > 0))))

    def piece(r: Column) -> Column:
        own = F.slice(line, r["s"] + 1, r["n"])
        tests = F.size(F.filter(F.slice("__f", r["s"] + 1, r["n"]), lambda f: f == 1))
        short = F.concat(F.regexp_extract(F.get(line, r["s"]), f"^({S}*)", 1), F.lit("✓ "), tests.cast("string"), F.lit(" test cases passed"))
        shorter = (F.get("__f", r["s"]) > 0) & (tests >= 3) & (size16(short) < F.aggregate(own, F.lit(0), lambda n, x: n + size16(x)))
        return F.struct(F.when(shorter, short).otherwise(join_lines(own, F.col("__e"))).alias("t"), shorter.alias("c"))

    df = df.withColumn("__p", F.transform("__r", piece)).withColumn(count, F.when(F.col("__ok"), F.size(F.filter("__p", lambda p: p["c"]))).otherwise(0))
    return df.withColumn(text, F.when(F.col(count) > 0, join_lines(F.col("__p.t"), F.col("__e"))).otherwise(F.col(text))).drop("__ok", "__e", "__l", "__f", "__r", "__p")


def units(x: str) -> int:
    return len(x.encode("utf-16-le", "surrogatepass")) // 2


def _python_class(java: str) -> str:
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", java)


_W = f"[{_python_class(WHITE)}]"
_D = "[^\n\r\u2028\u2029]"
_AT, _PLACE = re.compile(rf"{_W}+at{_W}{_D}+"), re.compile(r"\(|:[0-9]+")
_PY = re.compile(rf"{_W}+File{_W}\"{_D}+\",{_W}line{_W}[0-9]+,{_W}in{_W}{_D}+")
_MARK, _BLOCK_MARK = re.compile(r"\[repeated [0-9]+ times\]\Z"), re.compile(r"\[(?:block )?repeated [0-9]+ times\]")
_INDENT = re.compile(f"{_W}*")


def is_frame(line: str) -> bool:
    return bool(_AT.match(line) and _PLACE.search(line) or _PY.match(line))


def stack_kernel(text: str, forced: bool) -> tuple[str, int]:
    """Equal neighbouring stack records as one marked record: a Python frame with its source line, or a frame line."""
    lines, eol = re.split("\r?\n", text), "\r\n" if "\r\n" in text else "\n"
    if not forced and sum(map(is_frame, lines)) < 5:
        return text, 0
    out, groups, i = [], 0, 0

    def repeats(at: int, size: int) -> int:
        n = 1
        while at + (n + 1) * size <= len(lines) and lines[at : at + size] == lines[at + n * size : at + (n + 1) * size]:
            n += 1
        return n

    while i < len(lines):
        line, done = lines[i], 0
        if is_frame(line) and not _MARK.search(line):
            sizes = [1]
            if _PY.match(line):
                nxt = lines[i + 1] if i + 1 < len(lines) else ""
                deeper = _INDENT.sub("", nxt, count=1) != "" and len(_INDENT.match(nxt)[0]) > len(_INDENT.match(line)[0])
                sizes = [2, 1] if deeper and not is_frame(nxt) else [1]
            for size in sizes:
                n = repeats(i, size)
                if n < 2:
                    continue
                mark, rest = f" [repeated {n} times]", [units(x) for x in lines[i : i + size]]
                # a record is compared with its line ends, a single frame line without
                before, after = (n * sum(rest) + n * size - 1, sum(rest) + len(mark) + size - 1) if _PY.match(line) else (n * rest[0], rest[0] + len(mark))
                if after < before:
                    out += [line + mark, *lines[i + 1 : i + size]]
                    groups, done = groups + 1, n * size
                    break
            if not done:
                done = repeats(i, 1)
                out += lines[i : i + done]
                if done > 1 and _PY.match(line) and units(line) * done > units(line) + len(f" [repeated {done} times]"):
                    out[-done:] = [f"{line} [repeated {done} times]"]
                    groups += 1
        else:
            out.append(line)
            done = 1
        i += done
    return (eol.join(out), groups) if groups else (text, 0)


def block_kernel(text: str) -> tuple[str, int]:
    """Blocks of 8 down to 2 lines that follow each other three times or more, largest first, as one block and a marker."""
    eol = "\r\n" if "\r\n" in text else "\n"
    lines = text.split(eol)
    tail = eol if text.endswith(eol) else ""
    if tail:
        lines.pop()
    out, groups, i = [], 0, 0
    unfit = [_INDENT.sub("", x, count=1) == "" or bool(_BLOCK_MARK.search(x)) for x in lines]
    while i < len(lines):
        size = n = 0
        for size in range(min(8, (len(lines) - i) // 3), 1, -1):
            if any(unfit[i : i + size]):
                continue
            n = 1
            while lines[i : i + size] == lines[i + n * size : i + (n + 1) * size]:
                n += 1
            if n >= 3:
                break
        if n < 3:
            out.append(lines[i])
            i += 1
            continue
        whole, short = lines[i : i + n * size], [*lines[i : i + size], f"[block repeated {n} times]"]
        if units(eol.join(short)) < units(eol.join(whole)):
            out, groups = out + short, groups + 1
        else:
            out += whole
        i += n * size
    return eol.join(out) + tail, groups


CLEANED = T.StructType([T.StructField("text", T.StringType()), T.StructField("count", T.IntegerType())])


@F.pandas_udf(CLEANED)
def _stack(texts: pd.Series, forced: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([stack_kernel(t, bool(f)) if t is not None else (None, 0) for t, f in zip(texts, forced)], columns=["text", "count"])


@F.pandas_udf(CLEANED)
def _blocks(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([block_kernel(t) if t is not None else (None, 0) for t in texts], columns=["text", "count"])


def _kernel(df: DataFrame, text: str, count: str, result: Column) -> DataFrame:
    df = df.withColumn("__k", result)
    return df.withColumn(count, F.coalesce("__k.count", F.lit(0))).withColumn(text, F.coalesce("__k.text", text)).drop("__k")


def collapse_stacks(df: DataFrame, text: str, detection: str, count: str) -> DataFrame:
    forced = F.col(detection)["type"].isin("stack-trace", "test-output")
    gate = F.col(text).rlike(rf"(?:\A|\n){S}+(?:at|File){S}")  # no kernel call without a frame
    return _kernel(df, text, count, _stack(F.when(gate, F.col(text)), forced))


def collapse_blocks(df: DataFrame, text: str, detection: str, count: str) -> DataFrame:
    return _kernel(df, text, count, _blocks(F.when(is_terminal(detection, high=False), F.col(text))))


CLEANERS = dict(zip(ORDER, (strip_ansi, normalize_whitespace, collapse_duplicates, collapse_stacks, collapse_tests, collapse_blocks)))
