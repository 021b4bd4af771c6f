"""Classification of content, structured data and commands."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WHITE, D, END, N, S, START, size16, trim_white

#: white space within a line of a text whose line ends are line feeds
_S = f"[{WHITE}]".replace(r"\n", "")
_EOL = r"(?=\n|\z)"
#: fixed values: line shapes that the content rules count; each begins where a line begins and ends in it
PATTERNS = {
    "tests": rf"(?:{_S}*+[✓√✔×✗✘✕]{_S}|(?:PASS|FAIL){END}|{N}+::{N}+{_S}+(?:PASSED|FAILED)(?:{_S}|{_EOL})|{_S}*---{_S}+(?:PASS|FAIL):{_S}+{N}|test{_S}+{N}+{_S}+\.\.\.{_S}+(?:ok|FAILED){_EOL})",
    "summaries": rf"{_S}*+(?:Test Files|Tests(?::|{_S})|Snapshots{_S}|Test Suites|=+{_S}+\d+{_S}+(?:passed|failed)|test result:|ok{_S}+{N})",
    "frames": rf"(?:{_S}*+at{_S}{D}|{_S}++File{_S}\"{D}+\",{_S}line{_S}\d+,{_S}in{_S})",
    "headers": rf"(?:[^\n]*?{START}(?:Error|Exception|Traceback){END})",
    "code": rf"{_S}*+(?:(?:import|export|const|let|var|function|class|interface|type|return|case){_S}|(?:if|for|while|switch){_S}*+\(|=>)",
    "terminal": rf"(?:\[\d\d:\d\d:\d\d(?:\.\d+)?\]|#\d+{_S}|npm{_S}+(?:(?:WARN|warn|error|notice){END}|ERR!(?=[A-Za-z0-9_]))|Level{_S}+\d+{_S}+progress:|(?:added|removed|changed){_S}+\d+{_S}+packages?{END}|up to date|found{_S}+\d+{_S}+vulnerabilit)",
}
#: strings of which a text with such a line has one
NEEDED = {
    "tests": (*"✓√✔×✗✘✕", "PASS", "FAIL", "..."),
    "summaries": ("Test", "Snapshots", "passed", "failed", "test result:", "ok"),
    "frames": ("at", "File"),
    "headers": ("Error", "Exception", "Traceback"),
    "code": ("import", "export", "const", "let", "var", "function", "class", "interface", "type", "return", "case", "if", "for", "while", "switch", "=>"),
    "terminal": ("[", "#", "npm", "progress:", "package", "up to date", "vulnerabilit"),
}
TERMINAL = "generic-terminal-output"


def describe(kind: Column) -> Column:
    """The name under which a content type is shown: the type itself."""
    return kind


def detect(df: DataFrame, text: str = "text", out: str = "detection") -> DataFrame:
    """Adds ``out``: struct<type, confidence>. One narrow projection; each shape is one search over the whole text, so no list of lines is made."""
    t = F.col(text)
    lines = F.concat(F.lit("\n"), F.when(F.contains(t, F.lit("\r\n")), F.replace(t, F.lit("\r\n"), F.lit("\n"))).otherwise(t))
    df = df.withColumn("__t", lines)

    def count(name: str) -> Column:
        # a line begins at its line feed: a first character that the search finds fast
        found = F.regexp_count("__t", F.lit(r"\n" + PATTERNS[name]))
        needed = reduce(Column.__or__, (F.contains(t, F.lit(x)) for x in NEEDED[name]))
        return F.when(needed, found).when(t.isNotNull(), 0)

    df = df.withColumns({f"__{k}": count(k) for k in PATTERNS} | {
        "__ansi": F.contains(t, F.lit("\x1b[")).cast("int"), "__prose": F.regexp_count("__t", F.lit(rf"[.!?][\"')]?{_S}*+{_EOL}")), "__n": F.length("__t") - F.length(F.replace("__t", F.lit("\n"), F.lit(""))),
        "__size": size16(t), "__blank": ~t.rlike(N),
    })
    c = {k: F.col(f"__{k}") for k in [*PATTERNS, "ansi", "prose", "n", "size", "blank"]}

    def label(kind: str, confidence) -> Column:
        return F.struct(F.lit(kind).alias("type"), (F.lit(confidence) if isinstance(confidence, str) else confidence).alias("confidence"))

    share = c["code"] / c["n"]
    rules = (
        F.when(c["blank"] | ((c["size"] < 200) & (c["n"] <= 3)), label("unknown", "high"))
        .when((c["tests"] >= 3) | ((c["tests"] >= 1) & (c["summaries"] >= 1)), label("test-output", F.when(c["tests"] >= 8, "high").otherwise("medium")))
        .when(c["frames"] >= 3, label("stack-trace", F.when(c["headers"] < 1, "low").when(c["frames"] >= 5, "high").otherwise("medium")))
        .when(((share >= 0.4) & (c["code"] >= 6)) | ((share >= 0.8) & (c["code"] >= 3)), label("source-code", F.when(c["code"] >= 20, "high").otherwise("medium")))
        .when((c["ansi"] > 0) | ((c["terminal"] >= 3) & (c["terminal"] / c["n"] >= 0.25)), label(TERMINAL, "high"))
        .when((c["prose"] / c["n"] >= 0.6) & (c["prose"] >= 2) & (c["size"] >= 120), label("unknown", "medium"))
        .otherwise(label(TERMINAL, "medium"))
    )
    return df.withColumn(out, rules).drop("__t", *(f"__{k}" for k in c))


def strict_json(text: str) -> bool:
    """Whether a JSON parser without extensions takes the whole text; numbers are not converted."""

    def refuse(_):
        raise ValueError

    try:
        json.loads(text, parse_constant=refuse, parse_int=str, parse_float=str)
        return True
    except (ValueError, RecursionError):
        return False


def json_kind(text: str) -> str:
    lines = [x for x in text.replace("\r\n", "\n").split("\n") if x.strip()]
    if text[:1] in "{[" and text and strict_json(text):
        return "json"
    return "jsonl" if len(lines) >= 2 and all(map(strict_json, lines)) else "text"


@F.pandas_udf(T.StringType())
def _kind(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: json_kind(t) if t is not None else None)


def structured_kind(text: Column) -> Column:
    """json, jsonl or text. Only texts whose first line can begin a JSON value reach the validator."""
    t = trim_white(text)
    gated = F.when(t.rlike(r'\A(?:[\[{"\-0-9]|true|false|null)'), t)
    return F.coalesce(_kind(gated), F.lit("text"))


#: fixed values: executables by family
FAMILIES = {
    "test": ["jest", "vitest", "pytest", "cargo", "go", "rspec"],
    "build": ["npm", "npx", "pnpm", "yarn", "tsc", "eslint", "ruff"],
    "logs": ["docker", "kubectl", "terraform", "journalctl"],
    "version-control": ["git", "gh"],
    "read": ["cat", "sed", "head", "tail", "rg", "grep", "find", "ls", "tree"],
}


def command_profile(command: Column) -> Column:
    """struct<family, executable, preset, confidence> of a command line; the command is never run."""
    first = F.element_at(F.split(trim_white(command), f"{S}+"), 1)
    exe = F.lower(F.regexp_extract(first, r"([^/]*)/*\z", 1))
    family = F.lit("unknown")
    for name, names in reversed(FAMILIES.items()):
        family = F.when(exe.isin(names), name).otherwise(family)
    tests = command.rlike(rf"(?:^|{S})(?:test|run{S}+test)(?:{S}|\z)")
    build = family == "build"
    return F.struct(
        F.when(build & tests, "test").otherwise(family).alias("family"), exe.alias("executable"),
        F.when(family.isin("test", "build", "logs"), "balanced").otherwise("safe").alias("preset"),
        F.when(build, "medium").when(family == "unknown", "low").otherwise("high").alias("confidence"),
    )
