"""Incremental terminal cleanup: one open line and one open run per stream, kept as state."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import HIGH_SIGNAL, WHITE
from ..operators.cleaners import ANSI, units


def _java(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern).replace(r"\z", r"\Z")


_ANSI, _SIGNAL = re.compile(_java(ANSI)), re.compile(_java(HIGH_SIGNAL))
_TRAIL, _MARK = re.compile(r"[\t ]+\Z"), re.compile(r"\[repeated [0-9]+ times\]\Z")
_NOT_WHITE = f"[^{_java(WHITE)}]"
_GAP = re.compile(f"(?<={_NOT_WHITE}) {{3,}}(?={_NOT_WHITE})")
_LINE = re.compile(r"\r?\n")


class TerminalCleaner:
    """Feed chunks, get cleaned text; ``finish`` flushes. The state is a small dict, whatever the stream's length."""

    def __init__(self, state: dict | None = None, max_bytes: int = 16 << 20, max_line_bytes: int = 1 << 20):
        if max_line_bytes <= 0:
            raise ValueError("max_line_bytes must be positive")
        self.max_bytes, self.max_line_bytes = max_bytes, max_line_bytes
        self.s = state or {"pending": "", "blank": 0, "line": None, "eol": "", "n": 0, "bytes": 0, "ansi": 0, "whitespace": 0, "duplicates": 0}

    def _flush(self) -> str:
        s, line = self.s, self.s["line"]
        if line is None:
            return ""
        mark, n = f" [repeated {s['n']} times]", s["n"]
        fold = n >= 2 and not _MARK.search(line) and not _SIGNAL.search(line) and units(line) * n > units(line) + len(mark)
        out = f"{line}{mark}{s['eol']}" if fold else (line + s["eol"]) * n
        s["duplicates"] += fold
        s |= {"line": None, "eol": "", "n": 0}
        return out

    def _line(self, raw: str, eol: str) -> str:
        s = self.s
        line, n = _ANSI.subn("", raw)
        s["ansi"] += n
        line, n = _TRAIL.subn("", line)
        s["whitespace"] += n
        if "|" not in line:
            line, n = _GAP.subn(" ", line)
            s["whitespace"] += n
        if line == "":
            out = self._flush()
            s["blank"] += 1
            s["whitespace"] += s["blank"] > 1
            return out + (eol if s["blank"] <= 1 else "")
        s["blank"] = 0
        if (s["line"], s["eol"]) == (line, eol):
            s["n"] += 1
            return ""
        out = self._flush()
        s |= {"line": line, "eol": eol, "n": 1}
        return out

    def feed(self, chunk: str) -> str:
        s = self.s
        s["bytes"] += len(chunk.encode())
        if s["bytes"] > self.max_bytes:
            raise ValueError("input-limit: stream bytes")
        text, out, at = s["pending"] + chunk, [], 0
        for m in _LINE.finditer(text):
            out.append(self._line(text[at : m.start()], m[0]))
            at = m.end()
        s["pending"] = text[at:]
        if len(s["pending"].encode()) > self.max_line_bytes:
            raise ValueError("input-limit: line bytes")
        return "".join(out)

    def finish(self) -> str:
        last = self._line(self.s["pending"], "") if self.s["pending"] else ""
        self.s["pending"] = ""
        return last + self._flush()


OUT = T.StructType([T.StructField("stream", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("text", T.StringType()), T.StructField("stats", T.StringType())])


class _Processor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cleaner", T.StructType([T.StructField("json", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq")
        cleaner = TerminalCleaner(json.loads(self.state.get()[0]) if self.state.exists() else None)
        text, ended = [], False
        for r in pdf.itertuples():
            text.append(cleaner.feed(r.chunk or ""))
            ended = ended or bool(r.last)
        stats = None
        if ended:
            text.append(cleaner.finish())
            stats = json.dumps({k: cleaner.s[k] for k in ("bytes", "ansi", "whitespace", "duplicates")})
            self.state.clear()
        else:
            self.state.update((json.dumps(cleaner.s),))
        yield pd.DataFrame({"stream": [key[0]], "seq": [int(pdf["seq"].max())], "text": ["".join(text)], "stats": [stats]})

    def close(self) -> None:
        pass


def clean_stream(chunks: DataFrame) -> DataFrame:
    """(stream, seq, chunk, last) to cleaned text as it becomes final; ``last`` marks a stream's end and gives its stats."""
    return chunks.groupBy("stream").transformWithStateInPandas(statefulProcessor=_Processor(), outputStructType=OUT, outputMode="append", timeMode="none")


def clean_batch(chunks: DataFrame) -> DataFrame:
    """The same over a finished table of chunks: one row per stream."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = TerminalCleaner()
        text = "".join(c.feed(x or "") for x in pdf.sort_values("seq")["chunk"]) + c.finish()
        return pd.DataFrame({"stream": [pdf["stream"].iloc[0]], "text": [text], "ansi": [c.s["ansi"]], "whitespace": [c.s["whitespace"]], "duplicates": [c.s["duplicates"]]})

    return chunks.groupBy("stream").applyInPandas(run, "stream string, text string, ansi long, whitespace long, duplicates long")
