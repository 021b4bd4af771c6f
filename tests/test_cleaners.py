import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import cleaners, detect
from loomtext.operators import optimize as opt
from loomtext.streaming.terminal import TerminalCleaner


def reduced(spark, texts, **about):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r for r in opt.optimize(df, **about).orderBy("id").collect()]


def test_detection(spark):
    log = "\n".join(f"[00:00:0{i}] building stage {i}" for i in range(6))
    trace = "TypeError: x\nError: y\n" + "\n".join(f"    at f{i} (app.js:{i}:1)" for i in range(6)) + "x" * 100
    tests = "\n".join(f"  ✓ case {i}" for i in range(9)) + "\n" + "y" * 150
    prose = "A sentence that ends with a full stop and is long enough to count.\n" * 5
    code = "\n".join(f"const a{i} = {i};" for i in range(25))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([log, trace, tests, prose, code, " \n ", "short"])], "id int, text string")
    got = [(r.t, r.c) for r in detect.detect(df).orderBy("id").select(F.col("detection.type").alias("t"), F.col("detection.confidence").alias("c")).collect()]
    assert got == [("generic-terminal-output", "high"), ("stack-trace", "high"), ("test-output", "high"), ("unknown", "medium"), ("source-code", "high"), ("unknown", "high"), ("unknown", "high")]


def test_ansi_cases(spark):
    texts = ["\x1b[31mred\x1b[0m", "\x1b]0;title\x07x", "\x1b]8;;u\x1b\\link", "a\x1bPq\x1b\\b", "\x9b1mz", "q\x85r", "tail\x1b[12", "\x1b(Bx"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = cleaners.strip_ansi(detect.detect(df), "text", "detection", "n").orderBy("id").collect()
    assert [r.text for r in got] == ["red", "x", "link", "ab", "z", "qr", "tail", "x"]
    assert [r.n for r in got] == [2, 1, 1, 1, 1, 1, 1, 1]


def test_safe_pipeline_counts(spark):
    line = "[00:00:01] pulling layer"
    text = "\x1b[32mstart\x1b[0m\n" + "\n".join([line] * 5) + "  \n\n\n\n\nname    value\na  |    b\nerror: lost\nerror: lost\n[00:00:02] x\n"
    r = reduced(spark, [text, None])[0]
    assert r.optimized_text == f"start\n{line} [repeated 5 times]\n\nname value\na  |    b\nerror: lost\nerror: lost\n[00:00:02] x\n"
    assert [d.changes for d in r.decisions] == [2, 3, 1, 0, 0, 0]
    assert r.transformations == {"ansi": 2, "whitespace": 3, "duplicate-lines": 1}
    assert [d.reason for d in r.decisions][3:] == ["disabled-by-preset"] * 3


def test_kernels():
    frame = "    at handler (app.js:10:5)"
    text, n = cleaners.stack_kernel("Error: x\n" + "\n".join([frame] * 6) + "\nend", False)
    assert (text, n) == (f"Error: x\n{frame} [repeated 6 times]\nend", 1)
    record = '  File "a.py", line 3, in f\n    call()'
    text, n = cleaners.stack_kernel("\n".join([record] * 5), True)
    assert (text, n) == ('  File "a.py", line 3, in f [repeated 5 times]\n    call()', 1)
    assert cleaners.block_kernel("one line\ntwo line\n" * 4) == ("one line\ntwo line\n[block repeated 4 times]\n", 1)
    assert cleaners.block_kernel("a\nb\n" * 3) == ("a\nb\n" * 3, 0)


def test_passing_reports(spark):
    go = "\n".join(f"=== RUN   Test{i}\n--- PASS: Test{i} (0.00s)" for i in range(9)) + "\nok  pkg 0.1s\n" + "z" * 80
    bad = go + "\n--- FAIL: TestX"
    a, b = reduced(spark, [go, bad], preset="balanced")
    assert a.optimized_text.startswith("✓ 9 test cases passed\nok  pkg") and b.optimized_text == bad


def test_structured(spark):
    texts = ['{ "a" : [1.0, 1e5, "x \\" y"] , "a": 2 }', "1\n2\n", "{'a': 1}", '{"a": NaN}', "[1] tail", '{"a": 1}\n\n{"b": 2}\n', ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = opt.optimize_structured(df).orderBy("id").collect()
    assert [r.kind for r in got] == ["json", "jsonl", "text", "text", "text", "jsonl", "text"]
    assert got[0].optimized_text == '{"a":[1.0,1e5,"x \\" y"],"a":2}' and got[5].optimized_text == '{"a":1}\n{"b":2}\n' and got[2].optimized_text == texts[2]


def test_stream_is_chunk_independent():
    text = "\x1b[31mred\x1b[0m  \r\n" + "pulling layer one\n" * 4 + "\n\n\nerror: x\nerror: x\na    b\n last"
    whole = TerminalCleaner()
    want = whole.feed(text) + whole.finish()
    assert want == "red\r\npulling layer one [repeated 4 times]\n\nerror: x\nerror: x\na b\n last"
    rng = random.Random(1)
    for _ in range(30):
        c, out, at = TerminalCleaner(), "", 0
        while at < len(text):
            n = rng.randint(1, 9)
            out += c.feed(text[at : at + n])
            at += n
        assert out + c.finish() == want and c.s["duplicates"] == 1
    with pytest.raises(ValueError):
        TerminalCleaner(max_bytes=3).feed("four")
