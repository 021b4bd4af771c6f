"""Repeated and odd rows, limits, counters, segments, routes, metrics and evaluation."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from loomtext.functions.text import counter, from_encoder, from_tokenizer
from loomtext.operators import context, evaluation, metrics
from loomtext.operators import optimize as opt
from loomtext.sources.completions import service
from loomtext.sources.files import envelope, read_texts, rendered, workload_report

LOG = "[00:00:01] pulling layer\n" * 5 + "\x1b[31mend\x1b[0m"


def fails(df, words):
    with pytest.raises(Exception, match=words):
        df.collect()


def test_budget_refuses_what_it_cannot_number(spark):
    schema = "g string, idx int, tokens long, score double, text string"
    rows = [("g", 0, 1, 1.0, "a"), ("g", 1, 1, 2.0, "b"), (None, 0, 1, 1.0, "c")]
    got = context.fit_budget(spark.createDataFrame(rows, schema), "g", 1)
    assert got.columns == [*schema.replace(",", "").split()[::2], "selected"]
    assert {(r.g, r.idx): r.selected for r in got.collect()} == {("g", 0): False, ("g", 1): True, (None, 0): True}
    for extra, words in ((("g", 1, 1, 1.0, ""), "repeated"), (("g", None, 1, 1.0, ""), "null or repeated"), (("g", 2, -1, 1.0, ""), "negative"), (("g", 2, 1, float("nan"), ""), "finite")):
        fails(context.fit_budget(spark.createDataFrame([*rows, extra], schema), "g", 1), words)
    fails(context.fit_budget(spark.createDataFrame(rows, schema), "g", 1, most_items=1), "more than 1 items")
    assert context.fit_budget(spark.createDataFrame([], schema), "g", 1).count() == 0


def test_segments_of_repeated_rows(spark):
    md = f"# A\n~~~\nx   y\n~~~\n```console\n{LOG}\n```\nend"
    df = spark.createDataFrame([(1, md, "k"), (1, md, "k"), (1, None, None), (2, "plain\n```\nopen", "")], "id int, text string, doc string")
    got = opt.optimize_segments(df).orderBy("id", "text").collect()
    assert [(r.id, r.doc) for r in got] == [(1, None), (1, "k"), (1, "k"), (2, "")]
    assert got[0].optimized_text is None and got[3].optimized_text == got[3].text and got[3].segments_found == 0
    r = got[1]
    assert "[repeated 5 times]" in r.optimized_text and r.optimized_text.startswith("# A\n~~~\nx   y\n~~~\n") and r.optimized_text.endswith("\n```\nend")
    assert (r.segments_found, r.segments_optimized, r.transformations) == (2, 1, {"ansi": 2, "duplicate-lines": 1})
    assert [(d.enabled, d.reason) for d in r.decisions][::2] == [(False, "applied"), (False, "applied"), (False, "disabled-by-preset")]
    assert r.stats.characters_removed == len(md) - len(r.optimized_text)


def test_requests_that_share_an_id(spark):
    routes = spark.createDataFrame([(0, "a", 10, 1.0, None, ["t"]), (1, "b", 100, None, 5.0, None)], "idx int, id string, max_context_tokens long, input_cost double, priority double, capabilities array<string>")
    schema = "request_id int, input_tokens long, required array<string>"
    got = context.route_models(spark.createDataFrame([(1, 5, ["t"]), (1, 50, None), (None, 500, [])], schema), routes).collect()
    assert sorted((r.route_id or "", r.candidates) for r in got) == [("", 0), ("a", 1), ("b", 1)]
    assert [r.reason for r in got if r.route_id == "a"] == ["priority: 5 tokens and 1 capabilities fit"]
    fails(context.route_models(spark.createDataFrame([(1, -5, [])], schema), routes), "negative")
    with pytest.raises(ValueError):
        context.route_models(spark.createDataFrame([], schema), routes.withColumn("max_context_tokens", F.lit(-1)))


def test_vectors(spark):
    schema = "id int, embedding array<double>"
    docs = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(12)] + [(99, [0.0, 0.0])], schema).repartition(3)
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0])], "query_id string, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.id, r.similarity) for r in context.vector_top_k(docs, q, 5).collect()}
    assert [got["q", k] for k in (1, 2, 3, 4)] == [(0, 1.0), (3, 1.0), (6, 1.0), (9, 1.0)] and got["q", 5][0] == 1
    assert [got["z", k] for k in (1, 2)] == [(0, 0.0), (1, 0.0)]
    assert context.vector_top_k(docs, q.limit(0)).count() == 0 and context.vector_top_k(docs.limit(0), q).count() == 0
    for bad in ([1.0], [], [1.0, float("nan")], None):
        fails(context.vector_top_k(docs.unionByName(spark.createDataFrame([(5, bad)], schema)), q), "embedding")
        if bad is not None:
            fails(spark.createDataFrame([(bad, [1.0, 2.0])], "a array<double>, b array<double>").select(context.cosine(F.col("a"), F.col("b"))), "embedding")
    log = spark.createDataFrame([(1, 1, "upsert", [1.0]), (1, 2, "upsert", [2.0]), (2, 1, "upsert", [3.0]), (2, 2, "delete", None)], "id int, seq int, op string, embedding array<double>")
    assert [tuple(r) for r in context.vector_index(log).collect()] == [(1, [2.0])]
    with pytest.raises(ValueError):
        context.vector_index(log.unionByName(spark.createDataFrame([(3, 1, "upsert", [1.0, 2.0])], log.schema)))


def test_rank_of_a_large_group(spark):
    df = spark.createDataFrame([("g" if i % 4 else None, i, "a b" if i % 3 else "a") for i in range(60)], "g string, idx int, text string")
    got = context.ranked(df, context.query_terms("A b"), group="g", keep=["g", "idx"]).collect()
    for g in ("g", None):
        mine = sorted((r["rank"], r.idx) for r in got if r.g == g)
        assert mine == list(enumerate(sorted((i for i in range(60) if bool(i % 4) == (g == "g")), key=lambda i: (i % 3 == 0, i)), 1))


def test_counters_and_conversations(spark):
    words = counter(lambda t: len(t.split()))

    class Coder:
        encode = tokenize = staticmethod(str.split)

    df = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "user", LOG), (1, 2, "user", "pulling layer"), (1, 3, "user", None), (2, 0, "user", "x")], "conv_id int, turn int, role string, text string")
    for count in (words, from_encoder(Coder()), from_tokenizer(Coder())):
        r = opt.optimize(df.where("turn = 1"), tokens=count).first()
        assert (r.stats.original_tokens, r.stats.optimized_tokens, r.stats.exact) == (16, 7, True)
    out = context.compact_conversations(df, 5, query="layer", count=words)
    t = {r.conv_id: r for r in context.conversation_totals(out).collect()}
    assert (t[1].original_tokens, t[1].compacted_tokens, t[1].omitted) == (20, 4, [1]) and t[2].compacted_tokens == 1
    fails(context.compact_conversations(df, 5, most_characters=3), "input-limit")
    fails(context.compact_conversations(df, 5, most_messages=3), "more than 3 messages")
    totals = {r.conv_id: r for r in opt.message_totals(opt.optimize_messages(df)).collect()}
    assert [m["index"] for m in totals[1].message_stats] == [1, 2] and totals[1].transformations == {"ansi": 2, "duplicate-lines": 1}
    fails(opt.optimize(df, max_characters=3), "input-limit")
    with pytest.raises(ValueError):
        opt.optimize(df, max_characters=-1)


def test_routes_keep_their_statistics(spark):
    df = spark.createDataFrame([(0, '{ "a" : 1 }', None), (1, LOG, "pytest -q"), (2, LOG, "git log"), (3, LOG, ""), (4, "[1]", "ls")], "id int, text string, command string")
    got = opt.optimize_context(df, command="command").orderBy("id").collect()
    assert [r.strategy for r in got] == ["structured", "command", "command", "generic", "structured"]
    assert got[0].optimized_text == '{"a":1}' and [tuple(d) for d in got[0].decisions] == [("structured-json", True, 1, "applied")] and got[0].transformations == {"structured-json": 1}
    assert got[4].transformations == {} and got[4].command_profile.family == "read" and got[0].command_profile is None and got[0].lexically_lossless
    assert [sum(d.enabled for d in r.decisions) for r in got[1:4]] == [5, 3, 3] and all(r.stats.characters_removed > 0 for r in got[:4])


def test_gate_metrics_and_observer(spark):
    df = spark.createDataFrame([("a", LOG), ("b", "short")], "id string, text string")
    cases = context.quality_cases(df, str.split, lambda words: len(words) if len(words) < 9 else 0)
    assert context.quality_gate(cases, 10).first().passed and context.quality_failures(cases, "id", 10).count() == 0
    worse = context.quality_cases(df, str.split, len)
    assert {(r.check, r.case_id) for r in context.quality_failures(worse, "id", 100).collect()} == {("case", "a"), ("mean", None), ("reduction", None)}
    with pytest.raises(Exception, match="finite"):
        context.quality_cases(df, str, lambda _: float("nan"))
    from pyspark.sql import Observation

    seen = Observation()
    opt.observed(opt.optimize(df), seen).write.format("noop").mode("overwrite").save()
    m = metrics.Metrics(lambda: 5, most=9)
    m.record_all(seen.get, preset="safe")
    assert len(m) == 9 and {o["name"]: o["value"] for o in m.snapshot()}["ansi"] == 2
    with pytest.raises(ValueError):
        m.record("one more", 1)

    def broken(_):
        raise OSError

    with pytest.raises(OSError):
        m.flush(broken)
    kept = []
    assert len(m) == 9 and m.flush(kept.extend) == 9 and len(m) == 0 and kept[0]["timestamp"] == 5
    for wrong in (("", 1.0), ("n", float("inf"))):
        with pytest.raises(ValueError):
            m.record(*wrong)


def test_metrics_table_and_envelopes(spark, tmp_path):
    m = metrics.Metrics(lambda: 7)
    m.record("tokens", 3, model="x", exact=True)
    m.flush(metrics.table_exporter(spark, f"{tmp_path}/m"))
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/m").collect()] == [("tokens", 3.0, {"model": "x", "exact": "True"}, 7)]
    (tmp_path / "a.txt").write_bytes(LOG.encode() + b"\xff")
    texts = read_texts(spark, f"{tmp_path}/a.txt")
    fails(read_texts(spark, f"{tmp_path}/a.txt", 3), "input-limit")
    done = context.policy(opt.optimize(texts), minimum_reduction=99)
    one, two = (json.loads(done.select(envelope(version=v, checked=True, include_text=v == 1)).first()[0]) for v in (1, 2))
    assert one["schemaVersion"] == 1 and one["text"].endswith("end�") and one["stats"]["transformations"]["ansi"] == 2
    assert two["output"] == {"included": False} and two["policy"] == {"checked": True, "passed": False, "failures": ["reduction"]}
    report = workload_report(spark.createDataFrame([("w", "safe", 10, 5), ("v", "safe", 10, 10)], "workload string, preset string, original_characters long, optimized_characters long"))
    assert rendered(report).split("\n")[2:] == ["| v | safe | 10 | 10 | 0.0% |", "| w | safe | 10 | 5 | 50.0% |", "| all | safe | 20 | 15 | 25.0% |", "| all | all | 20 | 15 | 25.0% |"]
    assert service("deepseek", "k", lambda *_: (200, "{}")).base_url.startswith("https://")


def test_evaluation(spark):
    df = spark.createDataFrame([(1, "The cat, THE dog"), (2, None)], "id int, text string")
    got = evaluation.fact_recall(df, [["the cat", "a cat"], ["Dog"], ["bird"]]).orderBy("id").collect()
    assert [(r.found, r.missing) for r in got] == [(2, ["bird"]), (0, ["the cat|a cat", "Dog", "bird"])]
    v = evaluation.verified(df, must=["cat"], must_not=["dog"], counts={"he": 1, "THE": 1}).orderBy("id").collect()
    assert v[0].faults == ["left over: dog"] and not v[1].success
    tasks = spark.createDataFrame([(1, "b"), (1, "a")], "id int, workload string")
    assert {r.id: r.workload for r in evaluation.with_workload(df, tasks, "id").collect()} == {1: "a", 2: "unclassified"}
    low, high = evaluation.bootstrap_interval([0.0, 0.5, 1.0], 500)
    assert 0 <= low < 0.5 < high <= 1 and evaluation.bootstrap_interval([2.0], 9) == (2.0, 2.0) and evaluation.bootstrap_interval([]) == (0.0, 0.0)
    assert sorted(evaluation.shuffled(range(9), 4)) == list(range(9)) and evaluation.shuffled("abc", 1) == evaluation.shuffled("abc", 1)


def test_fences_are_paired_in_one_pass():
    text = "\n".join("`" * (3 + i % 50) + f"x{i}" for i in range(20_000)) + "\n~~~console\nx\n~~~~\n"
    found, parts = opt.fenced_parts(text)
    assert found == 1 and [p["label"] for p in parts] == [None, "console", None] and "".join(p["text"] for p in parts) == text


def test_core_needs_no_working_directory(tmp_path):
    """Tasks carry the package by value, from any folder."""
    code = "import sys; sys.path.insert(0, sys.argv[1]); import loomtext; from pyspark import cloudpickle; from loomtext.operators.cleaners import block_kernel; print(len(cloudpickle.dumps(block_kernel)) > 1000)"
    import loomtext

    root = loomtext.__file__.rsplit("/", 2)[0]
    assert subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, capture_output=True, text=True).stdout.strip() == "True"
