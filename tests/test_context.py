import pytest
from pyspark.sql import functions as F

from loomtext.operators import context, detect, stores


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("g", 0, 8, 8.0, False), ("g", 1, 5, 1.0, True), ("g", 2, 5, 4.0, False), ("h", 0, 99, 1.0, True)], "g string, idx int, tokens long, score double, req boolean")
    got = {(r.g, r.idx): r.selected for r in context.fit_budget(df, "g", 10, required="req").collect()}
    assert got == {("g", 0): False, ("g", 1): True, ("g", 2): True, ("h", 0): False}


def test_cosine_and_zero(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(context.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]


def test_routes(spark):
    routes = spark.createDataFrame([(0, "a", 10, 1.0, None, ["t"]), (1, "b", 100, None, 5.0, None)], "idx int, id string, max_context_tokens long, input_cost double, priority double, capabilities array<string>")
    req = spark.createDataFrame([(1, 5, ["t"]), (2, 50, []), (3, 500, [])], "request_id int, input_tokens long, required array<string>")
    assert {r.request_id: r.route_id for r in context.route_models(req, routes).collect()} == {1: "a", 2: "b", 3: None}
    with pytest.raises(ValueError):
        context.route_models(req, routes.unionByName(routes))


def test_command(spark):
    df = spark.createDataFrame([("/usr/bin/GIT log",), ("npm run test",), ("tsc -p .",), ("",)], "c string")
    got = [tuple(r.p) for r in df.select(detect.command_profile(F.col("c")).alias("p")).collect()]
    assert got == [("version-control", "git", "safe", "high"), ("test", "npm", "balanced", "medium"), ("build", "tsc", "balanced", "medium"), ("unknown", "", "safe", "low")]


def test_store_and_cache():
    s = stores.ContextStore(max_entries=2, max_bytes=6, ttl=10)
    a, b = s.put("abc", 0), s.put("def", 1)
    assert s.get(a, 5) == "abc" and s.put("xyz", 6) and s.get(a, 6) is None and s.get(b, 11) is None
    c = stores.SemanticCache(ttl=10)
    c.set("k", [1.0, 0.0], "v", 0)
    assert c.get("k", [0.0, 1.0], 1)[3] and c.get("z", [1.0, 0.01], 1)[:2] == ("k", "v") and c.get("z", [0.0, 1.0], 1) is None and c.get("k", [1.0, 0.0], 10) is None


def test_vector_top_k_in_blocks(spark):
    docs = spark.createDataFrame([(i, [float(i % 7 - 3), float(i % 5), float(i % 11) - 4]) for i in range(60)], "id int, embedding array<double>")
    queries = docs.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    want = sorted(context.vector_top_k(docs, queries, 4).collect())
    got = sorted(context.vector_top_k(docs, queries, 4, most_queries=6).collect())
    assert got == want and len(want) == 20 * 4


def test_rank_contexts_ranks_every_stated_query(spark, tmp_path):
    from loomtext.plans import catalogue

    spark.createDataFrame([(0, "a b"), (1, "c"), (50, "c d e")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["a c", "b A", "d e c", "zz", "c"]
    spark.createDataFrame([(i * 10, t, "xy"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for query, about in ((0, {"a", "b"}), (50, {"c", "d", "e"})):
        for source in "xy":
            mine = sorted((-len(about & set(t.lower().split())) / len(about) * 0.7, i * 10) for i, t in enumerate(texts) if "xy"[i % 2] == source)
            want += [(query, i, source, round(-s, 9), k + 1) for k, (s, i) in enumerate(mine)]
    assert sorted(map(tuple, catalogue.QUERIES["rank_contexts"](spark, str(tmp_path)).collect())) == sorted(want)
