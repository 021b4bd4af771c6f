from loomtext.operators.stores import replay_cache, replay_store
from loomtext.streaming.stores import cache_stream, store_stream
from loomtext.streaming.terminal import TerminalCleaner, clean_stream

LINES = ["[00:00:01] \x1b[31mstep\x1b[0m   \n", "same line of output\n", "same line of output\n", "same line of output\n", "\n", "\n", "end    of it"]


def test_running_stream(spark, tmp_path):
    """Two streams whose chunks cut lines, in two micro-batches; the state lives between them."""
    text = "".join(LINES)
    cuts = [text[i : i + 17] for i in range(0, len(text), 17)]
    parts = [(s, i, c, i == len(cuts) - 1) for s in ("a", "b") for i, c in enumerate(cuts)]
    schema = "stream string, seq long, chunk string, last boolean"
    half = len(cuts) // 2
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for chosen in ([p for p in parts if p[1] < half], [p for p in parts if p[1] >= half]):
        spark.createDataFrame(chosen, schema).coalesce(1).write.mode("append").parquet(source)
        stream = clean_stream(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(sink).awaitTermination(90)
    c = TerminalCleaner()
    whole = c.feed(text) + c.finish()
    got = spark.read.parquet(sink).orderBy("stream", "seq").collect()
    for s in ("a", "b"):
        assert "".join(r.text for r in got if r.stream == s) == whole
        assert [r.stats is not None for r in got if r.stream == s] == [False, True]
    assert "[repeated 3 times]" in whole and "\x1b" not in whole


def test_stores_as_state(spark, tmp_path):
    """Three micro-batches give what a replay of the whole log gives: hits, expiry and eviction reach across them."""
    rows = [(t, i, i * 10, "get" if i % 3 == 2 else "put", f"text {i * i % 5}", f"k{i % 4}", [float(i % 3), 1.0]) for t in (1, None) for i in range(30)]
    schema = "tenant int, seq long, now_ms long, op string, text string, key string, embedding array<double>"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    whole = spark.createDataFrame(rows, schema)
    for name, streamed, replayed in (
        ("store", lambda d: store_stream(d, max_entries=2, ttl=90), replay_store(whole, max_entries=2, ttl=90)),
        ("cache", lambda d: cache_stream(d, 0.99, max_entries=3, ttl=90), replay_cache(whole, threshold=0.99, max_entries=3, ttl=90)),
    ):
        source, sink, state = (str(tmp_path / name / x) for x in ("in", "out", "state"))
        for part in range(3):
            spark.createDataFrame([r for r in rows if r[1] // 10 == part], schema).coalesce(1).write.mode("append").parquet(source)
            stream = streamed(spark.readStream.schema(schema).parquet(source))
            stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(sink).awaitTermination(90)
        want, got = ({(r.tenant, r.seq): tuple(r) for r in d.collect()} for d in (replayed, spark.read.parquet(sink)))
        assert len(want) == 60 and got == want
        assert {r[2 if name == "cache" else 4] for r in want.values()} >= {True, False}
