"""Context stores and semantic caches as state of a running stream, one of each per tenant."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.stores import CACHE_LOG, STORE_LOG, ContextStore, SemanticCache, applied, cache_step, store_step


class _Held(StatefulProcessor):
    def __init__(self, make: Callable, step: Callable, schema: str):
        self.make, self.step, self.schema = make, step, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("entries", T.StructType([T.StructField("json", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.make()
        if self.state.exists():
            held.load(self.state.get()[0])
        out = applied(held, self.step, pd.concat(list(rows)), self.schema, key[0])
        self.state.update((held.dump(),))
        yield out

    def close(self) -> None:
        pass


def _stream(log: DataFrame, make: Callable, step: Callable, schema: str) -> DataFrame:
    out = f"tenant {log.schema['tenant'].dataType.simpleString()}, {schema}"
    return log.groupBy("tenant").transformWithStateInPandas(statefulProcessor=_Held(make, step, schema), outputStructType=out, outputMode="append", timeMode="none")


def store_stream(log: DataFrame, max_entries: int = 100, max_bytes: int = 16 << 20, ttl: float = 300_000) -> DataFrame:
    """The rows of ``replay_store`` from a stream of (tenant, seq, now_ms, op, text).

    A tenant's state is its entries, so at most ``max_bytes`` of texts. Rows are applied by seq within a micro-batch, and micro-batches as
    they come; the clock is the rows' own.
    """
    return _stream(log, lambda: ContextStore(max_entries, max_bytes, ttl), store_step, STORE_LOG)


def cache_stream(log: DataFrame, threshold: float = 0.95, max_entries: int = 100, ttl: float = 300_000) -> DataFrame:
    """The rows of ``replay_cache`` from a stream of (tenant, seq, now_ms, key, embedding); as ``store_stream``."""
    return _stream(log, lambda: SemanticCache(threshold, max_entries, ttl), cache_step, CACHE_LOG)
