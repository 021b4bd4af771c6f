"""Measurements: a bounded collector for the driver, and the table form of its observations."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..limits import checked_limit

SCHEMA = "name string, value double, attributes map<string,string>, timestamp long"


class Metrics:
    """Named numbers with attributes, up to ``most`` until they are exported. It holds metadata, never texts."""

    def __init__(self, now: Callable[[], int] | None = None, most: int = 10_000, most_attributes: int = 32, most_characters: int = 1024):
        self.now = now or (lambda: time.time_ns() // 1_000_000)
        self.most, self.most_attributes = checked_limit(most, "most", 1), checked_limit(most_attributes, "most_attributes")
        self.most_characters = checked_limit(most_characters, "most_characters", 1)
        self._held: list[dict] = []

    def __len__(self) -> int:
        return len(self._held)

    def record(self, name: str, value: float, **attributes: str | float | bool) -> None:
        if not math.isfinite(value):
            raise ValueError("a metric's value must be finite")
        if not 0 < len(name) <= self.most_characters:
            raise ValueError("a metric's name is empty or too long")
        if len(attributes) > self.most_attributes or any(len(x) > self.most_characters for kv in attributes.items() for x in kv if isinstance(x, str)):
            raise ValueError("too many attributes, or one is too long")
        if len(self._held) >= self.most:
            raise ValueError("too many observations: flush them first")
        self._held.append({"name": name, "value": float(value), "attributes": dict(attributes), "timestamp": self.now()})

    def record_all(self, values: dict[str, float], **attributes: str | float | bool) -> None:
        """All numbers of a Spark observation (``Observation.get``)."""
        for name, value in values.items():
            self.record(name, 0 if value is None else value, **attributes)

    def snapshot(self) -> list[dict]:
        return [o | {"attributes": dict(o["attributes"])} for o in self._held]

    def flush(self, export: Callable[[Sequence[dict]], None]) -> int:
        """Hand over everything; it is forgotten only if ``export`` returns."""
        held = self.snapshot()
        export(held)
        del self._held[: len(held)]
        return len(held)


def table_exporter(spark: SparkSession, path: str) -> Callable[[Sequence[dict]], None]:
    """An exporter that appends observations to a Parquet table."""

    def export(held: Sequence[dict]) -> None:
        rows = [(o["name"], o["value"], {k: str(v) for k, v in o["attributes"].items()}, o["timestamp"]) for o in held]
        observations(spark, rows).write.mode("append").parquet(path)

    return export


def observations(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)
