"""The verbs that every backend has, and a backend that lives in the session alone."""

from __future__ import annotations

from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import KeyNotFound
from tidemark.operators import Bound, live, multi_get, point_get, put, range_scan, remove, remove_failures, resolve


class Storage(Protocol):
    def set(self, key: Any, value: Any) -> int: ...
    def get(self, key: Any) -> Any: ...
    def remove(self, key: Any) -> int: ...
    def put(self, writes: DataFrame, ordinal: str | None = None) -> int | None: ...
    def multi_get(self, keys: DataFrame, ordinal: str | None = None) -> DataFrame: ...
    def remove_all(self, keys: DataFrame, ordinal: str | None = None) -> DataFrame: ...
    def iter(self, low: Bound | None = None, high: Bound | None = None) -> DataFrame: ...
    def flush(self) -> None: ...
    def is_empty(self) -> bool: ...
    def size_of_disk(self) -> int: ...
    def __len__(self) -> int: ...


class MemoryStore:
    """A change log as one frame of this session; ``flush`` replaces it by its newest rows, held in
    the executors' memory.  Nothing outlives the session."""

    def __init__(self, spark: SparkSession, key_type: str = "string", value_type: str = "string") -> None:
        self.spark, self.kinds, self.seq = spark, (key_type, value_type), 0
        self.log = spark.createDataFrame([], f"key {key_type}, seq long, value {value_type}")

    def _add(self, rows: DataFrame) -> int:
        self.log = self.log.unionByName(rows.select("key", "seq", "value"))
        self.seq += 1
        return self.seq

    def put(self, writes: DataFrame, ordinal: str | None = None) -> int:
        return self._add(put(writes, self.seq + 1, ordinal))

    def set(self, key: Any, value: Any) -> int:
        return self.put(self.spark.createDataFrame([(key, value)], f"key {self.kinds[0]}, value {self.kinds[1]}"))

    def get(self, key: Any) -> Any:
        got = point_get(self.log, key).select("value").head()
        return None if got is None else bytes(got[0]) if isinstance(got[0], bytearray) else got[0]

    def remove(self, key: Any) -> int:
        if point_get(self.log, key).isEmpty():
            raise KeyNotFound(key)
        return self.set(key, None)

    def remove_all(self, keys: DataFrame, ordinal: str | None = None) -> DataFrame:
        before = self.log
        self._add(remove(before, keys, self.seq + 1))
        return remove_failures(before, keys, ordinal=ordinal)

    def multi_get(self, keys: DataFrame, ordinal: str | None = None) -> DataFrame:
        return multi_get(self.log, keys, ordinal=ordinal)

    def iter(self, low: Bound | None = None, high: Bound | None = None) -> DataFrame:
        return range_scan(self.log, low, high).select("key", "value")

    def flush(self) -> None:
        self.log = resolve(self.log).persist()

    def live_count(self) -> int:
        return live(resolve(self.log)).count()

    def is_empty(self) -> bool:
        return self.log.isEmpty()

    def size_of_disk(self) -> int:
        return 0

    def __len__(self) -> int:
        return self.log.agg(F.count(F.lit(1))).head()[0]
