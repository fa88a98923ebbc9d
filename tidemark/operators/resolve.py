"""Newest-wins resolution: one row per key, by sequence or by source precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def resolve(log: DataFrame, keys: str | list[str] = "key", order: list[Column] | None = None) -> DataFrame:
    """The newest row of each key, tombstones included.

    ``order`` lists expressions, greatest first wins (default: ``seq``).  Equal orders of one key
    are the caller's to exclude; within a commit keys are unique.

    Where all other columns have a fixed width the plan is a hash aggregate with map-side combine
    (``max_by``).  Otherwise an aggregate would have to sort as well, and the window form is used: its
    group limit drops older versions before the shuffle.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = order or [F.col("seq")]
    rest = [f for f in log.schema.fields if f.name not in keys]
    if len(order) == 1 and rest and all(_fixed(f.dataType) for f in rest):
        newest = [F.max_by(f.name, order[0]).alias(f.name) for f in rest]
        return log.groupBy(*keys).agg(*newest).select(*log.columns)
    by = Window.partitionBy(*keys).orderBy(*(c.desc_nulls_last() for c in order))
    return log.withColumn("_rank", F.row_number().over(by)).where("_rank = 1").drop("_rank")


def _fixed(kind: T.DataType) -> bool:
    # A decimal beyond 18 digits is not mutable in place, so it would sort too.
    return isinstance(kind, _FIXED) and not (isinstance(kind, T.DecimalType) and kind.precision > 18)


def live(resolved: DataFrame, value: str = "value") -> DataFrame:
    """Without tombstones.  Only after resolution: before it, older versions would come back."""
    return resolved.where(F.col(value).isNotNull())


def as_of(log: DataFrame, seq: int, keys: str | list[str] = "key") -> DataFrame:
    """The snapshot at ``seq`` (inclusive).  The bound goes below the resolution, to the scan."""
    return resolve(log.where(F.col("seq") <= F.lit(seq)), keys)


def merge_runs(*sources: DataFrame, keys: str | list[str] = "key") -> DataFrame:
    """Merge of sources in the order of precedence: the first source that has a key wins, and
    within a source the highest ``seq`` if there is one.  Tombstones win like values."""
    ranked = [s.withColumn("_source", F.lit(-i)) for i, s in enumerate(sources)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    order = [F.col("_source")] + ([F.col("seq")] if "seq" in every.columns else [])
    return resolve(every, keys, order).drop("_source")


def overlay(snapshot: DataFrame, writes: DataFrame, keys: str | list[str] = "key") -> DataFrame:
    """What a transaction sees: its own writes (one row a key) over its snapshot."""
    return merge_runs(writes, snapshot, keys=keys)
