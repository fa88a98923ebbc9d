"""Levelled merge compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import NotSupported
from tidemark.operators.read import Bound
from tidemark.operators.resolve import resolve
from tidemark.operators.write import carried

#: Runs that a level may hold is FIRST * GROWTH ** level.
FIRST, GROWTH, LEVELS = 4, 10, 4


def level_loads(runs: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """``level, runs, most, over``: which levels are due to be merged down."""
    return (
        runs.groupBy("level")
        .agg(F.count(F.lit(1)).alias("runs"))
        .withColumn("most", (F.lit(first) * F.pow(F.lit(growth), F.col("level"))).cast("long"))
        .withColumn("over", F.col("runs") >= F.col("most"))
    )


def fuse(runs: DataFrame) -> DataFrame:
    """``lo, hi``: the range that all the runs span."""
    return runs.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _meeting(runs: DataFrame, span: DataFrame) -> DataFrame:
    # The span is one row: two scalars for the filter.
    one = span.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    return runs.join(F.broadcast(one), (F.col("lo") <= F.col("_hi")) & (F.col("_lo") <= F.col("hi"))).drop("_lo", "_hi")


def pick(runs: DataFrame, level: int, low: Bound | None = None, high: Bound | None = None) -> DataFrame:
    """Runs to merge: those of ``level`` that meet the target, and those of the next level that meet
    what they span.  In level 0, where runs overlap, the choice is closed over overlaps of overlaps
    by taking every run of the level that meets the fused range."""
    own = runs.where(F.col("level") == F.lit(level))
    if low is not None:
        own = own.where(F.col("hi") >= F.lit(low.value))
    if high is not None:
        own = own.where(F.col("lo") <= F.lit(high.value))
    if level == 0:
        own = _meeting(runs.where("level = 0"), fuse(own))
    below = _meeting(runs.where(F.col("level") == F.lit(level + 1)), fuse(own))
    return own.unionByName(below)


def merge_levels(rows: DataFrame, keys: str | list[str] = "key") -> DataFrame:
    """Compaction's merge: one row a key by ``seq``, ties to the newer run; tombstones stay, since an
    older version may lie in a run that does not take part."""
    order = [F.col("seq"), F.col("run_id")] if "run_id" in rows.columns else [F.col("seq")]
    return resolve(rows, keys, order)


def merge_anti(upper: DataFrame, lower: DataFrame, keys: str | list[str] = "key") -> DataFrame:
    """The same merge for two resolved inputs: all of ``upper``, and ``lower`` where it is new."""
    return upper.unionByName(lower.join(upper, keys, "left_anti"))


def shard_greedy(rows: DataFrame, size: int, weight: Column, order: str = "key") -> DataFrame:
    """Exact greedy sharding of rows in the order of ``order`` into ``ceil(total / size)`` shards.

    A row that brings a shard to ``size`` opens the next one and is not counted there; the last
    shard takes the rest.  What is held falls to 0 at the same rows as in a batch by weight, so ranges of the
    order are solved in parallel (:func:`~tidemark.operators.write.carried`) and each numbers its own rows.

    Null orders come last, equal orders by weight.  A null weight makes what is held unknown: no shard opens
    at it or after it.  Negative weights are not supported.
    """
    if size < 1:
        raise NotSupported(f"a shard size of {size}")
    weighed = rows.select(F.col(order).alias("_o"), weight.alias("_raw"), weight.cast("long").alias("weight"))
    unknown = F.col("weight").isNull()
    parts, least, nulls, first = weighed.agg(
        F.ceil(F.sum("_raw") / F.lit(size)).cast("int"), F.min("weight"), F.count_if(unknown), F.min(F.when(unknown, F.col("_o")))
    ).head()
    if least is not None and least < 0:
        raise NotSupported("negative weights")
    weighed = weighed.drop("_raw")
    if nulls:
        past = F.col("_o").isNull()
        if first is not None:
            past |= F.col("_o") >= F.lit(bytes(first) if isinstance(first, bytearray) else first)
        weighed = weighed.withColumn("weight", F.when(past, 0).otherwise(F.col("weight")))
    dealt, at = carried(weighed, size)
    kind = weighed.schema["_o"].dataType.simpleString()
    shards = dealt.groupBy("_p").applyInPandas(_number(size, at), f"_o {kind}, shard int")
    shard = F.col("shard") if parts is None else F.least("shard", F.lit(parts - 1))
    return shards.select(F.col("_o").alias(order), shard.alias("shard"))


def _number(size: int, at: dict[int, tuple[int, int]]):
    def run(rows):
        import numpy as np

        carry, before = at[int(rows["_p"].iloc[0])]
        rows = rows.sort_values(["_o", "weight"])
        total = rows["weight"].to_numpy(np.int64).cumsum()
        opens, base = np.zeros(len(total), np.int64), -carry
        while (end := int(np.searchsorted(total, base + size))) < len(total):
            opens[end], base = 1, int(total[end])
        return rows[["_o"]].assign(shard=before + opens.cumsum())

    return run


def seek_misses(probes: DataFrame, most: int = 100) -> DataFrame:
    """Runs with over ``most`` probes ``(run_id, hit)`` that found nothing: worth a merge."""
    return probes.groupBy("run_id").agg(F.count_if(~F.col("hit")).alias("misses")).where(F.col("misses") > F.lit(most))
