"""One order over a whole table without one task for it all.

Rows are cut into ranges at fixed bounds, ranked range by range, and shifted by the totals of the ranges
before.  Bounds come from a bounded sample and enter the plan as literals, so that every evaluation
of the plan cuts alike; a partitioner that samples at run time would not promise that.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values sampled for the bounds.
SAMPLE = 5_000


def bounds(rows: DataFrame, column: str, parts: int | None = None) -> list[Any]:
    """At most ``parts - 1`` values that cut ``column`` into ranges of about equal size."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = rows.select(F.col(column).alias("v")).where("v IS NOT NULL")
    every = max(1, values.count() // SAMPLE)
    picked = values.where(F.pmod(F.xxhash64("v"), F.lit(every)) == 0).distinct().limit(4 * SAMPLE)
    sample = sorted(bytes(r["v"]) if isinstance(r["v"], bytearray) else r["v"] for r in picked.collect())
    cuts = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []
    return sorted(set(cuts))


def range_of(column: Column, cuts: list[Any]) -> Column:
    """The number of the range a value lies in: how many cuts are not above it.  Nulls are in range 0.

    A balanced tree of comparisons, compiled with the rest of the stage.
    """

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column >= F.lit(cuts[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts))


def running_total(rows: DataFrame, column: str, weight: Column, name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``weight`` over all rows before, in the order of ``column``.

    Rows with equal values of ``column`` are in no set order among themselves.
    """
    cut = rows.withColumn("_w", weight.cast("long")).withColumn("_p", range_of(F.col(column), bounds(rows, column, parts)))
    by = Window.partitionBy("_p").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("_run", F.sum("_w").over(by))
    sums = cut.groupBy("_p").agg(F.sum("_w").alias("_t"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # A row a range, so one task may order them and every task may have them.
    offsets = sums.withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    out = local.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_run") + F.col("_base") - F.col("_w"))
    return out.drop("_p", "_run", "_base", "_w")


def gaps(rows: DataFrame, column: str) -> DataFrame:
    """``gap``: the first number that is missing after each run of whole numbers in ``column``, but for
    the end of the last run."""
    cut = rows.select(F.col(column).cast("long").alias("o"))
    cut = cut.withColumn("p", range_of(F.col("o"), bounds(cut, "o")))
    steps = cut.withColumn("next", F.lead("o").over(Window.partitionBy("p").orderBy("o")))
    inside = steps.where("next > o + 1").select((F.col("o") + 1).alias("gap"))
    ends = cut.groupBy("p").agg(F.min("o").alias("a"), F.max("o").alias("b"))
    across = ends.withColumn("next", F.lead("a").over(Window.orderBy("a"))).where("next > b + 1")
    return inside.unionAll(across.select((F.col("b") + 1).alias("gap")))
