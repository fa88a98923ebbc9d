"""The manifest as a relation: runs with key ranges, and the edits that made them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order import bounds, range_of
from tidemark.operators.read import Bound


def run_scopes(rows: DataFrame, column: str = "key") -> DataFrame:
    """``level, run_id, lo, hi, n, min_seq, max_seq`` of every run in a table of run rows."""
    return rows.groupBy("level", "run_id").agg(
        F.min(column).alias("lo"),
        F.max(column).alias("hi"),
        F.count(F.lit(1)).alias("n"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
    )


def meets(low: Bound | None, high: Bound | None) -> Column:
    """Whether a run's range meets the bounds; runs that do not are never read."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col("hi") >= F.lit(low.value) if low.inclusive else F.col("hi") > F.lit(low.value))
    if high is not None:
        out = out & (F.col("lo") <= F.lit(high.value) if high.inclusive else F.col("lo") < F.lit(high.value))
    return out


def contains(low: Any = None, high: Any = None) -> Column:
    """Whether a run's range holds the whole of ``[low, high]``."""
    return (F.col("lo") <= F.lit(low)) & (F.col("hi") >= F.lit(high))


def scope_overlaps(runs: DataFrame) -> DataFrame:
    """``a, b``: pairs of runs whose ranges overlap, ends inclusive, each pair once.

    The keys are cut into stripes, each run is dealt to the stripes that it meets, and runs are compared
    within a stripe; a pair counts in the stripe where the later of the two begins.
    """
    cuts = bounds(runs, "lo")
    dealt = runs.withColumn("from", range_of(F.col("lo"), cuts)).withColumn("to", range_of(F.col("hi"), cuts))
    dealt = dealt.withColumn("stripe", F.explode(F.sequence("from", "to")))
    a, b = (
        dealt.select("stripe", F.col("run_id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("lo", "hi", "from"))) for x in "ab"
    )
    meet = (F.col("a") < F.col("b")) & (F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi"))
    once = F.col("stripe") == F.greatest("a_from", "b_from")
    return a.join(b, "stripe").where(meet & once).select("a", "b")


def replay(edits: DataFrame, version: int | None = None) -> DataFrame:
    """Live runs after the edits ``(version, action add|remove, level, run_id, ...)`` up to a version."""
    if version is not None:
        edits = edits.where(F.col("version") <= F.lit(version))
    adds = edits.where("action = 'add'").drop("action")
    gone = edits.where("action = 'remove'").select("level", "run_id")
    return adds.join(gone, ["level", "run_id"], "left_anti")


def stats(edits: DataFrame) -> DataFrame:
    """``n, bytes``: sums of what was added less what was removed."""
    sign = F.when(F.col("action") == "add", 1).otherwise(-1)
    return edits.agg(
        F.coalesce(F.sum(F.col("n") * sign), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("bytes") * sign), F.lit(0)).alias("bytes")
    )


def garbage(edits: DataFrame, oldest_reader: int) -> DataFrame:
    """Removed runs that no snapshot from ``oldest_reader`` on can read."""
    gone = edits.where("action = 'remove'").select("run_id", F.col("version").alias("removed"))
    return gone.where(F.col("removed") <= F.lit(oldest_reader))


def totals(runs: DataFrame) -> DataFrame:
    """``runs, n, bytes`` of a set of runs."""
    return runs.agg(
        F.countDistinct("run_id").alias("runs"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )


def describe(runs: DataFrame) -> DataFrame:
    """A line per level: its runs with their ranges, in order."""
    text = F.concat_ws(" ", F.col("run_id").cast("string"), F.concat(F.lit("["), F.col("lo").cast("string"), F.lit(", "), F.col("hi").cast("string"), F.lit("]")))
    listed = F.array_sort(F.collect_list(F.struct("run_id", text.alias("text"))))
    return runs.groupBy("level").agg(
        F.count(F.lit(1)).alias("runs"), F.array_join(F.transform(listed, lambda x: x["text"]), "; ").alias("scopes")
    )
