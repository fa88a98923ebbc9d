"""Batches of writes, their failures, and conflicts between transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import byte_size
from tidemark.operators.order import bounds, range_of, running_total
from tidemark.operators.resolve import live, resolve


def put(writes: DataFrame, seq: int, ordinal: str | None = None, column: str = "key") -> DataFrame:
    """Log rows of a batch: every row gets the one ``seq`` of its commit.

    With ``ordinal`` the last row of a key in the batch wins; else keys are taken to be unique.
    """
    rows = resolve(writes, column, [F.col(ordinal)]).drop(ordinal) if ordinal else writes
    return rows.withColumn("seq", F.lit(seq).cast("long"))


def remove_failures(log: DataFrame, keys: DataFrame, column: str = "key", ordinal: str | None = None) -> DataFrame:
    """Requested removals that fail: absent keys, keys already removed, and the second and later
    occurrence of a key in the batch."""
    current = live(resolve(log, column)).select(column).withColumn("_live", F.lit(True))
    order = F.col(ordinal) if ordinal else F.col(column)
    ranked = keys.withColumn("_nth", F.row_number().over(Window.partitionBy(column).orderBy(order)))
    judged = ranked.join(current, column, "left")
    return judged.where((F.col("_nth") > 1) | F.col("_live").isNull()).select(*keys.columns)


def remove(log: DataFrame, keys: DataFrame, seq: int, column: str = "key") -> DataFrame:
    """Tombstones for the requested keys that are live."""
    current = live(resolve(log, column)).select(column, F.col("value"))
    gone = current.join(keys.select(column).distinct(), column, "left_semi")
    return gone.withColumn("value", F.when(F.lit(False), F.col("value"))).withColumn("seq", F.lit(seq).cast("long"))


def conflicts(log: DataFrame, writes: DataFrame, start_seq: int, column: str = "key") -> DataFrame:
    """Written keys that somebody else committed after ``start_seq``: a write-write conflict."""
    newer = log.where(F.col("seq") > F.lit(start_seq)).select(column)
    return writes.select(column).distinct().join(newer, column, "left_semi")


def apply_commands(commands: DataFrame, column: str = "key") -> DataFrame:
    """Log rows of a list of commands ``(ord, op, key, value)``: ``set`` and ``remove`` in their
    order, ``get`` reads nothing here."""
    return commands.where(F.col("op").isin("set", "remove")).select(
        column, F.col("ord").cast("long").alias("seq"), F.when(F.col("op") == "set", F.col("value")).alias("value")
    )


def physical_size(column: str = "key", value: str = "value") -> Column:
    """Bytes of key and value, a null value counting nothing."""
    return byte_size(F.col(column)) + F.coalesce(byte_size(F.col(value)), F.lit(0))


def flush_points(log: DataFrame, threshold: int, weight: Column | None = None, order: str = "seq") -> DataFrame:
    """``batch, rows, weight, first_seq, last_seq``: batches of a log in sequence order.

    A batch ends with the row that brings its count (or weight) since the batch began to the
    threshold; the next begins at 0.  The last batch may be short of it.  For counts the batch number is
    ``floor((rank - 1) / threshold)``, see :func:`~tidemark.operators.order.running_total` for how one
    order over the log is had; weights are cut by :func:`cut_by_weight`.  A null weight counts nothing.
    """
    if weight is not None:
        return cut_by_weight(log.select(F.col(order).alias("_o"), F.coalesce(weight, F.lit(0)).cast("long").alias("weight")), threshold)
    rows = log.select(F.col(order).alias("_o"), F.lit(1).cast("long").alias("weight"))
    placed = running_total(rows, "_o", F.col("weight"), "before")
    return placed.groupBy(F.floor(F.col("before") / F.lit(threshold)).alias("batch")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("weight").alias("weight"),
        F.min("_o").alias("first_seq"),
        F.max("_o").alias("last_seq"),
    )


def cut_by_weight(rows: DataFrame, threshold: int) -> DataFrame:
    """``batch, rows, weight, first_seq, last_seq`` of rows ``(_o, weight)`` with distinct ``_o``; see :func:`carried`."""
    dealt, at = carried(rows, threshold)
    kind = rows.schema["_o"].dataType.simpleString()
    spec = f"batch long, rows long, weight long, first_seq {kind}, last_seq {kind}"
    parts = dealt.groupBy("_p").applyInPandas(_cut(threshold, at), spec)
    return parts.groupBy("batch").agg(
        F.sum("rows").alias("rows"), F.sum("weight").alias("weight"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq")
    )


def carried(rows: DataFrame, threshold: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Rows ``(_o, weight)`` with ``_p``, the range of the order they lie in, and for each range the weight
    that is carried into it and the number of cuts before it.  No weight is null or negative.

    Where a batch ends depends on where the one before did.  Ranges of the order are therefore solved for
    every weight that may be carried into them: the first cut of a range is at one of its first rows,
    and cuts after it follow, most of them the same whatever came before.  What is carried out, as a step
    function of what comes in, is a few rows a range; the driver folds these in order, and each range
    then makes its cuts.  Ranges hold 64 batches or more, so that steps are few.  Null orders come last,
    equal orders by weight.
    """
    total = rows.agg(F.coalesce(F.sum("weight"), F.lit(0))).head()[0]
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = bounds(rows, "_o", max(1, min(most, total // (64 * threshold))))
    dealt = rows.withColumn("_p", F.when(F.col("_o").isNull(), len(cuts) + 1).otherwise(range_of(F.col("_o"), cuts)))
    told = dealt.groupBy("_p").applyInPandas(_steps(threshold), "_p int, least long, cuts long, carried long").collect()
    steps: dict[int, list] = {}
    for r in told:
        steps.setdefault(r["_p"], []).append((r["least"], r["cuts"], r["carried"]))
    carry, batch, at = 0, 0, {}
    for p in sorted(steps):
        at[p] = (carry, batch)
        # Steps go by the least weight carried in; the first is for no cut at all and adds to it.
        least, n, out = max(s for s in steps[p] if s[0] <= carry)
        carry, batch = (carry + out, batch) if n == 0 else (out, batch + n)
    return dealt, at


def _steps(threshold: int):
    def run(rows):
        import numpy as np
        import pandas as pd

        total = rows.sort_values(["_o", "weight"])["weight"].to_numpy(np.int64).cumsum()
        n = len(total)
        after = np.searchsorted(total, total + threshold)  # the cut that follows a cut at each row
        last, many = np.arange(n + 1), np.zeros(n + 1, np.int64)
        for i in range(n - 1, -1, -1):
            if after[i] < n:
                last[i], many[i] = last[after[i]], many[after[i]] + 1
        out = [(0, 0, int(total[-1]))] if total[-1] < threshold else []
        # The first cut is at the first row that the carried weight and the rows so far bring to the threshold.
        ends = np.unique(np.searchsorted(total, np.unique(np.minimum(total[: int(np.searchsorted(total, threshold)) + 1], threshold))))
        for j in ends[::-1].tolist():
            if not total[j]:
                continue
            step = (max(0, threshold - int(total[j])), int(many[j]) + 1, int(total[-1] - total[last[j]]))
            if out and out[-1][1:] == step[1:] and step[1]:
                continue  # as for less carried in
            out.append(step)
        return pd.DataFrame([(int(rows["_p"].iloc[0]), *s) for s in out], columns=["_p", "least", "cuts", "carried"])

    return run


def _cut(threshold: int, at: dict[int, tuple[int, int]]):
    def run(rows):
        import numpy as np
        import pandas as pd

        carry, batch = at[int(rows["_p"].iloc[0])]
        rows = rows.sort_values(["_o", "weight"])
        order, total = rows["_o"].to_numpy(), rows["weight"].to_numpy(np.int64).cumsum()
        out, begin, base = [], 0, -carry
        while begin < len(total):
            end = min(int(np.searchsorted(total, base + threshold)) + 1, len(total))
            before = int(total[begin - 1]) if begin else 0
            out.append((batch, end - begin, int(total[end - 1]) - before, order[begin], order[end - 1]))
            begin, base, batch = end, int(total[end - 1]), batch + 1
        return pd.DataFrame(out, columns=["batch", "rows", "weight", "first_seq", "last_seq"])

    return run
