"""Mixing sources to target weights with hash-threshold histograms.

A source with ``s`` words and a target of ``t`` words is taken ``floor(t / s)`` whole times, and
the rest by a threshold on a hash of the document id: documents below the threshold are taken
once more.  The threshold is found without sorting documents.  Words are summed by source and
leading hash digits; the histogram's running sums bracket the budget in one bucket, and only that
boundary bucket is summed again by the next digits, until the whole hash is used.  The documents
are then filtered by one comparison.

Defined results.  A null text has no words; a null id hashes like any other fixed value.
Documents with one hash (repeated ids) are taken together; the cut falls where the taken words
come nearest to the target, the smaller cut on a tie.  Sources with no words get a target of 0.
An empty table gives an empty table.  Only id, text and source are read.
"""

from __future__ import annotations

from itertools import cycle

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Hex digits of the hash and the digits that each histogram adds.
DIGITS, STEP = 15, 3
WEIGHTS = (5, 2, 1)


def water_fill(sizes: dict, weights: dict, most: float) -> dict:
    """Targets in proportion to ``weights`` that share ``sum(sizes)`` and stop at ``most`` times
    a source's size, the excess reshared among the others until none is above.

    The reshared targets are ``min(cap, level * weight)`` for one level; it is found by filling
    sources in the order of cap to weight.
    """
    total = sum(sizes.values())
    left, weight = total, sum(weights.values())
    out = {}
    order = sorted(sizes, key=lambda k: (most * sizes[k] / weights[k]))
    for k in order:
        cap = most * sizes[k]
        if weight and cap / weights[k] <= left / weight:
            out[k] = float(cap)
            left -= cap
            weight -= weights[k]
        else:
            level = left / weight
            out |= {x: level * weights[x] for x in order if x not in out}
            break
    return out


def word_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``doc_id, source, size, h``: words of the whole text and the hash digits of the id."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(
            F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0)
        ).alias("size"),
        _digits(id_col).alias("h"),
    )


def _digits(id_col: str):
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return F.substring(F.md5(ident.cast("binary")), 1, DIGITS)


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, cut``: the hash prefix up to which (inclusive) documents fill ``budget`` best.

    ``budgets(source, budget)`` has a row per source.  ``cut`` is null where nothing is taken.
    Each round handles one histogram of at most ``16 ** STEP`` buckets a source.
    """
    state = budgets.select("source", F.lit("").alias("prefix"), F.lit(0).alias("below"), "budget")
    state = state.withColumn("below", F.col("below").cast("long"))
    for used in range(STEP, DIGITS + 1, STEP):
        inside = sizes.join(F.broadcast(state), sizes["source"].eqNullSafe(state["source"])).where(
            F.substring("h", 1, used - STEP) == F.col("prefix")
        )
        histogram = inside.groupBy(
            state["source"], "below", "budget", F.substring("h", 1, used).alias("bucket")
        ).agg(F.sum("size").alias("words"))
        by = Window.partitionBy("source").orderBy("bucket")
        reach = histogram.withColumn(
            "upto", F.col("below") + F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, 0))
        ).withColumn("low", F.col("upto") - F.col("words"))
        if used < DIGITS:
            # The boundary bucket: the first whose running sum passes the budget, else the last.
            state = (
                reach.withColumn(
                    "rank", F.row_number().over(
                        Window.partitionBy("source").orderBy(
                            (F.col("upto") < F.col("budget")).cast("int"),
                            F.when(F.col("upto") >= F.col("budget"), F.col("bucket")),
                            F.desc("bucket"),
                        )
                    ),
                )
                .where("rank = 1")
                .select("source", F.col("bucket").alias("prefix"), F.col("low").alias("below"), "budget")
            )
            state = materialise(state)
        else:
            # Whole hashes: end before or after the document that crosses the budget.
            state = (
                reach.withColumn(
                    "rank", F.row_number().over(
                        Window.partitionBy("source").orderBy(
                            (F.col("upto") < F.col("budget")).cast("int"),
                            F.when(F.col("upto") >= F.col("budget"), F.col("bucket")),
                            F.desc("bucket"),
                        )
                    ),
                )
                .where("rank = 1")
                .select(
                    "source",
                    F.col("bucket").alias("cut"),
                    (
                        F.abs(F.col("upto") - F.col("budget")) < F.abs(F.col("low") - F.col("budget"))
                    ).alias("inclusive"),
                )
            )
    return state


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] | dict = WEIGHTS,
    most: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    most_sources: int = 100_000,
) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, times, taken``.

    ``weights`` maps a source to its weight, or is a cycle dealt to the sources in code-point
    order (null last).  A document is taken ``times`` times, at most ``most``.  The totals of the
    sources (not of documents) go through the driver; more than ``most_sources`` is an error.
    """
    plan, sizes = _plan(docs, weights, most, id_col, text_col, source_col, most_sources)
    own = sizes.withColumnRenamed("source", "own")
    return own.join(F.broadcast(plan), F.col("own").eqNullSafe(F.col("source"))).select(
        "doc_id", "source", "size", "source_size", "target", _times().alias("times"), (F.col("size") * _times()).alias("taken")
    )


def take(
    docs: DataFrame,
    weights: tuple[float, ...] | dict = WEIGHTS,
    most: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    most_sources: int = 100_000,
) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken.

    Hashes and thresholds decide where the rows lie; no text is shuffled.
    """
    plan, _ = _plan(docs, weights, most, id_col, text_col, source_col, most_sources)
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("own"), _digits(id_col).alias("h"))
    taken = own.join(F.broadcast(plan), F.col("own").eqNullSafe(F.col("source"))).withColumn("times", _times())
    return taken.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def _times():
    more = (F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & F.col("inclusive"))
    return F.col("times") + F.coalesce(more, F.lit(False)).cast("int")


def _plan(docs, weights, most, id_col, text_col, source_col, most_sources) -> tuple[DataFrame, DataFrame]:
    """Per source its size, target, whole times and cut; and the sizes of all rows (written)."""
    spark = docs.sparkSession
    sizes = materialise(word_counts(docs, id_col, text_col, source_col))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("words")).limit(most_sources + 1)
    total = {r["source"]: r["words"] for r in totals.collect()}
    if len(total) > most_sources:
        raise ValueError(f"over {most_sources} sources; a mix has a stated list of sources")
    names = sorted(total, key=lambda s: (s is None, s or ""))
    share = weights if isinstance(weights, dict) else dict(zip(names, cycle(weights)))
    target = water_fill(total, {s: share[s] for s in names}, most)
    plan = []
    for s in names:
        times = min(most, int(target[s] // total[s])) if total[s] else 0
        plan.append((s, total[s], target[s], times, target[s] - times * total[s]))
    plan = spark.createDataFrame(
        plan, "source string, source_size long, target double, times int, budget double"
    )
    cuts = materialise(thresholds(sizes, plan.where("budget > 0").select("source", "budget")))
    cuts = cuts.withColumnRenamed("source", "of")
    return plan.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), sizes


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, source,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15) AS h
    FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
    SELECT *, 3 * source_size AS cap,
           CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3
               WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
    FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, source) AS rk FROM w),
f AS (
    SELECT *, sum(source_size) OVER ()
              - coalesce(sum(cap) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
           sum(weight) OVER (ORDER BY rk DESC) AS open
    FROM r),
l AS (
    SELECT arg_min(remaining::DOUBLE / open, rk) FILTER (WHERE cap::DOUBLE / weight > remaining::DOUBLE / open) AS level
    FROM f),
t AS (
    SELECT source, source_size,
           CASE WHEN level IS NULL OR cap::DOUBLE / weight <= level THEN cap::DOUBLE ELSE level * weight END AS target
    FROM w CROSS JOIN l),
p AS (
    SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(3, floor(target / source_size))::BIGINT END AS times
    FROM t),
b AS (SELECT *, target - times * source_size AS budget FROM p),
c AS (
    SELECT source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto, sum(size) AS own
    FROM d GROUP BY source, h),
x AS (
    SELECT c.source, h, upto, upto - own AS low, budget,
           row_number() OVER (PARTITION BY c.source ORDER BY (upto < budget)::INT,
                              CASE WHEN upto >= budget THEN h END, h DESC) AS rank
    FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source WHERE budget > 0),
e AS (SELECT source, h AS cut, abs(upto - budget) < abs(low - budget) AS inclusive FROM x WHERE rank = 1)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (d.size * (b.times + coalesce((d.h < e.cut OR (d.h = e.cut AND e.inclusive))::INT, 0)))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
