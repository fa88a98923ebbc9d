"""Lookups and scans."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import NotSupported
from tidemark.operators.resolve import live, resolve


@dataclass(frozen=True)
class Bound:
    """One end of a range: a value, and whether it belongs to the range.  ``None``: unbounded."""

    value: Any
    inclusive: bool = True


def within(key: str, low: Bound | None, high: Bound | None) -> Column:
    """The range as a predicate on the plain key, so that it reaches the scan."""
    out = F.lit(True)
    if low is not None:
        out = (F.col(key) >= F.lit(low.value)) if low.inclusive else (F.col(key) > F.lit(low.value))
    if high is not None:
        top = (F.col(key) <= F.lit(high.value)) if high.inclusive else (F.col(key) < F.lit(high.value))
        out = top if low is None else out & top
    return out


def point_get(log: DataFrame, key: Any, column: str = "key") -> DataFrame:
    """The live row of one key, or none.  The equality reaches the scan below the resolution."""
    return live(resolve(log.where(F.col(column) == F.lit(key)), column))


def multi_get(log: DataFrame, keys: DataFrame, column: str = "key", ordinal: str | None = None) -> DataFrame:
    """``keys`` with ``value`` and ``found``, a row per requested row.

    Absent and removed keys come with a null value and ``found`` false.  With ``ordinal`` the rows
    are sorted by it.  The log is first cut down to the keys asked for; Spark chooses how by the size
    of ``keys``.
    """
    asked = log.join(keys.select(column).distinct(), column, "left_semi")
    newest = resolve(asked, column).select(column, "value")
    out = keys.join(newest, column, "left").withColumn("found", F.col("value").isNotNull())
    return out.orderBy(ordinal) if ordinal else out


def range_scan(
    log: DataFrame,
    low: Bound | None = None,
    high: Bound | None = None,
    tombstones: bool = True,
    seq: int | None = None,
    column: str = "key",
    descending: bool = False,
) -> DataFrame:
    """Newest rows of the keys in the range, by key.

    A scan emits tombstones unless told otherwise.  ``seq`` makes it a snapshot's scan.
    """
    rows = log.where(within(column, low, high))
    if seq is not None:
        rows = rows.where(F.col("seq") <= F.lit(seq))
    out = resolve(rows, column)
    if not tombstones:
        out = live(out)
    return out.orderBy(F.col(column).desc() if descending else F.col(column).asc())


def seek(log: DataFrame, to: str = "first", key: Any = None, column: str = "key") -> DataFrame:
    """A scan from a position: ``first`` (all), ``last`` (past the end: nothing) or ``lower_bound``
    (from the first key not below ``key``)."""
    if to == "first":
        return range_scan(log, column=column)
    if to == "last":
        return range_scan(log, column=column).limit(0)
    if to == "lower_bound":
        return range_scan(log, Bound(key), column=column)
    raise NotSupported(f"no seek to {to!r}")


def level_scan(runs: DataFrame, level: int, to: str = "first", key: Any = None, column: str = "key") -> DataFrame:
    """Rows of one level by key.  Level 0 overlaps, so a position in it has no meaning."""
    rows = runs.where(F.col("level") == F.lit(level))
    if level == 0:
        if to != "first":
            raise NotSupported("level 0 has overlapping runs and no seek")
        return rows.orderBy(column, F.col("seq").desc())
    if to == "lower_bound":
        rows = rows.where(F.col(column) >= F.lit(key))
    out = rows.orderBy(column)
    return out.limit(0) if to == "last" else out
