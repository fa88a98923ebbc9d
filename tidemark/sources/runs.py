"""Sorted runs as Parquet: range-clustered, sorted by key, with Bloom filters on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

CODECS = ("snappy", "zstd", "lz4", "gzip", "uncompressed")


def write_run(
    rows: DataFrame,
    path: str,
    column: str = "key",
    partitions: int | None = None,
    rows_per_file: int = 0,
    block_bytes: int = 128 << 20,
    page_bytes: int = 1 << 20,
    compression: str = "zstd",
    bloom_error: float | None = 0.05,
    n_keys: int | None = None,
) -> dict:
    """Write ``(key, seq, value)`` rows as one run; returns ``lo, hi, n, min_seq, max_seq``.

    The statistics are observed while the rows pass to the writer, so nothing is read again.

    Files hold disjoint key ranges, rows in a file are sorted by key, so that footers, page indexes
    and Bloom filters let a reader skip what a key or range cannot be in.
    """
    if compression not in CODECS:
        raise ValueError(f"unknown codec {compression}")
    dealt = rows.repartitionByRange(partitions, column) if partitions else rows.repartitionByRange(column)
    seen = Observation()
    watched = dealt.sortWithinPartitions(column, F.desc("seq")).observe(
        seen,
        F.min(column).alias("lo"),
        F.max(column).alias("hi"),
        F.count(F.lit(1)).alias("n"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
    )
    out = _options(
        watched.write.mode("errorifexists")
        .option("maxRecordsPerFile", rows_per_file),
        column, block_bytes, page_bytes, compression, bloom_error, n_keys,
    )
    out.parquet(path)
    return _plain(seen.get)


def _plain(row: dict) -> dict:
    return {k: bytes(v) if isinstance(v, bytearray) else v for k, v in row.items()}


def _options(out, column, block_bytes, page_bytes, compression, bloom_error, n_keys=None):
    out = (
        out.option("compression", compression)
        .option("parquet.block.size", block_bytes)
        .option("parquet.page.size", page_bytes)
    )
    if bloom_error:
        out = (
            out.option(f"parquet.bloom.filter.enabled#{column}", "true")
            .option(f"parquet.bloom.filter.fpp#{column}", str(bloom_error))
            .option(f"parquet.enable.dictionary#{column}", "false")
        )
        if n_keys:
            out = out.option(f"parquet.bloom.filter.expected.ndv#{column}", str(n_keys))
    return out


SLICE = "_slice"


def write_slices(
    rows: DataFrame,
    path: str,
    parts: int,
    column: str = "key",
    block_bytes: int = 128 << 20,
    page_bytes: int = 1 << 20,
    compression: str = "zstd",
    bloom_error: float | None = 0.05,
) -> list[dict]:
    """Write rows as a run for each of about ``parts`` ranges, all in one job, each in a folder of its own
    below ``path``; returns ``folder, lo, hi, n, min_seq, max_seq`` of those that have rows.

    A task holds one range, and its number names the folder.
    """
    dealt = rows.repartitionByRange(parts, column).withColumn(SLICE, F.spark_partition_id())
    dealt = dealt.sortWithinPartitions(SLICE, column, F.desc("seq"))
    out = _options(
        dealt.write.mode("errorifexists").partitionBy(SLICE), column, block_bytes, page_bytes, compression, bloom_error
    )
    out.parquet(path)
    told = rows.sparkSession.read.schema(StructType([*rows.schema.fields, StructField(SLICE, IntegerType())])).parquet(path)
    told = told.groupBy(SLICE).agg(
        F.min(column).alias("lo"),
        F.max(column).alias("hi"),
        F.count(F.lit(1)).alias("n"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
    )
    found = sorted((_plain(r.asDict()) for r in told.collect()), key=lambda r: r[SLICE])  # a row a run
    return [{"folder": f"{SLICE}={r.pop(SLICE)}", **r} for r in found]


def read_runs(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of several runs; an empty frame for none."""
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)
