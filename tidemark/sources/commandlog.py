"""A log of commands as JSON lines with a checksum each; replay stops at the first broken record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.order import gaps

SCHEMA = "ord long, op string, key string, value string"


class CommandLog:
    """Commands ``(ord, op, key, value)`` under one folder, appended in batches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def append(self, commands: DataFrame) -> None:
        body = F.to_json(F.struct("ord", "op", "key", "value"), {"ignoreNullFields": "false"})
        framed = commands.select("ord", body.alias("body"))
        line = F.to_json(F.struct(F.crc32(F.col("body").cast("binary")).alias("crc"), "ord", "body"))
        framed.select(line.alias("value")).write.mode("append").text(self.path)

    def replay(self) -> DataFrame:
        """Commands in order up to, and without, the first record that is broken or missing."""
        lines = self.spark.read.text(self.path)
        got = lines.select(F.from_json("value", "crc long, ord long, body string").alias("r")).select("r.*")
        good = F.coalesce(F.crc32(F.col("body").cast("binary")) == F.col("crc"), F.lit(False))
        judged = got.select("ord", good.alias("good"), F.from_json("body", SCHEMA).alias("c"))
        # A torn line has no number and shows as a gap.
        bad = judged.where(~F.col("good") & F.col("ord").isNotNull()).agg(F.min("ord").alias("bad"))
        whole = judged.where("good").select("c.*")
        # Numbers are whole from the first on: the first gap ends the prefix.
        gap = gaps(whole, "ord").agg(F.min("gap").alias("gap"))
        stop = bad.crossJoin(gap).select(F.least("bad", "gap").alias("stop"))  # one row with one row
        return whole.crossJoin(F.broadcast(stop)).where("stop IS NULL OR ord < stop").drop("stop").orderBy("ord")
