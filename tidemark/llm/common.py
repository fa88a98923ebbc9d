"""Shared plumbing of the training-data operators: scratch tables, Arrow maps, components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
SPACE = r"\x20\x09-\x0D"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent (tests in local mode) a temporary folder is made once for the
    session; on a cluster its absence is an error, since executors do not share local folders.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.scratch", None)
    if root is None:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-scratch-")
        spark.conf.set("tidemark.scratch", root)
    return root


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to a scratch table and read it back.

    This cuts the lineage on shared storage, so a lost executor costs no recomputation, and each
    expensive scan runs once however often its result is used.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tidemark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    _MADE.append(path)
    return out


_MADE: list[str] = []


@contextmanager
def temporary() -> Iterator[list[DataFrame]]:
    """Scratch tables made inside are deleted at the end, but for those of the frames put in the list."""
    begin, keep = len(_MADE), []
    yield keep
    kept = [df._tidemark_path for df in keep]
    for path in _MADE[begin:]:
        if path not in kept:
            _delete(path)
    _MADE[begin:] = kept


def discard(df: DataFrame | None) -> None:
    """Delete the scratch table behind a frame made by :func:`materialise`."""
    path = getattr(df, "_tidemark_path", None)
    if path is not None:
        _delete(path)


def _delete(path: str) -> None:
    spark = SparkSession.active()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for a Spark context.

    Harmless where it is already on their path; skipped where it came as an archive itself.
    """
    context = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    if getattr(context, "_tidemark_shipped", False) or not root.is_dir():
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, str(p.relative_to(root.parent)))
    context.addPyFile(archive)
    context._tidemark_shipped = True


#: Bytes after which a batch for a worker ends.  Spark's own 64 MB is held by each task's writer, grown by
#: doubling, and its pieces stay with the executor's native allocator.
BATCH_BYTES = 4 << 20


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package present on the workers.

    Batches end at about ``BATCH_BYTES``, for the session's other Arrow batches too, unless
    ``spark.sql.execution.arrow.maxBytesPerBatch`` was set by its owner.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_BYTES))
    ship(df.sparkSession)
    return df.mapInArrow(_tidied(fn), schema)


def _tidied(fn: Callable) -> Callable:
    """``fn``, which gives the memory it freed back to the system at its end: a worker that waits for its
    next task should hold no more than what it keeps on purpose."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(parts)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim is not None:
                trim(0)

    return run


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, one value converted at a time so that a batch of long
    texts is never held twice."""
    for batch in batches:
        cols = batch.columns
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in cols)


def batches(
    records: Iterable[tuple], schema: pa.Schema, size: int = 4096, limit: int = 16 << 20
) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` tuples, or of about ``limit`` bytes of strings."""
    held: list[tuple] = []
    weight = 0
    for record in records:
        held.append(record)
        weight += sum(len(v) for v in record if isinstance(v, (bytes, str)))
        if len(held) >= size or weight >= limit:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*held, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def join_counted(many: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of rows with a table of one row a key, whose ``n`` is at least the key's rows in ``many``.

    ``total`` is the sum of ``n``, so at most four keys a shuffle partition (65,536 in all) have more than
    that share of it.  These alone are sent to the rows where they lie; the rest is shuffled, and no key
    of it outweighs its partition.
    """
    parts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = F.lit(max(1, total // min(4 * parts, 1 << 16)))
    hot, cold = one.where(F.col("n") > limit).drop("n"), one.where(F.col("n") <= limit).drop("n")
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rest.join(cold, key).unionByName(many.join(F.broadcast(hot), key))


def without(docs: DataFrame, ids: DataFrame, id_col: str, most: int = 1 << 20) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``ids`` (one column of that name, each once); a null id stays.

    Up to ``most`` ids, 16 MB, are sent to the rows where they lie, so that texts are not shuffled; more
    meet the rows in a shuffled join.
    """
    ids = materialise(ids)
    few = ids.count() <= most
    return docs.join(F.broadcast(ids) if few else ids, id_col, "left_anti").select(*docs.columns)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large-star and small-star steps.

    Returns ``(node, component)`` for every node of an edge, ``component`` being the smallest
    node reachable.  Each step is a grouped minimum, pre-aggregated before its shuffle, and an equi-join
    in which hubs are met apart (:func:`join_counted`); no adjacency list is ever gathered.  Every
    round is written to scratch and the round before it deleted.
    """
    now = materialise(
        edges.select(
            F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")
        )
        .where("a <> b")
        .distinct()
    )
    mark = _mark(now)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        many = F.count(F.lit(1)).alias("n")
        least = both.groupBy(F.col("u").alias("b")).agg(F.least(F.min("v"), F.col("u")).alias("m"), many)
        # Only the upper end of an edge moves: (a, b) with a > b becomes (a, least of b and around b).
        large = join_counted(now, least, "b", 2 * mark[0]).select("a", F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"), many)
        small = (
            join_counted(large, least, "a", mark[0])
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                        F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                    )
                ).alias("e")
            )
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        after = materialise(small)
        discard(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
    out._tidemark_path = now._tidemark_path
    return out


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum: equal for equal edge sets."""
    got = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).head()
    return got[0], got[1]
