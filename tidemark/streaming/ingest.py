"""Structured Streaming into a store: one commit per micro-batch, each taken in once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import resolve
from tidemark.sources import KVStore


def ingest(
    stream: DataFrame,
    store: KVStore,
    name: str,
    checkpoint: str,
    ordinal: str | None = None,
    flush_every: int = 0,
    **trigger,
) -> StreamingQuery:
    """Write a stream of rows ``(key, value[, ordinal])`` to a store.

    A micro-batch is one commit: its last row of a key by ``ordinal`` stays.  The manifest version that
    adds the batch's run also records the batch's number under ``name``; a batch that is replayed after
    a failure is left out, so rows are taken in exactly once.  ``flush_every`` batches the store is
    flushed besides its own thresholds.  ``trigger`` is passed on (default: ``availableNow=True``).
    """

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.select("key", "value", *([ordinal] if ordinal else []))
        store.put(rows, ordinal=ordinal, mark=(name, number))
        if flush_every and (number + 1) % flush_every == 0:
            store.flush()

    return (
        stream.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .queryName(name)
        .start()
    )


def latest_per_key(stream: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """Newest row of each key over a stream, for ``update`` mode.

    State is one row a key; rows that come late are compared by ``order``, not by arrival.
    """
    if not stream.isStreaming:
        return resolve(stream, key, [F.col(order)])
    rest = [c for c in stream.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.col(order)).alias("_row")
    return stream.groupBy(key).agg(newest).select(key, "_row.*")
