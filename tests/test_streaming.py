"""Streams into a store: batches, replays, and the streamed newest rows."""

from tidemark.sources import Config, KVStore
from tidemark.streaming import ingest, latest_per_key

SPEC = "key string, seq long, value string"


def test_ingest_once(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(f"k{k}", 2 * k, "new"), ("same", 2 * k + 1, str(k))], SPEC).coalesce(1).write.mode("append").parquet(source)
    store = KVStore.open(spark, str(tmp_path / "store"), Config(key_type="string", value_type="string"))

    def stream():
        return spark.readStream.schema(SPEC).option("maxFilesPerTrigger", 1).parquet(source)

    ingest(stream(), store, "in", str(tmp_path / "checkpoint"), ordinal="seq", flush_every=2).awaitTermination()
    assert store.live_count() == 4 and len(store.manifest.marks) == 1
    seq = store.manifest.next_seq
    # A replay from the start (a lost checkpoint) takes nothing in again.
    ingest(stream(), store, "in", str(tmp_path / "other"), ordinal="seq").awaitTermination()
    assert store.manifest.next_seq == seq


def test_latest_per_key(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "old"), ("b", 3, None)], SPEC)
    rows.write.parquet(source)
    query = (
        latest_per_key(spark.readStream.schema(SPEC).parquet(source))
        .writeStream.format("memory").outputMode("update").queryName("newest").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    want = [("a", 2, "late"), ("b", 3, None)]
    assert sorted(tuple(r) for r in spark.table("newest").collect()) == want
    assert sorted(tuple(r) for r in latest_per_key(rows).collect()) == want
