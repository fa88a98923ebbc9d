"""The same checks over every backend, and what only the Parquet store has."""

import pytest

from tidemark.errors import KeyNotFound, ProcessExists
from tidemark.operators import Bound
from tidemark.sources import CommandLog, Config, KVStore, MemoryStore

STRINGS = Config(key_type="string", value_type="string")


@pytest.fixture(params=["parquet", "memory"])
def store(request, spark, tmp_path):
    return MemoryStore(spark) if request.param == "memory" else KVStore.open(spark, str(tmp_path), STRINGS)


def test_generic(spark, store):
    assert store.is_empty() and len(store) == 0 and store.get("a") is None
    with pytest.raises(KeyNotFound):
        store.remove("a")
    store.set("a", "1")
    store.set("a", "2")
    store.put(spark.createDataFrame([("b", "x"), ("c", "")], "key string, value string"))
    assert store.get("a") == "2" and store.get("c") == "" and not store.is_empty() and len(store) == 4
    store.remove("b")
    store.flush()
    assert store.get("b") is None and len(store) == 3 and store.live_count() == 2
    assert [tuple(r) for r in store.iter(Bound("a", False)).collect()] == [("b", None), ("c", "")]
    asked = spark.createDataFrame([(0, "c"), (1, "b"), (2, "c")], "ord int, key string")
    assert [r.found for r in store.multi_get(asked, "ord").collect()] == [True, False, True]
    assert sorted(r.ord for r in store.remove_all(asked, "ord").collect()) == [1, 2]
    assert store.get("c") is None and store.size_of_disk() >= 0


def test_exclusive(spark, tmp_path):
    with KVStore.open(spark, str(tmp_path), STRINGS, exclusive=True):
        with pytest.raises(ProcessExists):
            KVStore.open(spark, str(tmp_path), STRINGS, exclusive=True)
        KVStore.open(spark, str(tmp_path), STRINGS).set("k", "shared writers need no lock")
    KVStore.open(spark, str(tmp_path), STRINGS, exclusive=True).close()


def test_restore_versions_and_memory(spark, tmp_path):
    log = CommandLog(spark, str(tmp_path / "log"))
    spec = "ord long, op string, key string, value string"
    log.append(spark.createDataFrame([(0, "set", "a", "1"), (1, "set", "a", "2"), (2, "set", "b", "1"), (3, "remove", "b", None)], spec))
    store = KVStore.open(spark, str(tmp_path / "store"), STRINGS)
    store.restore(log)
    assert store.get("a") == "2" and store.get("b") is None
    assert store.versions() == list(range(1, store.manifest.version + 1))
    held = store.snapshot().persist()
    assert held.storageLevel.useMemory and held.count() == 2
    held.unpersist()
