"""Writers that overlap, merges that are cut into runs, readers against the collector, exact cuts by weight."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import flush_points, scope_overlaps
from tidemark.sources import Config, KVStore


def store_at(spark, path, **more):
    return KVStore.open(spark, str(path), Config(key_type="bigint", value_type="string", **({"auto": False} | more)))


def pairs(spark, keys, value):
    return spark.createDataFrame([(k, f"{value}{k}") for k in keys], "key long, value string")


def between(store, act):
    """Let ``act`` happen after the store's next write of files and before the version that names them."""
    write = store._write

    def late(*args, **more):
        store._write = write
        made = write(*args, **more)
        act()
        return made

    store._write = late


def test_two_writers_at_one_version(spark, tmp_path):
    a, b = store_at(spark, tmp_path / "s"), store_at(spark, tmp_path / "s")
    between(a, lambda: b.put(pairs(spark, [2], "b")))
    a.put(pairs(spark, [1], "a"))
    assert a.get(1) == "a1" and a.get(2) == "b2" and b.get(1) == "a1" and len(a) == 2
    assert len(a.files.names("data")) == 2  # the attempt that lost is gone


def test_merge_against_put_and_merge(spark, tmp_path):
    a, b = store_at(spark, tmp_path / "s"), store_at(spark, tmp_path / "s")
    for k in range(3):
        a.put(pairs(spark, [k, 9], f"v{k}."))
    between(a, lambda: b.put(pairs(spark, [7], "b")))
    a.flush()
    between(a, b.flush)
    a.flush()
    got = {r.key: r.value for r in a.snapshot().latest().collect()}
    assert got == {0: "v0.0", 1: "v1.1", 2: "v2.2", 9: "v2.9", 7: "b7"} and a.log.load().version == b.log.load().version


def test_a_batch_that_repeats_a_key_leaves_nothing(spark, tmp_path):
    s = store_at(spark, tmp_path / "s")
    with pytest.raises(ValueError):
        s.put(pairs(spark, [1, 1], "x"))
    assert s.is_empty() and s.files.names("data") == []


def test_removal_of_a_key_that_is_set_meanwhile(spark, tmp_path):
    a, b = store_at(spark, tmp_path / "s"), store_at(spark, tmp_path / "s")
    a.put(pairs(spark, [1, 2], "a"))
    between(a, lambda: b.set(1, "new"))
    a.remove_all(spark.createDataFrame([(1,)], "key long"))
    assert a.get(1) is None and a.get(2) == "a2"  # judged anew, after the other's write
    assert {r.seq for r in a.snapshot().rows().where("key = 1").collect()} == {1, 2, 3}


def sliced(spark, path, **more):
    """A store with one run at level 0 that a merge cuts into about six."""
    s = store_at(spark, path, **more)
    s.put(spark.range(4000).select(F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("value")))
    s.flush()
    s.config = replace(s.config, run_bytes=s.size_of_disk() // 6 + 1)
    return s


def test_merges_are_cut_into_runs(spark, tmp_path):
    s = sliced(spark, tmp_path / "s")
    s.compact(level=0)
    runs = sorted((r for r in s.manifest.runs if r.level == 1), key=lambda r: r.lo)
    assert len(runs) >= 3 and all(x.hi < y.lo for x, y in zip(runs, runs[1:], strict=False)) and sum(r.n for r in runs) == 4000
    before = {r.folder for r in runs}
    s.put(pairs(spark, [runs[1].lo], "new"))
    s.flush()
    s.compact(level=0)
    after = {r.folder for r in s.manifest.runs if r.level == 1}
    assert len(before & after) == len(before) - 1  # far runs are untouched
    assert s.get(runs[1].lo) == f"new{runs[1].lo}" and s.live_count() == 4000
    asked = spark.createDataFrame([(5,), (3999,), (77777,)], "key long")
    assert {r.key: r.found for r in s.multi_get(asked).collect()} == {5: True, 3999: True, 77777: False}
    files = s.snapshot().multi_get(spark.createDataFrame([(5,)], "key long")).inputFiles()
    assert len({f.rsplit("/", 1)[0] for f in files}) == 1


def test_a_level_is_drained_run_by_run(spark, tmp_path):
    s = sliced(spark, tmp_path / "s", first=1, growth=2, levels=3)
    s.compact_full()
    by = [sum(r.level == k for r in s.manifest.runs) for k in range(3)]
    assert by[0] == 0 and by[1] <= 1 and by[2] >= 2 and s.live_count() == 4000


def test_vacuum_spares_readers(spark, tmp_path):
    s = store_at(spark, tmp_path / "s", orphan_seconds=0.0)
    s.put(pairs(spark, range(10), "a"))
    view = s.snapshot()
    s.put(pairs(spark, range(10), "b"))
    s.flush()
    s.files.create("data/run-left-over/part", "x")
    assert s.vacuum() == [] and "run-left-over" not in s.files.names("data")
    assert view.get(3) == "a3"
    view.close()
    assert len(s.vacuum()) == 2 and s.get(3) == "b3"


def test_versions_before_a_checkpoint_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.sources.manifest.CHECKPOINT", 2)
    s = store_at(spark, tmp_path / "s")
    for k in range(4):
        s.set(k, str(k))
    s.vacuum()
    assert s.versions()[0] > 1 and store_at(spark, tmp_path / "s").live_count() == 4


def test_misses_bring_a_merge(spark, tmp_path):
    s = store_at(spark, tmp_path / "s", auto=True, most_misses=2)
    s.put(pairs(spark, [1, 5], "a"))
    s.flush()
    for _ in range(3):
        assert s.get(3) is None
    assert [r.level for r in s.manifest.runs] == [1] and s.get(5) == "a5"


def test_many_single_writes_in_a_transaction(spark, tmp_path):
    s = store_at(spark, tmp_path / "s")
    tx = s.begin()
    for k in range(2000):
        tx.set(k, str(k))
    tx.remove(1999)
    assert tx.get(7) == "7" and not tx.contains(1999)
    tx.commit()
    assert s.live_count() == 1999


@pytest.mark.parametrize("threshold", [1, 7, 40, 1000, 10**9])
def test_batches_by_weight(spark, threshold):
    rng = np.random.default_rng(3)
    weights = [None, *rng.integers(0, 60, 1500).tolist(), 0, 500, 0, 0, 41]
    log = spark.createDataFrame(list(enumerate(weights)), "seq long, w long").repartition(5)
    want, held, first, rows = [], 0, 0, 0
    for i, w in enumerate(weights):
        held, rows = held + (w or 0), rows + 1
        if held >= threshold:
            want.append((len(want), rows, held, first, i))
            held, first, rows = 0, i + 1, 0
    if rows:
        want.append((len(want), rows, held, first, len(weights) - 1))
    got = flush_points(log, threshold, F.col("w"))
    assert sorted(map(tuple, got.select("batch", "rows", "weight", "first_seq", "last_seq").collect())) == want


def test_no_batches(spark):
    assert flush_points(spark.createDataFrame([], "seq long, w long"), 5, F.col("w")).isEmpty()


def test_overlaps(spark):
    rng = np.random.default_rng(4)
    runs = [(i, int(lo), int(lo + width)) for i, (lo, width) in enumerate(zip(rng.integers(0, 1000, 200), rng.integers(0, 90, 200), strict=True))]
    got = scope_overlaps(spark.createDataFrame(runs, "run_id long, lo long, hi long"))
    want = {(a[0], b[0]) for a in runs for b in runs if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2]}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
