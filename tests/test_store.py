"""The store's contract: versions, tombstones, snapshots, transactions, compaction, reopening."""

import pytest
from pyspark.sql import functions as F

from tidemark.errors import KeyNotFound, LevelOver, NotSupported, RepeatedWrite
from tidemark.operators import Bound
from tidemark.sources import Config, KVStore

STRINGS = Config(key_type="string", value_type="string")


def make(spark, path, config=STRINGS, **kw):
    return KVStore.open(spark, str(path), config, **kw)


def rows(df):
    return [tuple(r) for r in df.collect()]


def frame(spark, *pairs, spec="key string, value string"):
    return spark.createDataFrame(list(pairs), spec)


def test_stored_value_survives_reopening(spark, tmp_path):
    with make(spark, tmp_path) as store:
        store.set("key1", "value1")
        store.set("key2", "value2")
        assert store.get("key1") == "value1"
        store.flush()
        assert store.get("key2") == "value2"
    again = make(spark, tmp_path)
    assert again.get("key1") == "value1" and again.get("key2") == "value2"
    assert again.get("key3") is None
    assert len(again) == 2 and not again.is_empty() and again.size_of_disk() > 0


def test_overwrite_and_empty_value(spark, tmp_path):
    store = make(spark, tmp_path)
    for v in ("value1", "value2", ""):
        store.set("key1", v)
        assert store.get("key1") == v
        store.flush()
    assert store.get("key1") == ""  # an empty value is no tombstone
    assert store.live_count() == 1 and len(store) == 3


def test_remove(spark, tmp_path):
    store = make(spark, tmp_path)
    with pytest.raises(KeyNotFound):
        store.remove("key1")
    store.set("key1", "value1")
    store.remove("key1")
    assert store.get("key1") is None and not store.contains_key("key1")
    with pytest.raises(KeyNotFound):
        store.remove("key1")
    store.flush()
    assert store.get("key1") is None
    store.set("key1", "back")
    assert store.get("key1") == "back"


def test_batches(spark, tmp_path):
    store = make(spark, tmp_path)
    seq = store.put(frame(spark, ("a", "1", 0), ("b", "2", 1), ("a", "3", 2), spec="key string, value string, ord int"), "ord")
    assert seq == 1
    with pytest.raises(ValueError):
        store.put(frame(spark, ("a", "1"), ("a", "2")))
    asked = frame(spark, (0, "b"), (1, "x"), (2, "a"), (3, "b"), spec="ord int, key string")
    assert rows(store.multi_get(asked, "ord").select("ord", "value", "found")) == [
        (0, "2", True), (1, None, False), (2, "3", True), (3, "2", True),
    ]
    failed = store.remove_all(asked, "ord")
    assert sorted(rows(failed.select("ord", "key"))) == [(1, "x"), (3, "b")]
    assert store.live_count() == 0


@pytest.mark.parametrize("low,high,want", [
    (None, None, "abcd"), (Bound("b"), None, "bcd"), (Bound("b", False), None, "cd"), (None, Bound("c"), "abc"),
    (None, Bound("c", False), "ab"), (Bound("b"), Bound("c"), "bc"), (Bound("a", False), Bound("d", False), "bc"),
    (Bound("bb"), Bound("z"), "cd"), (Bound("x"), None, ""),
])
def test_range_over_flushed_and_fresh_rows(spark, tmp_path, low, high, want):
    store = make(spark, tmp_path)
    store.put(frame(spark, ("a", "1"), ("b", "1"), ("c", "1")))
    store.flush()
    store.put(frame(spark, ("b", "2"), ("d", "2")))
    store.remove("c")
    got = rows(store.iter(low, high))
    assert "".join(k for k, _ in got) == want  # the tombstone of c is emitted
    assert dict(got).get("b", "2") == "2" and dict(got).get("c") is None


def test_scans(spark, tmp_path):
    store = make(spark, tmp_path)
    store.put(frame(spark, ("a", "1"), ("b", "1")))
    store.flush()
    store.set("c", "2")
    view = store.snapshot()
    assert rows(view.flushed()) == [("a", "1"), ("b", "1")]
    assert rows(view.range(descending=True))[0] == ("c", "2")
    assert rows(view.seek("lower_bound", "b")) == [("b", "1"), ("c", "2")]
    assert rows(view.seek("last")) == []
    with pytest.raises(NotSupported):
        view.level(0, "lower_bound", "a")
    store.compact(level=0)
    assert [r[0] for r in rows(store.snapshot().level(1, "lower_bound", "b"))] == ["b"]


def test_snapshot_reads_its_own_time(spark, tmp_path):
    store = make(spark, tmp_path)
    first = store.set("k", "1")
    view = store.snapshot()
    store.set("k", "2")
    store.flush()
    store.compact(level=0)
    assert view.get("k") == "1" and store.get("k") == "2"
    assert store.snapshot(view.manifest.version).get("k") == "1"
    assert view.seq == first


def test_transaction(spark, tmp_path):
    store = make(spark, tmp_path, Config(key_type="int", value_type="string"))
    ids = spark.range(100).select(F.col("id").cast("int").alias("key"), F.concat("id", F.lit("0")).alias("value"))
    store.put(ids.where("key < 50"))
    store.flush()
    store.put(ids.where("key >= 50 AND key < 75"))
    tx = store.begin()
    tx.put(ids.where("key >= 75"))
    tx.remove(99)
    assert store.get(80) is None and tx.get(80) == "800" and tx.get(10) == "100"
    assert tx.get(99) is None
    with pytest.raises(KeyNotFound):
        tx.remove(99)
    got = rows(tx.range(Bound(25)))
    assert [k for k, _ in got] == list(range(25, 100)) and got[-1] == (99, None)
    tx.commit()
    assert store.get(98) == "980" and store.get(99) is None
    assert store.begin().commit() is None  # nothing written


def test_first_committer_wins(spark, tmp_path):
    store = make(spark, tmp_path)
    a, b, c = store.begin(), store.begin(), store.begin()
    a.set("same", "")
    b.set("same", "x")
    b.set("other", "x")
    c.set("free", "y")
    a.commit()
    store.flush()  # the check covers what has been flushed since
    with pytest.raises(RepeatedWrite):
        b.commit()
    assert store.get("other") is None and store.get("same") == ""
    c.commit()
    assert store.get("free") == "y"
    d = store.begin()
    d.set("same", "d")
    store.set("same", "plain")  # a plain write conflicts as well
    with pytest.raises(RepeatedWrite):
        d.commit()
    e = store.begin()
    e.set("gone", "1")
    e.rollback()
    assert store.get("gone") is None


def test_two_writers_get_versions_of_their_own(spark, tmp_path):
    one, two = make(spark, tmp_path), make(spark, tmp_path)
    stale = one.manifest
    two.set("a", "2")
    assert one.log.append(stale, [], 9, 9, {}) is None  # that version is taken
    one.set("b", "1")
    assert two.get("b") == "1" and one.get("a") == "2" and one.manifest.next_seq == 3


def test_compaction_keeps_the_visible_state(spark, tmp_path):
    store = make(spark, tmp_path, Config(key_type="int", value_type="string", auto=False, run_bytes=1 << 20))
    want = {}
    for k in range(6):
        batch = {i: f"{k}-{i}" for i in range(k * 10, k * 10 + 25)}
        store.put(frame(spark, *batch.items(), spec="key int, value string"))
        want |= batch
        store.flush()
    store.remove(7)
    want.pop(7)
    store.flush()
    store.compact(level=0)
    assert {r.level for r in store.manifest.runs} == {1}
    assert dict(rows(store.snapshot().latest())) == want
    assert rows(store.iter(Bound(7), Bound(7))) == [(7, None)]  # the tombstone is kept
    store.put(frame(spark, (7, "again"), spec="key int, value string"))
    store.flush()
    store.compact(7, 7, 0)
    store.compact(level=1)
    assert store.get(7) == "again" and {r.level for r in store.manifest.runs} == {2}
    store.compact(9, 1, 0)  # an empty range
    with pytest.raises(LevelOver):
        store.compact(level=3)
    gone = store.vacuum()
    assert gone and dict(rows(store.snapshot().latest())) == want | {7: "again"}


def test_levels_merge_by_themselves(spark, tmp_path):
    store = make(spark, tmp_path, Config(key_type="int", value_type="string", flush_rows=1, first=2, growth=2))
    for k in range(5):
        store.put(frame(spark, (k, str(k)), (100, str(k)), spec="key int, value string"))
    now = store.manifest
    assert not [r for r in now.runs if r.level == -1]
    assert all(sum(r.level == n for r in now.runs) < 2 * 2**n for n in range(3))
    assert store.get(100) == "4" and store.live_count() == 6
    assert {r["level"] for r in store.describe().collect()} == {r.level for r in now.runs}


def test_binary_keys_sort_unsigned(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path))
    keys = [b"", b"\x00", b"\x7f", b"\x80", b"\xff"]
    store.put(spark.createDataFrame([(k, k) for k in reversed(keys)], "key binary, value binary"))
    store.flush()
    assert [bytes(k) for k, _ in rows(store.iter())] == keys
    assert [bytes(k) for k, _ in rows(store.iter(Bound(b"\x7f"), Bound(b"\x80")))] == keys[2:4]
    assert store.get(b"\x80") == b"\x80" and store.get(b"\x81") is None


def test_checkpoints(spark, tmp_path, monkeypatch):
    from tidemark.sources import manifest

    monkeypatch.setattr(manifest, "CHECKPOINT", 3)
    store = make(spark, tmp_path, Config(key_type="string", value_type="string", auto=False))
    for k in range(5):
        store.set("k", str(k))
    names = store.files.names("_manifest")
    assert any(n.endswith(".checkpoint") for n in names)
    before = store.manifest
    for n in names:  # what a checkpoint covers is not needed any more
        if n.isdigit() and int(n) < 4:
            store.files.delete(f"_manifest/{n}")
    assert store.manifest.runs == before.runs and store.get("k") == "4"


def test_command_log_replays_its_whole_prefix(spark, tmp_path):
    from tidemark.operators import apply_commands, live, resolve
    from tidemark.sources import CommandLog

    log = CommandLog(spark, str(tmp_path / "wal"))
    spec = "ord long, op string, key string, value string"
    log.append(spark.createDataFrame([(0, "set", "a", "1"), (1, "set", "b", "2"), (2, "remove", "a", None)], spec))
    log.append(spark.createDataFrame([(3, "set", "c", ""), (5, "set", "d", "lost")], spec))
    got = log.replay()
    assert [r.ord for r in got.collect()] == [0, 1, 2, 3]
    assert sorted(rows(live(resolve(apply_commands(got))).select("key", "value"))) == [("b", "2"), ("c", "")]
    part = next(p for p in (tmp_path / "wal").iterdir() if p.name.startswith("part") and '"ord":1,' in p.read_text())
    part.write_text(part.read_text().replace("b", "B", 1) if '"ord":1,' in part.read_text() else "")
    crc = tmp_path / "wal" / f".{part.name}.crc"
    crc.unlink(missing_ok=True)
    assert [r.ord for r in log.replay().collect()] == [0]
