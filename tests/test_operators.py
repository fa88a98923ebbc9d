"""Operators on small logs: precedence, tombstones, bounds, failures, runs and edits."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark import operators as op
from tidemark.errors import NotSupported
from tidemark.operators import Bound

SPEC = "key string, seq long, value string"


def log(spark, *rows, spec=SPEC):
    return spark.createDataFrame(list(rows), spec)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_newest_wins_and_tombstones(spark):
    rows = log(spark, ("k1", 1, "1"), ("k1", 4, "2"), ("k2", 2, "1"), ("k2", 5, None), ("k3", 3, ""))
    assert got(op.resolve(rows)) == [("k1", 4, "2"), ("k2", 5, None), ("k3", 3, "")]
    assert got(op.live(op.resolve(rows))) == [("k1", 4, "2"), ("k3", 3, "")]
    assert got(op.as_of(rows, 3)) == [("k1", 1, "1"), ("k2", 2, "1"), ("k3", 3, "")]
    assert got(op.point_get(rows, "k2")) == [] and got(op.point_get(rows, "k1")) == [("k1", 4, "2")]


def test_fixed_width_values_aggregate_without_a_sort(spark):
    rows = log(spark, (1, 1, 1.5), (1, 2, None), (2, 3, 2.5), spec="key int, seq long, value double")
    out = op.resolve(rows)
    assert got(out) == [(1, 2, None), (2, 3, 2.5)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan


def test_pushdown_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    log(spark, (b"a", 1, b"x"), (b"b", 2, b"y"), spec="key binary, seq long, value binary").write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    rows = spark.read.parquet(path)
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in text(op.point_get(rows, b"a"))
    scan = text(op.range_scan(rows, Bound(b"a"), Bound(b"c", False), seq=1))
    assert "GreaterThanOrEqual(key" in scan and "LessThan(key" in scan and "LessThanOrEqual(seq" in scan


def test_merge_takes_the_first_source(spark):
    one = log(spark, ("4", 1, "0"), ("5", 1, None), ("6", 1, "0"))
    two = log(spark, ("4", 9, None), ("5", 9, "1"), ("7", 9, "1"))
    assert got(op.merge_runs(one, two).select("key", "value")) == [("4", "0"), ("5", None), ("6", "0"), ("7", "1")]
    writes = log(spark, ("5", "w"), ("8", None), spec="key string, value string")
    seen = op.overlay(op.merge_runs(one, two).select("key", "value"), writes)
    assert got(seen) == [("4", "0"), ("5", "w"), ("6", "0"), ("7", "1"), ("8", None)]


def test_compaction_golden(spark):
    spec = "level int, run_id long, key string, seq long, value string"
    rows = log(
        spark,
        (0, 1, "1", 11, "1"), (0, 1, "2", 12, "2"), (0, 1, "3", 13, "31"), (0, 2, "3", 21, "3"), (0, 2, "4", 22, "4"),
        (1, 0, "1", 1, "11"), (1, 0, "2", 2, "21"), (1, 3, "3", 3, "32"), (1, 3, "4", 4, "41"), (1, 3, "5", 5, "5"),
        spec=spec,
    )
    want = [("1", "1"), ("2", "2"), ("3", "3"), ("4", "4"), ("5", "5")]
    assert got(op.merge_levels(rows).select("key", "value")) == want
    top = op.resolve(rows.where("level = 0").select("key", "seq", "value"))
    low = rows.where("level = 1").select("key", "seq", "value")
    assert got(op.merge_anti(top, low).select("key", "value")) == want


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.integers(0, 9), st.one_of(st.none(), st.integers(0, 5))), max_size=30),
    st.one_of(st.none(), st.tuples(st.integers(-1, 10), st.booleans())),
    st.one_of(st.none(), st.tuples(st.integers(-1, 10), st.booleans())),
    st.integers(0, 31),
)
def test_scans_equal_a_dictionary(spark, writes, low, high, seq):
    rows = log(spark, *[(k, i + 1, v) for i, (k, v) in enumerate(writes)], spec="key int, seq long, value int")
    state = {k: v for i, (k, v) in enumerate(writes) if i + 1 <= seq}
    inside = lambda k: (
        (low is None or k > low[0] or low[1] and k == low[0]) and (high is None or k < high[0] or high[1] and k == high[0])
    )
    out = op.range_scan(rows, low and Bound(*low), high and Bound(*high), seq=seq).select("key", "value")
    assert [tuple(r) for r in out.collect()] == [(k, state[k]) for k in sorted(state) if inside(k)]


def test_seek_and_levels(spark):
    rows = log(spark, ("1", 1, None), ("2", 2, "0"), ("4", 3, None))
    assert [r.key for r in op.seek(rows, "lower_bound", "3").collect()] == ["4"]
    assert op.seek(rows, "last").isEmpty() and op.seek(rows).count() == 3
    with pytest.raises(NotSupported):
        op.seek(rows, "nowhere")
    with pytest.raises(NotSupported):
        op.level_scan(rows.withColumn("level", F.lit(0)), 0, "lower_bound", "1")


def test_failures_and_conflicts(spark):
    rows = log(spark, ("a", 1, "1"), ("b", 2, "1"), ("b", 3, None), ("c", 4, "1"))
    asked = log(spark, ("a", 0), ("b", 1), ("x", 2), ("a", 3), (None, 4), spec="key string, ord int")
    assert got(op.remove_failures(rows, asked, ordinal="ord")) == [(None, 4), ("a", 3), ("b", 1), ("x", 2)]
    assert got(op.remove(rows, asked, 9).select("key", "seq", "value")) == [("a", 9, None)]
    assert got(op.conflicts(rows, asked, 2)) == [("b",)] and op.conflicts(rows, asked, 3).isEmpty()


def test_commands(spark):
    spec = "ord int, op string, key string, value string"
    rows = log(spark, (0, "set", "a", "1"), (1, "set", "b", ""), (2, "remove", "a", "ignored"), (3, "get", "b", None), spec=spec)
    assert got(op.live(op.resolve(op.apply_commands(rows))).select("key", "value")) == [("b", "")]


def test_flush_points_over_many_ranges(spark):
    rows = spark.range(1, 1001).select(F.col("id").alias("seq")).repartition(7)
    out = got(op.flush_points(rows, 300).select("batch", "rows", "first_seq", "last_seq"))
    assert out == [(0, 300, 1, 300), (1, 300, 301, 600), (2, 300, 601, 900), (3, 100, 901, 1000)]


def test_one_order_over_ranges(spark):
    from tidemark.operators.order import bounds, gaps, running_total

    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("o"), F.concat(F.lit("k"), F.col("id") * 7 % 500).alias("k"))
    assert len(bounds(rows, "o", 8)) == 7 and bounds(rows.where("false"), "o") == []
    out = running_total(rows, "o", F.lit(1), "before", 8)
    assert out.where("before <> o").isEmpty() and out.count() == 500
    names = sorted(f"k{i}" for i in range(500))
    assert [r.k for r in running_total(rows, "k", F.lit(1), "n", 5).orderBy("n").collect()] == names
    assert got(gaps(rows.where("o NOT IN (77, 300, 301)"), "o")) == [(77,), (300,)] and gaps(rows, "o").isEmpty()


def test_greedy_sharding(spark):
    rows = spark.range(7).select(F.col("id").alias("key"))
    assert [s for _, s in got(op.shard_greedy(rows, 100, F.lit(40)))] == [0, 0, 1, 1, 1, 2, 2]


@pytest.mark.parametrize("size", [1, 60, 1000, 10**9])
@pytest.mark.parametrize("unknown", [None, 2500])
def test_greedy_sharding_in_ranges(spark, size, unknown):
    # Ties go by weight, null keys come last; from an unknown weight on no shard opens.
    rows = [(f"k{i:05}", i * 7919 % 61) for i in range(4000)] + [("k00009", 5), ("k00010", 0), ("k00011", 3000), (None, 50), (None, 2000)]
    if unknown is not None:
        rows[unknown] = (rows[unknown][0], None)
    want, shard, held = [], 0, 0
    parts = -(-sum(w or 0 for _, w in rows) // size)
    for k, w in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1] is not None, r[1])):
        held = None if held is None or w is None else held + w
        if held is not None and held >= size:
            shard, held = shard + 1, 0
        want.append((k, min(shard, parts - 1)))
    out = op.shard_greedy(spark.createDataFrame(rows, "key string, w int").repartition(5), size, F.col("w"))
    assert out.dtypes == [("key", "string"), ("shard", "int")]
    by = lambda r: (r[0] is None, r[0] or "", r[1])
    assert sorted(map(tuple, out.collect()), key=by) == sorted(want, key=by)
    # No task holds all rows.
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()


def test_greedy_sharding_of_little(spark):
    none = spark.createDataFrame([], "key long, w int")
    assert op.shard_greedy(none, 5, F.col("w")).isEmpty()
    nulls = spark.createDataFrame([(None, None), (None, 7), (2**60 + 1, 7)], "key long, w int")
    assert got(op.shard_greedy(nulls, 5, F.col("w"))) == [(None, 1), (None, 1), (2**60 + 1, 1)]
    with pytest.raises(NotSupported):
        op.shard_greedy(nulls, 5, F.col("w") * -1)


def test_runs_and_edits(spark):
    spec = "run_id long, level int, lo int, hi int, n long, bytes long, version long, action string"
    edits = log(
        spark,
        (1, 0, 1, 4, 3, 30, 1, "add"), (2, 0, 3, 8, 5, 50, 2, "add"), (1, 0, 1, 4, 3, 30, 3, "remove"),
        (3, 1, 1, 8, 7, 70, 3, "add"), (4, 1, 20, 30, 2, 20, 4, "add"), spec=spec,
    )
    runs = op.replay(edits)
    assert [r[0] for r in got(runs.select("run_id"))] == [2, 3, 4]
    assert [r[0] for r in got(op.replay(edits, 2).select("run_id"))] == [1, 2]
    assert got(op.stats(edits)) == [(14, 140)] and got(op.totals(runs)) == [(3, 14, 140)]
    assert got(op.garbage(edits, 2)) == [] and got(op.garbage(edits, 3)) == [(1, 3)]
    assert got(op.scope_overlaps(runs)) == [(2, 3)]
    assert [r[0] for r in got(op.pick(runs, 0).select("run_id"))] == [2, 3]
    assert got(op.fuse(runs.where("level = 1"))) == [(1, 30)]
    assert [r[0] for r in got(runs.where(op.meets(Bound(8, False), None)).select("run_id"))] == [4]
    assert [r[0] for r in got(runs.where(op.contains(4, 8)).select("run_id"))] == [2, 3]
    assert got(op.level_loads(runs).select("level", "runs", "most", "over")) == [(0, 1, 4, False), (1, 2, 40, False)]
    assert got(op.describe(runs).select("level", "scopes")) == [(0, "2 [3, 8]"), (1, "3 [1, 8]; 4 [20, 30]")]


def test_bloom(spark):
    assert fn.bloom_bits(1000) == 6236 and fn.bloom_hashes() == 5
    keys = spark.range(2000).select(F.col("id").alias("key"))
    words, bits, hashes = fn.bloom_build(keys, p=0.01)
    assert fn.bloom_probe(keys, words, bits, hashes).where("NOT maybe").isEmpty()
    others = spark.range(10_000, 20_000).select(F.col("id").alias("key"))
    wrong = fn.bloom_probe(others, words, bits, hashes).where("maybe").count()
    assert 40 < wrong < 200  # about 1 in 100


def test_prefixes_and_checksums(spark):
    rows = spark.createDataFrame([(k,) for k in ("abc", "abd", "abe", "b")], "key string")
    assert got(fn.prefix_groups(rows, interval=3)) == [(0, 3, 2, 9, 5), (1, 1, 1, 1, 1)]
    import zlib

    (crc,) = spark.createDataFrame([("abc",)], "v string").select(fn.checksum(F.col("v"))).head()
    assert crc == zlib.crc32(b"abc")


def test_empty_log(spark):
    none = log(spark)
    assert op.live(op.resolve(none)).isEmpty() and op.range_scan(none, Bound("a")).isEmpty()
    assert op.multi_get(none, spark.createDataFrame([("a",)], "key string")).head()["found"] is False
    assert op.flush_points(none, 3).isEmpty() and op.run_scopes(none.withColumns({"level": F.lit(0), "run_id": F.lit(1)})).isEmpty()
