"""Both sides of the similarity that the near-copy stage names."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, simhash


def pair(rng, replaced, words=204):
    """Two texts of ``words - 4`` shingles each, ``replaced`` of them differing."""
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, words)]
    return " ".join(base), " ".join(base[: words - replaced] + [f"v{x}" for x in rng.integers(0, 1 << 40, replaced)])


def dedup(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.similar_dedup(docs, **more).collect()}


def test_pairs_below_the_similarity_are_not_linked(spark):
    """178 of 222 shingles shared is 0.802, 177 of 223 is 0.794, 165 of 235 is 0.702."""
    rng = np.random.default_rng(11)
    replaced = [22] * 40 + [23] * 40 + [35] * 40
    found = dedup(spark, [t for r in replaced for t in pair(rng, r)])
    linked = [found[2 * k] == found[2 * k + 1] for k in range(len(replaced))]
    assert sum(linked[:40]) >= 36 and not any(linked[40:])


@pytest.mark.parametrize("sides", [False, True])
def test_link_sets(sides):
    """Components of sets against a comparison of every pair."""
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 60))).astype(np.uint64)
        for _ in range(4):
            kept = base[rng.random(len(base)) < 0.93]
            sets.append(np.unique(np.r_[kept, rng.integers(0, 1 << 63, int(rng.integers(0, 3))).astype(np.uint64)]))
    sets.append(np.empty(0, np.uint64))
    side = rng.integers(0, 2, len(sets)) if sides else None
    plain = [set(x.tolist()) for x in sets]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            apart = side is None or side[i] != side[j]
            if apart and plain[i] and plain[j] and 5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    got = simhash.link_sets(sets, 0.8, side).tolist()
    assert {(i, j) for i in range(len(sets)) for j in range(i) if root[i] == root[j]} == {
        (i, j) for i in range(len(sets)) for j in range(i) if got[i] == got[j]
    }


def test_every_pair_at_the_similarity_is_linked(spark):
    """Isolated pairs at 0.802, one of their own each: all are found."""
    rng = np.random.default_rng(12)
    found = dedup(spark, [t for _ in range(300) for t in pair(rng, 22)])
    assert all(found[2 * k] == found[2 * k + 1] for k in range(300)) and len(set(found.values())) == 300


@pytest.mark.parametrize("large,most", [(256, 1 << 16), (4, 1 << 16), (256, 8)])
def test_prefixes_meet_every_pair(spark, monkeypatch, large, most):
    """Candidates of prefixes alone, at any size of set, in large and in cut buckets."""
    monkeypatch.setattr(simhash.link_parities, "__defaults__", (None, large))
    rng = np.random.default_rng(13)
    counts = np.zeros(simhash.PLACES, np.int32)
    common = rng.integers(0, 1 << 63, 3).astype(np.uint64)
    sets = []
    for m in (1, 4, 5, 9, 10, 40, 41, 300, 510, 1040):
        for _ in range(8):
            base = np.r_[common, rng.integers(0, 1 << 63, m).astype(np.uint64)]
            sets += [np.unique(base), np.unique(np.r_[base[: len(base) - len(base) // 9], rng.integers(0, 1 << 63, len(base) // 9).astype(np.uint64)])]
    rows = []
    for i, h in enumerate(sets):
        first = simhash.prefix(h, 0.8, counts).view(np.int64).tolist()
        slots, prints = simhash.parities(h, 0.8)
        rows.append((i, slots, [bytearray(x) for x in prints], first[:1], first[1:]))
    classes = spark.createDataFrame(rows, "code long, slots array<int>, parities array<binary>, common array<long>, prefix array<long>")
    found = {r.node: r.component for r in simhash.components(simhash.prefix_links(classes, 0.8, most, every=1)).collect()}
    plain = [set(x.tolist()) for x in sets]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j])]
    assert len(pairs) >= 60 and all(found[i] == found[j] for i, j in pairs)


def test_leads_lose_no_pair(spark):
    """Pairs of equal and of unequal size just at the similarity, under shingles that others share as well."""
    rng = np.random.default_rng(17)
    counts = np.zeros(simhash.PLACES, np.int32)
    pool = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    new = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    sets = []
    for m in (1, 5, 10, 45, 90, 300, 1100):
        for _ in range(12):
            base = np.unique(np.r_[new(m), rng.choice(pool, m // 3)])
            cut = int(rng.integers(0, len(base) // 5 + 1))  # of a subset, or as many again replaced
            least = int(np.ceil(0.8 * len(base) - 1e-9))
            other = base[rng.permutation(len(base))[: max(least, len(base) - cut)]]
            swap = len(base) // 9
            sets += [base, other, np.unique(np.r_[rng.permutation(base)[swap:], new(swap)])]
    rows = []
    for i, h in enumerate(sets):
        first = simhash.prefix(h, 0.8, counts).view(np.int64).tolist()
        slots, prints = simhash.parities(h, 0.8)
        rows.append((i, len(h), simhash.lead(len(h), 0.8), slots, [bytearray(x) for x in prints], [], first))
    spec = "code long, size long, lead long, slots array<int>, parities array<binary>, common array<long>, prefix array<long>"
    links = simhash.prefix_links(spark.createDataFrame(rows, spec), 0.8, every=1)
    found = {r.node: r.component for r in simhash.components(links).collect()}
    plain = [set(x.tolist()) for x in sets]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j])]
    assert len(pairs) >= 150 and all(i in found and found[i] == found.get(j) for i, j in pairs)


@pytest.mark.parametrize("most", [0, 2])
def test_without(spark, most):
    """Ids sent to the rows, or met in a shuffled join: the same rows stay, those without an id among them."""
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (4, None)], "doc_id long, text string")
    gone = spark.createDataFrame([(2,), (9,)], "doc_id long")
    out = common.without(docs, gone, "doc_id", most)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.where("doc_id IS NULL OR doc_id <> 2").collect()))


def brute(fps, radius):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return root


@pytest.mark.parametrize("most", [10, 60, 1000])
def test_cut_buckets_lose_no_pair(spark, most):
    """A bucket of a tight cluster, chains and texts of their own, cut into chunks or not."""
    rng = np.random.default_rng(7)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 60)}
    centre = int(rng.integers(0, 1 << 63))
    fps |= {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (80, 2))}
    for start in rng.integers(0, 1 << 63, 3):
        at = int(start)
        for k in range(12):
            fps.add(at)
            at ^= 0b1111 << (4 * k)  # each step as far as may be
    fps = sorted(fps)
    rows = [(0, 5, x, i) for i, x in enumerate(fps)]
    dealt = spark.createDataFrame(rows, "slot long, key long, fp long, rep long")
    out = simhash.components(simhash.link_buckets(dealt, simhash._linker(4), most, every=1))
    found = {r.node: r.component for r in out.collect()}
    want, got = brute(fps, 4), [found.get(i, i) for i in range(len(fps))]
    assert {(i, j) for i in range(len(fps)) for j in range(i) if want[i] == want[j]} == {
        (i, j) for i in range(len(fps)) for j in range(i) if got[i] == got[j]
    }


def test_cut_components_of_sets(spark):
    """Whole sets in cut components: links across chunks are found, and none below the similarity."""
    rng = np.random.default_rng(17)
    base = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    sets = []
    for k in range(40):  # a drift: neighbours share most, ends little
        sets.append(np.unique(np.r_[base[2 * k :], rng.integers(0, 1 << 63, 2 * k).astype(np.uint64)]))
    rows = [(0, 1, bytearray(x.tobytes()), i, len(x) * 8) for i, x in enumerate(sets)]
    dealt = spark.createDataFrame(rows, "slot long, key long, fp binary, rep long, bytes long")
    want = simhash.link_sets(sets, 0.8).tolist()
    for most in (2000, 8000, 1 << 20):
        edges = [(r.a, r.b) for r in simhash.link_buckets(dealt, simhash._set_linker(0.8), most, 1, F.col("bytes")).collect()]
        root = list(range(len(sets)))
        for a, b in edges:
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        assert {(i, j) for i in range(len(sets)) for j in range(i) if root[i] == root[j]} == {
            (i, j) for i in range(len(sets)) for j in range(i) if want[i] == want[j]
        }


def test_a_tight_cluster_takes_little_time():
    rng = np.random.default_rng(8)
    n = 16_000
    fp = np.full(n, rng.integers(0, 1 << 63), np.uint64)
    for _ in range(2):
        fp ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    for cross in (None, np.arange(n) % 2):
        began = time.perf_counter()
        assert len(set(simhash.link_arrays(np.zeros(n, int), fp[:, None], 4, cross).tolist())) == 1
        assert time.perf_counter() - began < 1


def test_a_star_of_100_000_leaves(spark):
    """A hub among the edges is met where they lie: no partition of the join holds it."""
    edges = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    out = simhash.components(edges)
    assert out.count() == 100_001 and out.where("component <> 0").isEmpty()
    one = spark.createDataFrame([(0, 100_000, 7), (1, 1, 8)], "b long, n long, m long")
    plan = simhash.join_counted(edges.select("a", F.when(F.col("b") == 1, 1).otherwise(0).cast("long").alias("b")), one, "b", 100_001)
    assert plan.count() == 100_000 and "BroadcastHashJoin" in plan._jdf.queryExecution().toString()
