"""Registered queries against their SQL, and the pipeline against a brute-force version."""

import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, mixing, quality, registry, simhash
from tidemark.llm.common import materialise

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def told(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted([text(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = con.execute(registry.ORACLES[name])
    df = registry.QUERIES[name](spark, SF)
    assert told(df.columns, [tuple(r) for r in df.collect()]) == told([d[0] for d in out.description], out.fetchall())


@pytest.mark.parametrize("name,key", [
    ("op1_simhash_near_dedup", "documents"), ("op3_bpe", "documents"), ("op5_quality_classifier", "documents"), ("op6_pii", "documents"),
    ("op8_language_id", "pages"), ("op9_lm_scoring", "documents"),
])
def test_a_row_for_every_row(spark, name, key):
    assert registry.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{key}.parquet").count()


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def test_stages(spark):
    """Every stage on what the one before kept, each against the same decision made by hand."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, ids = {}, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, before, SF))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        kept[name] = docs
        ids.append(Counter(r.doc_id for r in docs.select("doc_id").collect()))
    first, exact, near, mixed, last = kept.values()

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in ids[0] for i in good) >= 0.95 * len(good)  # few labels here: clean texts stay above all

    rows = [(r.doc_id, r.text) for r in first.collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(t.split()), []).append((-len(t), i))
    assert set(ids[1]) == {min(g)[1] for g in groups.values()} and max(ids[1].values()) == 1

    sets = {}
    for r in exact.collect():
        w = r.text.lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    best = {i: max((jaccard(s, sets[j]) for j in sets if j != i), default=0) for i, s in sets.items()}
    assert all(i in ids[2] for i in sets if best[i] < 0.4)  # texts of their own stay
    close = [(i, j) for i in ids[2] for j in ids[2] if i < j and jaccard(sets[i], sets[j]) >= 0.9]
    assert not close

    times = {r.doc_id: r.times for r in mixing.mix(near).collect()}
    assert ids[3] == +Counter(times)

    codec = bpe.Codec(bpe.vocabulary_path())
    want = Counter((r.doc_id, len(codec.encode(r.text)) // 4) for r in mixed.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in last.collect()) == want and ids[4] == ids[3]


def test_near_copies_of_either_kind(spark):
    """Near by SimHash bits alone, near by shingle sets alone, a chain of both, and a text of its own."""
    rng = np.random.default_rng(23)
    swap = lambda words, at: [f"v{rng.integers(1 << 40)}" if k in at else w for k, w in enumerate(words)]
    shingles = lambda words: {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    def bits(a, b):
        return bin(simhash.fingerprint(" ".join(a).encode()) ^ simhash.fingerprint(" ".join(b).encode())).count("1")

    def alike(near_bits):
        """A text, and one that is near by bits and not by sets, or the other way round."""
        places = {30, 60, 90, 120, 150, 180} if near_bits else {60, 150}
        a = [f"w{x}" for x in rng.integers(0, 1 << 40, 204)]
        while True:
            b = swap(a, places)
            if (bits(a, b) <= 4) == near_bits == (jaccard(shingles(a), shingles(b)) < 0.8):
                return a, b
            if not near_bits:
                a = [f"w{x}" for x in rng.integers(0, 1 << 40, 204)]

    a, b = alike(True)
    while True:
        c = swap(b, {15, 45, 105})  # near b by sets alone, and far from a
        if bits(b, c) > 4 and bits(a, c) > 4 and jaccard(shingles(b), shingles(c)) >= 0.8 > jaccard(shingles(a), shingles(c)):
            break
    pairs = [a, b, c, *alike(True), *alike(False), [f"w{x}" for x in rng.integers(0, 1 << 40, 204)]]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(pairs)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [0, 3, 5, 7]


def test_quality_on_held_out_labels(spark):
    """The classifier sees half of the labels; the other half tells how well it parts them."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.resample(docs, labels.where("doc_id % 2 = 0"))
    rows = out.join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in rows.collect()}
    assert kept[1] >= 0.98 and kept[0] <= 0.05


def test_edges(spark):
    """Nulls, repeats and odd texts pass through; an empty table gives an empty result."""
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, None, None, None, None), (2, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.where("false")):
        out = start
        for _, stage in corpus_pipeline.STAGES:
            out = materialise(stage(spark, out, SF))
        assert out.count() == 0 if start is not docs else out.where(F.col("doc_id") == 1).count() <= 3


def test_names():
    assert [n for n in registry.QUERIES if n == "pipeline"] and os.path.exists(corpus_pipeline.__file__)
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")} == set(range(1, 11))
