"""Each operator against brute force on a small fixture with nulls, ties, repeats, empty and long texts,
and extra columns whose names clash with the operators' own."""

import hashlib
import math
import re
from binascii import crc32
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, embedding_dedup, exact_dedup, language_id, lm, mixing, pii, quality, simhash
from tidemark.llm.common import components, materialise

SPEC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))
NEAR = " ".join(f"common{i}" for i in range(400))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog"), (2, "the QUICK brown fox jumps over the lazy dog"),
    (3, "The quick\tbrown fox jumps\nover the lazy dog "), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one two three four"),
    (9, LONG), (10, LONG + " tail"), (11, NEAR), (12, NEAR.replace("common7 ", "changed7 ")), (13, "ÀÉÎ ünïcode ÀÉÎ 日本 🙂"),
    (14, "<|endoftext|> it's  a  test\r\n\r\n 1234 ÀÉ"), (15, "one"), (15, "one"), (None, "one"), (None, "a null id"),
    (16, "mail me: a.b@c.org or c@d.e.f, 10.0.0.1, 4111 1111 1111 1111, +1 (555) 123-4567."), (17, "\x00\x0b\x0c x"), (18, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[k % 3], ("b", "a", None, "")[k % 4], len(t or "")) for k, (i, t) in enumerate(TEXTS)]
    out = spark.createDataFrame(rows, SPEC).repartition(3)
    # Names that operators use for themselves.
    return out.withColumns({c: F.lit("clash") for c in ("fp", "key", "size", "h", "kept", "weight", "row", "own", "id", "node")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SPEC)


def sort(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def got(df, *cols):
    return sort(tuple(r) for r in df.select(*(cols or df.columns)).collect())


# Components


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    edges += [(5000, 4000 - i) for i in range(200)]  # a hub above its leaves
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    out = components(spark.createDataFrame(edges, "a long, b long"))
    found = dict(tuple(r) for r in out.collect())
    assert all(found.get(x, x) == find(x) for x in parent) and out.count() == len(found)
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_materialised_once(spark):
    df = materialise(spark.range(3).toDF("x"))
    assert got(df) == [(0,), (1,), (2,)] and df.schema.simpleString() == "struct<x:bigint>"


# Exact de-duplication


def dedup_brute(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for key, rows in groups.items():
        keep = min(rows)[3]
        sha = hashlib.sha256(key.encode()).hexdigest()
        out += [(i, keep, len(rows), i == keep, sha) for *_, i in rows]
    return sort(out)


@pytest.mark.parametrize("budget", [1 << 26, 600])
def test_exact_dedup(docs, budget):
    out = exact_dedup.exact_dedup(docs, partitions=3, map_budget=budget, trie_budget=budget)
    assert got(out) == dedup_brute(TEXTS)


def test_exact_dedup_keeps_rows(docs, none):
    out = exact_dedup.keep_first(docs)
    ids = Counter(r.doc_id for r in out.select("doc_id").collect())
    want = {r[0] for r in dedup_brute(TEXTS) if r[3] and r[0] is not None}
    assert out.columns == docs.columns and {k for k in ids if k is not None} == want
    assert max(v for k, v in ids.items() if k is not None) == 1 and ids[None] == 2
    assert exact_dedup.exact_dedup(none).isEmpty() and exact_dedup.keep_first(none).isEmpty()


def test_trie_spills_whole_subtrees(tmp_path):
    rng = np.random.default_rng(1)
    keys = [bytes(rng.integers(97, 100, rng.integers(0, 9)).tolist()) for _ in range(4000)]
    trie = exact_dedup.OwnerTrie(budget=3000, folder=str(tmp_path))
    want = {}
    for i, k in enumerate(keys):
        trie.insert(k, -(i % 7), i, 1)
        a = want.get(k)
        want[k] = [-(i % 7), i, 1] if a is None else [*min((a[0], a[1]), (-(i % 7), i)), a[2] + 1]
    assert trie.spilled
    found = list(trie.owners())
    assert dict(found) == want and len(found) == len(want) and not list(tmp_path.iterdir())


# SimHash


def simhash_brute(texts, size=4, radius=4):
    prints = []
    for _, t in texts:
        words = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
        ones = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s, 42)
            for b in range(64):
                ones[b] += h >> b & 1
        prints.append(sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)))
    group = list(range(len(prints)))
    for _ in prints:  # enough rounds for any chain
        for i, x in enumerate(prints):
            for j, y in enumerate(prints):
                if (x ^ y).bit_count() <= radius:
                    group[i] = group[j] = min(group[i], group[j])
    out = []
    for k, (i, _) in enumerate(texts):
        ids = [texts[j][0] for j in range(len(texts)) if group[j] == group[k] and texts[j][0] is not None]
        out.append((i, prints[k] - (1 << 64) * (prints[k] >> 63), min(ids, default=None)))
    return sort(out)


def test_simhash(docs, none):
    assert got(simhash.near_dedup(docs)) == simhash_brute(TEXTS)
    assert simhash.near_dedup(none).isEmpty()


@pytest.mark.parametrize("most,large", [(1 << 16, 256), (1 << 16, 8), (40, 256)])
def test_links_of_clusters(spark, monkeypatch, most, large):
    """A tight cluster and unrelated fingerprints, with buckets swept, stepped through and chunked."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(150)}
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 400, dtype=np.uint64)}
    fps = sorted(fps)
    monkeypatch.setattr(simhash.link_arrays, "__defaults__", (None, large))
    rows = [(simhash._signed(f), i) for i, f in enumerate(fps)]
    edges = simhash.links(spark.createDataFrame(rows, "fp long, rep long"), len(rows), 4, most)
    found = dict(tuple(r) for r in components(edges).collect())
    group = list(range(len(fps)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    assert all(found.get(i, i) == find(i) for i in range(len(fps)))


def test_tables_cover_every_pair():
    rng = np.random.default_rng(2)
    for n in (1000, 1 << 22, 1 << 40):
        masks = simhash.tables(4, n)
        for _ in range(200):
            flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not flip & m for m in masks)


def test_bit_counts():
    rows = np.random.default_rng(4).integers(0, 1 << 63, (1001, 2), dtype=np.uint64)
    want = np.unpackbits(rows.view(np.uint8).reshape(1001, -1), axis=1, bitorder="little").sum(axis=0)
    assert (simhash.bit_counts(rows) == want).all() and (simhash._counts(rows) == want).all()


def test_similar_texts_are_found(spark):
    """Recall against exact shingle sets at 0.8 and more, and no link between unrelated texts."""
    rng = np.random.default_rng(6)
    texts, sets = [], []
    for _ in range(150):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        texts.append(" ".join(base))
        for edits in (1, 4, 5):
            copy = list(base)
            for at in rng.integers(0, 300, edits):
                copy[at] = "edited"
            texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    rows = list(enumerate(texts))
    found = dict(got(simhash.similar_dedup(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "component_id"))
    close = [(i, j) for i in range(len(rows)) for j in range(i) if i // 4 == j // 4 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(close) > 400 and all(found[i] == found[j] for i, j in close)
    assert all(found[i] // 4 == i // 4 for i in found)


def test_similar_dedup_edges(docs, none):
    out = dict((t, c) for t, c in got(simhash.similar_dedup(docs), "doc_id", "component_id") if t is not None)
    assert out[2] == 1 and out[12] == 11 and out[10] == 9 and out[4] == out[5] == out[6] == 4 and out[17] == 17 and out[18] == 18
    kept = simhash.keep_first(simhash.similar_dedup(docs), docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {v for v in out.values()} | {None}
    assert simhash.similar_dedup(none).isEmpty()


# Mixing


def test_water_fill():
    sizes, weights = {"a": 100, "b": 10, "c": 50}, {"a": 5, "b": 2, "c": 1}
    out = mixing.water_fill(sizes, weights, 3)
    assert out["b"] == 30 and math.isclose(sum(out.values()), 160) and math.isclose(out["a"] / out["c"], 5)
    assert mixing.water_fill({"a": 0}, {"a": 5}, 3) == {"a": 0.0}
    assert mixing.water_fill({}, {}, 3) == {}


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS) and sort(map(tuple, rows)) == sort(map(tuple, mixing.mix(docs).collect()))
    words = Counter((i, len((t or "").encode().split())) for i, t in TEXTS)
    assert Counter((r.doc_id, r.size) for r in rows) == words
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = mixing.water_fill(dict(sizes), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 3)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source]) and r.taken <= 3 * r.size
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
    most = {s: max(r.size for r in rows if r.source == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= most[s] for s in sizes)
    many = Counter(r.doc_id for r in mixing.take(docs).collect())
    want = Counter()
    for r in rows:
        want[r.doc_id] += r.times
    assert many == +want and mixing.take(docs).columns == docs.columns
    assert mixing.mix(none).isEmpty() and mixing.take(none).isEmpty()


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 50), f"s{i % 5}") for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("want")).collect():
        assert abs(r.t - r.want) <= 50


# BPE


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    real = Tokenizer.from_file(path)
    want = []
    for i, t in TEXTS:
        ids = real.encode(t or "", add_special_tokens=False).ids
        back = real.decode(ids, skip_special_tokens=False)
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got(bpe.round_trip(docs)) == sort(want)
    assert got(bpe.decode(bpe.encode(docs))) == sort((i, t or "") for i, t in TEXTS)
    assert bpe.round_trip(none).isEmpty() and bpe.encode(none).isEmpty()


def test_bpe_on_random_text():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    real, own = Tokenizer.from_file(path), bpe.Codec(path, held=50)
    rng = np.random.default_rng(8)
    blocks = [(32, 127), (0xA0, 0x250), (0x370, 0x600), (0x3040, 0x30FF), (0x1F300, 0x1F700), (9, 14)]
    for _ in range(400):
        text = "".join(chr(rng.integers(*blocks[rng.integers(len(blocks))])) for _ in range(rng.integers(0, 80)))
        ids = list(memoryview(own.encode(text)).cast("I"))
        assert ids == real.encode(text, add_special_tokens=False).ids
        assert own.decode(own.encode(text)) == text
    assert len(own.young) <= 50 and own.decode(own.encode("🖡")[:4]) == "�"


# Embeddings


@pytest.mark.parametrize("options", [{}, {"cell": 30, "fan": 4, "rounds": 2}, {"cell": 25, "rounds": 0}])
def test_embedding_dedup(spark, options):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(260):
        v = centres[i % 12] + rng.normal(size=8) * rng.choice([0.0, 0.02, 0.1, 0.3])
        rows.append((i, [float(x) for x in v * rng.choice([1.0, 3.0])], int(i % 12 // 6)))
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (902, None, 0), (903, [0.0] * 8, 0), (904, [1.0, None] + [0.0] * 6, 0)]
    rows += [(905, [float("nan")] * 8, 0), (906, rows[0][1], None), (907, rows[0][1][:4], 0), (908, [], 0), (None, rows[0][1], 0), (0, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("clash")).repartition(3)
    good = [
        k for k, (i, v, label) in enumerate(rows)
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    linked = defaultdict(set)
    for a in good:
        for b in good:
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                linked[a].add(b)
    label = {k: (rows[k][0] if rows[k][0] is not None else None) for k in range(len(rows))}
    for _ in rows:
        for a in good:
            label[a] = min([label[a], *(label[b] for b in linked[a])])
    want = [(rows[k][0], len(linked[k]), label[k], rows[k][0] is not None and rows[k][0] == label[k]) for k in range(len(rows))]
    assert sum(w[1] for w in want) > 300
    assert got(embedding_dedup.near_dedup(df, **options)) == sort(want)


def test_no_embeddings(spark):
    assert embedding_dedup.near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).isEmpty()


def test_cover_tree_invariants():
    rng = np.random.default_rng(10)
    points = embedding_dedup.unit(np.concatenate([rng.normal(size=(300, 5)), np.ones((60, 5)) + rng.normal(size=(60, 5)) * 0.05]))
    tree = embedding_dedup.CoverTree(points, np.arange(len(points)))
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for k, below in enumerate(tree.children):
        inside = tree.below(k)
        assert np.linalg.norm(points[inside] - points[tree.centre[k]], axis=1).max() <= tree.radius[k] + 1e-7
        if len(below):
            assert tree.centre[k] in tree.centre[below]  # nesting
            reach = 2.0 ** (np.ceil(np.log2(tree.radius[k])) - 1)
            assert (tree.radius[below] <= reach + 1e-7).all()  # covering, radii halved
            far = np.linalg.norm(points[tree.centre[below]][:, None] - points[tree.centre[below]][None], axis=2)
            assert (far[~np.eye(len(below), dtype=bool)] > reach - 1e-7).all()  # separation


# Quality


def test_quality(spark, none):
    rng = np.random.default_rng(11)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "over", "green", "fields", "slowly"], 60))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW$$$", "CHEAP***", "xx%%"], 60))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(600)]
    rows += [(1000, None), (1001, ""), (None, good()), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("weight", F.lit("clash"))
    labels = [(i, int(i % 4 != 0)) for i in range(0, 400)] + [(401, None), (None, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.resample(docs, labels)
    assert out.count() == len(rows)
    kept = {r.doc_id: r.kept for r in out.collect()}
    held = range(400, 600)  # no labels there
    assert np.mean([kept[i] == (i % 4 != 0) for i in held]) >= 0.98
    assert kept[1000] and kept[1001]  # no n-grams, no evidence
    same = quality.keep_resampled(docs, labels)
    assert same.columns == docs.columns
    assert Counter(r.doc_id for r in same.collect()) == Counter(r.doc_id for r in out.where("kept").collect())
    nothing = labels.where("false")
    assert quality.resample(docs, nothing).where("NOT kept").isEmpty()
    assert quality.resample(none, labels).isEmpty() and quality.keep_resampled(none, labels).isEmpty()


@pytest.mark.parametrize("k", [0, 1, 7, 50, 199, 200, 500])
def test_top_k(spark, k):
    values = [float(x) for x in np.random.default_rng(12).normal(size=180)] + [0.25] * 20
    cut = quality.top_k(spark.createDataFrame([(v,) for v in values], "key double"), k, parts=16)
    want = sorted(values, reverse=True)
    kept = sum(v >= cut for v in values)
    assert kept == (len(values) if k >= len(values) else sum(v >= want[k - 1] for v in values) if k else 0)


def test_best_cut():
    assert quality.best_cut(np.array([1.0, 2, 3, 4]), np.array([False, False, True, True])) == 2.5
    assert quality.best_cut(np.array([1.0, 1, 1]), np.array([True, False, True])) in (float("-inf"), float("inf"))


# Personal data

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def pii_brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0
            ok = (True, kind == 1 and max(map(int, m[0].split("."))) <= 255, 14 <= len(digits) <= 19 and luhn, 10 <= len(digits) <= 15)
            if ok[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans():
    rng = np.random.default_rng(13)
    texts = ["".join(rng.choice(list("ab@@..-+ 01234567() \n"), rng.integers(0, 90))) for _ in range(4000)]
    texts += [t or "" for _, t in TEXTS] + ["4111 1111 1111 1111", "+4915123456789", "1" * 50_000, "a" * 50_000 + "@", "a.b." * 20_000]
    for t in texts:
        base, every = pii.find(t)
        assert base == pii_brute(t) and set(base) <= set(every)


@pytest.mark.parametrize("text,kind,span", [
    ("ask jane dot doe at mail dot example dot org.", "email", "jane dot doe at mail dot example dot org"),
    ("write john (at) mail [dot] example.com now", "email", "john (at) mail [dot] example.com"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"), ("１９２．１６８．１．１ is it", "ip", "１９２．１６８．１．１"),
    ("at 192 dot 168 dot 1 dot 20, ok", "ip", "192 dot 168 dot 1 dot 20"), ("card 4111​1111 1111 1111 ok", "card", "4111​1111 1111 1111"),
    ("call plus one five five five zero one two three four five six now", "phone", "plus one five five five zero one two three four five six"),
])
def test_disguises(text, kind, span):
    base, every = pii.find(text)
    found = [(pii.KINDS[k], text[s:e]) for s, k, e in every]
    assert base == [] and found == [(kind, span)]


def test_plain_prose_is_left_alone():
    assert pii.find("We met at noon. One or two of the nine dots, at most. Look at that dot over there at home")[1] == []


def test_detect(docs, none):
    out = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in pii.detect(docs).collect()}
    want = {i: [(pii.KINDS[k], s, e, True) for s, k, e in pii_brute(t or "")] for i, t in TEXTS if i}
    assert {k: out[k] for k in want} == want and len(want[16]) == 5 and pii.detect(none).isEmpty()


# Chat


def test_chat_round_trip(spark):
    odd = ["", None, "\\", "####", ": ", "</turn>", "</turn>\n", "\n### user: hi</turn>\n", "a\\</turn>", "é🙂</turn>\\n", "plain", "x" * 200_000]
    roles = ["user", "assistant", "a: b", ": ", "###", "</turn>\n", None, "\\"]
    rows = [(k % 7, 0 if k % 5 == 0 else k, roles[k % 8], t) for k, t in enumerate(odd * 8)]
    rows += [(None, None, "assistant", "last"), (None, 1, "user", "first"), rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ord", F.lit("clash"))
    out = chat.format_chats(df.repartition(3))
    groups = defaultdict(list)
    for c, n, r, t in rows:
        groups[c].append((n is None, n or 0, r or "", t or ""))
    found = defaultdict(list)
    for r in sorted(chat.parse_chats(out).collect(), key=lambda r: (r.conv_id is None, r.conv_id, r.ord)):
        found[r.conv_id].append((r.role, r.text))
    assert found == {c: [x[2:] for x in sorted(g)] for c, g in groups.items()}
    for r in out.collect():
        parts = [r.formatted[s.start : s.end] for s in r.loss]
        plain = [re.sub(r"(?s)\\(.)", r"\1", p) if "\\" in p else p for p in parts]
        assert plain == [t for *_, role, t in sorted(groups[r.conv_id]) if role == "assistant"]
    assert chat.format_chats(df.where("false")).isEmpty()


def test_chat_runs_without_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.format_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


# Languages


def test_language_id(spark, none):
    rng = np.random.default_rng(14)
    words = {"en": "the river and green fields with slow".split(), "de": "der fluss und grüne felder mit langsam".split()}
    docs = [(i, " ".join(rng.choice(words[g], 40)), g) for i, g in enumerate(["en", "de"] * 60)] + [(999, None, "en"), (998, "x", None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    page = lambda text, lang: f"<html lang={lang}><head><script>the and river</script></head><body><p>{text}</p></body></html>"
    rows = []
    for i in range(80):
        g = ("en", "de")[i % 2]
        rows.append((i, f"https://{'x' if g == 'en' else 'y'}.example.{'com' if g == 'en' else 'de'}/p{i}", page(" ".join(rng.choice(words[g], 12)), g)))
    rows += [
        (100, "https://y.example.de/empty", "<html><body></body></html>"), (101, None, None), (102, "not an address", page("", "de-AT")),
        (0, rows[0][1], rows[0][2]),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", F.lit("clash"))
    out = language_id.identify(pages, docs)
    found = {r.page_id: r for r in out.collect()}
    assert out.count() == len(rows) and all(found[i].lang == ("en", "de")[i % 2] for i in range(80))
    assert found[100].lang == "de" and found[102].lang == "de" and found[102].declared == "de"
    assert found[101].lang in ("en", "de") and found[101].host == "" and all(0 < r.confidence <= 1 for r in found.values())
    assert language_id.identify(pages.where("false"), docs).isEmpty()
    assert {r.lang for r in language_id.identify(pages, docs.where("false")).collect()} == {None}


def test_page_parts():
    page = "<HTML class='a' LANG='pt-BR'><nav>menu</nav><!-- x --><p>a&amp;b<br>c</p><style>p{}</style></html>"
    assert language_id.visible(page) == "a&b c" and language_id.declared(page) == "pt"
    assert language_id.host("http://u:p@Www.Example.ORG:80/x") == "www.example.org" and language_id.host("x") == ""


# Language model


def lm_brute(texts, strength):
    tokens = [(i, (t or "").encode().lower().split() + [b""], crc32(str("null" if i is None else i).encode()) % 10 == 0) for i, t in texts]
    words, pairs = Counter(), Counter()
    for _, w, out in tokens:
        if not out:
            words.update(w)
            pairs.update(zip([b"", *w], w, strict=False))
    n, v = sum(words.values()), len(words)
    rows = []
    for i, w, out in tokens:
        base = model = 0.0
        for a, b in zip([b"", *w], w, strict=False):
            p = (words[b] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            model += math.log10((pairs[a, b] + strength * p) / (words[a] + strength))
        rows.append((i, out, len(w), sum(words[x] > 0 for x in w), n, round(base, 6), round(model, 1)))
    return sort(rows)


@pytest.mark.parametrize("options", [{}, {"block": 50, "shards": 3}])
def test_lm(docs, none, options):
    out = lm.score(docs, strength=2.0, **options)
    cols = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6), "score")
    found, want = got(out, *cols), lm_brute(TEXTS, 2.0)
    assert [r[:6] for r in found] == [r[:6] for r in want]
    assert all(math.isclose(a[6], b[6], rel_tol=2e-3, abs_tol=0.06) for a, b in zip(found, want, strict=True))
    assert lm.score(none).isEmpty()


def test_lm_with_a_word_that_is_half_of_all_tokens(spark):
    """Its successors are dealt over several shards; nothing else changes."""
    rng = np.random.default_rng(17)
    texts = [(i, " ".join(f"the w{x}" for x in rng.integers(0, 300, 60))) for i in range(120)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    hot = lm.hot_words(df, 6)
    assert hot == {b"the": 6}
    out = lm.score(df, strength=2.0, block=500, shards=6)
    cols = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6), "score")
    found, want = got(out, *cols), lm_brute(texts, 2.0)
    assert [r[:6] for r in found] == [r[:6] for r in want]
    assert all(math.isclose(a[6], b[6], rel_tol=2e-3, abs_tol=0.06) for a, b in zip(found, want, strict=True))


def test_elias_fano(tmp_path):
    rng = np.random.default_rng(15)
    for k, top in enumerate((5, 1 << 20, 1 << 50, (1 << 63) - 1)):
        for n in (0, 1, 5, 40_000):
            values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
            code = lm.EliasFano(tmp_path / f"a{k}-{n}", values)
            assert (np.concatenate([code.decode(c) for c in range(len(code.start))] or [values]) == values).all()
            index = np.sort(rng.integers(0, n, 50)) if n else np.empty(0, int)
            assert (code.at(index) == values[index]).all()
            keys = np.sort(np.concatenate([rng.integers(0, top, 50, dtype=np.uint64), values[:20]]))
            assert (code.find(keys) == np.searchsorted(values, keys)).all()


def test_lm_beats_its_base_on_held_out_text(spark):
    """On a text with order in it, the model's probabilities of held-out texts are higher."""
    rng = np.random.default_rng(16)
    after = {k: rng.integers(0, 200, 3) for k in range(200)}
    rows = []
    for i in range(300):
        w = [int(rng.integers(0, 200))]
        for _ in range(80):
            w.append(int(rng.choice(after[w[-1]])))
        rows.append((i, " ".join(f"w{x}" for x in w)))
    out = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), strength=5.0).where("held_out")
    base, score = out.agg(F.sum("base_score"), F.sum("score")).head()
    assert score > 0.6 * base
