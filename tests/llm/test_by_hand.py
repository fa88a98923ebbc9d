"""Queries that SQL cannot express, recomputed by hand from their definitions."""

import hashlib
from collections import defaultdict

import numpy as np

from tidemark.llm import language_id, lm, pii, quality, registry

SF = "/root/testdata/sf0.001"


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_simhash_query(spark):
    """Fingerprints in hex, and components of all pairs within four bits."""
    import xxhash

    prints = {}
    for i, text in documents(spark).items():
        words = text.encode().lower().split()
        shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if least[b] < least[a] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    least[a], changed = least[b], True
    rows = registry.QUERIES["op1_simhash_near_dedup"](spark, SF).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{p:016x}", least[i]) for i, p in prints.items()}


def test_pii_query(spark):
    rows = registry.QUERIES["op6_pii"](spark, SF).collect()
    texts = documents(spark)
    for r in rows:
        base, every = pii.find(texts[r.doc_id])
        count = [sum(k == n for _, k, _ in base) for n in range(4)]
        tell = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == count and r.spans == tell(every)
        assert r.base_sha256 == hashlib.sha256(tell(base).encode()).hexdigest()
    assert len(rows) == len(texts)


def test_lm_query_base(spark):
    texts = documents(spark)
    tokens = {i: [*t.encode().lower().split(), b""] for i, t in texts.items()}
    counts, total = defaultdict(int), 0
    for i, ts in tokens.items():
        if not lm.held_out(i):
            for t in ts:
                counts[t] += 1
                total += 1
    for r in registry.QUERIES["op9_lm_scoring"](spark, SF).collect():
        p = np.array([(counts.get(t, 0) + 0.1) / (total + 0.1 * (len(counts) + 1)) for t in tokens[r.doc_id]])
        assert r.train_tokens == total and r.n_tokens == len(p) and r.n_known == sum(t in counts for t in tokens[r.doc_id])
        assert abs(r.base_score - np.log10(p).sum()) < 1e-6 * len(p) and r.held_out == lm.held_out(r.doc_id)


def test_quality_by_hand(spark):
    """Weights from the fitted table, keys from weights, and the ``k`` largest keys."""
    docs = spark.createDataFrame([(i, f"good clean words number {i}" if i % 3 else f"spam spam {i} buy") for i in range(120)], "doc_id long, text string")
    labels = [(i, int(i % 3 > 0)) for i in range(90)] + [(7, 1), (7, 0), (8, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    ratio, cut = quality.fit(docs, labels)
    out = quality.resample(docs, labels).collect()
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    noise = quality._keyed("weight", "doc_id", 400.0, 3)
    keyed = {r.doc_id: r.k for r in quality.resample(docs, labels).select("doc_id", noise.alias("k")).collect()}
    for r in out:
        assert abs(r.weight - quality.weigh(texts[r.doc_id], ratio)) < 1e-9 and abs(r.key - keyed[r.doc_id]) < 1e-9
    k = sum(r.weight >= cut for r in out)
    best = sorted((r.key for r in out), reverse=True)[:k]
    assert {r.doc_id for r in out if r.kept} == {r.doc_id for r in out if r.key >= best[-1]} and k == len(best)
    again = quality.resample(docs, labels.repartition(7)).collect()  # labels that disagree decide nothing
    assert {(r.doc_id, r.kept) for r in again} == {(r.doc_id, r.kept) for r in out}


def test_language_by_hand(spark):
    """Posteriors from text, declared language and every suffix of the host, a page's own part left out."""
    rng = np.random.default_rng(2)
    words = {"aa": "alpha beta gamma delta".split(), "bb": "uno dos tres cuatro".split()}
    say = lambda k, n: " ".join(rng.choice(words[k], n))
    docs = spark.createDataFrame([(i, say(k, 40), k) for i, k in enumerate(["aa", "bb"] * 20)], "doc_id long, text string, lang string")
    hosts = ["x.aa.org", "y.aa.org", "bb.net", "u.v.w.bb.net", ""]
    pages = []
    for i in range(60):
        k = ("aa", "bb")[i % 2]
        url = f"http://{hosts[i % 5]}/{i}" if hosts[i % 5] else None
        pages.append((i, url, f"<html{f' lang={k}' if i % 3 else ''}><p>{say(k, i % 4)}</p>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    langs, like = language_id.fit(docs)
    strength, kappa, n = 40.0, 5.0, len(langs)
    post = {i: language_id.text_posterior(language_id.visible(h), like, strength) for i, _, h in pages}
    tag = {i: language_id.declared(h) for i, _, h in pages}
    host = {i: language_id.host(u) for i, u, _ in pages}
    text = {i: int(post[i].argmax()) for i in post}
    tags = sorted(set(tag.values()))
    likely = {t: np.array([(sum(tag[i] == t and text[i] == c for i in post) + 0.5) / (sum(text[i] == c for i in post) + 0.5 * len(tags)) for c in range(n)]) for t in tags}
    got = {r.page_id: r for r in language_id.identify(df, docs).collect()}
    for i in post:
        prior = (sum(post.values()) - post[i] + kappa / n) / (len(post) - 1 + kappa)
        labels = host[i].split(".") if host[i] else []
        levels = [[j for j in post if host[j].split(".")[-k:] == labels[-k:]] for k in range(1, len(labels) + 1)]
        levels += [[j for j in post if host[j] == host[i]]] if labels else []
        for level in levels:
            prior = (np.maximum(sum(post[j] for j in level) - post[i], 0) + kappa * prior) / (len(level) - 1 + kappa)
        raw = post[i] * prior * likely[tag[i]]
        assert got[i].lang == langs[int(raw.argmax())] and abs(got[i].confidence - raw.max() / raw.sum()) < 1e-6
