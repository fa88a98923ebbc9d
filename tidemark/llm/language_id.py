"""Language identification by Bayesian evidence fusion.

The posterior of a page's language multiplies four kinds of evidence:

* *text*: a naive Bayes model over hashed byte windows of the page's visible text, tempered so that
  its n-grams, which are not independent, count as at most ``strength`` observations;
* *declared markup language*: ``P(lang attribute | language)``, estimated over all pages by a grouped
  aggregation of declared against text languages;
* *address suffix and host priors*: for each suffix of the host name, from the top-level label down
  to the whole host, and last for the host without those below it, ``P(language | level) = (sum + kappa * P(language | level above)) / (n + kappa)``,
  the sums being text posteriors grouped by the level.  A page's own part is taken out of the sums
  first, so its text is not counted twice.

The text model is fitted on at most about ``fit_rows`` labelled documents (a documented bound, drawn by
a hash of the id) and is a table whose size does not follow the data.  Aggregations cover all pages;
pages are coded once and written, host tables are joined to them by host.

Defined results.  A null page body has no text and no declared language; a null or unreadable address
has the empty host, below which there is no level.  With no evidence the prior decides; ties go to
the first language in order.  Documents with a null language or text are not learned from; with none
at all the language is null.  Repeated rows are pages of their own.  An empty table gives an empty
table.  Only the columns named are read.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, batches, join_counted, materialise, rows

BITS = 16
SIZE = 1 << BITS
_CHUNK = 1 << 16
_HIDDEN = ("script", "style", "nav", "noscript", "template")
_HIDE = re.compile(rf"<!--|<({'|'.join(_HIDDEN)})\b", re.IGNORECASE)
_CLOSE = {"": re.compile("-->")} | {n: re.compile(rf"</{n}\s*>", re.IGNORECASE) for n in _HIDDEN}
_TAG = re.compile(r"<[^>]*>")
_OPENING = re.compile(r"<!--|<html\b", re.IGNORECASE)
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*(?:[\"']\s*)?([A-Za-z]{2,3})\b", re.IGNORECASE)
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def _shown(page: str) -> str:
    """A page without comments, scripts and the like; an opening without its end hides nothing.

    One pass: what was looked for in vain once is not looked for again, nor is a sign found ahead.
    """
    out, at, after, sign, gone = [], 0, 0, -1, set()
    while m := _HIDE.search(page, after):
        name, after = (m[1] or "").lower(), m.end()
        if name in gone:
            continue
        if name and sign < after:
            sign = page.find(">", after)
            if sign < 0:  # no tag ends from here on: only comments could, and theirs end so too
                break
        end = _CLOSE[name].search(page, sign + 1 if name else after)
        if not end:
            gone.add(name)
            continue
        out += page[at : m.start()], " "
        at = after = end.end()
    out.append(page[at:])
    return "".join(out)


def visible(page: str | None) -> str:
    """The text of a page without scripts, styles, navigation, comments and tags, in linear time."""
    shown = _shown(page or "")
    end = shown.rfind(">") + 1  # behind it no tag ends
    return " ".join(_html.unescape(_TAG.sub(" ", shown[:end]) + shown[end:]).split())


def declared(page: str | None) -> str:
    """Primary subtag of the page's language attribute, or nothing.

    The whole page is searched, once: comments are skipped (one without an end is none), and a tag is
    looked at up to its end.
    """
    page = page or ""
    at, ends = 0, True
    while m := _OPENING.search(page, at):
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at) if ends else -1
            ends = end >= 0
            at = end + 3 if ends else at
            continue
        end = page.find(">", at)
        end = len(page) if end < 0 else end
        tag = _DECLARED.match(page, m.start(), end)
        if tag:
            return tag[1].lower()
        at = end
    return ""


def host(url: str | None) -> str:
    m = _HOST.match(url) if url else None
    return m[1].lower().strip(".") if m else ""


def codes(text: str) -> Iterator[np.ndarray]:
    """Hashed windows of three bytes of the lower-cased text, chunk by chunk."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    for at in range(0, len(raw) - 2, _CHUNK):
        part = raw[at : at + _CHUNK + 2].astype(np.uint32)
        code = part[:-2] | part[1:-1] << 8 | part[2:] << 16
        yield (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


_COUNTS = pa.schema([("lang", pa.string()), ("sums", pa.binary())])


def _count(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for lang, item in rows(parts):
        got = sums.setdefault(lang, np.zeros(SIZE, np.int64))
        if isinstance(item, bytes):
            got += np.frombuffer(item, np.int64)
        else:
            for code in codes(item):
                np.add.at(got, code, 1)
    yield from batches(((k, v.tobytes()) for k, v in sums.items()), _COUNTS)


def fit(
    docs: DataFrame, fit_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = 200
) -> tuple[list[str], np.ndarray]:
    """Languages in order and their tables of log likelihoods, from about ``fit_rows`` documents."""
    own = docs.select(
        F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    n = own.count()
    share = min(1.0, fit_rows / max(1, n))
    picked = own.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    spec = "lang string, sums binary"
    counted = arrow_map(picked.select("lang", "text"), _count, spec)
    merged = arrow_map(counted.repartition("lang"), _count, spec)
    got = merged.limit(most + 1).collect()  # a table of fixed size for each language
    if len(got) > most:
        raise ValueError(f"over {most} languages")
    got.sort(key=lambda r: r["lang"])
    counts = np.array([np.frombuffer(r["sums"], np.int64) for r in got], float).reshape(len(got), SIZE)
    like = np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * SIZE))
    return [r["lang"] for r in got], like.astype(np.float32)


def text_posterior(text: str, like: np.ndarray, strength: float) -> np.ndarray:
    total, n = np.zeros(len(like)), 0
    for code in codes(text) if text else ():
        total += like[:, code].sum(axis=1, dtype=np.float64)
        n += len(code)
    score = total * (min(n, strength) / max(n, 1))
    score = np.exp(score - score.max())
    return score / score.sum()


def _code(like: np.ndarray, strength: float):
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            schema = pa.schema(
                [("id", part.schema.field(0).type), ("host", pa.string()), ("declared", pa.string()), ("post", pa.list_(pa.float64()))]
            )
            got = (
                (i, host(u), declared(h), text_posterior(visible(h), like, strength).tolist()) for i, u, h in rows([part])
            )
            yield from batches(got, schema)

    return run


def _sums(n: int):
    return F.array(*(F.sum(F.element_at("post", i + 1)) for i in range(n)))


def identify(
    pages: DataFrame,
    docs: DataFrame,
    fit_rows: int = 20_000,
    strength: float = 40.0,
    kappa: float = 5.0,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``id_col, lang, confidence, text_lang, declared, host``, one row per page."""
    langs, like = fit(docs, fit_rows)
    n = len(langs)
    kind = pages.schema[id_col].dataType.simpleString()
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    if not n:
        none = F.lit(None).cast("string")
        return own.select(F.col("id").alias(id_col), none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), none.alias("declared"), none.alias("host"))
    coded = materialise(
        arrow_map(own, _code(like, strength), f"id {kind}, host string, declared string, post array<double>").withColumn(
            "text_lang", F.expr("array_position(post, array_max(post)) - 1")
        )
    )
    # P(declared | language), over all pages, with a floor for pairs never seen.
    odds = _declared_odds(coded, n)
    # Host tables, from the whole down to the host: hosts are dealt to all their suffixes, then one join.
    whole = coded.agg(_sums(n).alias("s0"), F.count(F.lit(1)).cast("double").alias("n0")).head()
    hosts = coded.groupBy("host").agg(_sums(n).alias("sums"), F.count(F.lit(1)).cast("double").alias("pages"))
    hosts = materialise(hosts)
    depth = F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\."))))
    named = hosts.where("host <> ''").select("host", depth.alias("k"), F.col("sums").alias("post"), "pages")
    named = named.withColumn("suffix", F.expr("substring_index(host, '.', -k)"))
    # Hosts of a suffix, and pages of a host, may be a share of all: joined with the hot ones apart.
    summed = named.groupBy("suffix").agg(_sums(n).alias("s"), F.sum("pages").alias("m"), F.count(F.lit(1)).alias("n"))
    n_named, n_pages = hosts.where("host <> ''").agg(
        F.coalesce(F.sum(F.size(F.split("host", r"\."))), F.lit(0)), F.coalesce(F.sum("pages"), F.lit(0.0))
    ).head()
    above = join_counted(named.select("host", "k", "suffix"), summed, "suffix", n_named)
    above = above.select("host", F.struct("k", "s", F.col("m").alias("n")).alias("level"))
    alone = hosts.where("host <> ''").select(
        "host", F.struct(F.lit(1 << 30).alias("k"), F.col("sums").alias("s"), F.col("pages").alias("n")).alias("level")
    )
    levels = above.unionAll(alone).groupBy("host").agg(F.sort_array(F.collect_list("level")).alias("levels"))
    # The last level is the host itself.
    levels = materialise(levels.withColumn("n", F.element_at("levels", -1)["n"].cast("long")))
    nowhere = coded.where("host = ''").withColumn("levels", F.lit(None).cast(levels.schema["levels"].dataType))
    joined = join_counted(coded.where("host <> ''"), levels, "host", int(n_pages)).unionByName(nowhere)
    total = whole["n0"] or 0.0
    prior = F.array(
        *(
            (F.lit((whole["s0"] or [0.0] * n)[i] or 0.0) - F.element_at("post", i + 1) + F.lit(kappa / n)) / F.lit(total - 1 + kappa)
            for i in range(n)
        )
    )
    fold = F.aggregate(
        "levels",
        prior,
        lambda p, level: F.zip_with(
            F.zip_with(level["s"], F.col("post"), lambda x, own_: F.greatest(x - own_, F.lit(0.0))),
            p,
            lambda x, up: (x + kappa * up) / (level["n"] - 1 + kappa),
        ),
    )
    joined = joined.withColumn("prior", F.when(F.col("levels").isNull(), prior).otherwise(fold))
    raw = joined.join(odds, "declared").withColumn(
        "raw", F.array(*(F.element_at("post", i + 1) * F.element_at("prior", i + 1) * F.element_at("likely", i + 1) for i in range(n)))
    )
    names = F.array(*map(F.lit, langs))
    best = F.array_max("raw")
    return raw.select(
        F.col("id").alias(id_col),
        F.element_at(names, F.array_position("raw", best).cast("int")).alias("lang"),
        (best / F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)).alias("confidence"),
        F.element_at(names, (F.col("text_lang") + 1).cast("int")).alias("text_lang"),
        "declared",
        "host",
    )


def _declared_odds(coded: DataFrame, n: int) -> DataFrame:
    """``declared, likely``: per tag its smoothed share of each text language's pages, over all pairs.

    Tags are two or three letters or nothing, 18,253 at most, so the table can be broadcast.
    """
    pairs = materialise(coded.groupBy("declared", "text_lang").count())
    by = {r["text_lang"]: r["pages"] for r in pairs.groupBy("text_lang").agg(F.sum("count").alias("pages")).collect()}
    half = 0.5 * max(1, pairs.select("declared").distinct().count())
    seen = [F.sum(F.when(F.col("text_lang") == i, F.col("count")).otherwise(0)) for i in range(n)]
    likely = F.array(*((c + F.lit(0.5)) / F.lit(by.get(i, 0) + half) for i, c in enumerate(seen)))
    return F.broadcast(pairs.groupBy("declared").agg(likely.alias("likely")))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
