"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are counted: the *target* model from labelled rows of good
quality, the *raw* model from all documents.  A document's log weight is the sum over its n-grams of
``log(target / raw)``.  Documents are then resampled without replacement by Gumbel top-k: with noise
``g = -log(-log(u))``, ``u`` a hash of the id, the ``k`` largest ``weight + g`` stay.

N-grams are of two kinds, each with a table of its own: four-byte windows of the text, and word pairs
(a word that repeats one of its last eight is one n-gram of its own, whatever the word).  Weights of
both kinds are averaged over the document's n-grams, so that length does not decide, and scaled by
``sharpness`` before the noise is added: the noise then only decides among documents near the cut.

``k`` is not a guess: labelled rows that are not used for the target model give the weight that best
parts good from bad, and ``k`` is the number of all documents at or above it.

The target model is fitted on at most about ``fit_rows`` labelled rows (a documented bound, drawn by
a hash of the id); the raw model, the weights and the top-k cover every document.  The models travel
as two tables of ``2 ** BITS`` numbers, whose size does not follow the data.

Defined results.  A null text counts as empty; a document without n-grams weighs 0.  Null labels are
ignored.  Without labelled rows of either kind every document stays.  Rows that repeat an id share
its noise; rows whose keys tie at the cut stay together.  An empty table gives an empty table.  Only
id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, batches, materialise, rows

BITS = 17
SIZE = 1 << BITS
_SLICES = 64
_LAGS = 8
#: N-grams of ratio one that are added to every text, so that a few do not reject a short text.
PRIOR = np.array([32, 8])
_CHUNK = 1 << 16


def grams(text: bytes | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams of a text, chunk by chunk: byte windows, and word pairs."""
    data = text or b""
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, max(0, len(raw) - 3), _CHUNK):
        part = raw[at : at + _CHUNK + 3].astype(np.uint32)
        code = part[:-3] | part[1:-2] << 8 | part[2:-1] << 16 | part[3:] << 24
        yield (code * np.uint32(2654435761)) >> np.uint32(32 - BITS), np.empty(0, np.uint32)
    words = data.split()
    if len(words) < 2:
        return
    code = np.fromiter(map(crc32, words), np.uint32, len(words))
    again = np.zeros(len(code), bool)
    for lag in range(1, _LAGS + 1):
        again[lag:] |= code[lag:] == code[:-lag]
    pair = ((code[:-1] * np.uint32(2246822519) ^ code[1:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    pair[again[1:]] = 0
    yield np.empty(0, np.uint32), pair


def counts(texts: Iterable[bytes | None], out: np.ndarray | None = None) -> np.ndarray:
    """N-gram counts of the texts, added to ``out`` where it is given."""
    out = np.zeros((2, SIZE), np.int64) if out is None else out
    for text in texts:
        for kind, codes in ((k, c) for pair in grams(text) for k, c in enumerate(pair)):
            if len(codes) > SIZE // 16:
                out[kind] += np.bincount(codes, minlength=SIZE)
            elif len(codes):
                np.add.at(out[kind], codes, 1)
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """``log(target / raw)`` of both tables.

    The raw model has ``smooth`` added to every bucket; the target model has one raw document of
    ``SIZE`` n-grams added, so that buckets it never saw tend to the raw model.
    """
    if not target.any() or not raw.any():
        return np.zeros((2, SIZE), np.float32)
    q = (raw + smooth) / (raw.sum(axis=1, keepdims=True) + smooth * SIZE)
    p = (target + SIZE * q) / (target.sum(axis=1, keepdims=True) + SIZE)
    return np.log(p / q).astype(np.float32)


def weigh(text: bytes | None, ratio: np.ndarray) -> float:
    """Mean log ratio of a text: the sum of its kinds' means, shrunk for short texts."""
    total, n = np.zeros(2), np.zeros(2)
    for pair in grams(text):
        for kind, codes in enumerate(pair):
            total[kind] += float(ratio[kind][codes].sum(dtype=np.float64))
            n[kind] += len(codes)
    return float((total / (n + PRIOR)).sum())


_COUNTS = pa.schema([("kind", pa.int32()), ("slice", pa.int32()), ("sums", pa.binary())])


def _flush(tables: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    step = 2 * SIZE // _SLICES
    for kind, table in tables.items():
        flat = table.reshape(-1)
        held = [(kind, s, flat[s * step : (s + 1) * step].tobytes()) for s in range(_SLICES)]
        yield from batches(held, _COUNTS)


def _count(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition one table of raw counts and, where rows are marked, one of target counts."""
    tables: dict[int, np.ndarray] = {}
    for text, target in rows(parts):
        for kind in (0, 1) if target else (0,):
            tables[kind] = counts([text], tables.get(kind))
    yield from _flush(tables)


def _merge(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for kind, at, blob in rows(parts):
        got = np.frombuffer(blob, np.int64)
        key = (kind, at)
        sums[key] = sums[key] + got if key in sums else got
    yield from batches(((k, s, v.tobytes()) for (k, s), v in sums.items()), _COUNTS)


def _weights(ratio: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("weight", pa.float64())])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(((i, weigh(t, ratio)) for i, t in rows(parts)), schema)

    return run


def best_cut(weights: np.ndarray, good: np.ndarray, keep: float = 0.98) -> float:
    """The weight that parts good from bad rows with the best balanced accuracy, at the middle of
    its gap, among those that keep at least the share ``keep`` of good rows."""
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    bad_below = np.concatenate([[0], np.cumsum(~g)]) / max(1, (~g).sum())
    good_above = 1 - np.concatenate([[0], np.cumsum(g)]) / max(1, g.sum())
    whole = np.concatenate([[True], w[1:] > w[:-1], [True]])  # ties are not parted
    value = np.where(whole & (good_above >= min(keep, good_above.max())), bad_below + good_above, -1)
    at = np.flatnonzero(value >= value.max() - 1e-12)[0]
    if at == 0:
        return float("-inf")
    return float(w[at - 1] + w[at]) / 2 if at < len(w) else float("inf")


def _share(column: str, seed: int):
    """A number in [0, 1) from the id."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def top_k(keyed: DataFrame, k: int, column: str = "key", parts: int = 4096, rounds: int = 6) -> float:
    """The ``k``-th largest value of ``column`` (``-inf`` if there are no more rows).

    Histograms of ``parts`` bins over an interval that shrinks to the bin of the ``k``-th value;
    ``parts`` counts a round reach the driver, never rows.
    """
    low, high, n = keyed.agg(F.min(column), F.max(column), F.count(column)).head()
    if n <= k or n == 0:
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0
    for _ in range(rounds):
        width = (high - low) / parts
        if width <= 0 or low + width == low:
            return low
        bin_ = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(parts - 1))
        inside = keyed.where((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)))
        got = (
            inside.groupBy(bin_.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
            .orderBy(F.desc("bin"))
            .collect()
        )
        for r in got:
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
        if low == high:
            return low
    return low


def fit(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> tuple[np.ndarray, float]:
    """The table of log ratios and the cut.  ``labels`` holds 1 for good and 0 for bad rows.

    At most about ``fit_rows`` labelled rows fit the target model and as many set the cut.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("mark")).where(
        "doc_id IS NOT NULL AND mark IN (0, 1)"
    )
    # An id with both labels has none.
    marks = marks.groupBy("doc_id").agg(F.min("mark").alias("mark"), F.max("mark").alias("most")).where("mark = most").drop("most")
    n = marks.count()
    share = min(1.0, 2.0 * fit_rows / max(1, n))
    # A bounded set of ids, so it may be broadcast: a hash share, and a hard limit besides.
    chosen = marks.where(_share("doc_id", 1) < share).withColumn("fits", _share("doc_id", 2) < 0.5)
    chosen = materialise(chosen.limit(4 * fit_rows))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    marked = own.join(F.broadcast(chosen), "doc_id", "left").select(
        "text", F.coalesce((F.col("mark") == 1) & F.col("fits"), F.lit(False)).alias("target")
    )
    spec = "kind int, slice int, sums binary"
    sums = arrow_map(arrow_map(marked, _count, spec).repartition("kind", "slice"), _merge, spec)
    tables = np.zeros((2, _SLICES, 2 * SIZE // _SLICES), np.int64)
    for r in sums.collect():  # at most 2 x 64 rows, 4 MB in all
        tables[r["kind"], r["slice"]] += np.frombuffer(r["sums"], np.int64)
    raw, target = tables.reshape(2, 2, SIZE)
    ratio = log_ratio(target, raw)
    test = own.join(F.broadcast(chosen.where("NOT fits")), "doc_id")
    scored = arrow_map(test.select("doc_id", "text"), _weights(ratio), "doc_id long, weight double")
    pairs = scored.join(chosen, "doc_id").select("weight", "mark").collect()  # about fit_rows
    good = np.array([r["mark"] == 1 for r in pairs], bool)
    if not target.any() or good.all() or not good.any():
        return ratio, float("-inf")
    # A weight above 0 speaks for the target model: no cut rejects it, nor a text without evidence.
    return ratio, min(0.0, best_cut(np.array([r["weight"] for r in pairs]), good))


def _keyed(column: str, id_col: str, sharpness: float, seed: int):
    """Sharpened weight plus Gumbel noise from the id."""
    share = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return F.col(column) * F.lit(sharpness) - F.log(-F.log(share))


def _resampled(docs, labels, fit_rows, sharpness, id_col, text_col, label_col, seed):
    """Scores of all rows (written), the table of ratios, and the key of the last row that stays."""
    ratio, cut = fit(docs, labels, fit_rows, id_col, text_col, label_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary"))
    scored = materialise(
        arrow_map(own, _weights(ratio), "doc_id long, weight double").withColumn("key", _keyed("weight", "doc_id", sharpness, seed))
    )
    k = scored.where(F.col("weight") >= F.lit(cut)).count()
    return scored, ratio, top_k(scored, k)


def resample(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = 20_000,
    sharpness: float = 400.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    seed: int = 3,
) -> DataFrame:
    """``doc_id, weight, key, kept``, one row per input row."""
    scored, _, last = _resampled(docs, labels, fit_rows, sharpness, id_col, text_col, label_col, seed)
    return scored.withColumn("kept", F.col("key") >= F.lit(last))


def keep_resampled(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = 20_000,
    sharpness: float = 400.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    seed: int = 3,
) -> DataFrame:
    """The rows of ``docs`` that :func:`resample` keeps, with all their columns.

    Rows are weighed again where they lie, which costs less than to shuffle their texts to a join.
    """
    _, ratio, last = _resampled(docs, labels, fit_rows, sharpness, id_col, text_col, label_col, seed)
    own = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")
    )

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            weight = [weigh(t.as_py(), ratio) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), pa.array(weight, pa.float64())], names=["row", "doc_id", "weight"]
            )

    spec = f"row {own.schema['row'].dataType.simpleString()}, doc_id long, weight double"
    keyed = arrow_map(own, run, spec).where(_keyed("weight", "doc_id", sharpness, seed) >= F.lit(last))
    return keyed.select("row.*")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
