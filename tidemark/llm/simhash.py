"""SimHash near-de-duplication with pivot distance tables.

A document's fingerprint is the bitwise majority over the hashes of its word shingles.  Equal
fingerprints form one class; classes are linked when their fingerprints differ in at most
``radius`` bits, and linked classes form components.

Pairs are found without comparing everything with everything:

* *Partition.*  64 bits are cut into ``b`` segments.  Two fingerprints within ``radius`` bits agree
  on at least ``b - radius`` whole segments, so every pair meets in one of the
  ``C(b, radius)`` tables keyed by that many segments.  ``b`` follows the number of classes, so
  that buckets of unrelated fingerprints stay small at any size.
* *Pivots.*  In a bucket, Hamming distances to ``len(PIVOTS)`` reference fingerprints are
  tabulated.  By the triangle inequality a pair whose coordinates differ by more than ``radius``
  anywhere is no match; rows are walked in the order of the first coordinate, so only a window is
  looked at, and the maximum coordinate difference discards nearly all of it.
* *Verification.*  Survivors are compared bit by bit.

A bucket sends on a spanning forest of its matches, never all its pairs: rows that are linked already
are not compared with one another again.  A bucket too large for a task is first cut into chunks that
share some of its rows; what that leaves unlinked, and only that, then meets the rest of the bucket
(:func:`link_buckets`), so a tight cluster costs in proportion to its size.

:func:`near_dedup` links by a number of bits and finds every such pair.  :func:`similar_dedup` links by
the Jaccard similarity of the shingle sets, and finds every such pair too.  Majority bits cannot promise
that at 0.8, where some 39 of 256 differ and more by chance, so fingerprints are linear there.
:func:`near_copies` makes components of both kinds of links; :func:`similar_dedup` works as follows:

* *Partition.*  Two sets of similarity ``s`` share one of the first ``m - ceil(s * m) + 1`` of their ``m``
  shingles in any order of all shingles, so every pair meets under a shingle of its prefixes.  The order is
  from rare to common, by counts of a sample; it decides how large buckets are, never what is found.
  The rule is the same at every size of corpus.
  Buckets with the same members are one: a cluster of copies shares all its shingles.
* *Pivots.*  A fingerprint has a bit a shingle or more, each the parity of the shingles that fall on its
  place, so two of them never differ in more bits than the sets do in shingles.  By size, then by distances to
  reference fingerprints, then by all bits, pairs are discarded that cannot be similar
  (:func:`link_parities`).
* *Verification.*  The components of the pairs that remain are handed out, and in each the shingle sets
  are compared in full (:func:`link_sets`), so that no link is below the similarity asked for.

Defined results.  A null text counts as empty; documents without words have fingerprint zero and
are linked like any other.  Fewer words than a shingle make one shingle of them all.  Rows that
repeat an id share its component.  Rows with a null id belong to the class of their fingerprint
but never name it; a class with null ids alone has a null component.  An empty table gives an
empty table.  Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from itertools import combinations, groupby, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import arrow_map, batches, components, join_counted, materialise, rows, temporary, without

SEED = 42
BITS = 64
_SLICE = 1 << 14
_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pivots(n: int) -> np.ndarray:
    """``n`` fixed reference fingerprints: the SplitMix64 sequence from zero."""
    out, x, mask = [], 0, (1 << 64) - 1
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & mask
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


PIVOTS = _pivots(16)


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of the ``size``-word shingles of UTF-8 ``text``, A-Z lowered, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - size + 1)


def bit_counts(rows_: np.ndarray) -> np.ndarray:
    """How many rows (of 64-bit words) have each bit set.

    Three rows of weight 2^k become one of weight 2^k and one of weight 2^(k+1) by a carry-save
    adder over whole words, until two or less are left of each weight.
    """
    out, weight = np.zeros(BITS * rows_.shape[1], np.int64), 0
    while len(rows_):
        carried = []
        while len(rows_) > 2:
            m = len(rows_) // 3
            a, b, c = rows_[:m], rows_[m : 2 * m], rows_[2 * m : 3 * m]
            odd = a ^ b
            carried.append((a & b) | (odd & c))
            rows_ = np.concatenate([odd ^ c, rows_[3 * m :]])
        for row in rows_:
            out += np.unpackbits(row.astype("<u8").view(np.uint8), bitorder="little").astype(np.int64) << weight
        rows_ = np.concatenate(carried) if carried else rows_[:0]
        weight += 1
    return out


def _counts(hashes: np.ndarray) -> np.ndarray:
    """Set bits per place over rows of words, in slices."""
    out = np.zeros(BITS * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at : at + _SLICE]
        if len(part) > 8192:
            out += bit_counts(part)
        else:
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
            out += bits.sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: bytes | None, size: int = 4) -> int:
    """Unsigned 64-bit SimHash of a text; 0 without words."""
    hashes = shingle_hashes(text, size)
    ones = _counts(hashes[:, None])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(size: int):
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = ((i, _signed(fingerprint(t, size))) for i, t in rows(parts))
        yield from batches(got, _FP)

    return run


def fingerprints(
    docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long), one row per input row."""
    own = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    return arrow_map(own, _fingerprints(size), "doc_id long, fp long")


def tables(radius: int, n_keys: int, bucket: int = 64) -> list[int]:
    """Masks of the tables: the fewest segments for which unrelated buckets stay under ``bucket``."""
    for b in range(radius + 1, radius + 5):
        if n_keys >> (BITS * (b - radius) // b) <= bucket:
            break
    ends = [BITS * i // b for i in range(b + 1)]
    segments = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(ends, ends[1:], strict=False)]
    return [sum(c) for c in combinations(segments, b - radius)]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def pivot_table(fp: np.ndarray, count: int = len(PIVOTS)) -> np.ndarray:
    """Hamming distances of fingerprints (rows of words) to ``count`` reference fingerprints, a row each."""
    pivots = _pivots(count * fp.shape[1]).reshape(count, -1)
    return np.stack([_distance(fp, p) for p in pivots])


def _discard(table: np.ndarray, rows_: np.ndarray, x: int, most) -> np.ndarray:
    """The ``rows_`` whose distances to the references differ from those of ``x`` by ``most`` at most."""
    for column in table:
        if len(rows_) < 16:
            break
        gap = np.abs(column[rows_] - column[x]) <= (most if np.isscalar(most) else most[rows_])
        rows_ = rows_[gap]
    return rows_


def link_arrays(
    bucket: np.ndarray, fp: np.ndarray, radius: int, cross: np.ndarray | None = None, large: int = 256
) -> np.ndarray:
    """Root index of each row under "same bucket and within ``radius`` bits".

    ``bucket`` is sorted; ``fp`` has a row of words each.  With ``cross``, only rows whose ``cross``
    differs are compared, or all where it is below 0.
    """
    table = pivot_table(fp)
    order = np.lexsort((table[0], bucket))
    bucket, fp, table = bucket[order], fp[order], np.ascontiguousarray(table[:, order])
    side = None if cross is None else cross[order]
    root = np.arange(len(fp))
    left, step = np.arange(len(fp)), 0
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, len(bucket)])
    for k in np.flatnonzero(sizes > large):
        _sweep(root, np.arange(starts[k], starts[k] + sizes[k]), fp, table, radius, side)
    left = left[np.repeat(sizes <= large, sizes)]
    while len(left):
        step += 1
        left = left[left + step < len(fp)]
        right = left + step
        near = (bucket[left] == bucket[right]) & (table[0, right] - table[0, left] <= radius)
        left, right = left[near], right[near]
        a, b = left, right
        if side is not None:
            apart = (side[a] != side[b]) | (side[a] < 0)
            a, b = a[apart], b[apart]
        for column in table[1:]:
            if not len(a):
                break
            near = np.abs(column[a] - column[b]) <= radius
            a, b = a[near], b[near]
        if len(a):
            same = _distance(fp[a], fp[b]) <= radius
            _join(root, a[same], b[same])
    out = np.empty_like(root)
    out[order] = order[_flat(root)]
    return out


def _sweep(
    root: np.ndarray, rest: np.ndarray, fp: np.ndarray, table: np.ndarray, radius: int, side: np.ndarray | None = None
) -> None:
    """Components of one large bucket, breadth first: a row that is reached is never compared with
    another that was, so a tight cluster takes time in proportion to its size."""
    first_column = table[0]
    while len(rest):
        first, rest = rest[0], rest[1:]
        todo = [first]
        while todo and len(rest):
            x = todo.pop()
            own = first_column[rest]
            lo, hi = np.searchsorted(own, [first_column[x] - radius, first_column[x] + radius + 1])
            found = rest[lo:hi]
            if side is not None:
                found = found[(side[found] != side[x]) | (side[found] < 0)]
            found = _discard(table[1:], found, x, radius)
            found = found[_distance(fp[found], fp[x]) <= radius]
            if len(found):
                root[found] = first
                todo.extend(found.tolist())
                rest = np.delete(rest, np.searchsorted(rest, found))


def _flat(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return root
        root[:] = up


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of pairs: hook the larger root on the smaller, and again for hooks that were lost."""
    while len(a):
        _flat(root)
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        root[np.maximum(x, y)] = np.minimum(x, y)


def _even(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Columns of a batch, fingerprints in words below the others, cut where the width changes."""
    if not batch.num_rows:
        return
    other = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2, 3, 5)])
    fp = batch.column(4)
    if not pa.types.is_binary(fp.type):
        yield np.concatenate([other, fp.to_numpy()[None, :]])
        return
    fp = fp.to_pylist()
    lengths = np.array([len(x) for x in fp])
    cuts = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(fp)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield np.concatenate([other[:, lo:hi], np.frombuffer(b"".join(fp[lo:hi]), "<i8").reshape(hi - lo, -1).T])


def _linker(radius: float, chunk: int = 1 << 17, link: Callable = link_arrays):
    """Over partitions sorted by (slot, key, part): forests of the buckets."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for part in (piece for batch in parts for piece in _even(batch)):
            if held and len(part) != len(held[0]):  # fingerprints of another width: of another slot
                yield from emit(np.concatenate(held, axis=1))
                held, size = [], 0
            held.append(part)
            size += part.shape[1]
            if size >= chunk:
                block = np.concatenate(held, axis=1)
                last = (block[:3] != block[:3, -1:]).any(axis=0)
                end = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
                if end:
                    yield from emit(block[:, :end])
                    block = block[:, end:]
                held, size = [block], block.shape[1]
                if not end:
                    size = 0  # one bucket so far: gather as much again before the next look
        if held:
            yield from emit(np.concatenate(held, axis=1))

    def emit(block: np.ndarray) -> Iterator[pa.RecordBatch]:
        if block.shape[1] < 2:
            return
        new = np.ones(block.shape[1], bool)
        new[1:] = (block[:3, 1:] != block[:3, :-1]).any(axis=0)
        bucket = np.cumsum(new)
        cross = block[3] if (block[2] >= 0).any() else None
        root = link(bucket, np.ascontiguousarray(block[5:].T).view(np.uint64), radius, cross)
        rep = block[4]
        least = rep.copy()  # edges point at the smallest class, so that no hub is a source
        np.minimum.at(least, root, rep)
        away = np.flatnonzero(rep != least[root])
        if len(away):
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[away]), pa.array(least[root[away]])], schema=_EDGES
            )

    return run


def links(classes: DataFrame, n_classes: int, radius: int = 4, most: int = 1 << 16) -> DataFrame:
    """``a, b``: a spanning forest, bucket by bucket, of classes ``(fp, rep)`` within ``radius``."""
    masks = tables(radius, n_classes)
    keys = F.array(
        *(
            F.struct(F.lit(j).alias("slot"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
            for j, m in enumerate(masks)
        )
    )
    dealt = classes.select("fp", "rep", F.explode(keys).alias("k")).select("k.slot", "k.key", "fp", "rep")
    return link_buckets(dealt, _linker(radius), most)


_DEALT = ("slot", "key", "part", "side", "fp", "rep")


def link_buckets(
    dealt: DataFrame, linker: Callable, most: int, every: int = 64, weight: Column | None = None
) -> DataFrame:
    """``a, b``: a spanning forest of what ``linker`` matches in each bucket ``(slot, key)`` of ``(fp, rep)``.

    Buckets of weight (rows, if none is given) over ``most`` are looked for among one of ``every`` rows, so
    that the rows themselves are shuffled once.  Such a bucket is linked in two steps:

    * it is cut into chunks of half of ``most``, one row of 32 chunks' rows goes to all of them besides, and
      each chunk is linked alone;
    * rows outside the bucket's largest component by then are *loose*.  Blocks of them meet every
      chunk and one another, so every pair has been compared or is in that component.
    """
    keys, none, zero = ["slot", "key"], F.lit(-1).cast("long"), F.lit(0).cast("long")
    weight = F.lit(1) if weight is None else weight
    some = dealt if every == 1 else dealt.where(F.pmod(F.xxhash64(F.lit(13), "rep"), F.lit(every)) == 0)
    sums = some.groupBy(keys).agg((F.sum(weight) * every).alias("size")).where(F.col("size") > most)
    hot = materialise(sums.select(*keys, F.ceil(2 * F.col("size") / most).alias("n")))
    if hot.isEmpty():
        return _linked(dealt.withColumn("part", none).withColumn("side", none), linker)
    cold = _linked(dealt.join(hot, keys, "left_anti").withColumn("part", none).withColumn("side", none), linker)
    inside = dealt.join(hot, keys).withColumn("chunk", F.pmod(F.xxhash64(F.lit(17), "rep"), F.col("n")))
    inside = inside.withColumn("weight", weight)
    leads = F.pmod(F.xxhash64(F.lit(19), "rep"), 32 * F.col("n")) == 0
    away = inside.where(leads).withColumn("part", F.explode(F.sequence(zero, F.col("n") - 1))).where("part <> chunk")
    chunks = inside.withColumn("part", F.col("chunk")).select(*_DEALT[:3], "fp", "rep")
    first = materialise(_linked(chunks.unionAll(away.select(*chunks.columns)).withColumn("side", none), linker))
    found = components(first)
    named = inside.join(found, F.col("rep") == F.col("node"), "left").withColumn("c", F.coalesce("component", "rep"))
    named = named.select(*keys, "fp", "rep", "weight", "n", "chunk", "c")
    tally = named.groupBy(*keys, "c").agg(F.sum("weight").alias("w"))
    tally = tally.groupBy(keys).agg(F.max_by("c", F.struct("w", "c")).alias("main"), (F.sum("w") - F.max("w")).alias("loose"))
    tally = materialise(tally.where("loose > 0").select(*keys, "main", F.ceil(2 * F.col("loose") / most).alias("g")))
    if tally.isEmpty():
        return cold.unionAll(first)
    split = named.join(tally, keys).withColumn("block", F.pmod(F.xxhash64(F.lit(23), "rep"), F.col("g")))
    to = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    main = split.where("c = main").withColumn("to", to("g")).withColumn("part", F.col("chunk") * F.col("g") + F.col("to"))
    loose = split.where("c <> main").withColumn("to", to("n")).withColumn("part", F.col("to") * F.col("g") + F.col("block"))
    pairs = split.where("c <> main").withColumn("to", to("g"))
    pairs = pairs.withColumn(
        "part", (F.col("n") + F.least("block", "to")) * F.col("g") + F.greatest("block", "to")
    ).withColumn("side", F.when(F.col("block") == F.col("to"), none).otherwise(F.col("block")))
    second = main.withColumn("side", zero).select(*_DEALT).unionAll(loose.withColumn("side", zero + 1).select(*_DEALT))
    second = _linked(second.unionAll(pairs.select(*_DEALT)), linker)
    return cold.unionAll(first).unionAll(second)


def _linked(dealt: DataFrame, linker: Callable) -> DataFrame:
    by = ["slot", "key", "part"]
    own = dealt.select(F.col("slot").cast("long"), *_DEALT[1:])
    return arrow_map(own.repartition(*by).sortWithinPartitions(*by), linker, "a long, b long")


def near_dedup(
    docs: DataFrame,
    size: int = 4,
    radius: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, fp, component_id``, one row per input row."""
    prints = materialise(fingerprints(docs, size, id_col, text_col))
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    n_classes, n_rows = classes.agg(F.count("rep"), F.coalesce(F.sum("n"), F.lit(0))).head()
    found = components(links(classes.where("rep IS NOT NULL").select("fp", "rep"), n_classes, radius))
    owners = classes.join(found, F.col("rep") == F.col("node"), "left").select(
        "fp", "n", F.coalesce("component", "rep").alias("component_id")
    )
    return join_counted(prints, owners, "fp", n_rows).select("doc_id", "fp", "component_id")


def digest_of(hashes: np.ndarray) -> bytes:
    """Sixteen bytes that tell sets of shingle hashes apart."""
    return blake2b(hashes.tobytes(), digest_size=16).digest()


PLACES = 1 << 18  # of the sketch of shingle counts
COMMON = 16  # texts of the sample that have a shingle which is known to be shared
_SLOTS = 16  # of :func:`parities`
PARITY = 16  # words of the narrowest fingerprint, for sets of up to 64 shingles a word


def _sketch(size: int):
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(PLACES, np.int32)
        for (text,) in rows(parts):
            np.add.at(sums, np.unique(shingle_hashes(text, size)) & np.uint64(PLACES - 1), 1)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    return run


def shingle_counts(own: DataFrame, n: int, size: int, sample: int = 2_000) -> np.ndarray:
    """How often shingles occur in about ``sample`` of the ``n`` texts, by ``PLACES`` places of their hash."""
    share = int(min(1.0, sample / max(1, n)) * (1 << 40))
    picked = own.where(F.pmod(F.xxhash64(F.lit(7), "text"), F.lit(1 << 40)) < F.lit(share)).select("text")
    got = arrow_map(picked.coalesce(8), _sketch(size), "sums binary").collect()  # eight tables of fixed size
    return sum((np.frombuffer(r["sums"], np.int32) for r in got), np.zeros(PLACES, np.int32))


def prefix(hashes: np.ndarray, similarity: float, counts: np.ndarray) -> np.ndarray:
    """The shingles of which sets of that similarity share one, rare ones first."""
    m = len(hashes)
    take = m - int(np.ceil(similarity * m - 1e-6)) + 1 if m else 0
    return hashes[np.lexsort((hashes, counts[hashes & np.uint64(PLACES - 1)]))[:take]]


def lead(m: int, similarity: float) -> int:
    """How many of its first shingles hold one of any similar set that is not smaller than its own ``m``."""
    return m - int(np.ceil(2 * similarity / (1 + similarity) * m - 1e-6)) + 1 if m else 0


def parity(hashes: np.ndarray, width: int = PARITY) -> np.ndarray:
    """The set's size and, for each of ``64 * width`` places of the hash, whether an odd number of shingles
    falls there."""
    places = 64 * width
    odd = np.bincount((hashes >> np.uint64(32)) % np.uint64(places), minlength=places) & 1
    return np.r_[np.uint64(len(hashes)), np.packbits(odd.astype(bool), bitorder="little").view("<u8")]


def parities(hashes: np.ndarray, similarity: float) -> tuple[list[int], list[bytes]]:
    """Slots and fingerprints of a set: the slot of its size, whose width doubles from slot to slot, and
    those below in which a set of that similarity may be."""
    slot = 0
    while len(hashes) > 64 * PARITY << slot and slot < _SLOTS - 1:
        slot += 1
    slots = [k for k in range(slot + 1) if k == slot or similarity * len(hashes) <= (64 * PARITY << k) + 1e-6]
    return slots, [parity(hashes, PARITY << k).tobytes() for k in slots]


def link_parities(
    bucket: np.ndarray, fp: np.ndarray, similarity: float, cross: np.ndarray | None = None, large: int = 256
) -> np.ndarray:
    """Root index of each row under "same bucket, and no proof from size and parity that the sets are
    less similar".  Arguments as for :func:`link_arrays`, with rows of :func:`parity`."""
    sizes = fp[:, 0].astype(np.int64)
    order = np.lexsort((sizes, bucket))
    bucket, sizes, bits = bucket[order], sizes[order], np.ascontiguousarray(fp[order, 1:])
    side = None if cross is None else cross[order]
    share = (1 - similarity) / (1 + similarity)
    root = np.arange(len(fp))
    left, step = np.arange(len(fp)), 0
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    lengths = np.diff(np.r_[starts, len(bucket)])
    for k in np.flatnonzero(lengths > large):
        at = slice(starts[k], starts[k] + lengths[k])
        table = pivot_table(bits[at], 8)
        _sweep_parities(root[at], sizes[at], bits[at], table, similarity, None if side is None else side[at], starts[k])
    left = left[np.repeat(lengths <= large, lengths)]
    while len(left):
        step += 1
        left = left[left + step < len(fp)]
        right = left + step
        near = (bucket[left] == bucket[right]) & (sizes[left] >= sizes[right] * similarity - 1e-6)
        left, right = left[near], right[near]
        a, b = left, right
        if side is not None:
            apart = (side[a] != side[b]) | (side[a] < 0)
            a, b = a[apart], b[apart]
        if len(a):
            same = _distance(bits[a], bits[b]) <= (sizes[a] + sizes[b]) * share + 1e-6
            _join(root, a[same], b[same])
    out = np.empty_like(root)
    out[order] = order[_flat(root)]
    return out


def _sweep_parities(root, sizes, bits, table, similarity: float, side, offset: int) -> None:
    """:func:`_sweep` for one bucket's rows in the order of their sizes."""
    share = (1 - similarity) / (1 + similarity)
    rest = np.arange(len(sizes))
    while len(rest):
        first, rest = rest[0], rest[1:]
        todo = [first]
        while todo and len(rest):
            x = todo.pop()
            lo, hi = np.searchsorted(sizes[rest], (sizes[x] * similarity - 1e-6, sizes[x] / similarity + 1e-6))
            found = rest[lo:hi]
            if side is not None:
                found = found[(side[found] != side[x]) | (side[found] < 0)]
            if len(found) > 16:
                found = _discard(table, found, x, (sizes + sizes[x]) * share + 1e-6)
            found = found[_distance(bits[found], bits[x]) <= (sizes[found] + sizes[x]) * share + 1e-6]
            if len(found):
                root[found] = first + offset
                todo.extend(found.tolist())
                rest = np.delete(rest, np.searchsorted(rest, found))


def prefix_links(sets: DataFrame, similarity: float, most: int = 1 << 16, every: int = 64) -> DataFrame:
    """``a, b``: a spanning forest, bucket by bucket, of the codes of ``sets (code, size, lead, slots, parities,
    common, prefix)`` that share a slot and a shingle of their prefixes and may be similar.  Rows may repeat.

    Shingles, codes and sizes are dealt first.  Of two similar sets the smaller one has their first common
    shingle in the ``lead`` of its prefix, so under a shingle and in the order of sizes a row stays if a lead
    row before it is near enough in size, or it is one itself and the row after it is near enough.
    A shingle that is shared gives way to a signature of the classes that have it, so that buckets with the
    same members become one, and fingerprints follow only then.
    Shingles in ``common`` are known to be shared, so that none of them is counted or ordered in one task.
    Without columns ``size`` and ``lead`` every row under a shared shingle stays.
    """
    if "lead" not in sets.columns:
        sets = sets.withColumns({"size": F.lit(0).cast("long"), "lead": F.lit(1 << 40)})
    key = F.xxhash64("slot", "shingle").alias("key")
    place = ((F.col("size") * _SLOTS + F.col("slot")) * 2 + (F.col("at") < F.col("lead")).cast("long")).alias("place")
    deal = lambda c: sets.select("code", "size", "lead", c, F.explode("slots").alias("slot")).select(
        "slot", "code", "size", "lead", F.posexplode(c).alias("at", "shingle")
    ).select(place, "code", key)
    slot = F.pmod(F.floor(F.col("place") / 2), F.lit(_SLOTS)).cast("int").alias("slot")
    own = F.floor(F.col("place") / (2 * _SLOTS))
    mark = F.bit_xor(F.xxhash64("code"))
    by = Window.partitionBy("key")
    ordered = by.orderBy("size", "code")
    leads = F.pmod("place", F.lit(2)) == 1
    near = lambda least, most: F.coalesce(least >= most * similarity - 1e-6, F.lit(False))
    rare = deal("prefix").withColumn("size", own).withColumn("after", F.lead("size").over(ordered))
    before = F.last(F.when(leads, F.col("size")), ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    rare = rare.withColumn("before", before)
    rare = rare.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("sign", mark.over(by))
    rare = rare.where(near(F.col("before"), F.col("size")) | (leads & near(F.col("size"), F.col("after"))))
    common = deal("common")
    told = materialise(common.groupBy("key").agg(F.count(F.lit(1)).alias("n"), mark.alias("sign")))
    total = told.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    common = join_counted(common, told.withColumn("many", F.col("n")), "key", total).where("many > 1")
    sign = lambda n: F.xxhash64(slot, "sign", n).alias("key")
    shared = rare.select(slot, sign("n"), "code").unionAll(common.select(slot, sign("many"), "code")).distinct()
    prints = sets.select("code", F.explode(F.arrays_zip("slots", "parities")).alias("p"))
    prints = prints.select("code", F.col("p.slots").alias("slot"), F.col("p.parities").alias("fp"))
    met = materialise(shared.join(prints, ["code", "slot"]).select("slot", "key", "fp", F.col("code").alias("rep")))
    return link_buckets(met, _linker(similarity, 1 << 15, link_parities), most, every)


_PREFIX_SPEC = "doc_id long, digest binary, code long, size long, lead long, slots array<int>, parities array<binary>, common array<long>, prefix array<long>"


def _prefixes(size: int, similarity: float, counts: np.ndarray):
    long, many = pa.int64(), pa.list_(pa.int64())
    schema = pa.schema(
        [
            ("doc_id", long), ("digest", pa.binary()), ("code", long), ("size", long), ("lead", long), ("slots", pa.list_(pa.int32())),
            ("parities", pa.list_(pa.binary())), ("common", many), ("prefix", many),
        ]
    )

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            told: set[bytes] = set()  # sets that this task has dealt: of copies, one is enough
            for ident, text in rows(parts):
                hashes = np.unique(shingle_hashes(text, size))
                digest = digest_of(hashes)
                code = int.from_bytes(digest[:8], "little", signed=True)
                if digest in told:
                    yield ident, digest, code, len(hashes), 0, [], [], [], []
                    continue
                if len(told) >= 1 << 18:
                    told.clear()
                told.add(digest)
                first = prefix(hashes, similarity, counts)
                common = counts[first & np.uint64(PLACES - 1)] >= COMMON
                yield (
                    ident, digest, code, len(hashes), int((~common[: lead(len(hashes), similarity)]).sum()),
                    *parities(hashes, similarity), first[common].view(np.int64), first[~common].view(np.int64),
                )

        yield from batches(records(), schema, 512)

    return run


_SETS = pa.schema([("slot", pa.int64()), ("key", pa.int64()), ("fp", pa.binary()), ("rep", pa.int64()), ("bytes", pa.int64())])


def _sets(size: int):
    """Over ``rep, digest, key, text``: the set of each text that is the one meant by the digest."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for rep, digest, key, text in rows(parts):
                hashes = np.unique(shingle_hashes(text, size))
                if digest_of(hashes) == digest:
                    yield 0, key, hashes.tobytes(), rep, hashes.nbytes

        yield from batches(records(), _SETS)

    return run


def link_sets(sets: list[np.ndarray], similarity: float, side: np.ndarray | None = None) -> np.ndarray:
    """Root index of each set under "Jaccard similarity of at least ``similarity``", compared in full.

    Breadth first: a set that is reached is never compared with another that was.  With ``side``, only
    sets whose ``side`` differs are compared, or all where it is below 0.
    """
    sizes = np.array([len(x) for x in sets])
    root = np.arange(len(sets))
    rest = np.argsort(sizes, kind="stable")
    rest = rest[sizes[rest] > 0]
    if len(rest) < 2:
        return root
    flat = np.unique(np.concatenate([sets[i] for i in rest]), return_inverse=True)[1].astype(np.int32)
    mark = np.zeros(int(flat.max()) + 1, bool)
    at = np.r_[0, np.cumsum(sizes[rest])]
    own = {i: flat[lo:hi] for i, lo, hi in zip(rest.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)}

    def drop(gone: np.ndarray) -> None:
        nonlocal rest, flat, at
        flat = flat[np.repeat(~gone, sizes[rest])]
        rest = rest[~gone]
        at = np.r_[0, np.cumsum(sizes[rest])]

    while len(rest):
        first = int(rest[0])
        gone = np.zeros(len(rest), bool)
        gone[0] = True
        drop(gone)
        todo = [first]
        while todo and len(rest):
            x = todo.pop()
            bounds = sizes[x] * similarity - 1e-6, sizes[x] / similarity + 1e-6
            lo, hi = np.searchsorted(sizes[rest], bounds)
            if lo == hi:
                continue
            mark[own[x]] = True
            common = np.add.reduceat(mark[flat[at[lo] : at[hi]]], at[lo:hi] - at[lo], dtype=np.int64)
            mark[own[x]] = False
            window = rest[lo:hi]
            near = common * (1 + similarity) >= (sizes[window] + sizes[x]) * similarity - 1e-6
            if side is not None:
                near &= (side[window] != side[x]) | (side[x] < 0)
            if near.any():
                root[window[near]] = first
                todo.extend(window[near].tolist())
                gone = np.zeros(len(rest), bool)
                gone[lo:hi] = near
                drop(gone)
    return root


def _set_linker(similarity: float):
    """Over partitions sorted by (slot, key, part), ``fp`` being whole sets: forests of the buckets."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges() -> Iterator[tuple]:
            for _, group in groupby(rows(parts), key=itemgetter(0, 1, 2)):
                _, _, _, side, sets, rep = zip(*group, strict=True)
                if len(sets) < 2:
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in sets]
                root = link_sets(sets, similarity, np.array(side) if max(side) >= 0 else None)
                rep = np.array(rep)
                least = rep.copy()
                np.minimum.at(least, root, rep)
                away = rep != least[root]
                yield from zip(rep[away].tolist(), least[root[away]].tolist(), strict=True)

        yield from batches(edges(), _EDGES)

    return run


def verified(own: DataFrame, members: DataFrame, size: int, similarity: float, most: int = 8 << 20) -> DataFrame:
    """``a, b``: a spanning forest of the classes ``members(rep, digest, key)`` whose sets are similar, looked
    for among those with one ``key``.  A task holds about ``most`` bytes of sets."""
    # Some 32 bytes a candidate: sent to the texts up to 32 MB, else both are shuffled.
    wanted = F.broadcast(members) if members.count() <= 1 << 20 else members
    texts = own.where("doc_id IS NOT NULL").join(wanted, F.col("doc_id") == F.col("rep")).select("rep", "digest", "key", "text")
    spec = "slot long, key long, fp binary, rep long, bytes long"
    dealt = materialise(arrow_map(texts, _sets(size), spec))
    return link_buckets(dealt, _set_linker(similarity), most, 1, F.col("bytes"))


def similar_dedup(
    docs: DataFrame,
    size: int = 5,
    similarity: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, component_id``, one row per input row: texts linked whose ``size``-word shingle sets have
    a Jaccard similarity of at least ``similarity``; two texts without words are linked."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    n = own.count()
    maker = _prefixes(size, similarity, shingle_counts(own, n, size))
    with temporary() as keep:
        prints = materialise(arrow_map(own, maker, _PREFIX_SPEC))
        classes = prints.groupBy("digest", "code").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
        classes = materialise(classes)
        with temporary() as near_keep:
            near = components(prefix_links(prints.where(F.size("slots") > 0), similarity))
            near_keep.append(near)
        with temporary() as found_keep:
            members = classes.where("rep IS NOT NULL").join(near, F.col("code") == F.col("node"))
            members = materialise(members.select("rep", "digest", F.col("component").alias("key")))
            found = components(verified(own, members, size, similarity))
            found_keep.append(found)
        owners = classes.select("digest", "rep", "n").join(found, F.col("rep") == F.col("node"), "left")
        owners = owners.select("digest", "n", F.coalesce("component", "rep").alias("component_id"))
        out = materialise(join_counted(prints.select("doc_id", "digest"), owners, "digest", n).select("doc_id", "component_id"))
        keep.append(out)
    return out


def near_copies(
    docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, component_id`` of every id that has a near copy: the components of all links of
    :func:`near_dedup` and of :func:`similar_dedup` together, so that a chain may hold both kinds."""
    with temporary() as keep:
        found = near_dedup(docs, id_col=id_col, text_col=text_col).select("doc_id", "component_id")
        found = found.unionAll(similar_dedup(docs, size, similarity, id_col, text_col)).where("doc_id <> component_id")
        groups = components(found.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
        keep.append(groups)
    return groups.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def keep_first(found: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the smallest id.

    A row without an id cannot be named and stays.
    """
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return without(docs, gone, id_col)


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    got = near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
