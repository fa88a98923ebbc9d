"""Language-model scoring with an Elias-Fano n-gram trie.

Tokens are lower-cased words and one end token a text.  The model is a bigram model with Dirichlet
smoothing towards the unigrams, ``p(w | v) = (c(v w) + m p(w)) / (c(v) + m)``, the context of a first
token being the end token, and ``p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))``.  It is counted over all
training texts.

The trie is dealt over shards by the context word, since it grows with the corpus:

1. *Blocks.*  A task gathers texts to blocks of about ``block`` tokens and writes, per block, the
   coded texts and, per shard, a request: the block's distinct words with their training counts, and
   its distinct successors of each of these words.
2. *Shards.*  A shard merges the requests into its trie.  Level 1 holds its words in order, with
   monotone pointers to their successors; level 2 holds the successors of all words in one monotone
   sequence (each taken relative to its context) with joint probabilities quantised to two bytes.
   Both sequences are Elias-Fano coded, written to a file of the task and memory-mapped.  Requests are
   answered by successor search inside the context's range, block by block.
3. *Scores.*  Each block meets its answers, and its texts are summed up.

Successors are told apart in their context by 40 hash bits; words, and so the base score, are exact.
A word that is a large share of all tokens would make its shard grow with its distinct successors:
such words are looked for in a bounded sample of texts, and their successors are dealt over several
shards by hash.  Which words these are changes only who counts what, never a result.  So that a shard
need not know all of a context, level 2 holds joint probabilities ``c(v w) / N``, quantised up to
the constant ``N`` and not smoothed yet; whoever reads them adds ``m p(w)`` and divides by the
context's ``c(v) + m``.

Defined results.  A null text counts as empty and has the end token alone.  A null id is text
``null`` to the hash that deals texts to training.  Repeated rows are counted and scored each.
Without training texts every count is 0.  An empty table gives an empty table.  Only id and text are
read.
"""

from __future__ import annotations

import tempfile
from binascii import crc32
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import arrow_map, batches, materialise, rows

END = b""
HASH = 40
_MASK = (1 << HASH) - 1
_ADD = 0.1
#: Quantised joint probabilities take two bytes: 0 is "absent", 1 to TOP are log10 c(v w) from 0 to
#: HIGH, in steps of 0.0002.
HIGH, TOP = 13.0, 65535
_ODD = 0x9E3779B97F4A7C15


def held_out(ident: int | None) -> bool:
    return crc32(str("null" if ident is None else ident).encode()) % 10 == 0


def quantise(counts: np.ndarray) -> np.ndarray:
    return (1 + np.rint(np.log10(counts) / HIGH * (TOP - 1))).astype(np.uint16)


#: What each code stands for.
LEVELS = np.concatenate([[0.0], 10.0 ** (HIGH * np.arange(TOP) / (TOP - 1))])


class EliasFano:
    """Elias-Fano code of a monotone sequence of unsigned 64-bit numbers, memory-mapped from a file.

    The low ``width`` bits are packed; the high parts are unary in a bit vector, where bit
    ``high + i`` is set for element ``i``.  A directory every ``STEP`` elements gives the place in the
    bit vector, so that a range is decoded alone.
    """

    STEP = 1 << 14

    def __init__(self, path: Path, values: np.ndarray) -> None:
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.width = max(0, (top // max(1, n)).bit_length() - 1)
        upper = np.zeros(((top >> self.width) + n >> 3) + 1, np.uint8)
        bits = np.zeros((n * self.width + 7) // 8 + 8, np.uint8)
        starts = []
        for at in range(0, n, 1 << 20):  # in pieces, so that no copy of the sequence is held
            part = values[at : at + (1 << 20)]
            place = (part >> np.uint64(self.width)).astype(np.int64) + np.arange(at, at + len(part))
            np.bitwise_or.at(upper, place >> 3, (1 << (place & 7)).astype(np.uint8))
            starts.append(place[:: self.STEP])
            low = part & np.uint64((1 << self.width) - 1)
            spot = np.arange(at, at + len(part), dtype=np.int64) * self.width
            for shift in range(0, self.width + 7, 8):
                # Byte ``shift / 8`` of each low part, moved to its bit offset.
                moved = (low << (spot & 7).astype(np.uint64)) >> np.uint64(shift)
                np.bitwise_or.at(bits, (spot >> 3) + shift // 8, (moved & np.uint64(255)).astype(np.uint8))
        self.upper, self.bits = _mapped(path.with_suffix(".hi"), upper), _mapped(path.with_suffix(".lo"), bits)
        self.start = np.concatenate(starts) if starts else np.empty(0, np.int64)
        self.first = values[:: self.STEP].copy()

    def decode(self, chunk: int) -> np.ndarray:
        """Elements ``chunk * STEP`` up to the next chunk."""
        i = chunk * self.STEP
        j = min(self.n, i + self.STEP)
        begin = int(self.start[chunk])
        end = int(self.start[chunk + 1]) if chunk + 1 < len(self.start) else len(self.upper) * 8
        base = begin & ~7
        ones = np.flatnonzero(np.unpackbits(self.upper[base >> 3 : (end + 7) >> 3], bitorder="little")) + base
        ones = ones[ones >= begin][: j - i]
        high = (ones - np.arange(i, j)).astype(np.uint64)
        spot = np.arange(i, j, dtype=np.int64) * self.width
        low = np.zeros(j - i, np.uint64)
        for byte in range((self.width + 7) // 8 + 1):
            got = self.bits[np.minimum((spot >> 3) + byte, len(self.bits) - 1)].astype(np.uint64)
            if byte < 8:
                low |= got << np.uint64(8 * byte)
        low = (low >> (spot & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)
        return high << np.uint64(self.width) | low

    def find(self, keys: np.ndarray) -> np.ndarray:
        """For sorted keys, the index of the first element not below each."""
        out = np.empty(len(keys), np.int64)
        if not self.n:
            out[:] = 0
            return out
        # The last chunk that begins below the key has it, or ends just before it.
        chunk = np.maximum(np.searchsorted(self.first, keys) - 1, 0)
        at = 0
        while at < len(keys):
            c = int(chunk[at])
            end = int(np.searchsorted(chunk, c, side="right"))
            values = self.decode(c)
            out[at:end] = c * self.STEP + np.searchsorted(values, keys[at:end])
            at = end
        return out

    def at(self, index: np.ndarray) -> np.ndarray:
        """Elements at sorted indices."""
        out = np.empty(len(index), np.uint64)
        chunk = index // self.STEP
        at = 0
        while at < len(index):
            c = int(chunk[at])
            end = int(np.searchsorted(chunk, c, side="right"))
            out[at:end] = self.decode(c)[index[at:end] - c * self.STEP]
            at = end
        return out


def _mapped(path: Path, array: np.ndarray) -> np.ndarray:
    np.save(path.with_suffix(path.suffix + ".npy"), array)
    return np.load(path.with_suffix(path.suffix + ".npy"), mmap_mode="r")


class Trie:
    """A shard's two levels: sorted words with pointers, and successors relative to their context with
    quantised joint probabilities."""

    def __init__(self, folder: Path, contexts: int, keys: np.ndarray, counts: np.ndarray) -> None:
        """``keys`` are sorted, unique ``context << HASH | successor``, counts their occurrences."""
        ends = np.searchsorted(keys, np.arange(1, contexts + 1, dtype=np.uint64) << np.uint64(HASH))
        self.pointers = EliasFano(folder / "pointers", ends.astype(np.uint64))
        self.successors = EliasFano(folder / "successors", keys)
        codes = np.zeros(max(1, len(keys)), np.uint16)
        for at in range(0, len(keys), 1 << 20):
            codes[at : at + (1 << 20)] = quantise(counts[at : at + (1 << 20)])
        self.probability = _mapped(folder / "probability", codes)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Probability codes for sorted ``context << HASH | successor``; 0 where absent.

        The successor's place is searched relative to its context: it must lie before the
        context's pointer and carry the key sought.
        """
        if len(keys) > 1 << 20:
            return np.concatenate([self.look_up(keys[at : at + (1 << 20)]) for at in range(0, len(keys), 1 << 20)])
        if not len(keys) or not self.successors.n:
            return np.zeros(len(keys), np.uint16)
        spot = self.successors.find(keys)
        inside = spot < self.pointers.at((keys >> np.uint64(HASH)).astype(np.int64)).astype(np.int64)
        out = np.zeros(len(keys), np.uint16)
        k = np.flatnonzero(inside)
        hit = self.successors.at(spot[k]) == keys[k]
        k = k[hit]
        out[k] = self.probability[spot[k]]
        return out


_PACK = zstandard.ZstdCompressor(level=1)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one blob: sizes, then the bytes, planes of equal significance together."""
    head = [len(arrays)]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += [ord(a.dtype.char), len(a)]
        body.append(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if len(a) else b"")
    return _PACK.compress(np.array(head, np.int64).tobytes() + b"".join(body))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 1 + 2 * n)[1:]
    at, out = 8 * (1 + 2 * n), []
    for k in range(n):
        kind, size = np.dtype(chr(int(head[2 * k]))), int(head[2 * k + 1])
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1) if size else np.empty(0, kind))
        at += size * kind.itemsize
    return out


_ROWS = pa.schema(
    [("kind", pa.string()), ("block", pa.int64()), ("shard", pa.int32()), ("payload", pa.binary()), ("words", pa.binary()), ("tokens", pa.int64())]
)
_SPEC = "kind string, block long, shard int, payload binary, words binary, tokens long"


class _Block:
    """Texts gathered until they are coded together."""

    def __init__(self, shards: int, hot: dict[bytes, int]) -> None:
        self.shards, self.hot = shards, hot
        self.ids: dict[bytes, int] = {END: 0}
        self.docs: list[tuple] = []
        self.codes: list[np.ndarray] = []
        self.tokens = 0
        self.bytes = 0

    def add(self, ident: int | None, text: bytes | None) -> None:
        words = (text or b"").lower().split()
        ids = self.ids
        known = len(ids)
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words))
        if len(ids) > known:
            self.bytes += len(text)
        self.docs.append((ident, len(words) + 1, not held_out(ident)))
        self.codes.append(code)
        self.codes.append(np.zeros(1, np.int32))
        self.tokens += len(words) + 1

    def records(self, number: int) -> Iterator[tuple]:
        words = list(self.ids)
        hashes = np.fromiter((xxh64_intdigest(w) for w in words), np.uint64, len(words))
        shard = (hashes % np.uint64(self.shards)).astype(np.int64)
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        order = order[np.argsort(shard[order], kind="stable")]
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        code = rank[np.concatenate(self.codes)]
        lengths = np.array([d[1] for d in self.docs], np.int64)
        train = np.array([d[2] for d in self.docs], bool)
        fits = np.repeat(train, lengths)
        hashes, shard = hashes[order], shard[order]
        short = hashes >> np.uint64(64 - HASH)
        counts = np.bincount(code[fits], minlength=len(words))
        keys, mine = pairs(code, lengths, rank[0], short, fits)
        ident = np.array([0 if d[0] is None else d[0] for d in self.docs], np.int64)
        null = np.array([d[0] is None for d in self.docs], np.uint8)
        bounds = np.searchsorted(shard, np.arange(self.shards + 1))
        hot = [(int(rank[self.ids[w]]), ways) for w, ways in self.hot.items() if w in self.ids]
        hot = np.array(hot, np.int64).reshape(-1, 2)
        yield (
            "text", number, -1,
            _pack(ident, null, train.astype(np.uint8), lengths, code, hashes, np.array([rank[0]], np.int64), bounds, hot.reshape(-1)),
            None, int(self.tokens),
        )
        at, moved = deal(keys, hashes, bounds, hot)
        keys, mine, at = keys[moved], mine[moved], at[moved]
        context = (keys >> np.uint64(HASH)).astype(np.int64)
        cut = np.searchsorted(at, np.arange(self.shards + 1))
        train_tokens = int(fits.sum())
        for s in range(self.shards):
            lo, hi, a, b = int(bounds[s]), int(bounds[s + 1]), int(cut[s]), int(cut[s + 1])
            if lo == hi and a == b:
                continue
            # Contexts of its own in order, then those whose successors are dealt here from elsewhere.
            inside = (context[a:b] >= lo) & (context[a:b] < hi)
            guests, fan = np.unique(context[a:b][~inside], return_counts=True)
            fan = np.concatenate([np.bincount(context[a:b][inside] - lo, minlength=hi - lo), fan]).astype(np.uint32)
            low = keys[a:b] & np.uint64(_MASK)
            payload = _pack(
                counts[lo:hi].astype(np.uint32), fan, (low >> np.uint64(32)).astype(np.uint8), low.astype(np.uint32), mine[a:b]
            )
            text = _PACK.compress(b"\n".join(words[i] for i in [*order[lo:hi], *order[guests]]))
            yield "request", number, s, payload, text, train_tokens
            train_tokens = 0  # told once a block


def deal(keys: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each pair, and the order in which pairs are sent: by shard, in each the pairs of its
    own contexts before the others.  ``hot`` has rows ``(context, ways)``."""
    context = (keys >> np.uint64(HASH)).astype(np.int64)
    own = (np.searchsorted(bounds, context, side="right") - 1).astype(np.int32)
    at, shards = own.copy(), len(bounds) - 1
    for rank, ways in hot.tolist():
        lo, hi = np.searchsorted(context, [rank, rank + 1])
        part = (keys[lo:hi] & np.uint64(_MASK)) % np.uint64(ways) * np.uint64(_ODD) + hashes[rank]
        at[lo:hi] = (part % np.uint64(shards)).astype(np.int32)
    if not len(hot):
        return at, np.arange(len(keys))
    place = 2 * at + (at != own)
    return at, np.argsort(place.astype(np.uint16) if shards < 1 << 15 else place, kind="stable")


def pairs(code, lengths, end, short, fits) -> tuple[np.ndarray, np.ndarray]:
    """Sorted unique ``context << HASH | successor`` keys and their training counts.

    The training mark rides in the lowest bit, so that one sort in place does for both; a block has
    far fewer than 2^23 words, which leaves that bit free.
    """
    if len(short) >= 1 << (63 - HASH):
        raise ValueError(f"a text of {len(short)} distinct words does not fit a block")
    keys = _pair_keys(code, lengths, end, short)
    keys <<= np.uint64(1)
    keys |= fits
    keys.sort()
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:] >> np.uint64(1), keys[:-1] >> np.uint64(1), out=new[1:])
    first = np.flatnonzero(new)
    if not len(first):
        return keys, np.empty(0, np.uint32)
    marks = (keys & np.uint64(1)).astype(np.uint32)
    return keys[first] >> np.uint64(1), np.add.reduceat(marks, first)


def _pair_keys(code, lengths, end, short) -> np.ndarray:
    before = np.empty(len(code), np.uint64)
    before[1:] = code[:-1]
    starts = np.cumsum(lengths) - lengths
    before[starts] = end
    return before << np.uint64(HASH) | short[code]


def _hot_words(shards: int):
    """Words that are over a quarter of a shard's share of the tokens of a partition, with their counts;
    the word ``None`` stands for all tokens."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for (text,) in rows(parts):
            seen.update((text or b"").lower().split())
            seen[END] += 1
        total = sum(seen.values())
        told = [(w, c) for w, c in seen.items() if c * 8 * shards > total]
        yield from batches([(None, total), *told], pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    return run


def hot_words(docs: DataFrame, shards: int, sample: int = 20_000) -> dict[bytes, int]:
    """Words over a quarter of a shard's share of all tokens, as told by about ``sample`` texts, with the
    number of shards to deal their successors to; never more than ``4 * shards`` words."""
    n = docs.count()
    share = min(1.0, sample / max(1, n))
    ident = F.coalesce(F.col(docs.columns[0]).cast("string"), F.lit("null"))
    picked = docs.where(F.pmod(F.xxhash64(F.lit(4), ident), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    counted = arrow_map(picked.select(docs.columns[1]), _hot_words(shards), "word binary, n long")
    sums = counted.groupBy("word").agg(F.sum("n").alias("n"))
    total = sums.where("word IS NULL").select("n").head()
    if not total or not total[0]:
        return {}
    most = sums.where("word IS NOT NULL").where(F.col("n") * 4 * shards > F.lit(total[0])).orderBy(F.desc("n")).limit(4 * shards)
    return {bytes(r["word"]): min(shards, 1 + 4 * shards * r["n"] // total[0]) for r in most.collect()}


def _blocks(shards: int, most: int, hot: dict[bytes, int]):
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32

        def records() -> Iterator[tuple]:
            number, block = first, _Block(shards, hot)
            for ident, text in rows(parts):
                block.add(ident, text)
                if block.tokens >= most or block.bytes >= 24 << 20:
                    yield from block.records(number)
                    number, block = number + 1, _Block(shards, hot)
            if block.docs:
                yield from block.records(number)

        yield from batches(records(), _ROWS, limit=8 << 20)

    return run


def _requests(batches_: Iterable[pa.RecordBatch], key: int) -> Iterator[tuple[int, list[tuple]]]:
    """Consecutive rows with one value in column ``key``."""
    now, held = None, []
    for record in rows(batches_):
        if held and record[key] != now:
            yield now, held
            held = []
        now = record[key]
        held.append(record)
    if held:
        yield now, held


_ANSWERS = pa.schema(
    [("block", pa.int64()), ("shard", pa.int32()), ("payload", pa.binary()), ("known", pa.int64()), ("tokens", pa.int64())]
)


def _answer(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by shard: build its trie and answer its blocks."""

    def records() -> Iterator[tuple]:
        for shard, held in _requests(parts, 1):
            with tempfile.TemporaryDirectory(prefix="trie-") as folder:
                yield from _solve(shard, held, Path(folder))

    yield from batches(records(), _ANSWERS, limit=8 << 20)


def _solve(shard: int, held: list[tuple], folder: Path) -> Iterator[tuple]:
    names: dict[bytes, int] = {}
    owns = []
    for _, _, _, text, _ in held:
        words = zstandard.ZstdDecompressor().decompress(text).split(b"\n")
        owns.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.int32, len(words)))
    place = np.empty(len(names), np.int64)
    for k, w in enumerate(sorted(names)):
        place[names[w]] = k
    contexts = len(names)
    del names
    # All requests in one order: they are counted, and later looked up, in one pass over the trie.
    total = np.zeros(contexts, np.int64)
    n = sum(len(_unpack(payload)[3]) for _, _, payload, _, _ in held)
    every, mine, asked, at = np.empty(n, np.uint64), np.empty(n, np.uint32), [], 0
    for own in owns:
        block, _, payload, _, told = held.pop(0)
        counts, fan, high, low, own_counts = _unpack(payload)
        mine_words = place[own[: len(counts)]]  # contexts from elsewhere follow and are counted there
        np.add.at(total, mine_words, counts)
        part = every[at : at + len(low)]
        part[:] = np.repeat(place[own].astype(np.uint64), fan)
        part <<= np.uint64(HASH)
        part |= high.astype(np.uint64) << np.uint64(32)
        part |= low
        mine[at : at + len(low)] = own_counts
        at += len(low)
        asked.append((block, mine_words, len(low), told))
    order = np.argsort(every)
    every, mine = every[order], mine[order]
    fits = mine > 0
    keys, sums = every[fits], mine[fits]
    del mine, fits
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    keys, sums = keys[first], np.add.reduceat(sums, first, dtype=np.int64) if len(first) else sums
    del new, first
    trie = Trie(folder, contexts, keys, sums)
    del keys, sums
    found = np.empty(len(every), np.uint16)
    found[order] = trie.look_up(every)
    known, at = int((total > 0).sum()), 0
    for block, own, n, told in asked:
        yield block, shard, _pack(total[own], found[at : at + n]), known, told
        known, at = 0, at + n


_SCORES = pa.schema(
    [
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("base_score", pa.float64()), ("score", pa.float64()),
    ]
)


def _score(n: int, v: int, strength: float):
    """Over rows sorted by block, then shard (the texts' row first)."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _requests(parts, 0):
            if held[0][1] != -1:
                raise RuntimeError(f"block {block} has answers without texts")
            ident, null, train, lengths, code, hashes, end, bounds, hot = _unpack(held[0][2])
            answers = [_unpack(r[2]) for r in held[1:]]
            counts = np.concatenate([a[0] for a in answers])
            found = np.concatenate([a[1] for a in answers])
            if len(counts) != len(hashes):
                raise RuntimeError(f"block {block} is short of answers")
            del held, answers
            keys = _pair_keys(code, lengths, end[0], hashes >> np.uint64(64 - HASH))
            order = np.argsort(keys)
            new = np.ones(len(keys), bool)
            np.not_equal(keys[order[1:]], keys[order[:-1]], out=new[1:])
            spot = np.empty(len(keys), np.int32)
            spot[order] = np.cumsum(new, dtype=np.int32) - 1
            if spot[order[-1]] + 1 != len(found):
                raise RuntimeError(f"block {block} has answers to other texts")
            _, moved = deal(keys[order[new]], hashes, bounds, hot.reshape(-1, 2))
            sent, found = found, np.empty_like(found)
            found[moved] = sent
            del order, new, moved, sent
            starts = np.cumsum(lengths) - lengths
            base, score, seen = (np.empty(len(code)) for _ in range(3))
            for at in range(0, len(code), 1 << 18):  # in pieces, for the sake of memory
                part = slice(at, at + (1 << 18))
                known = counts[code[part]]
                p = (known + _ADD) / (n + _ADD * (v + 1))
                before = counts[(keys[part] >> np.uint64(HASH)).astype(np.int64)]
                model = (LEVELS[found[spot[part]]] + strength * p) / (before + strength)
                base[part], score[part], seen[part] = np.log10(p), np.log10(model), known > 0
            del keys, spot
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ident, mask=null.astype(bool)), pa.array(train == 0), pa.array(lengths),
                    pa.array(np.add.reduceat(seen, starts).astype(np.int64)),
                    pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(score, starts)),
                ],
                schema=_SCORES,
            )

    return run


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    strength: float = 200.0,
    block: int = 3 << 19,
    shards: int | None = None,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, a row per row.

    ``strength`` is the weight of the unigrams in a context; ``shards`` (default: the session's
    shuffle partitions) should follow the corpus, ``block`` bounds a task's memory.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    coded = materialise(arrow_map(own, _blocks(shards, block, hot_words(own, shards)), _SPEC))
    asked = coded.where("kind = 'request'").select("block", "shard", "payload", "words", "tokens")
    dealt = asked.repartition(shards, "shard").sortWithinPartitions("shard", "block")
    answers = materialise(
        arrow_map(dealt, _answer, "block long, shard int, payload binary, known long, tokens long")
    )
    n, v = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).head()
    texts = coded.where("kind = 'text'").select("block", "shard", "payload")
    joined = texts.unionAll(answers.select("block", "shard", "payload")).repartition("block")
    spec = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = arrow_map(joined.sortWithinPartitions("block", "shard"), _score(n, v, strength), spec)
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
