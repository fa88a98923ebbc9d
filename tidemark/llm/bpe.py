"""Byte-level BPE encoding and decoding with a public vocabulary.

A text is cut at special tokens, then into pieces by the vocabulary's pattern.  In a piece the
symbols form a doubly linked list; a heap holds ``(merge rank, position)`` of adjacent pairs.  The
least is popped; entries whose symbols have since merged or moved are stale and skipped; a merge
relinks the list and pushes its two new neighbours.  Pieces recur, so their ids are kept in a
bounded table on the worker.  Decoding concatenates the vocabulary's byte strings.

Defined results.  A null text counts as empty and gives no ids.  Text decodes to itself, special
tokens included; ids that do not join to valid UTF-8 decode with replacement characters, and an
unknown id is an error.  Repeated rows give repeated results; an empty table an empty table.
Only id and text are read, and any id type passes through.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, batches, rows

# Fixed value: the piece pattern of byte-level vocabularies of this kind.
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary's strings."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = (b for b in range(256) if b not in set(plain))
    chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [chars[b] for b in range(256)]


class Codec:
    """Encoder and decoder for a vocabulary file in JSON (byte-level BPE, no normaliser)."""

    def __init__(self, path: str, held: int = 200_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("not a plain byte-level BPE vocabulary")
        byte = {c: b for b, c in enumerate(byte_symbols())}
        vocab = model["vocab"]
        self.strings: dict[int, bytes] = {i: bytes(byte[c] for c in s) for s, i in vocab.items() if all(c in byte for c in s)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.first = [vocab[c] for c in byte_symbols()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.pieces = regex.compile(PATTERN).findall
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.held, self.young, self.old = held, {}, {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.first[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [
            (got[0], i, ids[i], ids[i + 1], got[1])
            for i in range(n - 1)
            if (got := merges.get((ids[i], ids[i + 1])))
        ]
        heapify(heap)
        while heap:
            _, i, a, b, made = heappop(heap)
            if ids[i] != a:
                continue  # stale: the left symbol has merged
            j = after[i]
            if j >= n or ids[j] != b:
                continue  # stale: the right symbol has merged
            ids[i], ids[j] = made, -1
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if got := merges.get((made, ids[k])):
                    heappush(heap, (got[0], i, made, ids[k], got[1]))
            h = before[i]
            if h >= 0 and (got := merges.get((ids[h], made))):
                heappush(heap, (got[0], h, ids[h], made, got[1]))
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        """Little-endian ids of a piece; two generations of the table bound what is held."""
        got = self.young.get(piece) or self.old.get(piece)
        if got is None:
            got = array("I", self.merge(piece.encode("utf-8"))).tobytes()
        if len(piece) <= 64:
            if len(self.young) >= self.held:
                self.old, self.young = self.young, {}
            self.young[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        parts = self.cut(text) if self.cut else [text]
        out: list[bytes] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            get, made = self.young.get, self._piece
            out += [get(p) or made(p) for p in self.pieces(part)]
        return b"".join(out)

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.strings.__getitem__, memoryview(ids).cast("I")))

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


_CODECS: dict[str, Codec] = {}


def _codec(name: str) -> Codec:
    """The worker's codec for a file sent with the job."""
    path = SparkFiles.get(name)
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _send(df: DataFrame, path: str) -> str:
    context = df.sparkSession.sparkContext
    sent = context.__dict__.setdefault("_tidemark_files", set())
    if path not in sent:
        context.addFile(path)
        sent.add(path)
    return path.rsplit("/", 1)[-1]


def vocabulary_path() -> str:
    """The default vocabulary: a public file that is installed, never copied here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (binary: little-endian unsigned 32-bit), one row per input row."""
    own = docs.select(id_col, F.col(text_col).cast("string"))
    name = _send(docs, path or vocabulary_path())
    return _mapped(own, id_col, "ids binary", lambda text: (_codec(name).encode(text or ""),))


def decode(ids: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text``, one row per input row."""
    name = _send(ids, path or vocabulary_path())
    return _mapped(ids.select(id_col, ids_col), id_col, "text string", lambda b: (_codec(name).decode(b or b""),))


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id, ``ids`` digest and count, and the digest of the decoded text.

    Encoding and decoding run in one pass, so that ids need not leave the worker.
    """
    name = _send(docs, path or vocabulary_path())

    def both(text: str | None) -> tuple:
        codec = _codec(name)
        ids = codec.encode(text or "")
        back = codec.decode(ids).encode("utf-8")
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

    own = docs.select(id_col, F.col(text_col).cast("string"))
    return _mapped(own, id_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", both)


_ARROW = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}


def _mapped(df: DataFrame, id_col: str, columns: str, fn) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    fields = [c.split(" ") for c in columns.split(", ")]

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            schema = pa.schema([(id_col, part.schema.field(0).type), *((n, _ARROW[t]) for n, t in fields)])
            yield from batches(((i, *fn(x)) for i, x in rows([part])), schema)

    return arrow_map(df, run, f"`{id_col}` {kind}, {columns}")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
