"""Exact de-duplication with Patricia-trie owners.

Texts are equal when their bytes are equal after every ASCII white-space byte has gone.  The
work runs in two trie passes:

1. every input partition inserts its normalised texts into a compressed radix trie, so that a
   text leaves the partition at most once however often it is repeated there (a text that a third
   of all rows share becomes one row a partition);
2. the survivors are dealt by (length, content hash) and inserted, as whole byte strings, into
   one trie a partition.  A terminal node keeps the best owner seen and the number of rows.

A trie holds at most ``budget`` bytes; beyond it the heaviest subtree is moved to a file of the
task and what reaches it later is appended there, to be resolved alone when the input has ended.

Defined results.  Null texts count as empty, and all empty texts form one group.  The row with
the most code points in its original text stays, then the smallest id; null ids come last and
are never ``kept`` while the group has another id.  Rows that repeat an id with the same text
count each in ``group_size`` and are flagged alike.  An empty table gives an empty table.  Only
the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, batches, join_counted, materialise, rows, without

_DROP = b" \t\n\x0b\x0c\r"


def normalise(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8").translate(None, _DROP)


class _Node:
    __slots__ = ("edges", "label", "owner")

    def __init__(self, label: bytes) -> None:
        self.label = label
        self.edges: dict[int, _Node] = {}
        self.owner: list | None = None  # [-code points, id, rows]


def rank(ident: int | None) -> tuple[bool, int]:
    """Order of ids: null last."""
    return ident is None, ident or 0


class OwnerTrie:
    """Compressed radix trie over bytes; terminal nodes hold ``[-code points, id, rows]``.

    ``insert`` keeps the smaller (-code points, id) pair and adds the rows.  ``owners`` yields
    ``(key, owner)`` and ends the trie.  The trie holds about ``budget`` bytes in memory; subtrees
    over it wait in files under ``folder``.  ``head`` is what all keys are known to begin with; it is
    not kept in the nodes.
    """

    _COST = 200  # bytes of a node besides its label

    def __init__(self, budget: int = 64 << 20, folder: str | None = None, head: bytes = b"") -> None:
        self.root = _Node(b"")
        self.budget, self.folder, self.head = budget, folder, head
        self.held = 0
        self.spilled: dict[int, list] = {}  # by first byte: file name, open file, common beginning

    def insert(self, key: bytes, order: int, ident: tuple[bool, int], count: int) -> None:
        if self.spilled and len(key) > len(self.head) and (away := self.spilled.get(key[len(self.head)])):
            pickle.dump((key, order, ident, count), away[1])
            if not key.startswith(away[2]):
                away[2] = away[2][: _shared(key, 0, away[2])]
            return
        before = self.held
        self._put(key, order, ident, count)
        if self.held > self.budget and self.held > before:
            self._spill()

    def _put(self, key: bytes, order: int, ident: tuple[bool, int], count: int) -> None:
        node, at = self.root, len(self.head)
        while True:
            if at == len(key):
                own = node.owner
                if own is None:
                    node.owner = [order, ident, count]
                    return
                if (order, ident) < (own[0], own[1]):
                    own[0], own[1] = order, ident
                own[2] += count
                return
            child = node.edges.get(key[at])
            if child is None:
                child = _Node(key[at:])
                child.owner = [order, ident, count]
                node.edges[key[at]] = child
                self.held += len(child.label) + self._COST
                return
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _shared(key, at, label)
            upper = _Node(label[:same])
            child.label = label[same:]
            upper.edges[child.label[0]] = child
            node.edges[key[at]] = upper
            self.held += self._COST
            node, at = upper, at + same

    def _spill(self) -> None:
        """Move the heaviest subtree under the root to a file."""
        weigh = {b: self._weight(n) for b, n in self.root.edges.items()}
        byte = max(weigh, key=weigh.get)
        node = self.root.edges.pop(byte)
        fd, path = tempfile.mkstemp(dir=self.folder, prefix="subtree-")
        out = os.fdopen(fd, "wb")
        for key, own in self._walk(node, self.head):
            pickle.dump((key, *own), out)
        self.spilled[byte] = [path, out, self.head + node.label]
        self.held -= weigh[byte]

    def _weight(self, top: _Node) -> int:
        total, todo = 0, [top]
        while todo:
            node = todo.pop()
            total += len(node.label) + self._COST
            todo.extend(node.edges.values())
        return total

    @staticmethod
    def _walk(top: _Node, head: bytes) -> Iterator[tuple[bytes, list]]:
        todo = [(top, head)]
        while todo:
            node, path = todo.pop()
            path += node.label
            if node.owner is not None:
                yield path, node.owner
            todo.extend((n, path) for n in node.edges.values())

    def _end(self) -> list[tuple[str, bytes]]:
        for _, out, _ in self.spilled.values():
            out.close()
        return [(path, common) for path, _, common in self.spilled.values()]

    def owners(self) -> Iterator[tuple[bytes, list]]:
        """Every key with its owner.

        A file is resolved by a trie of its own below what its keys begin with.  That trie either
        branches at its root or ends a key there, so files get smaller with each round.
        """
        yield from self._walk(self.root, self.head)
        todo = self._end()
        while todo:
            path, common = todo.pop()
            inner = OwnerTrie(self.budget, self.folder, common)
            with open(path, "rb") as f:
                while True:
                    try:
                        inner.insert(*pickle.load(f))
                    except EOFError:
                        break
            os.unlink(path)
            yield from self._walk(inner.root, inner.head)
            todo.extend(inner._end())


def _shared(key: bytes, at: int, label: bytes) -> int:
    """Length of the common prefix of ``key[at:]`` and ``label`` by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key[at + low : at + mid] == label[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


_DIGEST = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.binary())])
_TEXTS = pa.schema(
    [
        ("key", pa.binary()),
        ("n_bytes", pa.int64()),
        ("best", pa.int64()),
        ("ident", pa.int64()),
        ("n", pa.int64()),
    ]
)
_OWNERS = pa.schema(
    [
        ("text_sha256", pa.binary()),
        ("best", pa.int64()),
        ("keep_id", pa.int64()),
        ("group_size", pa.int64()),
    ]
)


def _digests(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = ((i, hashlib.sha256(normalise(t)).digest()) for i, t in rows(parts))
    yield from batches(got, _DIGEST)


def _local_owners(budget: int):
    """Map side: tries of ``budget`` bytes, emitted and begun anew when full (a later pass sees
    what is repeated across them), so nothing is spilled here."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            trie = OwnerTrie(budget=1 << 62)
            for ident, text in rows(parts):
                trie.insert(normalise(text), -len(text or ""), rank(ident), 1)
                if trie.held > budget:
                    yield from _flat(trie)
                    trie = OwnerTrie(budget=1 << 62)
            yield from _flat(trie)

        yield from batches(records(), _TEXTS)

    return run


def _flat(trie: OwnerTrie) -> Iterator[tuple]:
    for key, (order, (null, ident), count) in trie.owners():
        yield key, len(key), order, None if null else ident, count


def _global_owners(budget: int):
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="owners-") as folder:
            trie = OwnerTrie(budget, folder)
            for key, _, order, ident, count in rows(parts):
                trie.insert(key, order, rank(ident), count)
            got = (
                (hashlib.sha256(key).digest(), own[0], None if own[1][0] else own[1][1], own[2])
                for key, own in trie.owners()
            )
            yield from batches(got, _OWNERS)

    return run


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
    map_budget: int = 24 << 20,
    trie_budget: int = 64 << 20,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256`` (hex).

    ``partitions`` is the number of (length, content hash) partitions (default: the session's
    shuffle partitions).  ``map_budget`` and ``trie_budget`` bound the bytes of a trie.  The id
    must be a whole number.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = arrow_map(
        own, _local_owners(map_budget), "key binary, n_bytes long, best long, ident long, n long"
    )
    owners = arrow_map(
        texts.repartition(n, F.col("n_bytes"), F.xxhash64("key")),
        _global_owners(trie_budget),
        "text_sha256 binary, best long, keep_id long, group_size long",
    ).drop("best")
    digests = arrow_map(own, _digests, "doc_id long, text_sha256 binary")
    # A group of copies may be a share of all rows: its one owner goes to where its rows lie.
    owners = materialise(owners.withColumn("n", F.col("group_size")))
    total = owners.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    return join_counted(digests, owners, "text_sha256", total).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are named by id: a row without one cannot be named and stays, and of rows that repeat an id
    with an equal text one stays.  Only the ids that go are joined to the rows (:func:`without`).
    """
    found = materialise(exact_dedup(docs, id_col, text_col, **options))
    gone = found.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(id_col)).distinct()
    out = without(docs, gone, id_col)
    again = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    again = again.select(F.col("doc_id").alias(id_col))
    if again.isEmpty():
        return out
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]", "")
    twice = out.join(again, id_col, "left_semi").withColumn("_norm", norm).dropDuplicates([id_col, "_norm"])
    return out.join(again, id_col, "left_anti").unionByName(twice.select(*docs.columns))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
    FROM documents),
g AS (
    SELECT norm, count(*) AS group_size,
           first(doc_id ORDER BY length(text) DESC, doc_id ASC NULLS LAST) AS keep_id
    FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size,
       d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
       sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
