"""Embedding near-de-duplication: exact threshold pairs by a dual traversal of cover trees.

Unit vectors with cosine at least ``c`` lie within ``t = sqrt(2 - 2 c)`` of each other.  Equal
vectors of a label form a class first.  The classes of a label are dealt to *cells*:

* a label of at most ``cell`` classes is one cell;
* a larger one is split round by round, as the upper levels of its tree: some classes become
  centres, every class goes home to its nearest centre, and is lent to each other centre that is
  at most ``2 t`` farther (the triangle inequality: all partners of a class then meet it in its
  home cell).  Centres reach the rows by a co-partitioned merge, not by a broadcast;
* a round is taken only where it pays: the lending is measured on some rows of each large cell first, and
  where a class would go to ``L`` of ``fan`` sub-cells with ``L * L >= fan``, splitting would send more rows
  than it saves.  Such cells (unrelated vectors) are cut into chunks, and each pair of chunks is a task, so
  that no class is ever sent more often than its label has chunks.

In a cell a cover tree is built (nested centres, covering radii that halve from level to level,
centres of a level farther apart than its radius) and walked in pairs of nodes: a pair farther
apart than both radii and ``t`` is dropped with all below it, a pair wholly within ``t`` is linked
without a look at its points, leaves that remain are compared by cosine in double precision.
A cell sends on a link count and one forest edge for each class, never its pairs.

How well the tree prunes follows the intrinsic dimension of the data: results are exact anyway,
but unrelated vectors that are all about equally far apart end as siblings under one root.

Defined results.  Vectors that are null, zero, or hold null or non-finite components, and rows
with a null label or a null id, link with nothing: ``n_links`` 0 and their own id as component.
Vectors of different lengths are not compared.  Rows that repeat an id are vectors of their own
in the counts and one node in the components.  Only id, vector and label are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, components, join_counted, materialise

_OUT = pa.schema([("digest", pa.binary()), ("rep", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
_LEAF = 32
_SLACK = 1e-7  # distances are trusted to this; nearer calls are settled by the cosine itself
_BLOCK = 512
_CENTRES = 64


class CoverTree:
    """Cover tree over rows of unit vectors; ``order`` makes every node's points contiguous.

    Node ``k`` has centre ``centre[k]``, points ``order[start[k]:end[k]]``, covering radius
    ``radius[k]`` and children ``children[k]`` (none for a leaf).
    """

    def __init__(self, points: np.ndarray, index: np.ndarray) -> None:
        self.points = points
        self.order = index.copy()
        self.centre: list[int] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray] = []
        if len(index):
            self._grow()

    def _node(self, start: int, end: int, centre: int, radius: float) -> int:
        self.centre.append(centre)
        self.start.append(start)
        self.end.append(end)
        self.radius.append(radius)
        self.children.append(np.empty(0, int))
        return len(self.centre) - 1

    def _grow(self) -> None:
        all_ = self.order
        todo = [self._node(0, len(all_), int(all_[0]), float(_far(self.points, all_[0], all_).max()))]
        while todo:
            k = todo.pop()
            start, end, radius = self.start[k], self.end[k], self.radius[k]
            if end - start <= _LEAF or radius <= 1e-3:
                continue
            reach = 2.0 ** (np.ceil(np.log2(radius)) - 1)
            rest, at, made = self.order[start:end].copy(), start, []
            first = np.flatnonzero(rest == self.centre[k])[0]  # nesting: the centre stays one
            rest[[0, first]] = rest[[first, 0]]
            while len(rest):
                # The first rows of the rest, one after the other, unless one before has taken them.
                block = rest[:_CENTRES]
                gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.points[block] @ self.points[rest].T)))
                free = np.ones(len(rest), bool)
                for c in range(len(block)):
                    if not free[c]:
                        continue
                    near = np.flatnonzero((gap[c] <= reach) & free)
                    free[near] = False
                    self.order[at : at + len(near)] = rest[near]
                    made.append(self._node(at, at + len(near), int(block[c]), float(gap[c, near].max())))
                    at += len(near)
                rest = rest[free]
            self.children[k] = np.array(made)
            todo.extend(made)
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.start, self.end = np.array(self.start), np.array(self.end)

    def below(self, k: int) -> np.ndarray:
        return self.order[self.start[k] : self.end[k]]


def _far(points: np.ndarray, centre: int, index: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (points[index] @ points[centre])))


class Links:
    """Counts and forest of the links found in a cell."""

    def __init__(self, raw: np.ndarray, weight: np.ndarray, least: float) -> None:
        self.raw, self.weight, self.least = raw, weight, least
        self.norm = np.sqrt((raw * raw).sum(axis=1))
        self.count = np.zeros(len(raw), np.int64)
        self.root = np.arange(len(raw))
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.waiting = 0

    def test(self, a: np.ndarray, b: np.ndarray) -> None:
        """Compare points pair by pair, later and in bulk."""
        self.left.append(a)
        self.right.append(b)
        self.waiting += len(a)
        if self.waiting > 1 << 16:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        a, b = np.concatenate(self.left), np.concatenate(self.right)
        self.left, self.right, self.waiting = [], [], 0
        for at in range(0, len(a), 1 << 15):
            i, j = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
            cosine = np.einsum("ij,ij->i", self.raw[i], self.raw[j]) / (self.norm[i] * self.norm[j])
            ok = cosine >= self.least
            i, j = i[ok], j[ok]
            np.add.at(self.count, i, self.weight[j])
            np.add.at(self.count, j, self.weight[i])
            self._union(i, j)

    def whole(self, a: np.ndarray, b: np.ndarray | None = None) -> None:
        """Link every point of ``a`` with every one of ``b``, or of ``a`` with one another."""
        if b is None:
            self.count[a] += self.weight[a].sum() - self.weight[a]
            self._union(a[1:], np.full(len(a) - 1, a[0]))
            return
        self.count[a] += self.weight[b].sum()
        self.count[b] += self.weight[a].sum()
        both = np.concatenate([a, b])
        self._union(both[1:], np.full(len(both) - 1, both[0]))

    def _union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.find(a), self.find(b)
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            self.root[np.maximum(x, y)] = np.minimum(x, y)

    def find(self, a: np.ndarray) -> np.ndarray:
        up = self.root[a]
        while True:
            higher = self.root[up]
            if np.array_equal(higher, up):
                self.root[a] = up
                return up
            up = higher


def dual(a: CoverTree, b: CoverTree, t: float, links: Links) -> None:
    """All pairs within ``t`` between two trees, or within one tree if both are the same."""
    if not len(a.order) or not len(b.order):
        return
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        own = a is b and i == j
        if own and 2 * a.radius[i] <= t - _SLACK:
            links.whole(a.below(i))
            continue
        down_a, down_b = a.children[i], b.children[j]
        if not len(down_a) and not len(down_b):
            p, q = a.below(i), b.below(j)
            if own:
                x, y = np.triu_indices(len(p), 1)
                links.test(p[x], p[y])
            else:
                for at in range(0, len(p), _BLOCK):
                    part = p[at : at + _BLOCK]
                    links.test(np.repeat(part, len(q)), np.tile(q, len(part)))
            continue
        if own:
            down_b = down_a
        elif not len(down_a):
            down_a = np.array([i])
        elif not len(down_b):
            down_b = np.array([j])
        far_b = b.points[b.centre[down_b]]
        for at in range(0, len(down_a), _BLOCK):
            rows_ = down_a[at : at + _BLOCK]
            gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a.points[a.centre[rows_]] @ far_b.T)))
            reach = a.radius[rows_][:, None] + b.radius[down_b][None, :]
            meet = gap <= reach + t + _SLACK
            if own:
                meet &= np.arange(len(down_b))[None, :] >= (at + np.arange(len(rows_)))[:, None]
            x, y = np.nonzero(meet)
            p, q = rows_[x], down_b[y]
            single = (a.end[p] - a.start[p] == 1) & (b.end[q] - b.start[q] == 1)
            apart = (p != q) | (not own)
            alone = single & apart
            links.test(a.order[a.start[p[alone]]], b.order[b.start[q[alone]]])
            inside = (gap[x, y] + reach[x, y] <= t - _SLACK) & apart & ~single
            for u, v in zip(p[inside].tolist(), q[inside].tolist(), strict=True):
                links.whole(a.below(u), b.below(v))
            more = ~single & ~inside
            todo.extend(zip(p[more].tolist(), q[more].tolist(), strict=True))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cell_links(vectors, reps, weight, home, side, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots (as indices) and link counts of a cell's rows; ``side`` < 0: one chunk alone."""
    t = float(np.sqrt(2.0 - 2.0 * least))
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    points = unit(vectors)
    links = Links(scaled, weight, least)
    every = np.arange(len(reps))
    if (side < 0).all():
        tree = CoverTree(points, every)
        dual(tree, tree, t, links)
    else:
        low = side == side.min()
        dual(CoverTree(points, every[low]), CoverTree(points, every[~low]), t, links)
    links.settle()
    return links.find(every), np.where(home, links.count, 0)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def _grouped(parts: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys."""
    held: list[pa.RecordBatch] = []
    now = None
    for part in parts:
        if not part.num_rows:
            continue
        marks = list(zip(*(part.column(k).to_pylist() for k in keys), strict=True))
        at = 0
        for i in range(1, len(marks) + 1):
            if i == len(marks) or marks[i] != marks[at]:
                if now is not None and marks[at] != now and held:
                    yield pa.Table.from_batches(held)
                    held = []
                now = marks[at]
                held.append(part.slice(at, i - at))
                at = i
    if held:
        yield pa.Table.from_batches(held)


_CELL = ["label", "cell", "part"]


def _solve(least: float):
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(parts, _CELL):
            table = table.combine_chunks()
            reps = table["rep"].to_numpy()
            root, count = cell_links(
                _matrix(table["vec"].chunk(0)),
                reps,
                table["n"].to_numpy(),
                table["home"].to_numpy(zero_copy_only=False),
                table["side"].to_numpy(),
                least,
            )
            first = reps.copy()  # edges point at the smallest class, so that no hub is a source
            np.minimum.at(first, root, reps)
            yield pa.RecordBatch.from_arrays(
                [table["digest"].chunk(0), pa.array(reps), pa.array(first[root]), pa.array(count)], schema=_OUT
            )

    return run


def _route(t: float, fan: int):
    """Rows of a cell after its centres (``centre`` true): home and lent sub-cells."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centres = None, np.empty((0, 0))
        for table in _grouped(parts, ["label", "cell", "salt", "row"]):
            table = table.combine_chunks()
            key = (table["label"][0].as_py(), table["cell"][0].as_py(), table["salt"][0].as_py())
            points = unit(_matrix(table["vec"].chunk(0)))
            if not table["row"][0].as_py():
                order = np.argsort(table["rep"].to_numpy())[:fan]
                now, centres = key, points[order]
                continue
            if now != key:
                raise RuntimeError("a cell came without its centres")
            for at in range(0, len(points), 4096):
                far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (points[at : at + 4096] @ centres.T)))
                nearest = far.argmin(axis=1)
                near = far[np.arange(len(far)), nearest]
                i, c = np.nonzero(far <= near[:, None] + 2 * t + _SLACK)
                part = table.slice(at, 4096).combine_chunks().take(pa.array(i)).to_batches()[0]
                home = np.asarray(part.column("home").to_pylist(), bool) & (nearest[i] == c)
                cell = part.column("cell").to_numpy() * fan + c + 1
                got = {f: part.column(f) for f in ("label", "rep", "n", "vec", "digest")}
                got |= {"cell": pa.array(cell), "home": pa.array(home)}
                yield pa.RecordBatch.from_pydict({f: got[f] for f in ("label", "cell", "rep", "n", "vec", "home", "digest")})

    return run


_ROWS = "label string, cell long, rep long, n long, vec array<double>, home boolean, digest binary"


def _split(rows: DataFrame, big: DataFrame, t: float, cell: int, fan: int, some: int = 0) -> DataFrame:
    """Route the rows of cells ``big(label, cell, size)``, or about ``some`` rows of each, to sub-cells."""
    inside = rows.join(big, ["label", "cell"])
    share = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "digest"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # Twice the centres wanted on average, at least some in any case; the first ``fan`` serve.
    centres = inside.where(share(7) * F.col("size") < 2.0 * fan)
    salts = F.ceil(F.col("size") / cell)
    every = centres.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).withColumn("row", F.lit(False))
    if some:
        inside = inside.where(share(29) * F.col("size") < float(some))
    own = inside.withColumn("salt", F.pmod(F.xxhash64(F.lit(9), "digest"), salts)).withColumn("row", F.lit(True))
    both = own.unionByName(every).drop("size")
    dealt = both.repartition("label", "cell", "salt").sortWithinPartitions("label", "cell", "salt", "row")
    return arrow_map(dealt, _route(t, fan), _ROWS)


def _worth(rows: DataFrame, big: DataFrame, t: float, fan: int, some: int = 512) -> DataFrame:
    """The cells of ``big`` whose rows would go to less than the root of ``fan`` sub-cells each, as told by
    about ``some`` rows of each."""
    routed = _split(rows, big, t, 1 << 60, fan, some)
    lent = routed.groupBy("label", F.floor((F.col("cell") - 1) / fan).alias("cell")).agg(
        (F.count(F.lit(1)) / F.countDistinct("digest")).alias("lent")
    )
    return big.join(lent.where(F.col("lent") * F.col("lent") < fan), ["label", "cell"], "left_semi")


def _prepare(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``digest``: 16 bytes of label, length and components, or null for a row that links with nothing."""
    for part in parts:
        ids, vectors, labels = part.columns
        flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64) + 0.0  # -0.0 is 0.0
        digests, keys, at = [], [], 0
        for ident, size, label in zip(ids.to_pylist(), pc.list_value_length(vectors).to_pylist(), labels.to_pylist(), strict=True):
            x = flat[at : at + (size or 0)]
            at += size or 0
            if ident is None or label is None or not np.isfinite(x).all() or not x.any():
                digests.append(None)
                keys.append(None)
                continue
            keys.append(f"{size}:{label}")
            digests.append(blake2b(keys[-1].encode() + b"\0" + x.tobytes(), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [ids, vectors, pa.array(keys, pa.string()), pa.array(digests, pa.binary())], names=["vec_id", "vec", "label", "digest"]
        )


def near_dedup(
    vectors: DataFrame,
    least: float = 0.98,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    cell: int = 8192,
    fan: int = 64,
    rounds: int = 4,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per input row.

    ``cell`` bounds the classes of one task; larger cells are split into at most ``fan`` sub-cells
    in each of ``rounds`` rounds, and what is larger still goes in pairs of chunks.
    """
    t = float(np.sqrt(2.0 - 2.0 * least))
    own = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("string").alias("label")
    )
    # Lengths apart: they are part of the label from here on.
    every = materialise(arrow_map(own, _prepare, "vec_id long, vec array<double>, label string, digest binary"))
    valid = every.where("digest IS NOT NULL")
    classes = materialise(
        valid.groupBy("digest").agg(
            F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")
        )
    )
    rows = classes.select("label", F.lit(0).cast("long").alias("cell"), "rep", "n", "vec", F.lit(True).alias("home"), "digest")
    done: list[DataFrame] = []
    for _ in range(rounds):
        big = materialise(rows.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > cell))
        if big.isEmpty():
            break
        big = materialise(_worth(rows, big, t, fan))
        if big.isEmpty():
            break
        done.append(rows.join(big, ["label", "cell"], "left_anti"))
        rows = materialise(_split(rows, big, t, cell, fan))
    done.append(rows)
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    none = F.lit(-1).cast("long")
    big = rows.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 2 * cell)
    big = materialise(big.select("label", "cell", F.ceil(F.col("size") / cell).alias("k")))
    if big.isEmpty():
        dealt = rows.withColumn("part", none).withColumn("side", none)
    else:
        joined = rows.join(big, ["label", "cell"], "left").withColumn("side", F.pmod(F.xxhash64(F.lit(11), "digest"), F.col("k")))
        cold = joined.where("k IS NULL").withColumn("part", none).withColumn("side", none)
        hot = (
            joined.where("k IS NOT NULL")
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
            .withColumn("part", F.least("side", "other") * F.col("k") + F.greatest("side", "other"))
            .withColumn("side", F.when(F.col("side") == F.col("other"), none).otherwise(F.col("side")))
            .drop("other")
        )
        dealt = cold.unionByName(hot)
    dealt = dealt.select(*_CELL, "side", "rep", "n", "vec", "home", "digest").repartition(*_CELL).sortWithinPartitions(*_CELL)
    solved = materialise(arrow_map(dealt, _solve(least), "digest binary, rep long, root long, links long"))
    found = components(solved.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = solved.groupBy("digest").agg(F.sum("links").alias("links"))
    named = (
        classes.select("digest", "rep", "n")
        .join(counts, "digest", "left")
        .join(found, F.col("rep") == F.col("node"), "left")
        .select(
            "digest",
            "n",
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    linked = join_counted(valid.select("vec_id", "digest"), named, "digest", total)
    alone = every.where("digest IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    out = linked.select("vec_id", "n_links", "component_id").unionAll(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (
    SELECT vec_id AS x, vec_id AS y FROM embeddings
    UNION
    SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM p GROUP BY x)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""
