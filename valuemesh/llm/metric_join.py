"""Exact range join of vectors by cosine: pivots, triangle-inequality replication, cells apart.

On unit vectors, cosine >= c is Euclidean distance <= sqrt(2 - 2c). Every distinct vector has the cell
of its nearest pivot. A vector within that distance of one in cell q lies no further than it from the
plane midway between its own pivot and q, so it is sent to the cells for which that can hold, and
to no others. Of two cells only one gets the other's vectors, so every pair meets once. Cells
with many vectors are cut into blocks of BLOCK, and a block's task holds its own vectors and one batch
of visitors.

A block returns no pairs: per vector its number of links there, and edges to one linked vector, so
dense groups cost rows in proportion to their size. Products are screened in single precision with a
margin, and links decided in double precision.

Equal vectors are one class (their number counts as links among them). Pivots: a hash sample of at
most PIVOTS vectors. How much is replicated depends on the data: vectors without clusters in many
dimensions go to most cells, and the join is then a blocked comparison of all pairs.

Null and zero vectors, and those with null or non-finite components, have no links and are their own
component. Vectors of different lengths never link. Repeated rows count as vectors each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuemesh.llm.store import Scratch, components

COSINE = 0.9
BLOCK = 2048
PIVOTS = 2048
MARGIN = 1e-4


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)  # first by the largest component: squares may overflow
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _homes(unit: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pivot, squared distances to all)."""
    far = np.maximum(0.0, 2 - 2 * unit @ pivots.T)
    return far.argmin(axis=1), far


def _cells(vectors: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home, _ = _homes(_unit(_matrix(batch.column(2), width)), pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32())], ["id", "size", "v", "home"])

    return vectors.mapInArrow(run, "id bigint, size bigint, v array<double>, home int")


def _sent(cells: DataFrame, pivots: np.ndarray, blocks: np.ndarray, width: int, reach: float) -> DataFrame:
    """(block, visitor, id, size, v): a vector's own block, and those that it visits."""
    first = np.concatenate([[0], np.cumsum(blocks)])
    gap = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0.0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                ids, home = batch.column(0).to_numpy(), batch.column(3).to_numpy()
                _, far = _homes(_unit(_matrix(batch.column(2), width)), pivots)
                own = far[np.arange(len(home)), home][:, None]
                q = np.arange(len(pivots))
                near = far - own <= 2 * reach * gap[home] + 1e-6
                turn = np.where((home[:, None] + q) % 2 == 1, home[:, None] < q, home[:, None] > q)
                near &= turn
                part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % blocks[home].astype(np.uint64)
                block, visitor, row = [first[home] + part.astype(np.int64)], [np.zeros(len(ids), bool)], [np.arange(len(ids))]
                for i in range(len(ids)):
                    inner = np.arange(int(part[i]) + 1, blocks[home[i]]) + first[home[i]]
                    outer = [np.arange(first[c], first[c + 1]) for c in np.flatnonzero(near[i])]
                    to = np.concatenate([inner, *outer]).astype(np.int64)
                    block.append(to)
                    visitor.append(np.ones(len(to), bool))
                    row.append(np.full(len(to), i))
                row = pa.array(np.concatenate(row))
                for at in range(0, len(row), 8192):
                    take = row.slice(at, 8192)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(block)[at : at + 8192], pa.int32()), pa.array(np.concatenate(visitor)[at : at + 8192]), *(batch.column(c).take(take) for c in (0, 1, 2))],
                        ["block", "visitor", "id", "size", "v"],
                    )

    return cells.mapInArrow(run, "block int, visitor boolean, id bigint, size bigint, v array<double>")


class _Block:
    """One block's own vectors; visitors come batch by batch."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, unit: np.ndarray, cosine: float):
        self.ids, self.size, self.unit, self.cosine = ids, size, unit, cosine
        self.single = unit.astype(np.float32)
        self.links, self.root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for lo in range(0, len(ids), 1024):
            i, j = self._near(unit[lo : lo + 1024])
            i = i + lo
            i, j = i[i != j], j[i != j]
            np.add.at(self.links, i, size[j])
            self._join(i, j)

    def _near(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.nonzero(unit.astype(np.float32) @ self.single.T >= self.cosine - MARGIN)
        keep = np.zeros(len(i), bool)
        for lo in range(0, len(i), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            keep[part] = np.einsum("ij,ij->i", unit[i[part]], self.unit[j[part]]) >= self.cosine
        return i[keep], j[keep]

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            if (a == b).all():
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def visit(self, ids: np.ndarray, size: np.ndarray, unit: np.ndarray) -> pa.RecordBatch:
        i, j = self._near(unit)
        np.add.at(self.links, j, size[i])
        links = np.bincount(i, weights=self.size[j], minlength=len(ids)).astype(np.int64)
        some, first = np.unique(i, return_index=True)
        lead = np.zeros(len(ids), np.int64)
        lead[some] = j[first]
        self._join(lead[i], j)
        return _found(ids[some], links[some], self.ids[lead[some]])

    def end(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.links)
        return _found(self.ids[some], self.links[some], self.ids[self.root[some]])


def _found(ids, links, other) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(other, pa.int64())], ["id", "links", "other"])


def _joined(sent: DataFrame, width: int, cosine: float) -> DataFrame:
    """(id, links, other): links found in a block, and one vector of the block's that it is linked with."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own, block = None, [], None

        def opened():
            ids, size, unit = (np.concatenate(x) for x in zip(*own))
            return _Block(ids, size, unit, cosine)

        for batch in batches:
            if not batch.num_rows:
                continue
            which, visitor = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            ids, size, unit = batch.column(2).to_numpy(), batch.column(3).to_numpy(), _unit(_matrix(batch.column(4), width))
            cut = np.flatnonzero((which[1:] != which[:-1]) | (visitor[1:] != visitor[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(which)]):
                if which[lo] != number:
                    if own and block is None:
                        block = opened()
                    if block is not None:
                        yield block.end()
                    number, own, block = which[lo], [], None
                if not visitor[lo]:
                    own.append((ids[lo:hi], size[lo:hi], unit[lo:hi]))
                elif own:
                    block = block or opened()
                    for at in range(lo, hi, 1024):
                        s = slice(at, min(hi, at + 1024))
                        yield block.visit(ids[s], size[s], unit[s])
        if own and block is None:
            block = opened()
        if block is not None:
            yield block.end()

    dealt = sent.repartition(F.col("block")).sortWithinPartitions("block", "visitor")
    return dealt.mapInArrow(run, "id bigint, links bigint, other bigint")


def link_vectors(table: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id) for every row of ``table``."""
    scratch = Scratch(table.sparkSession)
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), v).alias("v"))
    # no vector in the rows' own table: a class is found again by its vector
    classes = scratch.write(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size")).select("id", "size", "v"))
    found, reach = None, float(np.sqrt(2 - 2 * cosine)) + 1e-9
    for width, number in classes.groupBy(F.size("v").alias("width")).count().collect():
        mine = classes.where(F.size("v") == width)
        most = min(PIVOTS, max(1, -(-number // BLOCK)))
        pivots = _unit(np.array([r.v for r in mine.orderBy(F.xxhash64("id"), "id").limit(most).select("v").collect()]))
        cells = scratch.write(_cells(mine, pivots, width))
        blocks = np.ones(len(pivots), np.int64)
        for r in cells.groupBy("home").count().collect():  # at most PIVOTS rows
            blocks[r["home"]] = -(-r["count"] // BLOCK)
        part = _joined(_sent(cells, pivots, blocks, width, reach), width, cosine)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = scratch.write(found)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = scratch.write(components(scratch, found.select(F.col("id").alias("a"), F.col("other").alias("b"))))
    known = classes.join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("v", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("root", "id").alias("root"))
    out = rows.join(known, "v", "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))


def op8_embedding_join(table: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    got = link_vectors(table)
    return got.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
