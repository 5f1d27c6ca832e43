"""Linking the members of inverted lists where the lists are.

``lists`` has a row (sig, cls, n, size) for each member of each list; related classes share a list. A
list's members are dealt in blocks of BLOCK, with their sketches. A block returns no pairs but a spanning
forest of what its sketches leave possible, so a list costs rows in proportion to its members. The
forest's edges are decided exactly (the set of a class travels once for some edges, not for each list).
A list all of whose edges hold is finished: whatever its sketches allow is connected. Only lists with an
edge that does not hold, and those of several blocks, are looked at again: of these, members that may
still be related to a member of another component are met once more with their whole sets, and decided
there; that again returns a spanning forest.

The first look at a list of several blocks adds its pivot (the member of least rank) to each, so that a
large group is one component before the blocks of the list meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuemesh.llm.batches import ODD, mix, release
from valuemesh.llm.store import Scratch, components

BLOCK = 2048
#: Edges of one class that are decided in one task.
STAR = 256


def tasks(df: DataFrame) -> int:
    """Tasks of an exchange before comparisons: they are dear for their bytes, so partitions are not to be
    coalesced by size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class Forest:
    """Components of a block's members, merged edge by edge."""

    def __init__(self, roots: np.ndarray):
        _, self.of = np.unique(roots, return_inverse=True)
        self.left = int(self.of.max(initial=-1)) + 1

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        return others[self.of[others] != self.of[i]]

    def join(self, i: int, j: int) -> bool:
        a, b = self.of[i], self.of[j]
        if a == b:
            return False
        self.of[self.of == b] = a
        self.left -= 1
        return True

    def join_all(self, i: int, others: np.ndarray) -> np.ndarray:
        """Joins i with each of the others; those that were of a component of their own each."""
        _, first = np.unique(self.of[others], return_index=True)
        new = others[first]
        self.of[np.isin(self.of, self.of[new])] = self.of[i]
        self.left -= len(new)
        return new


def _placed(lists: DataFrame) -> DataFrame:
    """``lists`` with ``blocks`` of the list and ``mine``, the member's own."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    return lists.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("blocks")).cast("int"))


def _first_look(lists: DataFrame, sketches: DataFrame, near: Callable) -> DataFrame:
    """(sig, a, b): a spanning forest of the possible links of every block with its list's pivot."""
    placed = _placed(lists)
    rank = F.struct(F.xxhash64("cls").alias("r"), "cls", "n", "blocks", "mine")
    pivot = placed.where("blocks > 1").groupBy("sig").agg(F.min(rank).alias("p")).select("sig", "p.*")
    guests = pivot.select("sig", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), "cls", "n", "mine").where("x <> mine").drop("mine")
    every = placed.select("sig", F.col("mine").alias("x"), "cls", "n").union(guests).join(sketches, "cls")

    def found(sig: int, held: list[tuple]) -> pa.RecordBatch | None:
        cls, n = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
        order = np.argsort(mix(cls.view(np.uint64) * ODD), kind="stable")
        cls, n, sketch = cls[order], n[order], [held[i][2] for i in order]
        at, to = possible_forest(n, sketch, near, Forest(np.arange(len(cls))))
        return _edges(sig, cls, at, to) if len(at) else None

    dealt = every.select("sig", "x", "cls", "n", "sketch").repartition(tasks(lists), "sig", "x").sortWithinPartitions("sig", "x")
    return dealt.mapInArrow(by_block(found, 2), "sig bigint, a bigint, b bigint")


def possible_forest(n: np.ndarray, sketch: list[bytes], near: Callable, forest: Forest) -> tuple[list[int], list[int]]:
    at, to = [], []
    test = near(n, sketch)
    for i in range(len(n) - 1):
        if forest.left == 1:
            break
        others = forest.apart(i, np.arange(i + 1, len(n)))
        others = others[test(i, others)] if len(others) else others
        if len(others):
            new = forest.join_all(i, others)
            at += [i] * len(new)
            to += new.tolist()
    return at, to


def _edges(sig: int, cls: np.ndarray, at: list[int], to: list[int]) -> pa.RecordBatch:
    one, two = cls[at], cls[to]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(one), sig)), pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["sig", "a", "b"])


def by_block(found: Callable, keys: int) -> Callable:
    """Runs ``found(first key, rows)`` for every block of two rows or more; rows are sorted by the keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
            for row in zip(*columns):
                if row[:keys] != now:
                    if len(held) > 1 and (out := found(now[0], held)) is not None:
                        yield out
                    now, held = row[:keys], []
                held.append(row[keys:])
        if len(held) > 1 and (out := found(now[0], held)) is not None:
            yield out
        held = columns = batch = None
        release()

    return run


def decided(pairs: DataFrame, sets: DataFrame, prepare: Callable, related: Callable) -> DataFrame:
    """(a, b, linked) by ``related(prepare(set of a), prepare(set of b))``; ``sets`` is (cls, data).

    The set of a travels once for each STAR of its pairs."""
    stars = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("stars"))
    salted = pairs.join(stars, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("stars")).cast("int")).select("a", "salt", "b")
    pivots = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("cls", "a"), "a").select("a", "salt", F.lit(None).cast("bigint").alias("b"), "data")
    members = salted.join(sets.withColumnRenamed("cls", "b"), "b").select("a", "salt", "b", "data")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, have = None, None
        for batch in batches:
            a, b, linked = [], [], []
            for x, y, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if y is None:
                    pivot, have = x, prepare(data)
                    continue
                assert x == pivot
                a.append(x)
                b.append(y)
                linked.append(related(have, prepare(data)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    dealt = pivots.union(members).repartition(tasks(pairs), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a bigint, b bigint, linked boolean")


def _still_open(lists: DataFrame, sketches: DataFrame, roots: DataFrame, near: Callable) -> DataFrame:
    """(sig, cls, n, root): the members of a block that may be related to one of another component there.
    Blocks that leave the same members are one, named by these."""
    rooted = _placed(lists).join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = rooted.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
    each = rooted.join(mixed, "sig").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = each.select("sig", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "cls", "n", "root").join(sketches, "cls")

    def found(_: int, held: list[tuple]) -> pa.RecordBatch | None:
        cls, n, root = (np.array([h[k] for h in held], np.int64) for k in (0, 1, 2))
        test, left = near(n, [h[3] for h in held]), np.zeros(len(held), bool)
        for i in range(len(held) - 1):
            others = np.arange(i + 1, len(held))
            others = others[root[others] != root[i]]
            others = others[test(i, others)] if len(others) else others
            left[i] |= len(others) > 0
            left[others] = True
        if not left.any():
            return None
        cls, n, root = cls[left], n[left], root[left]
        sig = np.full(len(cls), mix(mix(cls.view(np.uint64)).sum(keepdims=True)).view(np.int64)[0])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (sig, cls, n, root)], ["sig", "cls", "n", "root"])

    dealt = every.select("sig", "x", "y", "cls", "n", "root", "sketch").repartition(tasks(lists), "sig", "x", "y").sortWithinPartitions("sig", "x", "y")
    return dealt.mapInArrow(by_block(found, 3), "sig bigint, cls bigint, n bigint, root bigint").distinct()


def _last_look(still: DataFrame, sketches: DataFrame, sets: DataFrame, near: Callable, prepare: Callable, related: Callable) -> DataFrame:
    """(sig, a, b): the links of a block that join its components, decided on whole sets."""

    def found(sig: int, held: list[tuple]) -> pa.RecordBatch | None:
        cls, n, root = (np.array([h[k] for h in held], np.int64) for k in (0, 1, 2))
        test, data, forest, at, to = near(n, [h[3] for h in held]), {}, Forest(root), [], []
        get = lambda k: data[k] if k in data else data.setdefault(k, prepare(held[k][4]))
        for i in range(len(held) - 1):
            others = forest.apart(i, np.arange(i + 1, len(held)))
            for j in others[test(i, others)] if len(others) else ():
                if forest.of[i] != forest.of[j] and related(get(i), get(int(j))):
                    forest.join(i, int(j))
                    at.append(i)
                    to.append(int(j))
        return _edges(sig, cls, at, to) if at else None

    every = still.join(sketches, "cls").join(sets, "cls").select("sig", "cls", "n", "root", "sketch", "data")
    return every.repartition(tasks(every), "sig").sortWithinPartitions("sig").mapInArrow(by_block(found, 1), "sig bigint, a bigint, b bigint")


def link(scratch: Scratch, lists: DataFrame, sets: DataFrame, near: Callable, prepare: Callable, related: Callable) -> DataFrame:
    """(node, root) of every class that is linked.

    ``sets`` is (cls, sketch, data). ``near(n, sketches)`` gives a test(i, others) of which others may be
    related to i; it may only rule out what is sure not to be."""
    sketches, data = sets.select("cls", "sketch"), sets.select("cls", "data")
    edges = scratch.write(_first_look(lists, sketches, near))
    tried = scratch.write(decided(edges.select("a", "b").distinct(), data, prepare, related))
    links = tried.where("linked").select("a", "b")
    roots = scratch.write(components(scratch, links))
    failed = edges.join(tried.where("not linked"), ["a", "b"]).select("sig")
    again = lists.join(failed.union(lists.where(F.col("size") > BLOCK).select("sig")).distinct(), "sig", "left_semi")
    still = scratch.write(_still_open(again, sketches, roots, near))
    scratch.drop(edges)
    if still.isEmpty():
        scratch.drop(still, tried)
        return roots
    more = scratch.write(_last_look(still, sketches, data, near, prepare, related).select("a", "b").distinct())
    scratch.drop(still, roots)
    out = scratch.write(components(scratch, links.union(more)))
    scratch.drop(tried, more)
    return out
