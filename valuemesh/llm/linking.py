"""Components of a similarity relation from inverted lists, without all pairs of a list.

``lists`` has a row (sig, cls, n, flag, ...) for each member of each list; related classes share a
list. Round by round, members are compared with their list's pivot (the member of least rank, another
rank each round, the same over all lists so that the lists of one group share few pivots). Then only
lists remain that span several components, and of those only pairs of different components are
compared, first by sketches. A group of near copies costs about its size; hot lists are split by adaptive execution, hot pivots salted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuemesh.llm.store import Scratch, components

PIVOT_ROUNDS = 2
SALTS = 32
BLOCK = 2048
DELETED = 2


def with_list(lists: DataFrame, few: DataFrame) -> DataFrame:
    """``lists`` with the columns of ``few`` (one row a sig); adaptive execution splits a hot list."""
    return lists.join(few, "sig")


def _stars(lists: DataFrame, turn: int, possible: Callable[..., Column]) -> DataFrame:
    """(a, b): every member of a list with the list's pivot, the plain member of least rank."""
    rank = F.struct(F.xxhash64("cls", F.lit(turn)).alias("r"), F.col("cls").alias("a"), F.col("n").alias("an"), F.col("flag").alias("aflag"), F.col("root").alias("aroot"))
    pivot = lists.where(F.col("flag").bitwiseAND(DELETED) == 0).groupBy("sig").agg(F.min(rank).alias("p")).select("sig", "p.a", "p.an", "p.aflag", "p.aroot")
    met = with_list(lists, pivot).where(possible(F.col("n"), F.col("flag"), F.col("an"), F.col("aflag")))
    return met.where("root <> aroot").select("a", F.col("cls").alias("b"))


def list_blocks(some: DataFrame, sketches: DataFrame, size: int) -> DataFrame:
    """Members of each list with their sketch, dealt in blocks of about ``size`` members: (sig, x, y, mine,
    cls, n, flag, root, sketch) for every two blocks x <= y of a list; a short list is one block."""
    n = some.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cls", F.lit(7)), F.col("blocks")).cast("int")
    placed = with_list(some, n).join(sketches, "cls").withColumn("mine", own)
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.select("sig", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "cls", "n", "flag", "root", "sketch")


def _cross(some: DataFrame, sketches: DataFrame, near: Callable, possible: Callable) -> DataFrame:
    """(a, b): the pairs of a list that are in different components and that ``near`` leaves possible.

    Pairs are looked at where the list is, two blocks at a time; only possible ones become rows.
    """

    def pairs_of(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        mine, cls, n, flag, root = (np.array([h[k] for h in held], np.int64) for k in (0, 1, 2, 3, 4))
        sketch = [h[5] for h in held]
        one, two = np.flatnonzero(mine == mine.min()), np.flatnonzero(mine == mine.max())
        for i in one:
            to = two[(root[two] != root[i]) & (cls[two] != cls[i])]
            to = to[possible(n[to], flag[to], n[i], flag[i])]
            if mine[i] == mine.max():
                to = to[to > i]  # both in one block: each pair once
            if len(to):
                to = to[near(sketch, n, int(i), to)]
            if len(to):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[i], cls[to])), pa.array(np.maximum(cls[i], cls[to]))], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(9)]
            for sig, x, y, *row in zip(*columns):
                if (sig, x, y) != now:
                    if len(held) > 1:
                        yield from pairs_of(held)
                    now, held = (sig, x, y), []
                held.append(tuple(row))
        if len(held) > 1:
            yield from pairs_of(held)

    dealt = list_blocks(some, sketches, BLOCK).repartition(F.col("sig"), F.col("x"), F.col("y")).sortWithinPartitions("sig", "x", "y")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def link(scratch: Scratch, lists: DataFrame, verify: Callable[[DataFrame], DataFrame], possible: Callable, sketches: DataFrame, near: Callable, of_long: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root) of every class that is linked.

    ``verify`` turns pairs (a, b) into (a, b, linked). ``possible(n, flag, n, flag)`` tells from the sizes
    and flags of members (columns, or arrays) whether they can be; ``near(sketches, sizes, i, others)``
    from the sketches (cls, sketch) which of the others can be linked with i: both may only rule out
    what is sure not to be linked. ``of_long`` leaves out memberships whose links other lists hold."""
    tried = None
    open_lists = lists.withColumn("root", F.col("cls"))
    for turn in range(PIVOT_ROUNDS + 1):
        last = turn == PIVOT_ROUNDS
        if last and of_long:
            size = open_lists.groupBy("sig").agg(F.approx_count_distinct("root", 0.05).alias("roots"))
            open_lists = of_long(scratch.write(with_list(open_lists, size)))
        pairs = _cross(open_lists, sketches, near, possible) if last else _stars(open_lists, turn, possible)
        pairs = pairs.where("a <> b").distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti").join(tried.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
        got = scratch.write(verify(pairs))
        tried = got if tried is None else tried.union(got)
        roots = scratch.write(components(scratch, tried.where("linked").select("a", "b")))
        if last:
            break
        rooted = lists.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        mixed = rooted.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
        open_lists = scratch.write(with_list(rooted, mixed))
        if open_lists.isEmpty():
            break
    return roots


def verified(pairs: DataFrame, texts: DataFrame, prepare: Callable, related: Callable) -> DataFrame:
    """(a, b, linked) by ``related(prepare(text of a), prepare(text of b))``; ``texts`` is (cls, text).

    A pivot's text is prepared once for its pairs in a task; its pairs are salted over SALTS tasks.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    pivots = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("cls", "a"), "a").select("a", "salt", F.lit(None).cast("bigint").alias("b"), "text")
    members = salted.join(texts.withColumnRenamed("cls", "b"), "b").select("a", "salt", "b", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, have = None, None
        for batch in batches:
            a, b, linked = [], [], []
            for x, y, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if y is None:
                    pivot, have = x, prepare(text.as_py())
                    continue
                assert x == pivot
                a.append(x)
                b.append(y)
                linked.append(related(have, prepare(text.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    dealt = pivots.union(members).repartition(F.col("a"), F.col("salt")).sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a bigint, b bigint, linked boolean")
