"""Colours nearer than epsilon, block against block.

Colours of one scope are dealt by bands of lightness, of a width such that nearer ones lie in one band or in
neighbouring ones, and bands are cut into blocks. Every two blocks that may hold a near pair meet once, as
arrays: a window of lightness, then a lower bound without angles, then CIEDE2000. Colours outside L 0..100
are a band that meets all. Colours with a component that is null or not finite are near nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valuemesh.functions.colors import delta_e_arrays

BLOCK = 4096
#: Pairs of one step, so that its arrays stay small; rows of one batch returned.
CELLS, ROWS = 1 << 14, 1 << 17
OUTSIDE = -1
SLACK = 1 + 1e-9
#: q^2 + r^2 + R_T q r >= (1 - |R_T| / 2) (q^2 + r^2). |R_T| is below 2 sin 60; of two colours with b >= 0 the mean
#: hue is in 0..180, 95 degrees or more from 275, and |R_T| below 2e-6.
LEAST_SHARE, SHARE_WITHOUT_BLUE = 0.1339, 1 - 1e-5

PLACE = ["scope", "band", "block"]
PAIR = ["scope", "band", "block", "other_band", "other_block"]


def _placed(rows: DataFrame, width: float) -> DataFrame:
    """``rows`` (id, ord, scope, v) with l, a, b, their band, and its blocks and their own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater_equal(pc.list_value_length(batch.column(3)), 3))
            lab = [pc.fill_null(pc.list_element(batch.column(3), i), np.nan).to_numpy() for i in range(3)]
            ok = np.isfinite(lab).all(axis=0)
            l, a, b = (x[ok] for x in lab)
            band = np.where((l >= 0) & (l <= 100), np.floor(l / width), OUTSIDE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.filter(pa.array(ok)).columns[:3], *map(pa.array, (l, a, b, band))], ["id", "ord", "scope", "l", "a", "b", "band"])

    # in Python, as the optimizer would write the colours' expressions out wherever a component is used
    some = rows.select("id", F.col("ord").cast("bigint").alias("ord"), "scope", F.col("v").cast("array<double>").alias("v"))
    banded = some.mapInArrow(run, "id string, ord bigint, scope string, l double, a double, b double, band bigint")
    sizes = banded.groupBy("scope", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    return banded.join(sizes, ["scope", "band"]).withColumn("block", F.pmod(F.xxhash64("id", "ord"), F.col("blocks")).cast("int"))


def _met(placed: DataFrame, own: bool) -> DataFrame:
    """``placed`` for each two blocks that meet, ``second`` for those of the second; ``own``: blocks meet
    themselves too."""
    cells = placed.select("scope", "band", "blocks").distinct()
    first = cells.select("scope", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    near = first.withColumn("other_band", F.explode(F.array("band", F.col("band") + 1)))
    cell = cells.select("scope", F.col("band").alias("other_band"), F.col("blocks").alias("n"))
    met = near.where("band >= 0").join(cell, ["scope", "other_band"]).select("scope", "band", "block", "other_band", "n")
    out = first.where(F.col("band") == OUTSIDE).join(cell, "scope").select("scope", "band", "block", "other_band", "n")
    pairs = met.union(out).withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    order = F.col("block") <= F.col("other_block") if own else F.col("block") < F.col("other_block")
    pairs = pairs.where((F.col("band") != F.col("other_band")) | order)
    one = placed.join(pairs, PLACE).withColumn("second", F.lit(False))
    itself = (F.col("band") == F.col("other_band")) & (F.col("block") == F.col("other_block"))
    other = pairs.where(~itself).select("scope", F.col("band").alias("b1"), F.col("block").alias("k1"), F.col("other_band").alias("band"), F.col("other_block").alias("block"))
    two = placed.join(other, PLACE).withColumn("other_band", F.col("band")).withColumn("other_block", F.col("block")).withColumn("band", F.col("b1")).withColumn("block", F.col("k1")).withColumn("second", F.lit(True))
    return one.unionByName(two.drop("b1", "k1"))


class _Side:
    """Colours in order of lightness: arrays, and the place of each among those given."""

    def __init__(self, table: pa.Table, at: np.ndarray):
        l, a, b = (table.column(c).to_numpy()[at] for c in "lab")
        order = np.argsort(l, kind="stable")
        self.at, self.l, self.a, self.b = at[order], l[order], a[order], b[order]
        self.c, self.up = np.hypot(self.a, self.b), self.b >= 0

    def __len__(self) -> int:
        return len(self.at)


def _s_l(far: float) -> float:
    """S_L where the mean lightness is ``far`` from 50; it grows with that."""
    return 1 + 0.015 * far * far / np.sqrt(20 + far * far)


def near_of(x: _Side, y: _Side, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in x, place in y, d): all pairs of which d is at most the limit of the colour of x."""
    if not len(x) or not len(y):
        return
    farthest = max(np.abs(x.l - 50).max(), np.abs(y.l - 50).max())
    lo = 0
    while lo < len(x):
        hi, width = min(len(x), lo + 64), 1.0
        most = float(limit[lo:hi].max())
        for _ in range(2):  # the widest window there can be, then that by the mean lightness in it
            wide = most * (_s_l(farthest) if width == 1.0 else width) * SLACK + 1e-9
            means = max(abs(x.l[lo] - wide / 2 - 50), abs(x.l[hi - 1] + wide / 2 - 50))
            width = _s_l(min(farthest, means))
        wide = most * width * SLACK + 1e-9
        begin, end = np.searchsorted(y.l, x.l[lo] - wide, "left"), np.searchsorted(y.l, x.l[hi - 1] + wide, "right")
        for at in range(begin, end, CELLS // 64):
            to = min(end, at + CELLS // 64)
            part = np.s_[at:to]
            share = np.where(x.up[lo:hi, None] & y.up[part], SHARE_WITHOUT_BLUE, LEAST_SHARE)
            s_c = 1 + 0.045 * 0.75 * (x.c[lo:hi, None] + y.c[part])
            plane = (x.a[lo:hi, None] - y.a[part]) ** 2 + (x.b[lo:hi, None] - y.b[part]) ** 2
            bound = ((x.l[lo:hi, None] - y.l[part]) / width) ** 2 + share * plane / (s_c * s_c)
            i, j = np.nonzero(bound <= (limit[lo:hi, None] * SLACK) ** 2 + 1e-9)
            if len(i):
                i, j = i + lo, j + at
                d = delta_e_arrays(x.l[i], x.a[i], x.b[i], y.l[j], y.a[j], y.b[j])
                ok = d <= limit[i]
                yield i[ok], j[ok], d[ok]
        lo = hi


def by_key(keys: list[str], found: Callable[[dict, pa.Table], Iterator[pa.RecordBatch]]) -> Callable:
    """Runs ``found`` on the rows of each key; rows are sorted by it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            lo, rows = 0, zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys])
            for key, group in groupby(rows):
                n = sum(1 for _ in group)
                if key != now and held:
                    yield from found(dict(zip(keys, now)), pa.Table.from_batches(held))
                    held = []
                now = key
                held.append(batch.slice(lo, n))
                lo += n
        if held:
            yield from found(dict(zip(keys, now)), pa.Table.from_batches(held))

    return run


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """A block pair's rows in one task. Comparisons are dear for their bytes: not to be coalesced by size."""
    n = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys)


def _sides(table: pa.Table) -> tuple[_Side, _Side]:
    """The two blocks; the same twice where a block meets itself."""
    second = table.column("second").to_numpy()
    x = _Side(table, np.flatnonzero(~second))
    return x, _Side(table, np.flatnonzero(second)) if second.any() else x


def color_pairs(rows: DataFrame, epsilon: float, width: float) -> DataFrame:
    """(a, b, scope, d) of the pairs of ``rows`` (id, ord, scope, v) nearer than epsilon, a of lower ``ord``."""

    def found(key: dict, table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, order = table.column("id").combine_chunks(), table.column("ord").to_numpy()
        x, y = _sides(table)

        def batch(held: list[tuple]) -> pa.RecordBatch:
            one, two, d = (np.concatenate(h) for h in zip(*held))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(one)), ids.take(pa.array(two)), pa.repeat(key["scope"], len(d)), pa.array(d)], ["a", "b", "scope", "d"])

        held, total = [], 0
        for i, j, d in near_of(x, y, np.full(len(x), epsilon)):
            one, two = x.at[i], y.at[j]
            ok = (d < epsilon) & ((order[one] < order[two]) if x is y else (order[one] != order[two]))
            one, two, d = one[ok], two[ok], d[ok]
            swap = order[one] > order[two]
            held.append((np.where(swap, two, one), np.where(swap, one, two), d))
            total += len(d)
            if total >= ROWS:
                yield batch(held)
                held, total = [], 0
        if total:
            yield batch(held)

    columns = ["id", "ord", "l", "a", "b", "second"]
    met = _dealt(_met(_placed(rows, width), True).select(*PAIR, *columns), PAIR)
    return met.mapInArrow(by_key(PAIR, found), "a string, b string, scope string, d double")


def _first_k(row: np.ndarray, name: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k entries of least (d, name) of each row."""
    order = np.lexsort((name, d, row))
    row = row[order]
    new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
    return order[rank < k]


def nearest_colors_of_each(rows: DataFrame, k: int, epsilon: float, width: float) -> DataFrame:
    """(id, other, scope, d, rank): of each colour the k nearest below epsilon.

    First within the colour's own block, in growing radii; the k-th there bounds how far the search in the
    other blocks goes."""

    def names(table: pa.Table) -> np.ndarray:
        out = np.empty(len(table), np.int64)
        out[pc.sort_indices(table.column("id")).to_numpy()] = np.arange(len(table))
        return out

    def gathered(x: _Side, y: _Side, limit: np.ndarray, name: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in x, place in the table, d) of the k nearest within the limits, chunk by chunk."""
        out = []
        for i, j, d in near_of(x, y, limit):
            ok = (d < epsilon) & (order[x.at[i]] != order[y.at[j]])
            i, j, d = i[ok], y.at[j[ok]], d[ok]
            best = _first_k(i, name[j], d, k)
            out.append((i[best], j[best], d[best]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        i, j, d = (np.concatenate(o) for o in zip(*out))
        best = _first_k(i, name[j], d, k)
        return i[best], j[best], d[best]

    def own(key: dict, table: pa.Table) -> Iterator[pa.RecordBatch]:
        whole, name, order = _Side(table, np.arange(len(table))), names(table), table.column("ord").to_numpy()
        ids, limit = table.column("id").combine_chunks(), np.full(len(table), epsilon)
        left, radius, kept = np.arange(len(table)), epsilon / 16, []
        while len(left):
            radius = min(epsilon, 2 * radius)
            x = _Side(table, left)
            i, j, d = gathered(x, whole, np.full(len(x), radius), name, order)
            count = np.bincount(i, minlength=len(x))
            full = count >= k
            ok = full[i] | (radius == epsilon)
            i, j, d = i[ok], j[ok], d[ok]
            kept.append((x.at[i], j, d))
            last = np.zeros(len(x))
            np.maximum.at(last, i, d)
            limit[x.at[full]] = last[full]
            left = x.at[~full] if radius < epsilon else left[:0]
        me, j, d = (np.concatenate(o) for o in zip(*kept))
        by_row = np.argsort(me, kind="stable")
        me, j, d = me[by_row], j[by_row], d[by_row]
        at = pa.array(np.searchsorted(me, np.arange(len(table) + 1)), pa.int32())
        others = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([ids.take(pa.array(j)), pa.array(d)], ["other", "d"]))
        got = table.combine_chunks().to_batches()[0]
        yield pa.RecordBatch.from_arrays([*got.columns, pa.array(limit), others], [*got.schema.names, "reach", "others"])

    def across(key: dict, table: pa.Table) -> Iterator[pa.RecordBatch]:
        name, order, reach = names(table), table.column("ord").to_numpy(), table.column("reach").to_numpy()
        ids, (x, y) = table.column("id").combine_chunks(), _sides(table)
        if x is y:
            return
        for one, two in ((x, y), (y, x)):
            i, j, d = gathered(one, two, reach[one.at], name, order)
            if len(i):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(one.at[i])), ids.take(pa.array(j)), pa.repeat(key["scope"], len(d)), pa.array(d)], ["id", "other", "scope", "d"])

    columns = ["id", "ord", "l", "a", "b"]
    placed = _placed(rows, width).select(*PLACE, "blocks", *columns)
    schema = "scope string, band bigint, block int, blocks int, id string, ord bigint, l double, a double, b double, reach double, others array<struct<other:string,d:double>>"
    first = _dealt(placed, PLACE).mapInArrow(by_key(PLACE, own), schema)
    met = _dealt(_met(first.drop("others"), False).select(*PAIR, *columns, "reach", "second"), PAIR)
    more = met.mapInArrow(by_key(PAIR, across), "id string, other string, scope string, d double")
    every = first.select("id", F.explode("others").alias("o"), "scope").select("id", "o.other", "scope", "o.d").union(more)
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("id", "scope").orderBy("d", "other"))).where(F.col("rank") <= k)
