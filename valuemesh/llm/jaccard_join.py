"""Set-similarity join on word shingles by universe partition and the pigeonhole principle.

A document's set is its distinct 5-word shingles (64-bit hashes). Sets of one size band are cut into
the same m segments by ranges of the hash. If two sets differ in at most H elements and a set's
segments are given allocations that sum to more than H, some segment with allocation 1 is equal in
both, or one with allocation 2 differs by one element at most. So a segment of allocation 1 is indexed
by its content, and one of allocation 2 also by its content less each element (one-deletion
neighbourhood).

Allocation follows cost twice. Bands of small sets take 2, where one-deletion lists are short and plain
segments would be nearly empty, the others 1, where 2 would cost a key for each element without being
more selective. Then every set withdraws from its longest lists, as many as its allocations exceed what
it needs. All sets withdraw in one order of the lists (length, then name), so what two sets withdraw of
the lists that they share is the longer of two prefixes, and neither prefix is all of them: a list
remains that both are on.

Equal sets are one class from the start (class id: 64-bit hash of the set). Components need not all
links: see :mod:`valuemesh.llm.blocks`. The sketch of a set holds, for each of some ranges of a hash,
whether it has an odd number of elements there; two sets differ in at least as many elements as their
sketches do in bits. A link is decided on the whole sets of 64-bit hashes.

Nulls, texts without words: empty set, linked with nothing, n_shingles 0, component the row's own id.
Repeated rows with one id share a component. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valuemesh.llm.batches import LOWER, ODD, PACKED, distinct_lists, each_part, mix, pack_entries, part_of, range_hashes, repeated, shingle_hashes, text_chunks, words
from valuemesh.llm.blocks import link
from valuemesh.llm.store import Scratch, bit_filter, passing

WIDTH = 5
#: Links have 100 * intersection >= 80 * union. The bounds below are for this similarity.
PER_CENT = 80
#: Sizes 4 to 8 are band 0, to 16 band 1, and so on; up to DELETE_BAND segments get allocation 2.
FIRST, DELETE_BAND = 8, 3
FLUSH = 1 << 19
OWN, DELETED = 1, 2
#: A sketch has the power of two from 2 bits an element on, MOST_BITS at most: longer sets are screened
#: less sharply, and decided all the same.
LEAST_BITS, MOST_BITS = 64, 1 << 16


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, text number): each text's distinct shingles in order of their hash."""
    n = len(offsets) - 1
    start, end, doc = words(data, offsets)
    h = range_hashes(data, start, end)
    count = np.bincount(doc, minlength=n)
    s = shingle_hashes(h, WIDTH)
    first = np.concatenate([[0], np.cumsum(count)])
    for i in np.flatnonzero(count >= WIDTH):
        s[first[i] : first[i + 1] - WIDTH + 1].sort()
    d = doc[: len(s)]
    new = d == doc[len(doc) - len(s) :] if len(s) else np.zeros(0, bool)
    new[1:] &= (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[new], d[new]
    few = np.flatnonzero((count > 0) & (count < WIDTH))
    if len(few):
        whole = np.array([mix(np.array([h[first[i] : first[i + 1]]]) + np.arange(count[i], dtype=np.uint64) * ODD).sum() for i in few], np.uint64)
        s, d = np.concatenate([s, mix(whole + count[few].astype(np.uint64))]), np.concatenate([d, few])
        order = np.argsort(d, kind="stable")
        s, d = s[order], d[order]
    return s, d


def classes(s: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(class id, size) per text; class 0 is the empty set."""
    size = np.bincount(d, minlength=n)
    total = np.zeros(n, np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        total[some] = np.add.reduceat(mix(s + ODD), np.concatenate([[0], np.cumsum(size[some])[:-1]]))
        total[some] = mix(total[some] + size[some].astype(np.uint64)) | np.uint64(1)
    return total, size


def band(size: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) / FIRST)).astype(np.int64))


def segments(k: np.ndarray) -> np.ndarray:
    """Segments of the sets that meet in band k: enough allocations for the largest, and some over."""
    top = FIRST << k
    few = (top // 4 + 2) // 2 + 1
    return np.where(k <= DELETE_BAND, few, np.ceil(0.30 * top).astype(np.int64) + 2)


def needed(size: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Most elements in which a set can differ from one that it meets in band k, its own or the next lower."""
    partner = np.where(band(size) == k, size * 5 // 4, FIRST << k)
    return (size + partner) // 9


class _Cut:
    """The sets of the texts taken, each cut as in band k[text], and their allocations ``cap``."""

    def __init__(self, s: np.ndarray, d: np.ndarray, size: np.ndarray, k: np.ndarray, take: np.ndarray):
        n, in_it = len(size), take[d]
        self.s, self.d, self.k, self.m = s[in_it], d[in_it], k, segments(k)
        self.seg = ((self.s >> np.uint64(32)) * self.m[self.d].astype(np.uint64)) >> np.uint64(32)
        new = np.ones(len(self.s), bool)
        new[1:] = (self.seg[1:] != self.seg[:-1]) | (self.d[1:] != self.d[:-1])
        self.at = np.flatnonzero(new)
        self.which = np.cumsum(new) - 1
        self.length = np.diff(np.append(self.at, len(self.s)))
        self.doc = self.d[self.at]
        self.deep = k[self.doc] <= DELETE_BAND
        self.cap = np.bincount(self.doc, weights=np.where(self.deep & (self.length > 1), 2, 1), minlength=n).astype(np.int64)
        #: Too many empty segments: these index the empty ones too, and withdraw from none.
        self.short = take & (self.cap <= needed(size, k))

    def spare(self, size: np.ndarray) -> np.ndarray:
        """From how many lists a set can withdraw and still meet all its partners."""
        weight = np.where(self.k <= DELETE_BAND, 2, 1)
        return np.where(self.short, 0, np.maximum(self.cap - needed(size, self.k) - 1, 0) // weight)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, text number, flag)."""
        if not len(self.s):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        value = mix(self.s + ODD)
        total = np.add.reduceat(value, self.at)
        place = mix((self.k[self.d] + 1).astype(np.uint64) * ODD + self.seg)
        out = [(mix(total + place[self.at]), self.doc, np.zeros(len(self.doc), np.uint8))]
        less = self.deep[self.which] & ((self.length[self.which] > 1) | self.short[self.d])
        out.append((mix(total[self.which] - value + place)[less], self.d[less], np.full(int(less.sum()), DELETED, np.uint8)))
        for i in np.flatnonzero(self.short):
            empty = np.setdiff1d(np.arange(self.m[i], dtype=np.uint64), self.seg[self.d == i])
            if len(empty):
                out.append((mix(mix(np.full(len(empty), self.k[i] + 1, np.uint64) * ODD + empty)), np.full(len(empty), i), np.zeros(len(empty), np.uint8)))
        return tuple(np.concatenate(x) for x in zip(*out))


def both_bands(s: np.ndarray, d: np.ndarray, size: np.ndarray) -> tuple[_Cut, _Cut]:
    """The cuts for the sets' own band and, for those with partners there, the next lower one."""
    own = band(size)
    lower = np.maximum(own - 1, 0)
    low = (own > 0) & (size * 4 <= (FIRST << lower) * 5)
    return _Cut(s, d, size, own, size >= 4), _Cut(s, d, size, lower, low & (size >= 4))


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, cls, n, spare_own, spare_low) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            s, d = shingles(LOWER[data], offsets)
            cls, size = classes(s, d, len(offsets) - 1)
            own, low = both_bands(s, d, size)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(cls.view(np.int64)), *(pa.array(x, pa.int64()) for x in (size, own.spare(size), low.spare(size)))], ["doc_id", "cls", "n", "spare_own", "spare_low"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, cls bigint, n bigint, spare_own bigint, spare_low bigint")


def _lists(docs: DataFrame, parts: int) -> DataFrame:
    """Inverted lists with two or more classes: (sig, short, flag, size, lists), one sig per distinct list.

    Keys travel packed, a row for each task's flush and part, with 38 bits of the class; a part is
    sorted in one task, which holds one part at a time. Classes that agree in these bits only make
    more candidates.
    """

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for _, data, offsets in text_chunks(batches):
            s, d = shingles(LOWER[data], offsets)
            cls, size = classes(s, d, len(offsets) - 1)
            first = np.zeros(len(cls), bool)
            first[np.unique(cls, return_index=True)[1]] = True  # equal sets of a chunk once
            for cut, extra in zip(both_bands(s, d, size), (OWN, 0)):
                key, doc, flag = cut.keys()
                ok = first[doc]
                held.append((key[ok], ((cls[doc[ok]] >> np.uint64(26)) << np.uint64(2)) | flag[ok] | np.uint64(extra)))
                total += int(ok.sum())
            if total >= FLUSH:
                key, note = (np.concatenate(x) for x in zip(*held))
                yield pack_entries(part_of(key, parts), key, note)
                held, total = [], 0
        if total:
            key, note = (np.concatenate(x) for x in zip(*held))
            yield pack_entries(part_of(key, parts), key, note)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, note in each_part(batches):
            key, note, at, length = repeated(key, note)
            if not len(at):
                continue
            own = np.bitwise_or.reduceat(note & np.uint64(OWN), at) > 0
            plain = np.bitwise_or.reduceat(~note & np.uint64(DELETED), at) > 0
            low, high = np.minimum.reduceat(note, at) >> np.uint64(2), np.maximum.reduceat(note, at) >> np.uint64(2)
            keep = np.repeat(own & plain & (low != high), length)
            key, note, at, length = repeated(key[keep], note[keep] & ~np.uint64(DELETED))
            if len(at):
                sig, rows, times = distinct_lists(note, at, length, np.arange(len(at)))
                size = np.repeat(length, length)[rows]
                columns = (sig.view(np.int64), (note[rows] >> np.uint64(2)).astype(np.int64), (note[rows] & np.uint64(OWN)).astype(np.int32), size, times)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["sig", "short", "flag", "size", "lists"])

    sent = docs.select("doc_id", "text").mapInArrow(emit, PACKED)
    dealt = sent.repartition(F.col("part")).sortWithinPartitions("part")
    return dealt.mapInArrow(gather, "sig bigint, short bigint, flag int, size bigint, lists bigint")


def _withdrawn(lists: DataFrame, heads: DataFrame) -> DataFrame:
    """(sig, cls, n, size): the lists without the memberships that their classes can spare, longest first."""
    short = heads.select("cls", "n", "spare_own", "spare_low", F.shiftrightunsigned("cls", 26).alias("short"))
    every = lists.groupBy("sig", "short", "flag").agg(F.max("size").alias("size"), F.sum("lists").alias("lists")).join(short, "short")
    spent = F.sum("lists").over(Window.partitionBy("cls", "flag").orderBy(F.col("size").desc(), "sig"))
    spare = F.when(F.col("flag") == OWN, F.col("spare_own")).otherwise(F.col("spare_low"))
    return every.withColumn("spent", spent).where(F.col("spent") > spare).select("sig", "cls", "n", "size").distinct()


def sketches(s: np.ndarray, d: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Per text, a bit for each value of a hash: whether an odd number of its shingles have that value."""
    h, out = mix(s ^ np.uint64(0x5851F42D4C957F2D)), []
    first = np.concatenate([[0], np.cumsum(size)])
    for i, n in enumerate(size):
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(2 * n - 1).bit_length()))
        odd = np.bincount((h[first[i] : first[i + 1]] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8)).tobytes())
    return out


def _folded(table: np.ndarray, width: int) -> np.ndarray:
    while table.shape[1] > width:
        half = table.shape[1] // 2
        table = table[:, :half] ^ table[:, half:]
    return table


def near(n: np.ndarray, sketch: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
    """test(i, others): which of the others may be linked with i by their sizes and sketches."""
    length = np.array([len(x) // 8 for x in sketch])
    tables, place = {}, np.zeros(len(sketch), np.int64)
    for width in np.unique(length):
        at = np.flatnonzero(length == width)
        place[at] = np.arange(len(at))
        own = np.frombuffer(b"".join(sketch[j] for j in at), np.uint64).reshape(-1, width)
        for less in np.unique(length[length <= width]):
            tables[width, less] = _folded(own, less)

    def test(i: int, others: np.ndarray) -> np.ndarray:
        out = (n[others] * 100 >= n[i] * PER_CENT) & (n[i] * 100 >= n[others] * PER_CENT)
        for width in np.unique(length[others[out]]):
            at = np.flatnonzero(out & (length[others] == width))
            less = min(width, length[i])
            differ = np.bitwise_count(tables[width, less][place[others[at]]] ^ tables[length[i], less][place[i]]).sum(axis=1, dtype=np.int64)
            out[at] = differ * (100 + PER_CENT) <= (n[i] + n[others[at]]) * (100 - PER_CENT)
        return out

    return test


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """The rule, on two sets of shingles in order."""
    if not len(a) or not len(b):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return 100 * both >= PER_CENT * (len(a) + len(b) - both)


def _set(data: pa.Scalar | bytes) -> np.ndarray:
    return np.frombuffer(data if isinstance(data, bytes) else data.as_buffer(), np.uint64)


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.write(_rows(docs))
    heads = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("head"), *(F.first(c).alias(c) for c in ("n", "spare_own", "spare_low")))
    lists = scratch.write(_withdrawn(_lists(docs, parts), heads))
    sets = scratch.write(_sets(docs, lists.select("cls").distinct().join(heads.select("cls", "head"), "cls")))
    roots = link(scratch, lists, sets, near, _set, similar)
    scratch.drop(lists, sets)
    head = heads.select("cls", "head").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = head.groupBy("root").agg(F.min("head").alias("component_id"))
    by_class = scratch.write(head.join(least, "root").select("cls", "component_id"))
    scratch.drop(roots)
    return rows.join(by_class, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _sets(docs: DataFrame, member: DataFrame) -> DataFrame:
    """(cls, sketch, data) of each class that is on a list, from its least id's text; texts stay where
    they are."""
    bits = bit_filter(member, "head")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(passing(batches, bits)):
            s, d = shingles(LOWER[data], offsets)
            cls, size = classes(s, d, len(offsets) - 1)
            first = np.concatenate([[0], np.cumsum(size)])
            sets = [s[first[i] : first[i + 1]].tobytes() for i in range(len(size))]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(cls.view(np.int64)), pa.array(sketches(s, d, size), pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "cls", "sketch", "data"])

    every = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, cls bigint, sketch binary, data binary")
    want = member.select(F.col("cls").alias("want"), "head")
    return every.join(want, (F.col("cls") == F.col("want")) & F.col("doc_id").eqNullSafe(F.col("head")), "left_semi").dropDuplicates(["cls", "doc_id"]).select("cls", "sketch", "data")


def op9_ngram_jaccard(docs: DataFrame) -> DataFrame:
    return near_copies(docs)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each group of near copies: that of the least id."""
    got = near_copies(docs)
    gone = got.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
