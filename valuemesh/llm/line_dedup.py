"""Line deduplication by a segment-partition edit join.

Two lines are near copies at an edit distance of EDITS code points at most. Split into EDITS + 1
segments, one of the shorter line's segments occurs unchanged in the longer; so each line is indexed by
its segments (length, place, content) and probes with those of its substrings that may equal such a
segment, for each length from its own down to EDITS less, at the few places that a match allows.
Candidates are verified by bit-parallel edit distance along a band of 2 * EDITS + 1 cells.

Equal lines are one class from the start (64-bit hash); lines shorter than LEAST code points, for which
EDITS edits mean little similarity, are only compared for equality. White-space lines are never
duplicates. Of each component of near-equal lines the first line (least doc_id, then place) stays.

Null texts have no lines. Rows that share a doc_id are told apart by their text; equal rows are equal
lines of one document, of which the first row's stay. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuemesh.llm.batches import ODD, PACKED, _powers, distinct_lists, each_part, mix, pack_entries, part_of, repeated, text_chunks
from valuemesh.llm.linking import link, verified
from valuemesh.llm.store import Scratch, bit_filter, passes

EDITS = 2
LEAST = 20
FLUSH = 1 << 19
CHUNK = 1 << 19
INDEX = 1
GRAM = 3


def band_distance(p: str, t: str, most: int) -> int:
    """Edit distance of p and t if it is ``most`` or less, else ``most`` + 1.

    Bit b of a band word at column j is row j - most + b; the word moves down a row with each column.
    Along the diagonal of the last cell the distance grows by one wherever the diagonal step costs.
    """
    if abs(len(p) - len(t)) > most:
        return most + 1
    lo, hi = 0, min(len(p), len(t))
    while lo < hi and p[lo] == t[lo]:
        lo += 1
    end = 0
    while end < hi - lo and p[-1 - end] == t[-1 - end]:
        end += 1
    p, t = p[lo : len(p) - end], t[lo : len(t) - end]
    if not p or not t:
        return max(len(p), len(t))
    width = 2 * most + 1
    full = (1 << width) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(p):
        where[c] = where.get(c, 0) | 1 << (i + most)  # row i + 1, moved up by most - 1
    at = 1 << (most + len(p) - len(t))
    distance = abs(len(p) - len(t))
    plus = full & ~((1 << (most + 1)) - 1)  # rows above the first rise upwards
    minus = full & ~plus
    for j, c in enumerate(t):
        plus, minus = plus >> 1 | 1 << (width - 1), minus >> 1
        match = where.get(c, 0) >> j & full
        zero = ((((match & plus) + plus) ^ plus) | match | minus) & full
        right, left = (minus | ~(zero | plus)) & full, zero & plus
        if not zero & at:
            distance += 1
            if distance > most:
                return distance
        right, left = (right << 1 | 1) & full, left << 1 & full
        plus, minus = (left | ~(zero | right)) & full, zero & right
    return distance


def _lines(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(lines, text number, place in the text) of the lines that are not white space only."""
    lines, doc, place = [], [], []
    for d, t in enumerate(texts):
        for i, x in enumerate(t.split("\n")):
            if x and not x.isspace():
                lines.append(x)
                doc.append(d)
                place.append(i)
    return lines, np.array(doc, np.int64), np.array(place, np.int64)


class _Codes:
    """Prefix sums over the code points of lines; hashes of their substrings."""

    def __init__(self, lines: list[str]):
        self.length = np.array([len(x) for x in lines], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]) if lines else np.zeros(0, np.int64)
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        up, self.down = _powers(len(codes) + 1)
        value = (codes.astype(np.uint64) + np.uint64(1)) * ODD
        value ^= value >> np.uint64(29)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(value * up[: len(codes)], out=self.sums[1:])

    def hash(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start] + length.astype(np.uint64) * ODD)

    def whole(self) -> np.ndarray:
        return self.hash(self.start, self.length) if len(self.length) else np.zeros(0, np.uint64)


def _segment(length: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of segment i of lines of a length: even, the last ones longer by one."""
    size, more = length // (EDITS + 1), length % (EDITS + 1)
    extra = np.maximum(0, i - (EDITS + 1 - more))
    return i * size + extra, size + (i >= EDITS + 1 - more)


def substring_keys(codes: _Codes, pick: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(key, line, flag) of the picked lines' segments (INDEX) and probes (0)."""
    length, start = codes.length[pick], codes.start[pick]
    for less in range(EDITS + 1):
        target = length - less
        for i in range(EDITS + 1):
            at, size = _segment(target, i)
            tag = mix((target.astype(np.uint64) << np.uint64(8)) + np.uint64(i + 1))
            # a match at segment i leaves EDITS - i edits after it, and i before it
            for shift in range(max(-i, less - (EDITS - i)), min(i, less + EDITS - i) + 1):
                ok = (at + shift >= 0) & (at + shift + size <= length)
                flag = INDEX if less == 0 and shift == 0 else 0
                yield mix(codes.hash((start + at + shift)[ok], size[ok]) + tag[ok]), pick[ok], flag


def _texts_of(batch: pa.RecordBatch) -> list[str]:
    return pc.fill_null(batch.column(batch.schema.get_field_index("text")), "").to_pylist()


def _tid() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _all_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, place, line) of every line that counts: line is its 64-bit hash, tid the text's."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in text_chunks(batches, size=CHUNK):
            lines, doc, place = _lines(_texts_of(rows))
            row = pa.array(doc)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(row), rows.column(2).take(row), pa.array(place, pa.int64()), pa.array(_Codes(lines).whole().view(np.int64))], ["doc_id", "tid", "place", "line"])

    return docs.select("doc_id", "text", _tid().alias("tid")).mapInArrow(run, "doc_id bigint, tid bigint, place bigint, line bigint")


def _lists(docs: DataFrame, parts: int) -> DataFrame:
    """Lists of two or more classes that share a key: (sig, short, flag), one sig per distinct list.

    Keys travel packed, with 39 bits of the class; classes that agree in them only make more candidates.
    """

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for rows, _, _ in text_chunks(batches, size=CHUNK):
            lines, _, _ = _lines(_texts_of(rows))
            codes = _Codes(lines)
            cls = codes.whole()
            first = np.unique(cls, return_index=True)[1]  # equal lines of a chunk once
            pick = first[codes.length[first] >= LEAST]
            for key, line, flag in substring_keys(codes, pick):
                held.append((key, ((cls[line] >> np.uint64(25)) << np.uint64(1)) | np.uint64(flag)))
                total += len(key)
            if total >= FLUSH:
                key, note = (np.concatenate(x) for x in zip(*held))
                yield pack_entries(part_of(key, parts), key, note)
                held, total = [], 0
        if total:
            key, note = (np.concatenate(x) for x in zip(*held))
            yield pack_entries(part_of(key, parts), key, note)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.uint64(1)
        for key, note in each_part(batches):
            key, note, at, length = repeated(key, note)
            if not len(at):
                continue
            indexed = np.bitwise_or.reduceat(note & one, at) > 0
            keep = np.flatnonzero(indexed & (np.minimum.reduceat(note, at) >> one != np.maximum.reduceat(note, at) >> one))
            if len(keep):
                sig, rows, _ = distinct_lists(note, at, length, keep)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array((note[rows] >> one).astype(np.int64)), pa.array((note[rows] & one).astype(np.int32))], ["sig", "short", "flag"])

    sent = docs.select("text").mapInArrow(emit, PACKED)
    return sent.repartition(F.col("part")).sortWithinPartitions("part").mapInArrow(gather, "sig bigint, short bigint, flag int")


def _possible(n, flag, other_n, other_flag):
    """Lengths allow the distance, and one of the two is indexed under the key. Columns or arrays."""
    if isinstance(flag, Column):
        return (F.abs(n - other_n) <= EDITS) & (flag.bitwiseOR(other_flag).bitwiseAND(INDEX) > 0)
    return (np.abs(n - other_n) <= EDITS) & (((flag | other_flag) & INDEX) > 0)


def sketches(lines: list[str]) -> list[bytes]:
    """Per line the number of its 3-grams in each of 128 buckets, 255 at most.

    One edit changes three 3-grams at most, so near lines differ by 2 * 3 * EDITS in all at most.
    """
    codes = _Codes(lines)
    n = np.maximum(codes.length - GRAM + 1, 0)
    start = np.repeat(codes.start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    bucket = (codes.hash(start, np.full(len(start), GRAM)) >> np.uint64(57)).astype(np.int64)
    count = np.bincount(np.repeat(np.arange(len(lines)), n) * 128 + bucket, minlength=128 * len(lines))
    return [row.tobytes() for row in np.minimum(count, 255).astype(np.uint8).reshape(-1, 128)]


def _near(sketch: list[bytes], n: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    table = np.frombuffer(b"".join(sketch[j] for j in others), np.uint8).reshape(-1, 128).astype(np.int16)
    return np.abs(table - np.frombuffer(sketch[i], np.uint8).astype(np.int16)).sum(axis=1) <= 2 * GRAM * EDITS


def _screened(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sketches leave possible."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            one, two = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(-1, 128).astype(np.int16) for c in (2, 3))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(np.abs(one - two).sum(axis=1) <= 2 * GRAM * EDITS)], ["a", "b", "open"])

    one = texts.select(F.col("cls").alias("a"), F.col("sketch").alias("sa"))
    two = texts.select(F.col("cls").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint, open boolean")


def _verified(scratch: Scratch, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, linked): by sketch where that rules a pair out, else by edit distance."""
    screened = scratch.write(_screened(pairs, texts))
    exact = verified(screened.where("open").select("a", "b"), texts.select("cls", "text"), lambda t: t, _same)
    return exact.union(screened.where("not open").select("a", "b", F.lit(False)))


def _line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, text, n, sketch) of the lines whose class has one of the wanted ``short`` forms. A filter of
    fixed size keeps most other lines from being shuffled."""
    bits = bit_filter(wanted, "short")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in text_chunks(batches, size=CHUNK):
            lines, _, _ = _lines(_texts_of(rows))
            cls = _Codes(lines).whole()
            first = np.unique(cls, return_index=True)[1]
            first = first[passes(bits, cls[first] >> np.uint64(25))]
            first = [i for i in first if len(lines[i]) >= LEAST]
            yield pa.RecordBatch.from_arrays([pa.array(cls[first].view(np.int64)), pa.array([lines[i] for i in first], pa.string())], ["cls", "text"])

    def sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            lines = x.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array([len(t) for t in lines], pa.int64()), pa.array(sketches(lines), pa.binary())], ["cls", "text", "n", "sketch"])

    every = docs.select("text").mapInArrow(run, "cls bigint, text string").withColumn("short", F.shiftrightunsigned("cls", 25))
    found = every.join(wanted, "short", "left_semi").select("cls", "text").dropDuplicates(["cls"])
    return found.mapInArrow(sketched, "cls bigint, text string, n bigint, sketch binary")


def _same(a: str, b: str) -> bool:
    return band_distance(a, b, EDITS) <= EDITS


def line_classes(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(all lines, (line, root) of the lines that have near copies of other text)."""
    spark = docs.sparkSession
    parts = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = scratch.write(_all_lines(docs))
    short = scratch.write(_lists(docs, parts).distinct())
    texts = scratch.write(_line_texts(docs, short.select("short").distinct()))
    lists = scratch.write(short.join(texts.select("cls", "n", F.shiftrightunsigned("cls", 25).alias("short")), "short").drop("short"))
    roots = link(scratch, lists, lambda pairs: _verified(scratch, pairs, texts), _possible, texts.select("cls", "sketch"), _near)
    scratch.drop(short, lists, texts)
    return every, roots.withColumnRenamed("node", "line")


def duplicate_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all lines, the lines to remove): both (doc_id, tid, place, line); the latter with ``root``."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every, roots = line_classes(docs, scratch)
    # first by line, where equal lines were counted together, then by component: no hot group of rows
    rank = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tid", "place")
    by_line = scratch.write(every.groupBy("line").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("times")).join(roots, "line", "left").withColumn("root", F.coalesce("root", "line")))
    by_root = by_line.groupBy("root").agg(F.min("first").alias("first"), F.sum("times").alias("times")).where("times > 1")
    known = by_line.select("line", "root").join(by_root.select("root", "first"), "root")
    gone = every.join(known, "line").where(~rank.eqNullSafe(F.col("first")))
    return every, scratch.write(gone.select("doc_id", "tid", "place", "line", "root"))


def op4_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (places from 0 of the lines that go) for every document id."""
    every, gone = duplicate_lines(docs)
    count = every.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
    lost = gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("place")).alias("removed"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    out = rows.join(count.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")), "left").drop("d")
    out = out.join(lost.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")), "left").drop("d")
    removed = F.coalesce("removed", F.array().cast("array<bigint>"))
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def drop_duplicate_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the duplicate lines taken out of ``text`` (and ``n_chars`` recounted if there is such
    a column). Documents of which no line is left go; those that had none from the start stay."""
    every, gone = duplicate_lines(docs)
    count = every.groupBy("doc_id", "tid").agg(F.countDistinct("place").alias("n"))
    lost = gone.groupBy(F.col("doc_id").alias("__d"), F.col("tid").alias("__t")).agg(F.collect_set("place").alias("__gone"))
    lost = lost.join(count, F.col("__d").eqNullSafe(F.col("doc_id")) & (F.col("__t") == F.col("tid"))).select("__d", "__t", "__gone", (F.size("__gone") == F.col("n")).alias("__all"))
    got = docs.join(lost, docs["doc_id"].cast("long").eqNullSafe(F.col("__d")) & (_tid() == F.col("__t")), "left").where(~F.coalesce("__all", F.lit(False)))
    lines = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__gone", i.cast("long")))
    got = got.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n")))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return got.select(*[F.col(f"`{c}`") for c in docs.columns])
