"""Cost-balanced packing of tokenised documents into sequences of a fixed number of tokens.

A document's ids, with an end id, are cut at multiples of the capacity; whole pieces fill a sequence
each. The tails are ordered by estimated cost (linear plus quadratic attention), and each goes to
the sequence of lowest cost with room for it. As many sequences are open as the tails' ids need, so
tails that fit nowhere whole are cut over the room left, and a group of documents leaves less than
one sequence unfilled. That rest waits for the task's next group; at the task's end it is laid out
in sequences whose lengths are powers of two, which need no padding.

One pass over each input partition, no shuffle. A task holds one group (GROUP_IDS ids, or one longer
document). Null texts count as empty (one end id); repeated rows are packed each on their own; an
empty table gives no rows. Input columns other than the id and the text are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
END_ID = 0
#: Cost of n ids: n + QUADRATIC * n * n.
QUADRATIC = 1 / 512
GROUP_IDS = 1 << 20
LONG_SPACE = 50_000
_LONG_SPACE = re.compile(r"\s{%d}" % LONG_SPACE)
SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def load_encoder(path: str):
    """text -> uint32 ids, equal to those of the tokenizer file (byte-level BPE).

    The file's ranks run in a faster encoder of the same algorithm; strings of special tokens in a
    text become their ids, as they do in the tokenizer file's own encoder. That one gets the texts with
    LONG_SPACE white-space characters in a row, for which the faster one's pattern overflows its stack.
    """
    import json

    import tiktoken
    import tokenizers

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocab, pre = model["model"]["vocab"], model.get("pre_tokenizer") or {}
    added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    if model["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model.get("normalizer") or model["model"].get("ignore_merges"):
        raise ValueError(f"not a plain byte-level BPE: {path}")
    # byte-level vocabularies spell bytes as printable characters: the printable ones as themselves,
    # the others as the characters from 256 on, in order
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    spelled = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(spelled[c] for c in piece): i for piece, i in vocab.items() if piece not in added}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    own = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    specials, given = list(added), []

    def encode(text: str) -> np.ndarray:
        if len(text) >= LONG_SPACE and _LONG_SPACE.search(text):
            if not given:
                given.append(tokenizers.Tokenizer.from_file(path))
            return np.asarray(given[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if any(s in text for s in specials):
            return np.asarray(own.encode(text, allowed_special="all"), dtype=np.uint32)
        return np.asarray(own.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)

    return encode


def balance(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(item, start, length, bin) placing every id of every item; bins of ``capacity`` ids each.

    Items go by descending cost to the bin of lowest cost with room. Those that fit nowhere are cut
    over the bins' room, lowest cost first. Bins: as few as hold all ids.
    """
    total = int(lengths.sum())
    bins = -(-total // capacity)
    left = np.full(bins, capacity, np.int64)
    cost = np.zeros(bins)
    weight = lengths + QUADRATIC * lengths.astype(float) ** 2
    placed, late = [], []
    for item in np.argsort(-weight, kind="stable"):
        n = int(lengths[item])
        if not n:
            continue
        at = int(np.argmin(np.where(left >= n, cost, np.inf)))
        if left[at] < n:
            late.append(item)
            continue
        placed.append((int(item), 0, n, at))
        left[at] -= n
        cost[at] += weight[item]
    for item in late:
        done, n = 0, int(lengths[item])
        while done < n:
            at = int(np.argmin(np.where(left > 0, cost, np.inf)))
            k = min(n - done, int(left[at]))
            placed.append((int(item), done, k, at))
            left[at] -= k
            cost[at] += k + QUADRATIC * k * k
            done += k
    return placed


class _Packer:
    """Packs group after group; ``rest`` carries what does not fill a sequence."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id, self.rest = capacity, first_id, []

    def rows(self, docs: list[tuple[int | None, np.ndarray]], last: bool) -> list[tuple]:
        """Rows of the sequences that this group, with the rest of the groups before, fills."""
        out, tails = [], self.rest
        for doc, ids in docs:
            n, full = len(ids), len(ids) // self.capacity * self.capacity
            for at in range(0, full, self.capacity):
                out.append((doc, at, self.capacity, n, self.next_id, 0, ids[at : at + self.capacity].tobytes()))
                self.next_id += 1
            if full < n:
                tails.append((doc, ids, full, n))
        lengths = np.array([e - s for _, _, s, e in tails], np.int64)
        bins: dict[int, list] = {}
        for item, at, k, b in balance(lengths, self.capacity):
            bins.setdefault(b, []).append((item, at, k))
        self.rest = []
        for pieces in bins.values():
            cut = [(tails[i][0], tails[i][1], tails[i][2] + at, tails[i][2] + at + k) for i, at, k in pieces]
            if sum(e - s for _, _, s, e in cut) == self.capacity:
                out += self._sequence(cut)
            else:
                self.rest += cut
        if last:
            out += self._powers(self.rest)
        return out

    def _sequence(self, cut: list) -> list[tuple]:
        rows, offset = [], 0
        for doc, ids, s, e in cut:
            rows.append((doc, s, e - s, len(ids), self.next_id, offset, ids[s:e].tobytes()))
            offset += e - s
        self.next_id += 1
        return rows

    def _powers(self, cut: list) -> list[tuple]:
        rows = []
        while cut:
            left = sum(e - s for _, _, s, e in cut)
            size, now = min(self.capacity, 1 << (left.bit_length() - 1)), []
            while size:
                doc, ids, s, e = cut.pop()
                k = min(size, e - s)
                now.append((doc, ids, s, s + k))
                if s + k < e:
                    cut.append((doc, ids, s + k, e))
                size -= k
            rows += self._sequence(now)
        return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece, see SCHEMA: ``ids`` holds its ids as little-endian unsigned 32-bit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = load_encoder(tokenizer)
        packer = _Packer(capacity, TaskContext.get().partitionId() << 33)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        group, held = [], 0
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encode(value.as_py() or ""), end])
                group.append((doc, ids))
                held += len(ids)
                if held >= GROUP_IDS:
                    yield from _batches(packer.rows(group, False))
                    group, held = [], 0
        yield from _batches(packer.rows(group, True))

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    for lo in range(0, len(rows), 2048):
        columns = list(zip(*rows[lo : lo + 2048]))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int64()), pa.array(columns[6], pa.binary())], names)


def op2_packing(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece."""
    got = pack(docs, tokenizer)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
