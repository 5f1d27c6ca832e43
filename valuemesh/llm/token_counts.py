"""Token counts by a unigram model: a trie of distinct pre-tokens, scored once per shared prefix.

A pre-token is a maximal run of bytes other than white space, with the word mark in front. The forward
score of a prefix is the best log-probability of any way to cut it into pieces; a byte that no piece
covers counts as one token at UNKNOWN. Distinct pre-tokens of a chunk are sorted, so that the trie's
nodes are the prefixes that a pre-token does not share with the one before; each node is scored once,
level by level, and a pre-token's count is that of its last node. Ties go to the cut whose last piece
is shortest.

The vocabulary file gives the pieces in order of rank and no probabilities, so a piece of rank r is
given the probability of Zipf's law, 1 / (r + 1), normalised.

One pass over each input partition, no shuffle; a task holds one chunk of texts. Null and empty texts
have no tokens; repeated rows are counted each on their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuemesh.llm.batches import range_hashes, text_chunks, words

MARK = "▁".encode()
UNKNOWN = -25.0
CHUNK = 2 << 20
#: Bytes of a pre-token (with its mark) that the trie takes; longer ones are scored one by one.
WIDTH = 48
SCHEMA = "doc_id bigint, n_pretokens bigint, n_tokens bigint, log_prob double"
_BASE = np.uint64(0xD6E8FEB86659FD93)


class Unigram:
    """Pieces as byte strings with log-probabilities, and the batch scorer."""

    def __init__(self, pieces: dict[bytes, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.tables = []  # by length from 1: sorted hashes and their scores
        for n in range(1, self.longest + 1):
            own = [p for p in pieces if len(p) == n]
            h = self._hash(np.frombuffer(b"".join(own), np.uint8).reshape(-1, n)) if own else np.zeros(0, np.uint64)
            order = np.argsort(h)
            self.tables.append((h[order], np.array([pieces[p] for p in own])[order] if own else np.zeros(0)))

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for c in range(rows.shape[1]):
            h = h * _BASE + rows[:, c].astype(np.uint64) + np.uint64(1)
        return h

    @classmethod
    def from_sentencepiece(cls, path: str) -> Unigram:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ranked = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        total = np.log(sum(1 / (r + 1) for r in range(len(ranked))))
        return cls({sp.id_to_piece(i).encode(): -float(np.log(r + 1) + total) for r, i in enumerate(ranked)})

    def one(self, word: bytes) -> tuple[float, int]:
        """(log-probability, tokens) of one pre-token, straight along the string."""
        best, count = [0.0], [0]
        for d in range(1, len(word) + 1):
            top, n = best[d - 1] + UNKNOWN, count[d - 1] + 1
            for k in range(1, min(d, self.longest) + 1):
                p = self.pieces.get(word[d - k : d])
                if p is not None and best[d - k] + p > top:
                    top, n = best[d - k] + p, count[d - k] + 1
            best.append(top)
            count.append(n)
        return best[-1], count[-1]

    def many(self, sorted_rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for the rows of a byte matrix in sorted order, sharing prefixes."""
        n, width = sorted_rows.shape
        shared = np.zeros(n, np.int64)  # bytes in common with the row before
        if n > 1:
            same = sorted_rows[1:] == sorted_rows[:-1]
            shared[1:] = np.where(same.all(axis=1), width, same.argmin(axis=1))
        best, count = np.zeros((width + 1, n)), np.zeros((width + 1, n), np.int32)
        prefix = np.zeros((width + 1, n), np.uint64)
        powers = np.multiply.accumulate(np.full(self.longest + 1, _BASE, np.uint64)) if self.longest else None
        row = np.arange(n)
        for d in range(1, width + 1):
            node = np.flatnonzero((lengths >= d) & (shared < d))
            if not len(node):
                if not (lengths >= d).any():
                    break
            h = prefix[d - 1, node] * _BASE + sorted_rows[node, d - 1].astype(np.uint64) + np.uint64(1)
            top, toks = best[d - 1, node] + UNKNOWN, count[d - 1, node] + 1
            for k in range(1, min(d, self.longest) + 1):
                keys, scores = self.tables[k - 1]
                if not len(keys):
                    continue
                piece = h - prefix[d - k, node] * powers[k - 1]
                at = np.searchsorted(keys, piece)
                at[at == len(keys)] = 0
                hit = np.flatnonzero(keys[at] == piece)
                if not len(hit):
                    continue
                score = best[d - k, node[hit]] + scores[at[hit]]
                better = score > top[hit]
                hit = hit[better]
                top[hit] = score[better]
                toks[hit] = count[d - k, node[hit]] + 1
            # a row takes the node of the row before it as far as they share their prefix
            owner = np.zeros(n, np.int64)
            owner[node] = row[node]
            owner = np.maximum.accumulate(owner)
            for table, values in ((best, top), (count, toks), (prefix, h)):
                table[d, node] = values
                table[d] = table[d, owner]
        return best[lengths, row], count[lengths, row]


def score_chunk(model: Unigram, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pre-tokens, tokens, log-probability) per text."""
    n = len(offsets) - 1
    start, end, doc = words(data, offsets)
    pre = np.bincount(doc, minlength=n)
    if not len(start):
        return pre, np.zeros(n, np.int64), np.zeros(n)
    _, first, which = np.unique(range_hashes(data, start, end), return_index=True, return_inverse=True)
    s, length = start[first], (end - start)[first] + len(MARK)
    score, count = np.zeros(len(first)), np.zeros(len(first), np.int64)
    fits = np.flatnonzero(length <= WIDTH)
    if len(fits):
        width = int(length[fits].max())
        rows = np.zeros((len(fits), width), np.uint8)
        rows[:, : len(MARK)] = np.frombuffer(MARK, np.uint8)
        inner = width - len(MARK)
        at = s[fits][:, None] + np.arange(inner)
        rows[:, len(MARK) :] = np.where(np.arange(inner) < (length[fits] - len(MARK))[:, None], data[np.minimum(at, len(data) - 1)], 0)
        order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
        got = model.many(rows[order], length[fits][order])
        score[fits[order]], count[fits[order]] = got
    for i in np.flatnonzero(length > WIDTH):
        score[i], count[i] = model.one(MARK + data[s[i] : s[i] + length[i] - len(MARK)].tobytes())
    return pre, np.bincount(doc, weights=count[which], minlength=n).astype(np.int64), np.bincount(doc, weights=score[which], minlength=n)


def count_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, n_pretokens, n_tokens, log_prob of the best segmentation."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram.from_sentencepiece(vocabulary)
        for rows, data, offsets in text_chunks(batches, size=CHUNK):
            pre, tokens, score = score_chunk(model, data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(pre, pa.int64()), pa.array(tokens, pa.int64()), pa.array(np.round(score, 3), pa.float64())], ["doc_id", "n_pretokens", "n_tokens", "log_prob"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op10_token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    return count_tokens(docs, vocabulary)
