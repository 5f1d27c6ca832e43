"""Arrow batches for the operators that run in Python: bounded pieces, byte-level words and hashes.

``text_chunks`` cuts incoming batches into pieces of whole texts of about CHUNK bytes, so what a task
holds does not depend on how long the texts of a batch are (one longer text is a piece by itself).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20


def release() -> None:
    """Gives freed memory back to the system. A Python worker lives on from task to task, and what the largest
    had freed would else count until the executor ends."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


ODD = np.uint64(0x9E3779B97F4A7C15)


def text_chunks(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets): null texts count as empty; offsets has one more entry than rows."""
    for batch in batches:
        column = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()), "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        n = len(column)
        if not n:
            continue
        _, at, data = column.buffers()
        at = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
            yield batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi
    batch = column = at = data = None
    release()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BASE = 0xD6E8FEB86659FD93
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * ODD)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS[0], _POWERS[1]


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for each range; equal bytes give equal hashes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * ODD)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of the maximal runs of bytes other than space and 0x09-0x0D."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[data]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


#: Multipliers of a shingle's words.
_PLACES = mix(np.arange(1, 17, dtype=np.uint64) * ODD) | np.uint64(1)


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` words from each word on, as far as there are so many."""
    n = max(0, len(h) - width + 1)
    s = h[:n] * _PLACES[0]
    for k in range(1, width):
        s += h[k : n + k] * _PLACES[k]
    return mix(s)


def pack_entries(part: np.ndarray, key: np.ndarray, note: np.ndarray) -> pa.RecordBatch:
    """One row a part: its keys' low 48 bits and notes of 40 bits, packed (the part holds the top bits)."""
    order = np.argsort(part, kind="stable")
    key, note, part = key[order], note[order], part[order]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    to = np.append(at[1:], len(part))
    key, note = key.view(np.uint8).reshape(-1, 8)[:, :6], note.view(np.uint8).reshape(-1, 8)[:, :5]
    blobs = (pa.array([x[a:b].tobytes() for a, b in zip(at, to)], pa.binary()) for x in (key, note))
    return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), *blobs], ["part", "keys", "notes"])


PACKED = "part int, keys binary, notes binary"


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """A part by the top 32 bits; ``parts`` is below 2**32."""
    return ((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _wide(blob: pa.Scalar, size: int) -> np.ndarray:
    got = np.frombuffer(blob.as_buffer(), np.uint8).reshape(-1, size)
    out = np.zeros((len(got), 8), np.uint8)
    out[:, :size] = got
    return out.view(np.uint64).ravel()


def each_part(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, notes) of one part after the other, from rows sorted by part."""
    now, held = None, []
    for batch in batches:
        part = batch.column(0).to_numpy()
        for i in range(len(part)):
            if part[i] != now:
                if held:
                    yield tuple(np.concatenate(x) for x in zip(*held))
                now, held = part[i], []
            held.append((_wide(batch.column(1)[i], 6), _wide(batch.column(2)[i], 5)))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))
    held = batch = None
    release()


def repeated(key: np.ndarray, note: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, notes, start, length) of the lists of keys that occur more than once; a list's notes are
    distinct and sorted."""
    order = np.argsort(key, kind="stable")
    key, note = key[order], note[order]
    dup = np.zeros(len(key), bool)
    dup[1:] = key[1:] == key[:-1]
    dup[:-1] |= dup[1:]
    key, note = key[dup], note[dup]
    order = np.lexsort((note, key))
    key, note = key[order], note[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (note[1:] != note[:-1])
    key, note = key[new], note[new]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key, note, at, np.diff(np.append(at, len(key)))


def distinct_lists(note: np.ndarray, at: np.ndarray, length: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sig, entry, times) per entry of the kept lists, of equal lists one: times is how many there were."""
    sig = np.add.reduceat(mix(note + ODD), at)
    _, first, times = np.unique(sig[keep], return_index=True, return_counts=True)
    pick = keep[first]
    size = length[pick]
    rows = np.repeat(at[pick], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(sig[pick], size), rows, np.repeat(times, size)
