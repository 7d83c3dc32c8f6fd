"""Words and hashes of whole texts, vectorised over an Arrow batch in a task.

A batch is cut into slices by bytes of text, so a task holds a few megabytes
of words at a time; a longer document forms a slice of its own and is never
cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4_000_000
# A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# The same, with every ASCII character outside 0-9 and a-z a blank.
LOWER_ALNUM = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def strings(column: pa.Array) -> pa.Array:
    """A string column as one large_string array, NULL as the empty text."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def body(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    """Offsets from 0 and the bytes of a large_string array."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if not len(texts) or data is None:
        return np.zeros(len(texts) + 1, np.int64), b""
    return offsets - offsets[0], data[int(offsets[0]): int(offsets[-1])].to_pybytes()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most `limit` bytes of `column`, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def words(texts: pa.Array, table: bytes | None = None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words between ASCII white space: codes of all words, where each text
    starts among them (one more entry than texts), and the distinct words.
    `table` maps bytes first."""
    if table is not None:
        offsets, data = body(texts)
        texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1,
                                      [None, pa.py_buffer(offsets), pa.py_buffer(data.translate(table))])
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    vocabulary = coded.dictionary.cast(pa.large_binary()).to_pylist()
    starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
    if b"" in vocabulary:  # blanks at the ends of a text
        kept = codes != vocabulary.index(b"")
        before = np.concatenate([[0], np.cumsum(kept)])
        codes, starts = codes[kept], before[starts]
    return codes, starts, vocabulary


def word_hashes(vocabulary: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in vocabulary), np.uint64, len(vocabulary))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(h: np.ndarray, k: int, multiplier: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of every `k` consecutive values, as a polynomial in an odd multiplier."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(multiplier)
        out += h[j: n + j]
    return mixed(out)


def inside(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the `n - k + 1` windows over joined texts lie in one text."""
    ok = np.ones(max(n - k + 1, 0), bool)
    for back in range(1, k):
        at = starts[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def covered(at: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of `n` places lie in [at, at + length) of any entry."""
    change = np.bincount(at, minlength=n + 1).astype(np.int64) - np.bincount(at + length, minlength=n + 1)[: n + 1]
    return np.cumsum(change[:n]) > 0


class Remembered:
    """What a worker has worked out for words, in two generations of about
    `BYTES` each: a word met again moves to the young one, the rest go with
    the old one. Values are binary; `make` gives those of unknown words. A
    worker holds one such memory: the words of another operator go first."""

    BYTES = 28_000_000
    # What a word and its value take besides their bytes.
    ENTRY = 190
    active: ClassVar[Remembered | None] = None

    def __init__(self, make: Callable[[list[bytes]], list[bytes]]):
        self.make = make
        self.forget()

    def forget(self) -> None:
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def of(self, vocabulary: list[bytes]) -> list[bytes]:
        if Remembered.active is not self:
            if Remembered.active is not None:
                Remembered.active.forget()
            Remembered.active = self
        out = list(map(self.young.get, vocabulary))
        again = [i for i, v in enumerate(out) if v is None]
        for i in again:
            out[i] = self.old.get(vocabulary[i])
        new = [i for i in again if out[i] is None]
        for a in range(0, len(new), 5_000):
            part = new[a: a + 5_000]
            for i, v in zip(part, self.make([vocabulary[i] for i in part])):
                out[i] = v
        keys, values = [vocabulary[i] for i in again], [out[i] for i in again]
        size = sum(map(len, keys)) + sum(map(len, values)) + self.ENTRY * len(again)
        if self.held + size > self.BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        if size <= self.BYTES:
            self.young.update(zip(keys, values))
            self.held += size
        return out
