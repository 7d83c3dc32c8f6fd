"""Repeated passages by a run-length compressed Burrows-Wheeler index.

Documents are UTF-8 bytes. A window of `size` bytes has an anchor: the place
of the smallest hash among its short grams, which is the same wherever the
window occurs. Anchors that two documents share pick the stretches of text
worth indexing, and equal windows meet in the shard of their anchor. A shard
lays its distinct stretches out one after the other, builds their
Burrows-Wheeler transform and keeps a sample at the border of every run: the
place in the text and how far it matches its neighbour in suffix order. Between
samples the matching statistics are streamed in text order, each one less than
the one before. Places that match over `size` bytes or more form the classes of
equal windows; the smallest document of a class keeps them, the others mark
them. Long repeats cost one sample per run, however often they occur.

Later copies of a whole text are found by its hash before anything is indexed,
and stretches with equal bytes are indexed once. A task that gathers a passage
from many documents sends the few entries that decide for other tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm import exchange as ex, text as tx
from tidemark.llm.suffix import shared_prefix, suffix_order
from tidemark.llm.tables import packed_row, written

GRAM = 16
# Bytes of distinct stretches in one index; anchors are not split over indexes.
SHARD = 1_500_000
HIGH = np.uint64(0xFFFFFFFF00000000)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        v, span = np.minimum(v[:-span], v[span:]), 2 * span
    return np.minimum(v[: len(v) - (width - span)], v[width - span:]) if width > span else v


def anchors(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: document, hash of the anchor, first and last window start."""
    none = np.zeros(0, np.int64)
    if len(data) < size:
        return none, none.astype(np.uint64), none, none
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), "<u8", padded, strides=(1,)).copy()
    h = tx.mixed(eight[: len(data) - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15) + (eight[8: len(data) - GRAM + 9] ^ (eight[8: len(data) - GRAM + 9] >> np.uint64(29))))
    least = _sliding_min(h & HIGH | np.arange(len(h), dtype=np.uint64), size - GRAM + 1)
    begin = np.arange(len(least))
    doc = np.searchsorted(starts, begin, side="right") - 1
    inside = begin + size <= starts[doc + 1]
    begin, doc, at = begin[inside], doc[inside], (least[inside] & ~HIGH).astype(np.int64)
    if not len(begin):
        return none, none.astype(np.uint64), none, none
    new = np.ones(len(begin), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1
    return doc[first], h[at[first]], begin[first], begin[last]


def _bytes(s: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    offsets, data = tx.body(tx.strings(s.column("text")))
    return np.frombuffer(data, np.uint8), offsets


def _combine_anchors(ids, owns, doc, bucket, values, raw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an anchor that several texts hold, those of the outermost ids and texts are sent, the others are shared for sure."""
    sent = ex.first_copies(ids, owns)[doc]
    entry = np.flatnonzero(sent)
    i, o = ids[doc[entry]], owns[doc[entry]]
    key = bucket[entry].astype(np.uint64) << np.uint64(32) | values[0][entry]
    at, edge = ex.repeated(key, i, o)
    if not len(at):
        return sent, doc[:0], key[:0]
    # Once for each document.
    again = np.zeros(len(at), bool)
    again[1:] = (key[at[1:]] == key[at[:-1]]) & (o[at[1:]] == o[at[:-1]])
    sent[entry[at[again]]] = False
    at = at[~again]
    edge = np.flatnonzero(np.concatenate([[True], key[at[1:]] != key[at[:-1]]]))
    size = np.diff(np.append(edge, len(at)))
    least, most = np.minimum.reduceat(i[at], edge), np.maximum.reduceat(i[at], edge)
    outer = (i[at] == np.repeat(least, size)) | (i[at] == np.repeat(most, size))
    outer[edge] = outer[edge + size - 1] = True
    inner = ~outer & np.repeat(least != most, size)
    sent[entry[at[inner]]] = False
    at = at[inner]
    at = at[np.argsort(doc[entry[at]], kind="stable")]
    return sent, doc[entry[at]], key[at]


def _combine_stretches(size: int):
    def combine(ids, owns, doc, bucket, values, raw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of equal stretches those of the smallest id are sent; the others are repeats from end to end."""
        key, at, length = values
        starts, data = raw
        sent = np.ones(len(doc), bool)
        again, _ = ex.repeated(tx.mixed(bucket.astype(np.uint64) << np.uint64(32) | key) ^ length.astype(np.uint64))
        if not len(again):
            return sent, doc[:0], np.zeros((0, 2), np.int32)
        number: dict[bytes, int] = {}
        which = np.fromiter((number.setdefault(data[a: a + m].tobytes(), len(number)) for a, m in zip(starts[again].tolist(), length[again].tolist())),
                            np.int64, len(again))
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids[doc[again]])
        gone = np.sort(again[ids[doc[again]] > least[which]])
        sent[gone] = False
        gone = gone[np.argsort(doc[gone], kind="stable")]
        return sent, doc[gone], np.column_stack([at[gone], at[gone] + length[gone] - size + 1]).astype(np.int32)

    return combine


def _shared(ids, owns, doc, values, data, bucket) -> tuple[np.ndarray, np.ndarray]:
    """Anchors that different texts of different ids hold."""
    order = np.argsort(values[0], kind="stable")
    key, of, text = values[0][order], ids[doc[order]], owns[doc[order]]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    several = (np.minimum.reduceat(of, edge) != np.maximum.reduceat(of, edge)) & (np.minimum.reduceat(text, edge) != np.maximum.reduceat(text, edge))
    hit = np.zeros(len(order), bool)
    hit[order] = np.repeat(several, np.diff(np.append(edge, len(key))))
    return doc[hit], values[0][hit].astype(np.uint64) | np.uint64(bucket << 32)


def matching_statistics(text: np.ndarray, order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """For every place, how far its suffix matches the one before it in suffix order.

    The transform's runs are found, the match is measured at run borders only,
    and streamed from there: the place after one with match m matches m - 1.
    """
    before = np.where(order > 0, text[order - 1], -1)  # the transform
    border = np.ones(len(order), bool)
    border[1:] = before[1:] != before[:-1]
    rows = np.flatnonzero(border)
    length = np.zeros(len(rows), np.int64)
    length[1:] = shared_prefix(levels, order[rows[1:] - 1], order[rows[1:]])
    sample = np.full(len(text), -1, np.int64)
    sample[order[rows]] = length + order[rows]
    place = np.maximum.accumulate(np.where(sample >= 0, np.arange(len(text)), 0))
    return np.maximum(sample[place] - np.arange(len(text)), 0)


def owners(stretches: list[bytes], least_id: np.ndarray, size: int) -> np.ndarray:
    """For every window of every stretch, one after the other, the smallest id whose stretches hold it."""
    lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.empty(int((lengths + 1).sum()), np.int64)
    of = np.repeat(np.arange(len(stretches)), lengths + 1)
    inner = np.ones(len(text), bool)
    inner[starts + lengths] = False
    text[inner] = np.frombuffer(b"".join(stretches), np.uint8)
    text[starts + lengths] = 256 + np.arange(len(stretches))  # an end of its own for each
    levels: list[tuple[int, np.ndarray]] = []
    order = suffix_order(text, int(lengths.max()) + 1, levels)
    match = matching_statistics(text, order, levels)[order]
    head = np.flatnonzero(match < size)
    least = np.minimum.reduceat(least_id[of[order]], head)
    owner = np.empty(len(text), least_id.dtype)
    owner[order] = np.repeat(least, np.diff(np.append(head, len(order))))
    windows = lengths - size + 1
    first = np.cumsum(windows) - windows
    return owner[np.arange(int(windows.sum())) + np.repeat(starts - first, windows)]


def _index(size: int):
    def solve(ids, owns, doc, values, data, bucket) -> tuple[np.ndarray, np.ndarray]:
        key, at, length = values
        ends = np.cumsum(length, dtype=np.int64)
        raw = data.tobytes()
        number: dict[bytes, int] = {}
        which = np.fromiter((number.setdefault(raw[a:e], len(number)) for a, e in zip((ends - length).tolist(), ends.tolist())),
                            np.int64, len(key))
        stretches = list(number)
        least = np.full(len(stretches), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids[doc])
        keys = np.empty(len(stretches), key.dtype)
        keys[which] = key
        # Indexes of whole anchors.
        by_key = np.argsort(keys, kind="stable")
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))[by_key]
        last_of_key = np.searchsorted(keys[by_key], keys[by_key], side="right")
        total, begin, found = np.cumsum(sizes + 1), 0, []
        while begin < len(by_key):
            done = total[begin - 1] if begin else 0
            stop = int(last_of_key[max(begin, int(np.searchsorted(total, done + SHARD)) - 1)])
            found.append(owners([stretches[j] for j in by_key[begin:stop]], least[by_key[begin:stop]], size))
            begin = stop
        owner = np.concatenate(found)
        windows = sizes - size + 1
        first = np.empty(len(stretches), np.int64)  # of each stretch among the owners
        first[by_key] = np.cumsum(windows) - windows
        # Windows of every occurrence whose owner is another, smaller document.
        count = length.astype(np.int64) - size + 1
        start = np.cumsum(count) - count
        step = np.arange(int(count.sum())) - np.repeat(start, count)
        gone = owner[step + np.repeat(first[which], count)] < np.repeat(ids[doc], count)
        opens, closes = gone.copy(), gone.copy()
        opens[1:] &= ~gone[:-1] | (step[1:] == 0)
        closes[:-1] &= ~gone[1:] | (step[1:] == 0)
        opens, closes = np.flatnonzero(opens), np.flatnonzero(closes)
        occurrence = np.searchsorted(start, opens, side="right") - 1
        spans = np.column_stack([at[occurrence] + step[opens], at[occurrence] + step[closes] + 1]).astype(np.int32)
        return doc[occurrence], spans

    return solve


def find_repeats(d: DataFrame, first: DataFrame, size: int) -> DataFrame:
    """id, own, answers (start and end of runs of repeated windows)."""
    n = ex.buckets(d)
    texts = d.filter(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "own", "text")

    def send(s: pa.RecordBatch, sender: ex.Sender) -> Iterator[pa.RecordBatch]:
        doc, h, _, _ = anchors(*_bytes(s), size)
        if len(doc):
            yield from sender.add(*ex.ids(s), doc, h, (h >> np.uint64(32)).astype(np.uint32))

    shared = ex.deal(texts, send, _combine_anchors, _shared, n, [np.uint32], copies=True)

    found = written(shared.join(first.select("id", "own"), ["id", "own"], "left_semi"), "anchors")

    def stretch(s: pa.RecordBatch, sender: ex.Sender) -> Iterator[pa.RecordBatch]:
        data, starts = _bytes(s)
        doc, h, a, e = anchors(data, starts, size)
        key = (h >> np.uint64(32)) | (h % np.uint64(n)) << np.uint64(32)
        hit = ex.shared_places(key, doc, *ex.answers(s, np.uint64))
        doc, h, a, e = doc[hit], h[hit], a[hit], e[hit]
        if len(doc):
            length = (e - a + size).astype(np.int32)
            yield from sender.add(*ex.ids(s), doc, h, (h >> np.uint64(32)).astype(np.uint32), (a - starts[doc]).astype(np.int32),
                                  length, ragged=(data, a))

    return ex.deal(texts.join(found, ["id", "own"]), stretch, _combine_stretches(size), _index(size), n,
                   [np.uint32, np.int32, np.int32], ragged=True)


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50,
                keep: list[str] | None = None) -> DataFrame:
    """`row` (the columns given, or those in `keep`), `kept_bytes`, `n_bytes`, `n_removed`, `removed`.

    A byte goes if it lies in a string of `size` (at least 32) bytes that also
    starts in a document of a smaller id; strings never cross documents and are
    judged on the input. `removed` has start and end byte of each removed run.
    A NULL text is empty. Rows that repeat an id do not remove from each other;
    a row without an id is kept whole and counts for no other. No rows give none.
    """
    d = ex.named(docs, id_col, text_col)
    first = written(ex.originals(d), "originals")
    marks = ex.marked(d, first, find_repeats(d, first, size), "marks")
    row = packed_row(docs.select(*keep) if keep else docs)
    joined = ex.with_marks(docs, marks, id_col, text_col, row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in tx.slices(batches, "text"):
            data, starts = _bytes(s)
            count = np.diff(starts)
            copy = np.array([bool(x) for x in s.column("copy").to_pylist()]) & (count >= size)
            flat, of = ex.answers(s, np.dtype((np.void, 8)))
            pairs = np.frombuffer(flat.tobytes(), np.int32).reshape(-1, 2).astype(np.int64)
            at = starts[of] + pairs[:, 0]
            gone = tx.covered(at, pairs[:, 1] - pairs[:, 0] + size - 1, len(data)) | np.repeat(copy, count)
            kept, removed = [], []
            for a, e in zip(starts[:-1], starts[1:]):
                g = gone[a:e]
                any_ = g.any()
                kept.append(data[a:e][~g].tobytes() if any_ else data[a:e].tobytes())
                removed.append(np.column_stack(tx.spans(g)).ravel().tolist() if any_ else [])
            lost = np.concatenate([[0], np.cumsum(gone)])
            yield pa.RecordBatch.from_arrays(
                [s.column("row"), pa.array(kept, pa.binary()), pa.array(count), pa.array(lost[starts[1:]] - lost[starts[:-1]]),
                 pa.array(removed, pa.list_(pa.int64()))], ["row", "kept_bytes", "n_bytes", "n_removed", "removed"])

    kind = T.StructType([joined.schema["row"]])
    return joined.mapInArrow(run, kind.add("kept_bytes", "binary").add("n_bytes", "long").add("n_removed", "long").add("removed", T.ArrayType(T.LongType())))


def digest(result: DataFrame) -> DataFrame:
    return result.select("row.doc_id", "n_bytes", "n_removed", (F.size("removed") / 2).cast("bigint").alias("n_spans"),
                         F.sha2("kept_bytes", 256).alias("kept_sha256"))
