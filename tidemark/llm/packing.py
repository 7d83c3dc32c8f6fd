"""Packing documents into training sequences by the sum-of-squares rule.

A piece goes where the sum, over all gaps, of the squared number of open
sequences with that gap becomes smallest. The rule looks at counts only, and
pieces of one length are alike, so it runs on the histogram of lengths (at
most `capacity` counts, whatever the corpus) and not on the pieces: a plan of
at most about `plan_items` placements is made and repeated as often as the
counts allow. Full sequences of a repeated plan stay; pieces of the others go
back to the pool, and the last, unrepeated plan takes what is left. Pieces then
find their place by their rank among the pieces of their length, which needs
one count per part and length. No group of equal lengths meets in one task.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm import text as tx
from tidemark.llm.tables import map_texts, written

CAPACITY = 2048
PLAN_ITEMS = 1 << 15
# What the word-by-word way is made for, as the tokenizer's file has it. Fixed values.
LETTERS_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
LETTERS_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# Closing marks after a letter and before white space are a token of their own.
MARKS = r"([A-Za-z])([.,;:!?]+)([ \t\n\r\f]|$)"
# Letters before this one are normal and in lower case one by one.
LATIN_END = "\u0250"
# The character that stands for each byte: printable ones for themselves, the rest in order from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {
    b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}


class TextIds:
    """Token ids of texts for any tokenizer file.

    Where the file's patterns never cross white space and set letters apart,
    the ids of a text are those of its words in order: distinct words are
    looked up once a slice and remembered, and words of Latin letters go
    straight to the merges. Any other tokenizer gets the whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        steps = (file.get("pre_tokenizer") or {}).get("pretokenizers") or []
        self.by_word = (
            file.get("normalizer") == LETTERS_NORMALIZER and [p.get("type") for p in steps] == ["Split", "ByteLevel"]
            and (steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == ({"Regex": LETTERS_SPLIT}, "Removed", True)
            and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex"))
        self.known = tx.Remembered(self._ids)

    @staticmethod
    def _letters(word: bytes) -> str | None:
        """The merges' own spelling of a word of Latin letters."""
        if word.isalpha():  # ASCII letters
            return word.lower().decode()
        w = word.decode()
        if not w.isalpha() or max(w) >= LATIN_END:
            return None
        w = w.lower()
        return w.encode().decode("latin-1").translate(BYTE_CHARS) if w.isalpha() else None

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        plain = list(map(self._letters, words))
        odd = iter(self.tokenizer.encode_batch([w.decode() for w, m in zip(words, plain) if m is None], add_special_tokens=False))
        flat, ends, merge = [], [], self.tokenizer.model.tokenize
        for m in plain:
            flat += [t.id for t in merge(m)] if m is not None else next(odd).ids
            ends.append(4 * len(flat))
        data = array("i", flat).tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        if not self.by_word:
            each = [e.ids for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter((i for ids in each for i in ids), np.int32), np.fromiter(map(len, each), np.int64, len(each))
        codes, starts, vocabulary = tx.words(pc.replace_substring_regex(texts, pattern=MARKS, replacement=r"\1 \2\3"))
        each = self.known.of(vocabulary)
        ends = np.cumsum(np.fromiter(map(len, each), np.int64, len(each)) // 4)
        ids, a = np.frombuffer(b"".join(each), np.int32), np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        size = (ends - a)[codes]
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = ids[np.arange(upto[-1]) - np.repeat(upto[:-1] - a[codes], size)]
        return flat, np.diff(upto[starts])


_TEXT_IDS: dict[str, TextIds] = {}


def token_ids(texts: pa.Array, path: str, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, `end_id` after each, and where each text starts."""
    if path not in _TEXT_IDS:
        _TEXT_IDS[path] = TextIds(path)
    flat, size = _TEXT_IDS[path].of(texts)
    starts = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(starts[-1], end_id, np.int32)
    out[np.arange(len(flat)) + np.repeat(np.arange(len(size)), size)] = flat
    return out, starts


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: only documents of more than `capacity` ids are
    cut. `part` and `local` number the pieces of a length within a task."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = f"doc_id {d.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, local long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for s in tx.slices(batches, "text"):
            ids, starts = token_ids(tx.strings(s.column("text")), path, end_id)
            count = -(-np.diff(starts) // capacity)
            row = np.repeat(np.arange(len(count)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            a = starts[row] + piece * capacity
            length = np.minimum(starts[row + 1] - a, capacity)
            order = np.argsort(length, kind="stable")
            many = np.bincount(length, minlength=capacity + 1)
            local = np.empty(len(row), np.int64)
            local[order] = np.arange(len(row)) - np.repeat(np.cumsum(many) - many - seen, many)
            seen += many
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = np.fromiter((zlib.crc32(raw[4 * i: 4 * (i + n)]) for i, n in zip(a.tolist(), length.tolist())), np.int64, len(a))
            columns = [s.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * np.int64(capacity)),
                       pa.array(length), pa.array(crc), pa.array(np.full(len(row), part, np.int32)), pa.array(local)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
            if keep_ids:
                bounds = pa.array(np.append(a, a[-1:] + length[-1:]).astype(np.int32))
                columns, names = [*columns, pa.ListArray.from_arrays(bounds, pa.array(ids))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_texts(d, run, kind + ", ids array<int>" * keep_ids)


def place_all(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rule, piece by piece: sequence and offset of each, fill of each sequence."""
    open_ = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, n in enumerate(lengths.tolist()):
        now, after = open_[n:capacity], open_[: capacity - n]
        # Change of the sum of squares for each gap; a filled sequence counts no more.
        change = 2 * (after - now) + 2
        if len(change):
            change[0] = 1 - 2 * now[0]
            change[now == 0] = np.iinfo(np.int64).max
        best = int(change.argmin()) if len(change) else 0
        if len(change) and change[best] <= 2 * open_[capacity - n] + 1:
            gap = best + n
            k = by_gap[gap].pop()
            open_[gap] -= 1
        else:
            gap, k = capacity, len(fill)
            fill.append(0)
        sequence[i], offset[i] = k, fill[k]
        fill[k] += n
        left = gap - n
        if left:
            by_gap[left].append(k)
            open_[left] += 1
    return sequence, offset, np.array(fill, np.int64)


def plan(counts: np.ndarray, capacity: int = CAPACITY, plan_items: int = PLAN_ITEMS) -> list[dict]:
    """Waves of placements for `counts[n]` pieces of each length `n` below the
    capacity. A wave has `slots` sorted by length and is repeated `times`."""
    left, waves, base = counts.astype(np.int64).copy(), [], 0
    used = np.zeros(capacity + 1, np.int64)
    while left.sum():
        times = max(1, int(left.sum()) // plan_items)
        once = left // times
        if not once.sum():
            times, once = 1, left
        lengths = np.repeat(np.arange(capacity + 1), once)
        # The rule is made for pieces that come in no order.
        lengths = np.random.default_rng(len(waves)).permutation(lengths)
        sequence, offset, fill = place_all(lengths, capacity)
        if times > 1:
            full = fill == capacity
            if 8 * fill[full].sum() >= fill.sum():
                stay = full[sequence]
                number = np.cumsum(full) - 1
                lengths, sequence, offset, fill = lengths[stay], number[sequence[stay]], offset[stay], fill[full]
        order = np.argsort(lengths, kind="stable")
        lengths, sequence, offset = lengths[order], sequence[order], offset[order]
        taken = np.bincount(lengths, minlength=capacity + 1)
        waves.append({"times": times, "base": base, "sequences": len(fill), "from": used.copy(), "per": taken,
                      "at": np.cumsum(taken) - taken, "sequence": sequence.astype(np.int32), "offset": offset.astype(np.int32)})
        used += taken * times
        left -= taken * times
        base += len(fill) * times
    return waves


def place(length: np.ndarray, rank: np.ndarray, waves: list[dict], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by their rank among the pieces of their length."""
    planned = waves[-1]["base"] + waves[-1]["sequences"] * waves[-1]["times"] if waves else 0
    sequence, offset = planned + rank, np.zeros(len(rank), np.int64)  # whole sequences follow the planned ones
    for w in waves:
        k = rank - w["from"][length]
        own = np.flatnonzero((k >= 0) & (k < w["per"][length] * w["times"]) & (length < capacity))
        copy, slot = np.divmod(k[own], w["per"][length[own]])
        at = w["at"][length[own]] + slot
        sequence[own] = w["base"] + copy * w["sequences"] + w["sequence"][at]
        offset[own] = w["offset"][at]
    return sequence, offset


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = 0, keep_ids: bool = False, plan_items: int = PLAN_ITEMS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, and with `keep_ids` its token ids.

    A NULL or empty text is the end id alone. Repeated rows are packed each; a
    NULL id stays NULL. An empty table gives no rows; further columns of the
    documents are not used. `path` is a tokenizer file on every worker.
    """
    p = written(pieces(docs, path, id_col, text_col, capacity, end_id, keep_ids), "pieces")
    per_part = p.groupBy("part", "length").agg(F.max("local").alias("n")).withColumn("n", F.col("n") + 1)
    per_part = written(per_part, "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in per_part.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    counts[capacity] = 0
    waves = plan(counts, capacity, plan_items)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = per_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = p.join(first, ["part", "length"])
    out = [f for f in p.schema.fieldNames() if f not in ("part", "local")]
    ranked = ranked.select(*out, (F.col("before") + F.col("local")).alias("rank"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = place(b.column("length").to_numpy(), b.column("rank").to_numpy(), waves, capacity)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in out], pa.array(sequence), pa.array(offset)],
                                             [*out, "sequence_id", "offset"])

    return ranked.mapInArrow(run, kind + ", sequence_id long, offset long")
