"""Dealing many small keys of documents to buckets, and answers back.

A row for every word or byte position would cost more than the text. Here a
task packs the keys of several megabytes of text by bucket into binary columns;
a bucket sees all equal keys together, as sorted arrays, and answers per
document.

What many documents share is combined before it is sent: of the entries a task
has gathered with one key, a few stand for all, the task answers the others
itself, and a bucket gets a few entries a task for a key, however many hold it.

Documents are named by `id` and `own`, a hash of the text, so that rows which
repeat an id do not mix. Of the copies of a text in a slice only the one with
the smallest id is sent, and a bucket keeps the smallest of what it got, so a
text that a third of all rows hold is no hot key. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import text as tx
from tidemark.llm.tables import parts, text_bytes, written

# Entries that a task gathers before it sends them.
GATHER = 3_000_000
BUCKET_BYTES = 64_000_000
# For the bytes of stretches: Spark's LZ4 looks for repeats, of which a row has few.
STRETCHES = pa.Codec("zstd", 1)


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, own, own2: `own` and `own2` together stand for the text."""
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return d.withColumn("own", F.xxhash64("text")).withColumn("own2", F.xxhash64(F.lit(1), "text"))


def originals(d: DataFrame) -> DataFrame:
    """own, own2, id: the smallest id of each text."""
    return (d.filter(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "own", "own2")
            .groupBy("own", "own2").agg(F.min("id").alias("id")))


def buckets(d: DataFrame) -> int:
    return 2 * parts(d.sparkSession, text_bytes(d, "text"), BUCKET_BYTES)


def first_copies(ids: np.ndarray, owns: np.ndarray) -> np.ndarray:
    """Which documents have the smallest id of their text, each of them once."""
    order = np.lexsort((ids, owns))
    first = np.zeros(len(ids), bool)
    first[order[np.flatnonzero(np.concatenate([[True], owns[order][1:] != owns[order][:-1]]))]] = True
    return first


def repeated(key: np.ndarray, *order_by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose key occurs again, sorted by key and what follows (last first), and where each key starts."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    at = np.sort(order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]) if len(key) else order
    at = at[np.lexsort((*(v[at] for v in order_by), key[at]))]
    k = key[at]
    return at, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(at) else at


def packed(ids: np.ndarray, owns: np.ndarray, of: np.ndarray, answers: np.ndarray, n: int) -> list[list]:
    """dest, ids, owns, sizes, answers: answers of documents, packed by where the documents go; `of` is in order."""
    edges = np.flatnonzero(np.diff(of, prepend=-1, append=-1)) if len(of) else np.zeros(1, np.int64)
    at, size = of[edges[:-1]], np.diff(edges)
    dest = (tx.mixed(ids[at].astype(np.uint64)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(dest, kind="stable")
    ends = np.flatnonzero(np.diff(dest[order], prepend=-1, append=-1)) if len(dest) else np.zeros(1, np.int64)
    take = edges[:-1][order]
    rows: list[list] = [[], [], [], [], []]
    for x, y in zip(ends[:-1], ends[1:]):
        part = order[x:y]
        picked = np.concatenate([answers[k: k + m] for k, m in zip(take[x:y].tolist(), size[part].tolist())])
        for column, v in zip(rows, (int(dest[part[0]]), ids[at[part]].tobytes(), owns[at[part]].tobytes(),
                                    size[part].tobytes(), picked.tobytes())):
            column.append(v)
    return rows


class Sender:
    """Gathers entries of documents, combines them and packs them by bucket.

    `combine(ids, owns, doc, bucket, values, raw)` gets all that is gathered
    (`raw`: starts and bytes of the stretches) and gives which entries are sent,
    and answers that need no bucket: document of each in order, answers.
    """

    def __init__(self, n: int, combine: Callable):
        self.n, self.combine, self.docs, self.entries, self.size = n, combine, [], [], 0

    def add(self, ids: np.ndarray, owns: np.ndarray, doc: np.ndarray, key: np.ndarray, *values: np.ndarray,
            ragged: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
        """Entries in order of `doc` (index into `ids`); `key` picks the bucket,
        `values` are sent, and of `ragged` (starts, lengths as the last value)
        the bytes."""
        before = sum(len(i) for i, _ in self.docs)
        self.docs.append((ids, owns))
        self.entries.append((doc + before, (key % np.uint64(self.n)).astype(np.int64), values, ragged))
        self.size += len(doc) + (int(values[-1].sum()) // 16 if ragged is not None else 0)
        if self.size >= GATHER:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            ids, owns = (np.concatenate(x) for x in zip(*self.docs))
            doc, bucket = (np.concatenate([e[i] for e in self.entries]) for i in (0, 1))
            values = [np.concatenate(x) for x in zip(*[e[2] for e in self.entries])]
            data = starts = buffer = None
            if self.entries[0][3] is not None:
                base = np.cumsum([0] + [len(e[3][0]) for e in self.entries])
                starts = np.concatenate([e[3][1] + b for e, b in zip(self.entries, base)])
                buffer = np.concatenate([e[3][0] for e in self.entries])
            sent, of, said = self.combine(ids, owns, doc, bucket, values, (starts, buffer))
            told = packed(ids, owns, of, said, self.n)
            none = [[b""] * len(told[0])] * (len(values) - 1 + (starts is not None))
            if told[0]:
                yield pa.RecordBatch.from_arrays([pa.array([-1 - x for x in told[0]], pa.int32()), *[pa.array(c, pa.binary()) for c in told[1:] + none]],
                                                 ["bucket", "ids", "owns", "counts", *[f"v{i}" for i in range(len(values))], *(["data"] if starts is not None else [])])
            order = np.flatnonzero(sent)
            order = order[np.argsort(bucket[order].astype(np.uint16) if self.n < 65536 else bucket[order], kind="stable")]
            bucket, doc, values = bucket[order], doc[order], [v[order] for v in values]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else np.zeros(1, np.int64)
            if starts is not None and len(order):
                lengths, starts = values[-1].astype(np.int64), starts[order]
                ends = np.cumsum(lengths)
                data = buffer[np.arange(ends[-1]) - np.repeat(ends - lengths - starts, lengths)]
                ends = np.concatenate([[0], ends])
            names = ["bucket", "ids", "owns", "counts", *[f"v{i}" for i in range(len(values))], *(["data"] if data is not None else [])]
            for group in range(0, len(edges) - 1, 64):
                rows: list[list] = [[] for _ in names]
                for a, e in zip(edges[group: group + 64], edges[group + 1: group + 65]):
                    at = np.flatnonzero(np.diff(doc[a:e], prepend=-1))
                    seen = doc[a:e][at]
                    row = [int(bucket[a]), ids[seen].tobytes(), owns[seen].tobytes(),
                           np.diff(at, append=e - a).astype(np.int32).tobytes(), *[v[a:e].tobytes() for v in values]]
                    if data is not None:
                        row.append(STRETCHES.compress(data[ends[a]: ends[e]], asbytes=True))
                    for column, v in zip(rows, row):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names)
        self.docs, self.entries, self.size = [], [], 0


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _stretches(data: pa.ChunkedArray, lengths: pa.ChunkedArray, kind) -> np.ndarray:
    """The bytes of all stretches, which were packed row by row."""
    sizes = [int(np.frombuffer(x, kind).sum()) for x in lengths.to_pylist()]
    return np.frombuffer(b"".join([STRETCHES.decompress(x, n, asbytes=True) for x, n in zip(data.to_pylist(), sizes)]), np.uint8)


def deal(docs: DataFrame, send: Callable, combine: Callable, solve: Callable, n: int, kinds: list, ragged: bool = False,
         copies: bool = False) -> DataFrame:
    """id, own, answers (a list of binary) for every document with an answer.

    `send(slice, sender)` yields what `sender.add` yields; `combine` is for the
    sender; with `copies` a bucket gets texts under several ids. `solve(ids, owns, doc,
    values, data, bucket)` gets all entries of a bucket and gives (which entries
    answer, array of answers), or for its own order (doc of each answer, answers).
    """
    schema = "bucket int, ids binary, owns binary, counts binary" + "".join(f", v{i} binary" for i in range(len(kinds)))

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(n, combine)
        for s in tx.slices(batches, "text"):
            id_, own = ids(s)
            order = np.lexsort((id_, own))
            first = np.flatnonzero(np.diff(own[order], prepend=own[order[:1]] - 1))
            yield from send(s.take(pa.array(np.sort(order[first]))), sender)
        yield from sender.flush()

    def back(table: pa.Table) -> pa.Table:
        names = ["dest", "ids", "owns", "sizes", "answers"]
        if (bucket := table["bucket"][0].as_py()) < 0:  # answers already
            return pa.table([pa.array([-1 - bucket] * len(table), pa.int32()), *[table[c] for c in ("ids", "owns", "counts", "v0")]], names=names)
        counts = _joined(table["counts"], np.int32)
        ids, owns = _joined(table["ids"], np.int64), _joined(table["owns"], np.int64)
        doc = np.repeat(np.arange(len(ids)), counts)
        values = [_joined(table[f"v{i}"], k) for i, k in enumerate(kinds)]
        data = _stretches(table["data"], table[f"v{len(kinds) - 1}"], kinds[-1]) if ragged else None
        # Of the copies of a text, those of the smallest id stay.
        _, text = np.unique(owns, return_inverse=True)
        low = np.full(text.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, text, ids)
        if not copies and (ids != low[text]).any():
            kept = (ids == low[text])[doc]
            if ragged:
                data = data[np.repeat(kept, values[-1])]
            doc, values = doc[kept], [v[kept] for v in values]
        rows = packed(ids, owns, *solve(ids, owns, doc, values, data, bucket), n)
        return pa.table([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names=names)

    def merge(table: pa.Table) -> pa.Table:
        by: dict[tuple[int, int], list[bytes]] = {}
        for row in table.select(["ids", "owns", "sizes", "answers"]).to_pylist():
            sizes = np.frombuffer(row["sizes"], np.int64)
            width = len(row["answers"]) // int(sizes.sum())
            ends = np.cumsum(sizes) * width
            for i, o, a, e in zip(np.frombuffer(row["ids"], np.int64).tolist(), np.frombuffer(row["owns"], np.int64).tolist(),
                                  (ends - sizes * width).tolist(), ends.tolist()):
                by.setdefault((i, o), []).append(row["answers"][a:e])
        return pa.table([pa.array([i for i, _ in by], pa.int64()), pa.array([o for _, o in by], pa.int64()),
                         pa.array(list(by.values()), pa.list_(pa.binary()))], names=["id", "own", "answers"])

    sent = docs.mapInArrow(out, schema + ", data binary" * ragged)
    back_again = sent.groupBy("bucket").applyInArrow(back, "dest int, ids binary, owns binary, sizes binary, answers binary")
    return back_again.groupBy("dest").applyInArrow(merge, "id long, own long, answers array<binary>")


def answers(s: pa.RecordBatch, kind) -> tuple[np.ndarray, np.ndarray]:
    """All answers of a slice's documents, and the document of each."""
    lists = [b"".join(x) if x else b"" for x in s.column("answers").to_pylist()]
    size = np.array([len(x) for x in lists], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(lists), kind), np.repeat(np.arange(len(lists)), size)


def ids(s: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return s.column("id").to_numpy(), s.column("own").to_numpy()


def shared_places(key: np.ndarray, doc_of: np.ndarray, wanted: np.ndarray, wanted_doc: np.ndarray) -> np.ndarray:
    """Which (document, key) entries are among the wanted ones."""
    mix = lambda k, d: tx.mixed(k ^ (d.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return np.isin(mix(key, doc_of), mix(wanted, wanted_doc))


def marked(d: DataFrame, first: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """id, own, copy, answers: which rows are later copies of a text, and what was found in the others."""
    rows = d.filter(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "own", "own2")
    copies = (rows.join(first.withColumnRenamed("id", "original"), ["own", "own2"]).filter("id > original")
              .select("id", "own", F.lit(True).alias("copy"), F.lit(None).cast("array<binary>").alias("answers")))
    return written(copies.union(found.select("id", "own", F.lit(False).alias("copy"), "answers")), name)


def with_marks(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, row) -> DataFrame:
    d = docs.select(row, F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).withColumn("own", F.xxhash64("text"))
    return d.join(marks.dropDuplicates(["id", "own"]), ["id", "own"], "left").select("row", "text", "copy", "answers")
