"""Exact substring dedup with fixed-block anchors.

Every document is cut into non-overlapping blocks of `size / 2` words; these
are the index. Every rolling window of as many words probes it. Of two equal
passages of `size` words, one contains a whole block of its document wherever
it starts, and the other probes it, so both learn of a hit. Hits are then
extended: the windows of `size` words around a hit are compared by their own
hash, and each but the first occurrence is repeated; runs of such windows are
the maximal exact repeats. Occurrences that share a block meet as sorted keys,
never as pairs, so a passage that a third of all documents hold costs as much
as any other.

Later copies of a whole text are found by its hash before anything is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm import exchange as ex, text as tx
from tidemark.llm.tables import packed_row, written

LOW = np.uint64(0xFFFFFFFE)


def _words(s: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and place in it of each word, and where documents start."""
    codes, starts, vocabulary = tx.words(tx.strings(s.column("text")))
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return tx.word_hashes(vocabulary)[codes], doc, np.arange(len(codes)) - starts[doc], starts


def _probes(h: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every rolling window inside one document."""
    w = tx.windows(h, block)
    ok = np.flatnonzero(tx.inside(starts, block, len(h)))
    return w[ok], ok


def _combine_probes(ids, owns, doc, bucket, values, raw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probes that meet each other here are hits; of their blocks, the first two are sent."""
    sent = ex.first_copies(ids, owns)[doc]
    entry = np.flatnonzero(sent)
    key = bucket[entry].astype(np.uint64) << np.uint64(32) | (values[0][entry] & np.uint32(LOW)).astype(np.uint64)
    at, edge = ex.repeated(key, owns[doc[entry]], ids[doc[entry]])
    if not len(at):
        return sent, doc[:0], key[:0]
    block = (values[0][entry[at]] & 1).astype(np.int64)
    before = np.cumsum(block) - block
    before -= np.repeat(before[edge], np.diff(np.append(edge, len(at))))
    sent[entry[at[(block == 0) | (before > 1)]]] = False
    at = at[np.argsort(doc[entry[at]], kind="stable")]
    return sent, doc[entry[at]], key[at]


def _combine_windows(ids, owns, doc, bucket, values, raw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal windows the first is sent; the others are repeated."""
    h1, h2, at = values
    sent = np.ones(len(doc), bool)
    key = h1 ^ tx.mixed(h2.astype(np.uint64))
    e, _ = ex.repeated(key)
    e = e[np.lexsort((at[e], ids[doc[e]], h2[e], h1[e]))]
    if not len(e):
        return sent, doc[:0], at[:0]
    new = np.ones(len(e), bool)
    new[1:] = (h1[e[1:]] != h1[e[:-1]]) | (h2[e[1:]] != h2[e[:-1]])
    first = e[np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))]
    later = e[(ids[doc[e]] != ids[doc[first]]) | (at[e] != at[first])]
    sent[later] = False
    later = later[np.argsort(doc[later], kind="stable")]
    return sent, doc[later], at[later]


def _hits(ids, owns, doc, values, data, bucket) -> tuple[np.ndarray, np.ndarray]:
    """Probes that meet a block at another place."""
    key = values[0] & np.uint32(LOW)
    index, count = np.unique(key[(values[0] & 1).astype(bool)], return_counts=True)
    if not len(index):
        return doc[:0], key[:0].astype(np.uint64)
    at = np.minimum(np.searchsorted(index, key), len(index) - 1)
    others = np.where(index[at] == key, count[at], 0) - (values[0] & 1)
    hit = others > 0
    return doc[hit], key[hit].astype(np.uint64) | np.uint64(bucket << 32)


def _repeats(ids, owns, doc, values, data, bucket) -> tuple[np.ndarray, np.ndarray]:
    """Windows that occur at an earlier place: a smaller id, or the same and an earlier start."""
    h1, h2, at = values
    order = np.lexsort((at, ids[doc], h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = np.zeros(len(order), bool)
    later[order] = (ids[doc[order]] != ids[doc[first]]) | (at[order] != at[first])
    return doc[later], at[later]


def find_repeats(d: DataFrame, first: DataFrame, size: int) -> DataFrame:
    """id, own, answers (starts of the repeated windows)."""
    block, n = size // 2, ex.buckets(d)
    texts = d.filter(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "own", "text")

    def probe(s: pa.RecordBatch, sender: ex.Sender) -> Iterator[pa.RecordBatch]:
        h, doc, place, starts = _words(s)
        w, at = _probes(h, starts, block)
        aligned = (place[at] % block == 0).astype(np.uint64)
        yield from sender.add(*ex.ids(s), doc[at], w, ((w >> np.uint64(32)) & LOW | aligned).astype(np.uint32))

    hits = ex.deal(texts, probe, _combine_probes, _hits, n, [np.uint32])

    found = written(hits.join(first.select("id", "own"), ["id", "own"], "left_semi"), "hits")

    def extend(s: pa.RecordBatch, sender: ex.Sender) -> Iterator[pa.RecordBatch]:
        h, doc, place, starts = _words(s)
        w, at = _probes(h, starts, block)
        key = (w >> np.uint64(32)) & LOW | (w % np.uint64(n)) << np.uint64(32)
        hit = np.zeros(len(h) + 1, np.int64)
        hit[at[ex.shared_places(key, doc[at], *ex.answers(s, np.uint64))]] = 1
        total = np.concatenate([[0], np.cumsum(hit)])
        begin = np.flatnonzero(tx.inside(starts, size, len(h)))
        begin = begin[total[begin + size - block + 1] > total[begin]]
        h1, h2 = tx.windows(h, size), tx.windows(h, size, 0xC2B2AE3D27D4EB4F)
        if len(begin):
            yield from sender.add(*ex.ids(s), doc[begin], h1[begin], h1[begin], (h2[begin] >> np.uint64(32)).astype(np.uint32),
                                  place[begin].astype(np.int32))

    return ex.deal(texts.join(found, ["id", "own"]), extend, _combine_windows, _repeats, n, [np.uint64, np.uint32, np.int32])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20,
                     keep: list[str] | None = None) -> DataFrame:
    """`row` (the columns given, or those in `keep`), `kept_text`, `n_words`, `n_removed`, `removed`.

    Words are runs without ASCII white space. A word goes if it lies in a window
    of `size` (even) words whose sequence also starts earlier: in a document of
    a smaller id, or earlier in the same. `kept_text` joins the other words by a
    blank; `removed` has start and end word of each removed run. NULL and empty
    texts have no words. Rows that repeat an id and text are one document;
    a row without an id is kept whole and counts for no other. No rows give none.
    """
    d = ex.named(docs, id_col, text_col)
    first = written(ex.originals(d), "originals")
    marks = ex.marked(d, first, find_repeats(d, first, size), "marks")
    row = packed_row(docs.select(*keep) if keep else docs)
    joined = ex.with_marks(docs, marks, id_col, text_col, row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in tx.slices(batches, "text"):
            texts = tx.strings(s.column("text"))
            codes, starts, vocabulary = tx.words(texts)
            count = np.diff(starts)
            copy = np.array([bool(x) for x in s.column("copy").to_pylist()]) & (count >= size)
            at, of = ex.answers(s, np.int32)
            gone = tx.covered(starts[of] + at, np.full(len(at), size), len(codes)) | np.repeat(copy, count)
            kept, removed = [], []
            names = [w.decode() for w in vocabulary]
            for a, e in zip(starts[:-1], starts[1:]):
                kept.append(" ".join([names[c] for c in codes[a:e][~gone[a:e]].tolist()]))
                removed.append(np.column_stack(tx.spans(gone[a:e])).ravel().tolist() if gone[a:e].any() else [])
            lost = np.concatenate([[0], np.cumsum(gone)])
            yield pa.RecordBatch.from_arrays(
                [s.column("row"), pa.array(kept, pa.string()), pa.array(count), pa.array(lost[starts[1:]] - lost[starts[:-1]]),
                 pa.array(removed, pa.list_(pa.int64()))], ["row", "kept_text", "n_words", "n_removed", "removed"])

    kind = T.StructType([joined.schema["row"]])
    return joined.mapInArrow(run, kind.add("kept_text", "string").add("n_words", "long").add("n_removed", "long").add("removed", T.ArrayType(T.LongType())))


def digest(result: DataFrame) -> DataFrame:
    return result.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


DIGEST_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, i, list_aggregate(ws[i : i + 19], 'string_agg', ' ') AS seq
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
each AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w))
SELECT w.doc_id, CAST(len(any_value(ws)) AS BIGINT) AS n_words, count(*) FILTER (WHERE gone.p IS NOT NULL) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY each.p) FILTER (WHERE each.p IS NOT NULL AND gone.p IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN each ON each.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.p = each.p
GROUP BY w.doc_id"""
