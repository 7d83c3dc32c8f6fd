"""Benchmark decontamination with suffix arrays over the training documents.

Documents never move: each task cuts its rows into shards, builds a word
suffix array of a shard and binary-searches every benchmark window in it, so
there is no shuffle and no key that could be hot. The benchmark travels to the
tasks. Its size is measured first; above `block_bytes` it goes in blocks, each
of which passes over the documents' words in turn and adds to what was found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm import text as tx
from tidemark.llm.suffix import search, suffix_order
from tidemark.llm.tables import map_texts, packed_row, text_bytes

BLOCK_BYTES = 8_000_000


def _windows(items: list[tuple[str, str | None]], size: int) -> tuple[list[bytes], np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Distinct words, windows as word codes, their lengths, item names, item of each window."""
    texts = tx.strings(pa.array([t for _, t in items], pa.string()))
    codes, starts, vocabulary = tx.words(texts, tx.LOWER_ALNUM)
    rows, lengths, owner = [], [], []
    for i in range(len(items)):
        w = codes[starts[i]: starts[i + 1]]
        k = min(size, len(w))
        for at in range(len(w) - k + 1 if k else 0):
            rows.append(np.pad(w[at: at + k], (0, size - k)))
            lengths.append(k)
            owner.append(i)
    table = np.array(rows, np.int64).reshape(-1, size)
    return vocabulary, table, np.array(lengths, np.int64), [n for n, _ in items], np.array(owner, np.int64)


def _shard(texts: pa.Array, bench, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts of the documents, which words are hit, and the pairs (document, item) found."""
    vocabulary, table, lengths, _, owner = bench
    codes, starts, own = tx.words(texts, tx.LOWER_ALNUM)
    place = {w: i for i, w in enumerate(own)}
    to_own = np.array([place.get(w, -1) for w in vocabulary], np.int64)
    none = np.zeros(0, np.int64)
    if not len(codes) or not len(table):
        return starts, np.zeros(len(codes), bool), none, none
    patterns = to_own[table]
    known = ((patterns >= 0) | (np.arange(size) >= lengths[:, None])).all(1)
    patterns, lengths, owner = patterns[known] + 2, lengths[known], owner[known]
    # One text of all documents: 1 after each of them, words from 2 on.
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    joined = np.ones(len(codes) + len(starts) - 1, np.int64)
    joined[np.arange(len(codes)) + doc] = codes.astype(np.int64) + 2
    order = suffix_order(joined, size)
    low, high = search(joined, order, patterns, lengths)
    count = high - low
    which = np.repeat(np.arange(len(low)), count)
    at = order[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]]
    hit = tx.covered(at, lengths[which], len(joined))
    ends = starts[1:] + np.arange(len(starts) - 1)  # of each document in the joined text
    where = np.searchsorted(ends, at)
    pairs = np.unique(where * np.int64(len(owner) + 1 + owner.max(initial=0)) + owner[which]) if len(at) else none
    base = np.int64(len(owner) + 1 + owner.max(initial=0))
    return starts, hit[np.arange(len(codes)) + doc], pairs // base, pairs % base


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                   item_text: str = "text", size: int = 13, keep: list[str] | None = None,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`row` (the columns given, or those in `keep`), `n_words`, `n_hit`, `items` (names of the
    items found, sorted as strings), `hits` (start and end word of each hit run).

    A word is a run of ASCII letters, digits and non-ASCII characters, A-Z in
    lower case. A document word in any occurrence of a window of `size`
    consecutive words of an item is hit; an item with fewer words is one
    window. NULL or empty texts have no words; items without words or name
    are never found; repeated items and rows change nothing. No rows give no rows.
    """
    items = benchmark.filter(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).distinct()
    blocks = max(1, -(-text_bytes(items, "text") // block_bytes))
    # Counts of one pass are given on to the next.
    found = T.StructType([T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hits", T.ArrayType(T.LongType())),
                          T.StructField("n_words", T.LongType())])
    d = docs.select(packed_row(docs.select(*keep) if keep else docs), F.col(text_col).alias("text"))
    row, text = d.schema.fields
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow()
        bench = _windows(list(zip(part["item"].to_pylist(), part["text"].to_pylist())), size)

        def run(batches: Iterator[pa.RecordBatch], bench=bench, last=b == blocks - 1) -> Iterator[pa.RecordBatch]:
            for s in tx.slices(batches, "text"):
                starts, hit, doc, item = _shard(tx.strings(s.column("text")), bench, size)
                before = s.column("found").to_pylist() if "found" in s.schema.names else [None] * s.num_rows
                bounds = np.searchsorted(doc, np.arange(s.num_rows + 1))
                out = []
                for i, old in enumerate(before):
                    names = {bench[3][j] for j in item[bounds[i]: bounds[i + 1]]}
                    mask = hit[starts[i]: starts[i + 1]]
                    if old:
                        names |= set(old["items"])
                        for a, e in zip(old["hits"][::2], old["hits"][1::2]):
                            mask[a:e] = True
                    runs = np.column_stack(tx.spans(mask)).ravel().tolist() if names else []
                    out.append({"items": sorted(names), "hits": runs, "n_words": len(mask)})
                kind = pa.struct([("items", pa.list_(pa.string())), ("hits", pa.list_(pa.int64())), ("n_words", pa.int64())])
                columns = {"row": s.column("row"), "found": pa.array(out, kind)} | ({} if last else {"text": s.column("text")})
                yield pa.RecordBatch.from_pydict(columns)

        d = map_texts(d, run, T.StructType([row, T.StructField("found", found), *([] if b == blocks - 1 else [text])]))
    lost = F.aggregate("found.hits", F.lit(0).cast("bigint"), lambda a, x: x - a)  # ends less starts, in order
    return d.select("row", "found.n_words", lost.alias("n_hit"), "found.items", "found.hits")


def contaminated(share: int = 20) -> F.Column:
    """Hit words make up at least one in `share`."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def digest(result: DataFrame) -> DataFrame:
    return result.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


DIGEST_SQL = r"""
WITH w(kind, id, ws) AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)),
bw AS (
  SELECT DISTINCT id AS item, k, list_aggregate(ws[i : i + k - 1], 'string_agg', ' ') AS win
  FROM (SELECT id, ws, least(13, len(ws)) AS k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i
        FROM w WHERE kind = 'b' AND len(ws) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT id, k, i, list_aggregate(ws[i : i + k - 1], 'string_agg', ' ') AS win
  FROM (SELECT id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, sizes WHERE kind = 'd' AND len(ws) >= k)),
hits AS (SELECT dw.id, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
places AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT id, i, k FROM hits)) GROUP BY id),
found AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM hits) GROUP BY id)
SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN places ON places.id = w.id LEFT JOIN found ON found.id = w.id
WHERE kind = 'd'"""
