"""Line dedup: a line that several documents hold stays in the first of them.

Lines are exploded, normalised and hashed; one aggregate counts the documents
of a hash through their smallest and largest id; the lines over the threshold
are dropped and the rest is put together by position. Only hashes and
positions are shuffled for the count; the text moves once, to meet the
positions its document loses. The aggregate combines before its shuffle, and a
line that all documents share meets one row in a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.tables import packed_row, written

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(c: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """`row` (the columns given), `kept_text`, `n_lines`, `n_dropped`.

    A line's key is the line without ASCII white space at its ends and with
    A-Z in lower case. A key of `min_chars` code points or more that at least
    two document ids hold loses all its lines outside the smallest of these
    ids. A NULL text is one empty line; a document without an id counts for no
    key and keeps its lines; rows that repeat an id are one document. An empty
    table gives no rows; the columns given may have any names.
    """
    lines = F.split(F.coalesce(F.col("_text"), F.lit("")), "\n", -1)
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    own = F.xxhash64("_text")
    each = (base.filter(F.col("_id").isNotNull() & F.col("_text").isNotNull())
            .select("_id", own.alias("_own"), F.posexplode(lines).alias("_at", "_line"))
            .select("_id", "_own", "_at", _lower(F.trim(F.col("_line"), F.lit(WHITE))).alias("_key"))
            .filter(F.char_length("_key") >= min_chars)
            .select("_id", "_own", "_at", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2")))
    shared = (each.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
              .filter("_first < _last").drop("_last"))
    shared = written(shared, "shared-lines")  # on its own, so that Spark can split the hot side of the join
    lost = (each.join(shared, ["_h1", "_h2"]).filter("_id > _first")
            .groupBy("_id", "_own").agg(F.collect_set("_at").alias("_lost")))
    all_docs = docs.select(packed_row(docs), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    d = all_docs.withColumn("_own", own).join(lost, ["_id", "_own"], "left").withColumn("_lines", lines)
    kept = F.when(F.col("_lost").isNull(), F.coalesce("_text", F.lit(""))).otherwise(F.concat_ws("\n", F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost")), lambda i: F.get("_lines", i))))
    return d.select("row", kept.alias("kept_text"), F.size("_lines").cast("bigint").alias("n_lines"),
                    F.coalesce(F.size("_lost"), F.lit(0)).cast("bigint").alias("n_dropped"))


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return result.select(F.col("row")[id_col].alias("doc_id"), "n_lines", "n_dropped",
                         F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


DIGEST_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, s.first IS NOT NULL AND k.doc_id > s.first AS lost FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
