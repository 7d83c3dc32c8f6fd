"""Exact dedup by sorting contents: equal texts become neighbours and are compared in full.

Expressions only. A row's sort key is the head of its normalised bytes, then
their SHA-256, then its id, in a fixed width. Splitters drawn from a sample of
keys, weighted by bytes, cut the order into parts of about `PART_BYTES`; one
shuffle brings a part together, Spark's external sort orders it, and every row
is compared with the row before it, over the whole text. The id in the key
lets splitters fall inside a group of copies, so a text that a third of all
rows hold is spread over as many parts as it needs. What is left of it is one
small row a part: the last text of a part is compared with the first of the
next, and the counts and smallest ids of runs that go on are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.tables import parts, written

# ASCII white space; a run of it is one blank.
WHITE = r"[\x20\x09-\x0D]+"
# Bytes of a key: head of the text, digest, id.
HEAD, DIGEST, ID = 64, 32, 8
WIDTH = HEAD + DIGEST + ID
PART_BYTES = 32_000_000
# Sampled keys a part, and what a row weighs besides its text.
PER_PART, ROW_BYTES = 40, 128


def _id_bytes(c: Column) -> Column:
    """Eight bytes that sort as the whole number does; NULL sorts last."""
    sortable = F.unhex(F.lpad(F.hex(c.bitwiseXOR(F.lit(-(2**63)))), 2 * ID, "0"))
    return F.coalesce(sortable, F.lit(bytearray(b"\xff" * ID)))


def _keyed(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """`row`, `_id`, `_norm` and `_key` (head and digest)."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(id_col).cast("bigint").alias("_id"),
                    F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE, " ").alias("_norm"))
    head = F.rpad(F.substring(F.col("_norm").cast("binary"), 1, HEAD), HEAD, F.lit(bytearray(b"\0")))
    return d.withColumn("_key", F.concat(head, F.unhex(F.sha2("_norm", 256))))


def _splitters(sample: DataFrame, share: float, weight: int, n: int) -> list[bytes]:
    """At most about n - 1 keys that cut the order into stretches of equal weight.

    `sample` holds a share of all rows, about `PER_PART` rows a part; only the
    keys cut at reach the driver.
    """
    s = sample.select(F.concat("_key", _id_bytes(F.col("_id"))).alias("cut"),
                      (F.octet_length("_norm").cast("bigint") + ROW_BYTES).alias("w"))
    upto = F.sum("w").over(Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, 0))
    step = F.lit(max(1.0, weight * share / n))
    s = s.select("cut", upto.alias("upto"), "w").filter(F.floor(F.col("upto") / step) > F.floor((F.col("upto") - F.col("w")) / step))
    return sorted({bytes(r.cut) for r in s.select("cut").collect()})


def _part(key: Column, cuts: list[bytes]) -> Column:
    """How many of the sorted cuts are at most `key`: a binary search in one literal."""
    if not cuts:
        return F.lit(0)
    table = F.lit(bytearray(b"".join(cuts)))

    def step(at: Column, by: Column) -> Column:
        to = at + by
        found = F.substring(table, (to - 1) * WIDTH + 1, F.lit(WIDTH))
        return F.when((to <= len(cuts)) & (found <= key), to).otherwise(at)

    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), step)


def _runs(d: DataFrame, n: int) -> DataFrame:
    """Rows sorted within their part, without their texts but at a part's two ends.

    `_run` numbers the runs of equal texts of a part, `_start` marks the first
    row of a run, `_n` and `_first` are the run's size and smallest id.
    """
    order = Window.partitionBy("_part").orderBy("_key", "_norm", F.col("_id").asc_nulls_last())
    same = F.coalesce(F.lag("_norm").over(order) == F.col("_norm"), F.lit(False))
    end = F.lag(F.lit(1)).over(order).isNull() | F.lead(F.lit(1)).over(order).isNull()
    d = d.repartition(n, "_part").select(
        "row", "_id", "_part", F.substring("_key", HEAD + 1, DIGEST).alias("_sha"), "_norm", "_key",
        (~same).alias("_start"), F.when(end, F.col("_norm")).alias("_edge"))
    d = d.withColumn("_run", F.sum(F.col("_start").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("_part", "_run")
    return d.drop("_norm", "_key").withColumns({"_n": F.count(F.lit(1)).over(run), "_first": F.min("_id").over(run)})


def _chains(rows: DataFrame) -> DataFrame:
    """_part, _run, total, least, opens: the runs that go on over the ends of their parts.

    Neighbouring parts meet in a join, so no task holds more than two texts of
    an end; the running sums see at most two small rows a part.
    """
    def at(f, c):
        return f(c, F.col("_run"))

    ends = rows.filter(F.col("_edge").isNotNull()).groupBy("_part").agg(
        F.min("_run").alias("lo"), F.max("_run").alias("hi"), at(F.min_by, "_edge").alias("head"),
        at(F.max_by, "_edge").alias("tail"), at(F.min_by, "_n").alias("n_lo"), at(F.max_by, "_n").alias("n_hi"),
        at(F.min_by, "_first").alias("first_lo"), at(F.max_by, "_first").alias("first_hi"))
    ends = written(ends, "sort-ends")
    place = ends.select("_part", F.row_number().over(Window.orderBy("_part")).alias("place"))
    ends = ends.join(place, "_part")
    before = ends.select((F.col("place") + 1).alias("place"), F.col("tail").alias("tail_before"))
    ends = ends.join(before, "place", "left").withColumn("goes_on", F.coalesce(F.col("head") == F.col("tail_before"), F.lit(False)))

    def entry(run, n, first, opens):
        return F.struct(F.col(run).alias("_run"), F.col(n).alias("n"), F.col(first).alias("first"), opens.alias("opens"))

    head, tail = entry("lo", "n_lo", "first_lo", ~F.col("goes_on")), entry("hi", "n_hi", "first_hi", F.lit(True))
    each = ends.select("_part", F.when(F.col("hi") > F.col("lo"), F.array(head, tail)).otherwise(F.array(head)).alias("e"))
    each = each.select("_part", F.inline("e"))
    chain = F.sum(F.col("opens").cast("int")).over(Window.orderBy("_part", "_run").rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy("chain")
    each = each.withColumn("chain", chain).withColumns({
        "total": F.sum("n").over(whole), "least": F.min("first").over(whole), "links": F.count(F.lit(1)).over(whole)})
    return written(each.filter("links > 1").select("_part", "_run", "total", "least", "opens"), "sort-chains")


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
                part_bytes: int = PART_BYTES) -> DataFrame:
    """`row` (the columns in `keep`, else all), `keep_id`, `group_size`, `kept`, `text_sha256`.

    Texts are equal when they are once each run of ASCII white space is one
    blank; NULL is the empty text. `keep_id` is the smallest id of the group
    and `kept` marks its row. Of rows that repeat an id and a text one is kept,
    any of them; a row without an id is kept only if no row of its group has
    one, and then one row is. Ids are whole numbers. Texts of any length are
    compared whole. An empty table gives no rows; other columns may have any
    names.
    """
    keep = docs.columns if keep is None else keep
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text_col)).cast("bigint"))).first()
    weight = (size or 0) + ROW_BYTES * rows
    n = parts(docs.sparkSession, weight, part_bytes)
    share = min(1.0, PER_PART * n / max(rows, 1))
    cuts = _splitters(_keyed(docs.sample(share, 7), id_col, text_col, keep), share, weight, n)
    d = _keyed(docs, id_col, text_col, keep)
    d = d.withColumn("_part", _part(F.concat("_key", _id_bytes(F.col("_id"))), cuts))
    sorted_rows = written(_runs(d, n), "sorted")
    d = sorted_rows.join(_chains(sorted_rows), ["_part", "_run"], "left")
    return d.select("row", F.coalesce("least", "_first").alias("keep_id"), F.coalesce("total", "_n").alias("group_size"),
                    (F.col("_start") & F.coalesce("opens", F.lit(True))).alias("kept"),
                    F.lower(F.hex("_sha")).alias("text_sha256"))


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return result.select(F.col("row")[id_col].alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


DIGEST_SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)"""
