"""A trie of conversation prefixes, in shards of flat arrays addressed by a minimal perfect hash.

Turns are reduced to digests and lengths before anything is shuffled. A node is
a distinct prefix, named by its depth and 128 bits: the exclusive or of a hash
of every turn with its place. One aggregate, combined before its shuffle,
enumerates the nodes with their members, and checks that all members of a node
agree on its last turn and on its parent, so two prefixes under one name are
found and not mixed.

Nodes with more than `hot` members form the crown; below it, all nodes under
one child of the crown form a group, and groups are dealt to shards by hash. A
shard gives each node a slot by a minimal perfect hash (levels of bit arrays,
ranks as slots), looks the parents' slots up and verifies them against the
stored names, scatters the counts and adds them to the parents in order of
depth. What a shard's tops hand to parents outside goes there as one sum a
parent. Deep conversations are cut into slabs of depth, taken from below, and
the crown of a slab comes after its shards.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.text import mixed
from tidemark.llm.tables import parts, written

# Conversations are rebuilt from the first of their block.
BLOCK, HEADS = 100, 6
# Nodes a shard, turns of depth a slab, least members of a hot node.
SHARD, SLAB, HOT = 200_000, 1 << 20, 256
# Ids of a piece of a list that is hashed in order.
PIECE = 1 << 16
NODE = "depth int, p1 long, p2 long"


def heads(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its block."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, idx (from 1), t1, t2 (the turn's digest), chars."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    both = F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)
    sha = F.sha2(both, 256)
    half = [F.conv(F.substring(sha, a, 16), 16, -10).cast("long") for a in (1, 17)]
    slim = rows.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), half[0].alias("t1"), half[1].alias("t2"),
        F.char_length(t).cast("bigint").alias("chars"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "t1", "t2")
    return slim.select("conv", F.row_number().over(order).alias("idx"), "t1", "t2", "chars")


def _rebuilt(turns: DataFrame) -> DataFrame:
    """Turns of rebuilt conversations and their roots (depth 0): conv, depth, t1, t2, chars, last."""
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).cast("int").alias("n"))
    own = written(own.withColumns({"base": F.col("conv") - F.col("conv") % BLOCK, "h": heads(F.col("conv"))}), "conversations")
    sizes = own.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    own = own.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    own = own.withColumn("size", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("n_base", "n")
    first = turns.filter(F.col("idx") < HEADS).withColumnRenamed("conv", "base")
    shared = own.join(first, "base").filter("idx <= taken").withColumn("depth", F.col("idx"))
    rest = turns.join(own, "conv").filter("idx > h").withColumn("depth", F.col("idx") - F.col("h") + F.col("taken"))
    zero = F.lit(0).cast("long")
    roots = own.withColumns({"depth": F.lit(0), "t1": zero, "t2": zero, "chars": zero})
    cols = ["conv", "depth", "t1", "t2", "chars", (F.col("depth") == F.col("size")).alias("last")]
    return shared.select(*cols).union(rest.select(*cols)).union(roots.select(*cols))


def _named(rebuilt: DataFrame) -> DataFrame:
    """The turns with the names of their prefixes: p1, p2, and q1, q2 of the parent."""
    upto = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    for k in ("1", "2"):
        e = F.when(F.col("depth") > 0, F.xxhash64(F.lit(int(k)), "depth", "t1", "t2")).otherwise(F.lit(0).cast("long"))
        rebuilt = rebuilt.withColumn("e" + k, e)
    d = rebuilt.withColumns({"p" + k: F.bit_xor("e" + k).over(upto) for k in ("1", "2")})
    return d.withColumns({"q" + k: F.col("p" + k).bitwiseXOR(F.col("e" + k)) for k in ("1", "2")}).drop("e1", "e2")


def _nodes(paths: DataFrame) -> DataFrame:
    """depth, p1, p2, conv_id, n_convs, q1, q2, chars: one row a distinct prefix."""
    own = ["q1", "q2", "t1", "t2", "chars"]
    agree = F.struct(*[F.min(c) for c in own]) == F.struct(*[F.max(c) for c in own])
    found = paths.groupBy("depth", "p1", "p2").agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), agree.alias("agree"),
        *[F.max(c).alias(c) for c in ("q1", "q2", "chars")])
    clash = F.raise_error(F.lit("two prefixes share a name of 128 bits")).cast("long")
    return found.withColumn("n_convs", F.when(F.col("agree"), F.col("n_convs")).otherwise(clash)).drop("agree")


def _dealt(nodes: DataFrame, paths: DataFrame, hot: int, n: int) -> DataFrame:
    """The nodes with their `shard`: -1 for the crown, else by the child of the crown they lie under.

    A node lies under the same child as its smallest member does, and a child
    of the crown has at most `hot` members, so no join here meets a hot key.
    """
    crown, name = F.col("n_convs") > hot, ["depth", "p1", "p2"]
    parents = nodes.filter(crown).select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    below = nodes.filter(~crown)
    tops = below.filter("depth > 0").join(parents, ["depth", "q1", "q2"], "left_semi").select(name)
    tops = tops.union(below.filter("depth = 0").select(name))
    group = paths.join(tops, name).select(F.col("conv").alias("conv_id"), F.pmod(F.xxhash64(*name), F.lit(n)).cast("int").alias("shard"))
    return below.join(group, "conv_id").select(*nodes.columns, "shard").union(nodes.filter(crown).withColumn("shard", F.lit(-1)))


class SlotTable:
    """A minimal perfect hash of distinct keys of two longs.

    On each level a key that shares its place with no other sets the place's
    bit; the rest go to the next level. A key's slot is the rank of its bit.
    The keys stored by slot verify every answer, so unknown keys are found out.
    """

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        at, base = np.arange(len(k1)), 0
        while len(at):
            place = self._place(k1[at], k2[at], len(self.levels), len(at))
            single = np.bincount(place, minlength=len(at)) == 1
            self.levels.append((single, base + np.cumsum(single) - 1, len(at)))
            base += int(single.sum())
            at = at[~single[place]]
            if len(self.levels) > 200:
                raise ValueError("keys of a slot table must be distinct")
        self.key1, self.key2 = np.zeros(len(k1), np.int64), np.zeros(len(k1), np.int64)
        slot = self._slots(k1, k2)
        self.key1[slot], self.key2[slot] = k1, k2
        self.slot = slot

    @staticmethod
    def _place(k1: np.ndarray, k2: np.ndarray, level: int, size: int) -> np.ndarray:
        h = k1.view(np.uint64) ^ mixed(k2.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return (mixed(h) % np.uint64(size)).astype(np.int64)

    def _slots(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        slot, left = np.full(len(k1), -1, np.int64), np.arange(len(k1))
        for level, (single, rank, size) in enumerate(self.levels):
            place = self._place(k1[left], k2[left], level, size)
            hit = single[place]
            slot[left[hit]] = rank[place[hit]]
            left = left[~hit]
        return slot

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not in the table."""
        slot = self._slots(k1, k2)
        if not len(self.key1):
            return slot
        return np.where((slot >= 0) & (self.key1[slot] == k1) & (self.key2[slot] == k2), slot, -1)


def _name2(p2: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The second half of a name with the depth mixed in: equal bits at two depths are two nodes."""
    return (p2.view(np.uint64) ^ mixed(depth.astype(np.int64).view(np.uint64))).view(np.int64)


def _accumulate(v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Children, leaves and saved tokens of a shard's nodes, in the order given;
    `top` marks nodes whose parent lies outside."""
    table = SlotTable(v["p1"], _name2(v["p2"], v["depth"]))
    parent = table.find(v["q1"], _name2(v["q2"], v["depth"] - 1))
    n, slot = len(table.slot), table.slot
    flat = {c: np.zeros(n, np.int64) for c in ("children", "leaves", "saved", "parent", "depth")}
    for c, values in (("children", v["children"]), ("leaves", v["leaves"]), ("parent", parent), ("depth", v["depth"]),
                      ("saved", v["saved"] + (v["n_convs"] - 1) * v["chars"])):
        flat[c][slot] = values
    inside = flat["parent"][flat["parent"] >= 0]
    flat["children"] += np.bincount(inside, minlength=n)
    flat["leaves"][flat["children"] == 0] = 1
    order = np.argsort(-flat["depth"], kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(flat["depth"][order])) + 1):
        level = level[flat["parent"][level] >= 0]
        for c in ("leaves", "saved"):
            np.add.at(flat[c], flat["parent"][level], flat[c][level])
    return {c: flat[c][slot] for c in ("children", "leaves", "saved")} | {"top": parent < 0}


SHARD_OUT = NODE + ", q1 long, q2 long, conv_id long, n_convs long, children long, leaves long, saved long, top boolean"


def _shards(nodes: DataFrame) -> DataFrame:
    """Nodes of the column `shard` with what their subtrees hold."""
    def one(table: pa.Table) -> pa.Table:
        v = {c: table.column(c).to_numpy() for c in ("depth", "p1", "p2", "q1", "q2", "n_convs", "chars", "children", "leaves", "saved")}
        found = _accumulate({c: np.ascontiguousarray(x).astype(np.int64) for c, x in v.items()})
        kept = table.select(["depth", "p1", "p2", "q1", "q2", "conv_id", "n_convs"])
        for c, x in found.items():
            kept = kept.append_column(c, pa.array(x))
        return kept

    return nodes.groupBy("shard").applyInArrow(one, SHARD_OUT)


def _handed(done: DataFrame) -> DataFrame:
    """What the tops of shards hand to each parent outside."""
    return done.filter("top and depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _ends(path_ends: DataFrame) -> DataFrame:
    """node name, ends_sha256: the hash of the conversations that end at it.

    Ids are joined in pieces of at most `PIECE` neighbouring ids, and a task
    hashes a node's pieces one after the other without holding them.
    """
    piece = F.floor(F.col("conv") / PIECE).alias("piece")
    pieces = path_ends.groupBy("depth", "p1", "p2", piece).agg(
        F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []

        def ready(rows):
            return pa.RecordBatch.from_pydict({
                "depth": pa.array([r[0] for r in rows], pa.int32()), "p1": pa.array([r[1] for r in rows], pa.int64()),
                "p2": pa.array([r[2] for r in rows], pa.int64()), "ends_sha256": pa.array([r[3] for r in rows], pa.string())})

        for batch in batches:
            names = zip(*(batch.column(c).to_pylist() for c in ("depth", "p1", "p2")))
            for name, ids in zip(names, batch.column("ids")):
                if name != now:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = name, hashlib.sha256(ids.as_py().encode())
                else:
                    sha.update(b"," + ids.as_py().encode())
            if len(out) >= 10_000:
                yield ready(out)
                out = []
        if now is not None:
            out.append((*now, sha.hexdigest()))
        yield ready(out)

    dealt = pieces.repartition("depth", "p1", "p2").sortWithinPartitions("depth", "p1", "p2", "piece")
    return dealt.select("depth", "p1", "p2", "ids").mapInArrow(hashed, NODE + ", ends_sha256 string")


def prefix_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                hot: int = HOT, shard: int = SHARD, slab: int = SLAB) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are rebuilt: the first `heads` turns are those of the first
    conversation of the block of 100, the rest their own. Turns are ordered
    with NULL first; turns that tie stand in an order fixed by their contents.
    Rows without a conversation are left out; NULL role or text is empty.
    Repeated rows are turns of their own. A very long text counts with all its
    code points and is never moved. An empty table gives no rows, not even a
    root. Other columns are not read. Ids are whole numbers. A conversation's
    turns meet in one sort (40 bytes a turn), its nodes in a shard a slab.
    """
    spark, name = rows.sparkSession, ["depth", "p1", "p2"]
    turns = written(_turns(rows, conv, turn, role, text), "turns")
    paths = written(_named(_rebuilt(turns)), "paths")
    nodes = written(_nodes(paths), "prefixes")
    convs, n_nodes, deepest = nodes.agg(F.max("n_convs"), F.count(F.lit(1)), F.max("depth")).first()
    # A child of the crown has at most `hot` members, and of one depth at most convs / hot nodes are hot.
    hot = max(hot, math.isqrt(convs or 0))
    nodes = written(_dealt(nodes, paths, hot, parts(spark, n_nodes, shard)), "dealt")
    none = spark.createDataFrame([], NODE + ", children long, leaves long, saved long")
    done, handed = [], none
    for low in reversed(range(0, (deepest or 0) + 1, slab)):
        part = nodes.filter(F.col("depth").between(low, low + slab - 1))
        for group, got in ((F.col("shard") >= 0, none), (F.col("shard") < 0, done)):
            if got is done and done:
                handed = handed.union(_handed(done[-1]))
            d = part.filter(group).join(handed, name, "left").na.fill(0, ["children", "leaves", "saved"])
            done.append(written(_shards(d), "trie"))
        handed = written(_handed(done[-2].union(done[-1])), "handed")
    every = done[0]
    for d in done[1:]:
        every = every.union(d)
    parent = every.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                          F.col("conv_id").alias("parent_conv_id"))
    out = every.join(parent, ["depth", "q1", "q2"], "left").join(_ends(paths.filter("last")), name, "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs",
                      F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


DIGEST_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
           lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))), 4294967295) % 6 AS h
  FROM (SELECT conv_id, list(turn ORDER BY i) AS turns FROM t GROUP BY conv_id)),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS p
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
n AS MATERIALIZED (
  SELECT d, p[1:d] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE d = len(p)), '')) AS ends_sha256
  FROM r, unnest(range(len(p) + 1)) AS u(d) GROUP BY d, prefix),
k AS (SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
m AS MATERIALIZED (
  SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(prefix[d].text) ELSE 0 END AS w
  FROM n LEFT JOIN k USING (d, prefix)),
s AS (
  SELECT a AS d, prefix[1:a] AS prefix, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(w) AS saved
  FROM m, unnest(range(d + 1)) AS u(a) GROUP BY a, prefix[1:a])
SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s USING (d, prefix) LEFT JOIN n q ON q.d = m.d - 1 AND q.prefix = m.prefix[1:m.d - 1]"""
