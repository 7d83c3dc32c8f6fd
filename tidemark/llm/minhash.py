"""MinHash near-dedup by an inverted join over signature coordinates.

A document is posted under each (coordinate, value) pair of its signature; a
value joins the minima of four hash functions, so that common shingles alone
rarely make two documents collide. Documents with equal shingle sets are one
class with one posting list entry. Two classes are candidates when they collide
in at least `threshold` of the coordinates; candidates are confirmed on their
full shingle sets.

Groups of near copies share most postings, so their pairs are not written out.
Each posting list first proposes its leader to every member (one row per
posting); the leaders that win enough collisions are confirmed, and classes so
linked are one component. A posting list inside one component then says nothing
more, and a class with fewer than `threshold` postings left can have no further
link: both drop out. What is left is done in full. Classes that leaders tie
together, confirmed or not, are compared in blocks, giving links only; large
groups try a few more leaders before. Classes of different groups meet in the rarest
postings of each (any two with `threshold` collisions meet in these), skipping
the long lists, whose collisions are then counted on the signatures. So no link
is lost, but those whose collisions fall under the threshold by chance: for
similarity 0.8 (four minima agree with 0.41) and 3 of 40 coordinates three in
ten million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm import text as tx
from tidemark.llm.components import components
from tidemark.llm.tables import map_texts, written

COORDINATES, MINIMA, THRESHOLD = 40, 4, 3
# Classes in a block, shingles in a block, further leaders of a group larger than a block.
BLOCK, BLOCK_SHINGLES, LEADERS = 256, 1_000_000, 3
# Columns of shingles multiplied at a time.
COLUMNS = 8192


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(n).integers(1, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    codes, starts, vocabulary = tx.words(texts, tx.LOWER)
    h = tx.word_hashes(vocabulary)[codes]
    w = tx.windows(h, size)
    out = []
    for a, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if e - a >= size:
            out.append(np.unique(w[a: e - size + 1]))
        elif e > a:  # the whole sequence, apart from any longer one
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:e].tobytes(), e - a)], np.uint64))
        else:
            out.append(w[:0])
    return out


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """One 64-bit value for each coordinate."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(multipliers), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(h), 1024):
        np.minimum(low, (h[i: i + 1024, None] * multipliers).min(0), out=low)
    return tx.windows(low.astype(np.uint64) + np.uint64(1), MINIMA)[::MINIMA].view(np.int64)


def signatures(docs: DataFrame, size: int, coordinates: int) -> DataFrame:
    """doc_id, n_shingles, key (of the whole set), sig; `docs` has doc_id and text."""
    multipliers = _multipliers(coordinates * MINIMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in tx.slices(batches, "text"):
            sets = shingle_sets(tx.strings(s.column("text")), size)
            sig = [signature(h, multipliers) if len(h) else None for h in sets]
            key = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets]
            yield pa.RecordBatch.from_arrays(
                [s.column("doc_id"), pa.array([len(h) for h in sets], pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "key", "sig"])

    return map_texts(docs, run, f"{_id(docs)}, n_shingles long, key binary, sig array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """rep, shingles: the whole sets of the wanted classes (rep, key)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in tx.slices(batches, "text"):
            sets = shingle_sets(tx.strings(s.column("text")), size)
            own = [xxhash.xxh3_128_digest(h.tobytes()) == k for h, k in zip(sets, s.column("key").to_pylist())]
            rows = [h.view(np.int64) for h, ok in zip(sets, own) if ok]
            yield pa.RecordBatch.from_arrays([s.column("doc_id").filter(pa.array(own)), pa.array(rows, pa.list_(pa.int64()))], ["rep", "shingles"])

    texts = docs.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id").select("doc_id", "text", "key")
    return written(map_texts(texts, run, f"{_id(docs).replace('doc_id', 'rep')}, shingles array<long>"), "sets")


def _id(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


def _posted(classes: DataFrame, *more: str) -> DataFrame:
    return (classes.select("rep", *more, F.posexplode("sig").alias("k", "v"))
            .select("rep", *more, F.xxhash64("k", "v").alias("post")))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    d = (pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
         .join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    fits = 100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb"))
    close = d.filter(fits).filter(100 * both.cast("bigint") >= percent * union.cast("bigint"))
    return written(close.select("a", "b").distinct(), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80,
                    coordinates: int = COORDINATES, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per row given.

    Words are runs without ASCII white space, A-Z in lower case; a document's
    set holds its distinct `size`-word shingles, or the whole sequence if it is
    shorter. Documents link if `100 * |both| >= percent * |either|`. Without
    words or text the set is empty and links with nothing. Rows that repeat an
    id and text are one document; a NULL id gets no component and is kept. An
    empty table gives no rows; further columns are not read.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(signatures(d, size, coordinates), "signatures")
    own = signed.filter(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    named = own.groupBy("key").agg(F.min("doc_id").alias("rep"))
    classes = written(named.join(own.select("doc_id", "key", "n_shingles", "sig"), "key").filter("doc_id = rep")
                      .dropDuplicates(["rep", "key"]).select("rep", "key", "n_shingles", "sig"), "classes")
    # Only classes that share enough postings with others go on. Lists are
    # written before they are joined, so that Spark can split a hot one.
    posts = _posted(classes)
    lists = posts.groupBy("post").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).filter("lead < last")
    met = posts.join(written(lists.drop("last"), "lists"), "post").groupBy("rep", "lead").agg(F.count("*").alias("n"))
    wins = F.collect_list(F.when((F.col("n") >= threshold) & (F.col("lead") < F.col("rep")), F.col("lead")))
    found = met.groupBy("rep").agg(F.sum("n").alias("n"), wins.alias("leads")).filter(F.col("n") >= threshold)
    live = written(classes.join(found.select("rep", "leads"), "rep"), "live")
    # Classes that leaders tie together, confirmed or not, are one group.
    led = live.select(F.explode("leads").alias("a"), F.col("rep").alias("b"))
    groups = components(led).withColumnsRenamed({"node": "rep", "comp": "home"})
    live = live.join(groups, "rep", "left").withColumn("home", F.coalesce("home", "rep"))
    sets = full_sets(d, live.select("rep", "key"), size)
    edges = _confirmed(led, sets, percent)
    labels = components(edges)
    live = _open(live.select("rep", "n_shingles", "sig", "home"), labels, threshold)
    if not live.isEmpty():
        large = live.groupBy("home").count().filter(F.col("count") > block).select("home")
        if not large.isEmpty():
            edges = edges.union(_led(live.join(large, "home"), sets, percent))
            labels = components(edges)
            live = _open(live.drop("comp"), labels, threshold)
        edges = edges.union(_in_blocks(live, sets, percent, block)).union(_confirmed(_apart(live, threshold), sets, percent))
        labels = components(edges)
    names = (named.join(labels, named["rep"] == labels["node"], "left")
             .select("key", F.coalesce("comp", "rep").alias("component_id")))
    usable = F.when(F.col("doc_id").isNotNull(), F.col("key"))
    out = signed.select("doc_id", "n_shingles", usable.alias("key")).join(written(names, "names"), "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _open(live: DataFrame, labels: DataFrame, threshold: int) -> DataFrame:
    """Classes with enough postings that more than one component holds, and their component."""
    named = live.join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    posts = _posted(named, "comp")
    shared = posts.groupBy("post").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("post")
    enough = posts.join(written(shared, "lists"), "post").groupBy("rep").count().filter(F.col("count") >= threshold).select("rep")
    return written(named.join(enough, "rep"), "open")


def _led(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links to a few further leaders of each large group."""
    order = [F.xxhash64(F.lit(k), F.col("rep")) for k in range(LEADERS)]
    leaders = live.groupBy("home").agg(*[F.min_by(F.struct(F.col("rep").alias("lead"), F.col("comp").alias("lead_comp")), o).alias(f"l{k}")
                                         for k, o in enumerate(order)])
    each = written(leaders.select("home", F.explode(F.array_distinct(F.array(*[f"l{k}" for k in range(LEADERS)]))).alias("l")).select("home", "l.*"), "leaders")
    pairs = live.join(each, "home").filter("comp <> lead_comp")
    return _confirmed(pairs.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct(), sets, percent)


def links_between(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of the left link with which of the right, by exact counts."""
    values, of = np.concatenate([*left, *right]), np.repeat(np.arange(len(left) + len(right)), list(map(len, [*left, *right])))
    _, code = np.unique(values, return_inverse=True)
    sides = [np.bincount(code[s], minlength=code.max(initial=0) + 1) > 0 for s in (of < len(left), of >= len(left))]
    common = np.flatnonzero(sides[0] & sides[1])
    number = np.full(len(sides[0]), -1)
    number[common] = np.arange(len(common))
    column = number[code]
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    bounds = np.searchsorted(column[order], np.arange(0, len(common) + COLUMNS, COLUMNS))
    for k, (a, e) in enumerate(zip(bounds[:-1], bounds[1:])):
        at = order[a:e]
        x = np.zeros((len(left) + len(right), min(COLUMNS, len(common) - k * COLUMNS)), np.float32)
        x[of[at], column[at] - k * COLUMNS] = 1
        both += x[: len(left)] @ x[len(left):].T
    sizes = [np.array(list(map(len, s)), np.int64) for s in (left, right)]
    exact = both.astype(np.int64)
    return 100 * exact >= percent * (sizes[0][:, None] + sizes[1] - exact)


def _in_blocks(live: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between the components of every group, from pairs of blocks. Blocks
    hold one side each: the largest component of the group, and the rest."""
    count = live.groupBy("home", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    main = count.groupBy("home").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1")
    side = live.select("rep", "comp", "home", "n_shingles").join(written(main.drop("comps"), "groups"), "home").withColumn("in_main", F.col("comp") == F.col("main"))
    width = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    blocks = written(side.groupBy("home", "in_main").agg(width.alias("blocks"))
                     .select("home", "in_main", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt")), "blocks")
    a, b = (blocks.select("home", F.struct("in_main", "salt").alias(x)) for x in ("a", "b"))
    pairs = written(a.join(b, "home").filter("a <= b AND NOT (a.in_main AND b.in_main)"), "block-pairs")
    dealt = side.join(blocks.select("home", "in_main", "blocks").distinct(), ["home", "in_main"])
    dealt = dealt.select("home", "rep", "comp", F.struct("in_main", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("salt")).alias("mine"))
    sides = pairs.select("home", F.col("a").alias("mine"), "a", "b", F.lit(0).alias("side")).union(
        pairs.filter("a <> b").select("home", F.col("b").alias("mine"), "a", "b", F.lit(1).alias("side")))
    full = dealt.join(sides, ["home", "mine"]).withColumn("pair", F.xxhash64("home", "a", "b")).join(sets.dropDuplicates(["rep"]), "rep")

    def compare(table: pa.Table) -> pa.Table:
        rep, comp, side_ = (table[c].to_numpy() for c in ("rep", "comp", "side"))
        shingles = [v.values.to_numpy() for v in table["shingles"]]
        right = np.flatnonzero(side_ == 1) if (side_ == 1).any() else np.arange(len(rep))
        left = np.flatnonzero(side_ == 0)
        close = links_between([shingles[i] for i in left], [shingles[i] for i in right], percent)
        x, y = np.nonzero(close & (comp[left, None] != comp[right]))
        x, y = left[x], right[y]
        # Links between two components lead to the same component: one is enough.
        low, high = np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])
        _, one = np.unique(np.column_stack([low, high]), axis=0, return_index=True) if len(x) else (None, np.zeros(0, np.int64))
        return pa.table([pa.array(rep[x[one]]), pa.array(rep[y[one]])], names=["a", "b"])

    kind = live.schema["rep"].dataType.simpleString()
    links = full.select("pair", "rep", "comp", "side", "shingles").groupBy("pair").applyInArrow(compare, f"a {kind}, b {kind}")
    return written(links, "links")


def _apart(live: DataFrame, threshold: int) -> DataFrame:
    """Pairs of open classes of different groups with enough collisions, by their rarest postings."""
    posts = _posted(live, "comp", "home")
    lists = posts.groupBy("post").agg(F.count("*").alias("n"), F.min("home").alias("low"), F.max("home").alias("high")).filter("low < high")
    mine = posts.join(written(lists.select("post", "n"), "lists"), "post")
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("n", "post"))
    total = F.count("*").over(Window.partitionBy("rep"))
    prefix = (mine.select("rep", "comp", "home", "post", rank.alias("rank"), total.alias("total"))
              .filter(F.col("rank") <= F.col("total") - threshold + 1))
    other = prefix.select("post", F.col("rep").alias("b"), F.col("comp").alias("other"), F.col("home").alias("other_home"))
    pairs = (prefix.select("post", F.col("rep").alias("a"), "comp", "home").join(other, "post")
             .filter("a < b AND comp <> other AND home <> other_home").select("a", "b").distinct())
    sig = live.select("rep", "sig")
    both = (pairs.join(sig.withColumnsRenamed({"rep": "a", "sig": "sa"}), "a").join(sig.withColumnsRenamed({"rep": "b", "sig": "sb"}), "b"))
    hits = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return written(both.filter(hits >= threshold).select("a", "b"), "pairs")


DIGEST_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, x.b FROM reach r JOIN both_ways x ON x.a = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""
