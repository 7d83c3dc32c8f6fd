"""Codebooks for parts of vectors: Lloyd rounds over cover trees, in whole numbers.

Each block of vectors gets, once, a cover tree for every part position: a node
covers the points below it within its radius, children lie within half of it
and apart from each other. Points are stored in tree order, so a node is a
range of them and running sums give the sum of any node. In a round a node
whose points must all have the same nearest entry, by the triangle inequality,
is assigned whole; other nodes go down, and single points are compared exactly.
A task adds up its blocks and sends at most one sum for each entry and
position, so a round shuffles a few thousand small rows a task, whatever the
table; only codebooks, whose size is a parameter, pass through the driver.
Trees are a written table: a lost executor's blocks are read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.tables import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Vectors a tree; a block holds the distances of all its pairs for a moment.
BLOCK = 1024
# Whole numbers below this are exact in double precision.
EXACT = 1 << 53
# Bits of a digit of the sums that tasks send; 2**22 tasks fit a long.
LIMB = 40
TREE = T.StructType([T.StructField(n, T.BinaryType()) for n in (
    "points", "count", "at", "center", "start", "end", "radius", "first", "children")])


def squares(p: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of `p` and `c`, exact: in double precision
    where every term is below 2**53, in Python's whole numbers beyond."""
    if not len(p) or not len(c):
        return np.zeros((len(p), len(c)))
    most = max(abs(int(p.max())), abs(int(p.min())), abs(int(c.max())), abs(int(c.min())))
    kind = np.float64 if 4 * p.shape[1] * most * most < EXACT else object
    p, c = p.astype(kind), c.astype(kind)
    return (p * p).sum(1)[:, None] - 2 * p.dot(c.T) + (c * c).sum(1)[None, :]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one range after the other."""
    if not len(size):
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1])


def unique_rows(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, which of them each row is, and how often each occurs."""
    if points.dtype != object:
        return np.unique(points, axis=0, return_inverse=True, return_counts=True)
    known = {row: i for i, row in enumerate(sorted(set(map(tuple, points))))}
    which = np.array([known[tuple(row)] for row in points])
    return np.array(list(known), object), which, np.bincount(which)


class CoverTree:
    """A tree over the distinct rows of `points`, kept in tree order.

    `at` gives the place of each row given; node i covers places
    start[i]..end[i] within radius[i] of place center[i], and its children are
    first[i]..first[i] + children[i].
    """

    FIELDS = {"count": np.int64, "at": np.int32, "center": np.int32, "start": np.int32, "end": np.int32,
              "radius": np.float64, "first": np.int32, "children": np.int32}

    @classmethod
    def build(cls, points: np.ndarray) -> "CoverTree":
        t = cls()
        distinct, which, count = unique_rows(points)
        apart = np.sqrt(squares(distinct, distinct).astype(np.float64))
        order = np.arange(len(distinct))
        start, end, center, radius, first, children = [0], [len(distinct)], [0], [], [], []
        node = 0
        while node < len(start):
            a, b, c = start[node], end[node], center[node]
            members = order[a:b]
            radius.append(float(apart[c, members].max()))
            first.append(len(start))
            if radius[node] > 0:
                within, near = radius[node] / 2, apart[c, members] <= radius[node] / 2
                while True:
                    group, members = members[near], members[~near]
                    order[a: a + len(group)] = group
                    start.append(a)
                    end.append(a + len(group))
                    center.append(c)
                    a += len(group)
                    if not len(members):
                        break
                    c = members[0]
                    near = apart[c, members] <= within
            children.append(len(start) - first[node])
            node += 1
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        t.points, t.count, t.at = distinct[order], count[order], place[which.ravel()]
        t.center, t.start, t.end = place[np.array(center)], np.array(start, np.int32), np.array(end, np.int32)
        t.radius, t.first, t.children = np.array(radius), np.array(first, np.int32), np.array(children, np.int32)
        return t

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The nearest entry of each place (ties to the lower index), and sums
        and counts by entry; last, how many points were compared alone."""
        sums = np.concatenate([np.zeros((1, self.points.shape[1]), self.points.dtype),
                               np.cumsum(self.points * self.count[:, None], axis=0)])
        counts = np.concatenate([[0], np.cumsum(self.count)])
        owner = np.zeros(len(self.points), np.int64)
        total, members = np.zeros(book.shape, sums.dtype), np.zeros(len(book), np.int64)
        front, alone = np.zeros(1, np.int64), 0
        while len(front):
            d = squares(self.points[self.center[front]], book)
            best = np.argmin(d, axis=1).astype(np.int64)
            rows, radius = np.arange(len(front)), self.radius[front]
            nearest = np.sqrt(d[rows, best].astype(np.float64))
            d[rows, best] = np.inf
            second = np.sqrt(d.min(axis=1).astype(np.float64))
            # The margin covers rounding: a doubtful node only goes further down.
            done = (radius == 0) | ((nearest + 2 * radius) * (1 + 1e-12) + 1e-9 < second)
            alone += int((radius == 0).sum())
            whole, entry = front[done], best[done]
            a, b = self.start[whole], self.end[whole]
            owner[ranges(a.astype(np.int64), (b - a).astype(np.int64))] = np.repeat(entry, b - a)
            np.add.at(total, entry, sums[b] - sums[a])
            np.add.at(members, entry, counts[b] - counts[a])
            down = front[~done]
            front = ranges(self.first[down].astype(np.int64), self.children[down].astype(np.int64))
        return owner, total, members, alone

    def pack(self) -> dict[str, bytes]:
        wide = self.points.dtype == object or abs(self.points).max(initial=0) >= 1 << 31
        text = ",".join(map(str, self.points.ravel())).encode() if self.points.dtype == object else None
        points = text if text is not None else self.points.astype(np.int64 if wide else np.int32).tobytes()
        kind = b"o" if text is not None else b"q" if wide else b"i"
        return {"points": kind + points} | {n: np.asarray(getattr(self, n), k).tobytes() for n, k in self.FIELDS.items()}

    @classmethod
    def unpack(cls, packed: dict[str, bytes]) -> "CoverTree":
        t = cls()
        for n, k in cls.FIELDS.items():
            setattr(t, n, np.frombuffer(packed[n], k))
        kind, data = packed["points"][:1], packed["points"][1:]
        if kind == b"o":
            flat = np.array([int(x) for x in data.split(b",")], object)
        else:
            flat = np.frombuffer(data, np.int64 if kind == b"q" else np.int32).astype(np.int64)
        t.points = flat.reshape(len(t.count), -1)
        return t


def limbs(v: int) -> Iterator[tuple[int, int]]:
    """The digits of `v` to the base 2**LIMB with its sign: their sums are those of the numbers."""
    sign, v, k = (-1 if v < 0 else 1), abs(v), 0
    while v or not k:
        yield k, sign * (v & (1 << LIMB) - 1)
        v, k = v >> LIMB, k + 1


def whole_numbers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as int64 or, where sums could pass it, as Python's whole numbers."""
    v = np.floor(flat.astype(np.float64) * scale)
    if not len(v) or np.abs(v).max() < 1 << 40:
        return v.astype(np.int64)
    return np.array([int(x) for x in v], object)


def _trees(kept: DataFrame, parts: int, block: int, scale: int) -> DataFrame:
    """Blocks of vectors: `rows`, their columns, and `trees`, one tree a part position."""
    schema = T.StructType([T.StructField("rows", T.ArrayType(kept.schema["row"].dataType)),
                           T.StructField("trees", T.ArrayType(TREE))])
    kind = pa.list_(pa.struct([(f.name, pa.binary()) for f in TREE]))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                part = batch.slice(a, block)
                v = whole_numbers(part.column("vec").flatten().to_numpy(zero_copy_only=False), scale)
                v = v.reshape(part.num_rows, parts, -1)
                trees = [CoverTree.build(v[:, p]).pack() for p in range(parts)]
                rows = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("row"))
                yield pa.RecordBatch.from_arrays([rows, pa.array([trees], kind)], ["rows", "trees"])

    return kept.select("row", "vec").mapInArrow(blocks, schema)


def _forest(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[CoverTree]]]:
    for i in range(batch.num_rows):
        trees = batch.column("trees")[i].as_py()
        yield batch.column("rows")[i].values, [CoverTree.unpack(t) for t in trees]


def _round(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one round: means of the parts assigned, floored; unused entries stay."""
    schema = "part int, entry int, place int, limb int, total long"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), b.shape[1] + 1), object) for b in books]
        for batch in batches:
            for _, forest in _forest(batch):
                for p, tree in enumerate(forest):
                    _, s, n, _ = tree.assign(books[p])
                    total[p] += np.column_stack([n, s]).astype(object)
        rows = [(p, e, i, k, x) for p, t in enumerate(total) for e in np.flatnonzero(t[:, 0] > 0)
                for i, v in enumerate(t[e]) for k, x in limbs(int(v))]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32()] * 4 + [pa.int64()])]
        if rows:
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "place", "limb", "total"])

    found = trees.mapInArrow(sums, schema).groupBy("part", "entry", "place", "limb").agg(F.sum("total").alias("total"))
    sums_of = [np.zeros((len(b), b.shape[1] + 1), object) for b in books]
    for r in found.collect():  # bounded: entries times positions
        sums_of[r.part][r.entry, r.place] += r.total << LIMB * r.limb
    out = []
    for b, s in zip(books, sums_of):
        new = b.astype(object)
        used = np.flatnonzero(s[:, 0] > 0)
        new[used] = s[used, 1:] // s[used, :1]
        out.append(new if max((abs(x) for x in new.ravel()), default=0) >= 1 << 40 else new.astype(np.int64))
    return out


def _codes(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """row, code, error of every vector."""
    row = trees.schema["rows"].dataType.elementType
    schema = T.StructType([T.StructField("row", row), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, forest in _forest(batch):
                digits, error = [], 0
                for p, tree in enumerate(forest):
                    owner = tree.assign(books[p])[0]
                    off = tree.points - books[p][owner]
                    off = off.astype(np.int64 if abs(off).max(initial=0) < 1 << 24 else object)
                    digits.append(owner[tree.at])
                    error = error + (off * off).sum(axis=1)[tree.at]
                code = pa.array([bytes(c).hex() for c in np.stack(digits, 1).astype(np.uint8)])
                error = pa.array([e if e < 1 << 63 else None for e in map(int, error)], pa.int64())
                yield pa.RecordBatch.from_arrays([rows, code, error], ["row", "code", "error"])

    return trees.mapInArrow(coded, schema)


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             keep: list[str] | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, list[np.ndarray]]:
    """(`row`, `code`, `error`, `label_error`; codebooks as one array of entries a part position).

    `row` has the columns in `keep` (all but the vector where not given). Rows
    whose vector is NULL, empty or holds NULL or non-finite components are
    dropped; so are those whose length is not that of the vector of the
    smallest id, or not a multiple of `parts`. Codebooks start from the
    `entries` (at most 256) smallest ids, fewer where there are fewer; among
    rows that repeat an id the smaller vector comes first. Arithmetic is exact
    at any magnitude; an error beyond a long is NULL and left out of
    `label_error`, the error of all rows of a label, NULL labels together. An
    empty table gives no rows. Other columns may have any names.
    """
    keep = [c for c in vectors.columns if c != vector_col] if keep is None else keep
    finite = F.coalesce(F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    d = vectors.filter(finite & (F.size(vector_col) > 0)).select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(vector_col).cast("array<double>").alias("vec"),
        F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
    d = d.withColumn("row", F.struct(F.col("row").alias("row"), F.col("_label").alias("label")))
    first = d.filter(F.col("_id").isNotNull()).orderBy("_id", "vec").limit(1).select(F.size("vec")).first()
    dim = first[0] if first is not None and first[0] % parts == 0 else 0
    kept = d.filter((F.size("vec") == dim) & F.lit(dim > 0))
    start = kept.filter(F.col("_id").isNotNull()).orderBy("_id", "vec").limit(entries).select("vec").collect()
    flat = whole_numbers(np.array([x for r in start for x in r.vec]), scale).reshape(len(start), parts, -1 if start else 0)
    books = [flat[:, p] for p in range(parts)]
    trees = written(_trees(kept, parts, block, scale), "cover-trees")
    for _ in range(rounds):
        books = _round(trees, books)
    codes = written(_codes(trees, books).select("row.row", "row.label", "code", "error"), "codes")
    by_label = written(codes.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    same = codes["label"].eqNullSafe(by_label["label"])
    return codes.join(by_label, same, "left").select(codes["row"], "code", "error", "label_error"), books


def digest(result: DataFrame, books: list[np.ndarray], id_col: str = "vec_id") -> DataFrame:
    return result.select(F.col("row")[id_col].alias("vec_id"), "code", "error", "label_error",
                         F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Every round as a query of its own."""
    steps = ["""q AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS w
  FROM q, unnest(range(4)) AS u(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, w AS c FROM p
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 256)"""]
    for r in range(5):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, label, part, w, m % 256 AS e, m // 256 AS error FROM (
  SELECT p.vec_id, p.label, p.part, any_value(p.w) AS w, min(CAST(list_dot_product(w, w) - 2 * list_dot_product(w, c)
    + list_dot_product(c, c) AS BIGINT) * 256 + e) AS m FROM p JOIN b{r} USING (part) GROUP BY ALL))""")
        if r < 4:
            steps.append(f"""m{r} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i)::DOUBLE[] AS c FROM (
  SELECT part, e, i, sum(w[i]::BIGINT) AS s, count(*) AS n FROM a{r}, unnest(range(1, len(w) + 1)) AS u(i)
  GROUP BY part, e, i) GROUP BY part, e),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (part, e))""")
    steps.append("""v AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(error)::BIGINT AS error
  FROM a4 GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(c::BIGINT[], ','), ',' ORDER BY part, e)) AS h FROM b4)""")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM v, books"""


DIGEST_SQL = _sql()
