"""Content sort, cover-tree codebooks and the prefix trie against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm import data
from tidemark.llm import contentsort, covertree, prefixtrie


# content sort

def plain_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return groups


@pytest.mark.parametrize("part_bytes", [300, 10_000_000])
def test_exact_dedup_is_the_plain_grouping(spark, part_bytes):
    rows = data.texts() + [(1000 + k, "the same text\tin \n many rows") for k in range(40)]
    rows += [(2000 + k, "x" * 70 + str(k % 3)) for k in range(9)] + [(-5, "the same text in many rows"), (None, "ümläut"), (None, "ümläut")]
    found = contentsort.dedup_exact(data.frame(spark, rows), part_bytes=part_bytes).select(
        "row.doc_id", "keep_id", "group_size", "kept", "text_sha256", "row.text").collect()
    groups = plain_groups(rows)
    assert len(found) == len(rows)
    kept = defaultdict(int)
    for r in found:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        ids = [i for i in groups[norm] if i is not None]
        assert (r.keep_id, r.group_size, r.text_sha256) == (min(ids, default=None), len(groups[norm]), data.sha(norm))
        if r.kept:
            kept[norm] += 1
            assert r.doc_id == r.keep_id
    assert dict(kept) == {norm: 1 for norm in groups}


def test_exact_dedup_of_nothing_and_of_copies_only(spark):
    assert contentsort.dedup_exact(data.frame(spark, [])).count() == 0
    rows = [(k, "one text") for k in range(200)]
    found = contentsort.dedup_exact(data.frame(spark, rows), part_bytes=1_000).select("row.doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(found) == [(k, 0, 200, k == 0) for k in range(200)]


def test_exact_dedup_splits_copies_and_runs_no_python(spark, monkeypatch):
    seen = []
    own = contentsort.written
    monkeypatch.setattr(contentsort, "written", lambda d, name: seen.append(own(d, name)) or seen[-1])
    contentsort.dedup_exact(data.frame(spark, [(k, "one text of some length") for k in range(300)]), part_bytes=2_000)
    assert seen[0].select("_part").distinct().count() > 10
    plan = seen[0]._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_very_long_texts_are_compared_whole(spark):
    long = "word " * 400_000
    rows = [(3, long + "end"), (1, long + "End"), (2, long.replace(" ", "\n") + "end")]
    found = contentsort.dedup_exact(data.frame(spark, rows)).select("row.doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(found) == [(1, 1, 1, True), (2, 2, 2, True), (3, 2, 2, False)]


# codebooks

SCHEMA = "vec_id long, embedding array<float>, label int, row string, code int"


def vectors(n=700, seed=5):
    r = np.random.default_rng(seed)
    base = r.normal(0, 0.2, (n, 16)).astype(np.float32)
    base[n // 2:] = base[: n - n // 2] + r.normal(0, 0.002, (n - n // 2, 16)).astype(np.float32)
    base[-40:] = base[3]
    rows = [(int(k) * 2, [float(x) for x in v], None if k % 7 == 0 else int(k % 4), "r", 1) for k, v in enumerate(base)]
    bad = [(9001, None, 1, "r", 1), (9003, [None] * 16, 1, "r", 1), (9005, [math.nan] + [0.0] * 15, None, "r", 1),
           (9007, [math.inf] + [0.0] * 15, 2, "r", 1), (9009, [0.5] * 8, 2, "r", 1), (9011, [], 2, "r", 1)]
    return rows + bad + [rows[10]]


def plain_codes(rows, entries=256, rounds=4):
    kept = sorted((i, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for i, v, lab, *_ in rows
                  if v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v))
    parts = [np.array([v[4 * p: 4 * p + 4] for _, v, _ in kept], np.int64) for p in range(4)]
    books, codes, errors = [p[:entries].copy() for p in parts], [], 0

    def nearest(x, b):
        d = ((x[:, None, :] - b[None, :, :]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for p in range(4):
        for _ in range(rounds):
            a, _ = nearest(parts[p], books[p])
            for e in range(len(books[p])):
                if (a == e).any():
                    books[p][e] = parts[p][a == e].sum(0) // (a == e).sum()
        a, d = nearest(parts[p], books[p])
        codes.append(a)
        errors = errors + d
    out = {}
    label = defaultdict(int)
    for k, (_, _, lab) in enumerate(kept):
        label[lab] += int(errors[k])
    for k, (i, _, lab) in enumerate(kept):
        out.setdefault(i, []).append(("".join(f"{c[k]:02x}" for c in codes), int(errors[k]), label[lab]))
    return out, covertree.books_sha256(books)


@pytest.mark.parametrize("block,entries", [(64, 256), (1024, 20)])
def test_codes_are_those_of_plain_lloyd_rounds(spark, block, entries):
    rows = vectors()
    found, books = covertree.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block, entries=entries)
    want, sha = plain_codes(rows, entries)
    got = defaultdict(list)
    for r in found.select("row.vec_id", "code", "error", "label_error").collect():
        got[r.vec_id].append((r.code, r.error, r.label_error))
    assert dict(got) == want and covertree.books_sha256(books) == sha
    assert set(found.select("row.*").columns) == {"vec_id", "label", "row", "code"}


def test_codes_of_nothing_of_one_and_of_huge_components(spark):
    found, books = covertree.compress(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and all(len(b) == 0 for b in books)
    found, _ = covertree.compress(spark.createDataFrame([(1, [0.5] * 8, None, "r", 1)], SCHEMA))
    assert [tuple(r)[1:] for r in found.collect()] == [("00000000", 0, 0)]
    rows = [(k, [3e38 * (k % 2), 1.0, 2.0, float(k)], 1, "r", 1) for k in range(5)]
    found, _ = covertree.compress(spark.createDataFrame(rows, SCHEMA), entries=2)
    assert sorted(r.code for r in found.collect()) == ["00000000", "00000001", "00000001", "01000000", "01000001"]


def test_cover_tree_invariants_and_whole_subtrees():
    r = np.random.default_rng(1)
    points = np.repeat(r.integers(-400, 400, (30, 6)), 20, axis=0) + r.integers(-2, 3, (600, 6))
    t = covertree.CoverTree.build(points)
    assert (t.points[t.at] == points).all() and t.count.sum() == 600
    for k in range(len(t.start)):
        here = t.points[t.start[k]: t.end[k]]
        assert t.start[k] <= t.center[k] < t.end[k]
        assert np.sqrt(((here - t.points[t.center[k]]) ** 2).sum(1)).max() <= t.radius[k] + 1e-9
        if t.radius[k]:
            kids = range(t.first[k], t.first[k] + t.children[k])
            assert t.start[kids[0]] == t.start[k] and t.end[kids[-1]] == t.end[k]
            assert all(t.radius[c] <= t.radius[k] / 2 for c in kids)
    owner, total, n, alone = t.assign(points[:600:20])
    d = ((t.points[:, None] - points[None, :600:20]) ** 2).sum(2)
    assert (owner == d.argmin(1)).all() and alone < len(t.points) / 4
    again = covertree.CoverTree.unpack(t.pack())
    assert (again.points == t.points).all() and (again.end == t.end).all()


# trie

TURNS = "conv_id long, turn long, role string, text string, depth string, p1 int"


def conversations(seed=4):
    r = random.Random(seed)
    say = ["hello", "", None, "a longer turn of text", "ümläut", "x" * 5000]
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 260), 777]:
        for t in range(r.choice([1, 2, 3, 6, 9])):
            rows.append((c, t if t or r.random() < 0.8 else None, r.choice(["user", "assistant", None]),
                         "hello" if t == 0 and c % 3 else r.choice(say), "d", 1))
    return rows + [(None, 1, "user", "lost", "d", 1), rows[5], rows[40]]


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        w = (len(m) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += w
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def untied(rows):
    """Repeated (conversation, turn) pairs in the data are whole repeated rows only."""
    seen, out = {}, []
    for r in rows:
        if seen.setdefault(r[:2], r) == r:
            out.append(r)
    return out


@pytest.mark.parametrize("sizes", [{}, {"hot": 3, "slab": 2, "shard": 20}, {"hot": 1000, "slab": 3}])
def test_trie_is_the_plain_trie(spark, sizes):
    rows = untied(conversations())
    found = prefixtrie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(4), **sizes)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_trie(rows)


def test_trie_of_nothing_and_of_a_hot_conversation(spark):
    assert prefixtrie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    rows = [(c, t, "user", f"turn {t}", "d", 1) for c in range(300) for t in range(8)]
    found = prefixtrie.prefix_trie(spark.createDataFrame(rows, TURNS), hot=2, shard=10)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_trie(rows)


def test_ids_of_a_node_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE", 16)
    rows = [(c, 0, "user", "same", "d", 1) for c in range(7, 120)]
    found = prefixtrie.prefix_trie(spark.createDataFrame(rows, TURNS))
    assert sorted(map(tuple, found.collect()), key=repr) == plain_trie(rows)


def test_slot_table_is_minimal_perfect_and_verified():
    r = np.random.default_rng(2)
    k1, k2 = r.integers(-(1 << 62), 1 << 62, (2, 20_000))
    k1[:10], k2[:10] = 7, np.arange(10)
    t = prefixtrie.SlotTable(k1, k2)
    assert (np.sort(t.slot) == np.arange(20_000)).all()
    assert (t.find(k1, k2) == t.slot).all() and (t.find(k1 + 1, k2) == -1).all()
    assert len(prefixtrie.SlotTable(k1[:0], k2[:0]).find(k1, k2)) == 20_000
    with pytest.raises(ValueError):
        prefixtrie.SlotTable(np.array([1, 1]), np.array([2, 2]))
